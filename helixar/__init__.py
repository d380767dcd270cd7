"""Helixar: assembly planning and sequence analytics as Spark DataFrames."""
