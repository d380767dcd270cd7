"""`python -m helixar.plans.cli --goals G --templates T [--fragments F] [--primers P] --out DIR`: plan assemblies of sequence files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from helixar.operators import cost
from helixar.plans.design import design
from helixar.sources import params as P
from helixar.sources import sequences as S

VERSION = "0.1"


def read(spark: SparkSession, glob: str, is_circular: bool):
    genbank = glob.endswith((".gb", ".gbk", ".genbank"))
    return S.read_genbank(spark, glob, is_circular, parts=True) if genbank else S.read_fasta(spark, glob, is_circular)


def run(spark: SparkSession, goals: str, templates: str, out: str, fragments: str | None = None, primers: str | None = None, params: str | None = None, n_paths: int = 3):
    """Write under out, and return the design: summary.csv; sequence_design.csv, the table of all reactions' molecules;
    sequences.gb, the molecules of every goal's best assembly; designs.json; and output.json, the sections of the whole document."""
    table = cost.span_cost_cached(spark, out, P.load(params))
    d = design(read(spark, goals, True), read(spark, templates, True), read(spark, fragments, False) if fragments else None, read(spark, primers, False) if primers else None, table, n_paths=n_paths)
    nested = ("array", "map", "struct")
    flat = lambda df: df.select(*[(F.to_json(c) if kind.startswith(nested) else F.col(c).cast("string")).alias(c) for c, kind in df.dtypes])
    table = d.reaction_table().persist()
    flat(d.summary()).write.mode("overwrite").option("header", True).option("escape", "\"").csv(f"{out}/summary.csv")
    flat(table).write.mode("overwrite").option("header", True).option("escape", "\"").csv(f"{out}/sequence_design.csv")
    S.write_genbank(d.records(rank=0), f"{out}/sequences.gb", mode="overwrite")
    d.document().lines().select("json").write.mode("overwrite").text(f"{out}/output.json")
    table.unpersist()
    d.json().select("json").write.mode("overwrite").text(f"{out}/designs.json")
    return d


def main() -> None:
    a = argparse.ArgumentParser()
    for name in ("goals", "templates", "out"):
        a.add_argument(f"--{name}", required=True)
    for name in ("fragments", "primers", "params"):
        a.add_argument(f"--{name}")
    a.add_argument("--n-paths", type=int, default=3)
    a.add_argument("--version", action="version", version=VERSION)
    x = a.parse_args()
    run(SparkSession.builder.getOrCreate(), x.goals, x.templates, x.out, x.fragments, x.primers, x.params, x.n_paths)


if __name__ == "__main__":
    main()
