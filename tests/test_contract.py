"""Every query has a name, the entry has rows, and queries with SQL give the same rows as DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from helixar.plans import queries

SF = "/root/testdata/sf0.001"
SLOW = {"span_cost_table", "primer_cost", "synthesis_cost", "span_cost_lookup", "complexity_score", "overlap_edges", "gap_edges"}


def cells(rows):
    def one(x):
        return None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 5) if isinstance(x, float) else str(x)

    return sorted(repr([one(x) for x in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - SLOW))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert cells(df.select(*cols).collect()) == cells(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
