"""Edges made by a range join are those of all pairs, and as many as can have a price."""

import random

import pytest
from pyspark.sql import functions as F

from helixar import constants as K
from helixar.operators import cost, graph
from helixar.plans import queries


@pytest.fixture(scope="module")
def table(spark):
    return cost.span_cost(spark).cache()


def groups_of(spark, goals, seed):
    rng, rows = random.Random(seed), set()
    for key, length, n in goals:
        for _ in range(n):
            a, size = rng.randrange(length), rng.randrange(1, length)
            rows.add((key, rng.choice([K.PCR, K.FRAGMENT, K.PCR_PRIMERS]), a, (a + size - 1) % length + 1, size, length, True))
        rows.add((key, K.PCR, 0, length // 2, length // 2, length, True))
        rows.add((key, K.PCR, length // 2, length, length - length // 2, length, True))
    return spark.createDataFrame(sorted(rows), "query_key string, atype string, a int, b int, n int, length int, cyclic boolean")


def as_set(df):
    return {(r.query_key, str(r.src), str(r.dst), r.mtype, r.span, r.origin) for r in df.collect()}


@pytest.mark.parametrize("spans", [(-300, 2248), (-20, 30), (0, 0), (-5, 5000)])
def test_the_same_edges_as_all_pairs(spark, spans):
    g = groups_of(spark, [("tiny", 12, 6), ("small", 700, 8), ("large", 9000, 12), ("one", 2500, 1)], 4)
    nodes = graph.nodes_of(graph.internal_edges(g))
    starts = g.select("query_key", F.col("a").alias("start"))
    every = graph.external_edges(nodes, starts).filter(F.col("span").between(*spans))
    some = graph.external_edges(nodes, starts, spans)
    assert as_set(some) == as_set(every) and some.count() == every.count()


def test_overlaps_need_a_start_in_their_region(spark):
    """As said by all starts of the goal."""
    g = groups_of(spark, [("x", 300, 5), ("y", 41, 4)], 8)
    nodes = graph.nodes_of(graph.internal_edges(g))
    starts = g.select("query_key", F.col("a").alias("start"))
    own: dict = {}
    for r in starts.collect():
        own.setdefault(r.query_key, []).append(r.start)
    for r in graph.external_edges(nodes, starts).filter(F.col("mtype") == K.OVERLAP).collect():
        a, b = r.dst["index"] % r.length, (r.src["index"] - 1) % r.length + 1
        inside = any(a <= s <= b for s in own[r.query_key])
        around = any(s >= a or s <= b for s in own[r.query_key])
        assert around if r.origin else inside


def test_the_graph_keeps_its_edges(spark, table):
    g = groups_of(spark, [("small", 700, 6), ("large", 9000, 10)], 5)
    inner = graph.internal_edges(g)
    starts = g.select("query_key", F.col("a").alias("start"))
    want = graph.priced(graph.external_edges(graph.nodes_of(inner), starts), table)
    got = graph.assembly_graph(g, table).filter("kind = 'external'")
    key = lambda df: sorted((r.query_key, str(r.src), str(r.dst), r.mtype, r.span, r.cost) for r in df.select("query_key", "src", "dst", "mtype", "span", "cost").collect())
    assert key(got) == key(want) and len(key(got)) > 50


def test_pairs_grow_with_what_is_kept(spark):
    """A goal of 50 kb with 200 groups: of all its pairs of nodes, few are made."""
    g = groups_of(spark, [("g", 50_000, 200)], 6)
    nodes = graph.nodes_of(graph.internal_edges(g))
    n = {k: nodes.filter(F.col("ntype") == k).count() for k in "AB"}
    ends = nodes.filter("ntype = 'B'").select("query_key", "length", F.col("index").alias("b_i"), F.col("expandable").alias("b_x"), F.col("overhang").alias("over"))
    begins = nodes.filter("ntype = 'A'").select("query_key", "length", F.col("index").alias("a_i"), F.col("expandable").alias("a_x"), F.col("overhang").alias("over"))
    made = graph._pairs_within(ends, begins, -300, 2248).count()
    kept = graph.external_edges(nodes, g.select("query_key", F.col("a").alias("start")), (-300, 2248)).count()
    assert kept <= made < n["A"] * n["B"] / 2 / 10 and made < 4 * kept


def test_pairs_are_compared_by_a_short_condition(spark):
    """a condition that spells out regions is a method too long to be compiled; along() is the n of make()."""
    from helixar.functions import intervals as I
    from helixar.operators import graph
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(1, 10, 5, True, "A", True)], "query_key int, length int, index int, expandable boolean, ntype string, overhang boolean")
    e = graph.external_edges(nodes, nodes.select("query_key", F.col("index").alias("start")))
    joins = [x for x in e._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "_first" in x]
    assert joins and all(len(x) < 1000 and "FLOOR" not in x for x in joins)
    c = F.col
    d = spark.range(-25, 26).select(c("id").cast("int").alias("a")).crossJoin(spark.range(-25, 26).select(c("id").cast("int").alias("b")))
    assert d.filter(I.along(c("a"), c("b"), F.lit(10)) != I.make(c("a"), c("b"), F.lit(10), F.lit(True))["n"]).count() == 0


@pytest.mark.parametrize("name", ["gap_edges", "overlap_edges"])
def test_lines_are_dealt_once_by_order(spark, name):
    """No exploded row is shuffled, or put together before a shuffle in a task's memory: all that is exchanged is order lines."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)
