"""Helpers that no query calls: roles of materials, small expressions, tidy names, streams of inventory and events."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from helixar.functions import intervals as I
from helixar.operators import frame, output, score
from helixar.sources import sequences as files
from helixar.streaming import inventory


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def seqs(spark, rows, circular=False):
    return spark.createDataFrame([(k, k, b, len(b), circular, []) for k, b in rows], files.RECORDS)


def test_materials_by_role(spark):
    linear, ring = seqs(spark, [("f1", "AC")]), seqs(spark, [("f2", "GT")], True)
    got = {(r.key, r.role) for r in files.materials(seqs(spark, [("p", "AA")]), seqs(spark, [("t", "CC")]), seqs(spark, [("q", "GG")], True), linear.unionByName(ring)).collect()}
    assert got == {("p", "primer"), ("t", "template"), ("q", "query"), ("f1", "fragment"), ("f1", "template"), ("f2", "template")}
    assert files.materials(linear, linear, linear).count() == 3
    assert {r.is_circular for r in files.with_topology(linear, True).collect()} == {True}


def test_random_designs(spark):
    goals, templates = files.random_designs(spark, 3, size=301, parts=4)
    again, _ = files.random_designs(spark, 3, size=301, parts=4)
    own = {r.key: r.bases for r in goals.collect()}
    assert own == {r.key: r.bases for r in again.collect()} and len(set(own.values())) == 3 and all(set(b) <= set("ACGT") and len(b) == 301 for b in own.values())
    by: dict = {}
    for r in templates.collect():
        by.setdefault(r.key.rsplit("_t", 1)[0], {})[int(r.key[-1])] = r.bases
    assert {k: "".join(v[i] for i in range(4)) for k, v in by.items()} == own


def test_gap_between(spark):
    df = spark.createDataFrame([(8, 2), (2, 8), (5, 5), (10, 0)], "b int, a int").select(I.gap_between(F.col("b"), F.col("a"), F.lit(10)).alias("n"))
    assert [r.n for r in df.collect()] == [4, 6, 0, 0]


def test_sequence_json(spark):
    df = spark.createDataFrame([("k", "n", "ACGT", 4, True, [(0, 2, 1, "f", "gene", [(0, 2, 1)])])], files.RECORDS)
    doc = json.loads(output.sequence_json(df).first().json)
    assert (doc["bases"], doc["name"], doc["isCircular"]) == ("ACGT", "n", True) and doc["annotations"][0]["name"] == "f" and doc["annotations"][0]["parts"] == [{"start": 0, "end": 2, "strand": 1}]


def test_window_counts(spark):
    s = "A" * 40 + dna(60, 1)
    df = spark.createDataFrame([("k", s), ("none", ""), ("short", "ACG")], "key string, bases string")
    got = {r.key: (r.n_base_windows, r.n_gc_windows, r.n_at_windows) for r in score.window_counts(df).collect()}
    wins = [s[i : i + 20] for i in range(len(s) - 19)]
    want = (sum(w.count(b) / 20 > 0.75 for w in wins for b in "ACGT"), sum((w.count("G") + w.count("C")) / 20 > 0.85 for w in wins), sum((w.count("A") + w.count("T")) / 20 > 0.9 for w in wins))
    assert got == {"k": want, "none": (0, 0, 0), "short": (0, 0, 0)}


def test_suffix(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k int, v int, w int")
    assert frame.suffix(df, ["k"], "_x").columns == ["k", "v_x", "w_x"]


def test_arrivals_are_matched_once(spark, tmp_path):
    goal = dna(400, 3)
    goals = spark.createDataFrame([("g", goal, False)], "key string, bases string, is_circular boolean")
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    for i, rows in enumerate([[("a", goal[10:80])], [("b", goal[200:260]), ("c", dna(90, 9))]]):
        spark.createDataFrame(rows, "key string, bases string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, bases string").parquet(source)
        inventory.match_arrivals(stream, goals, out, state).awaitTermination(120)
        got = sorted((r.subject_key, r.q_start, r.n) for r in spark.read.parquet(out).collect())
        assert got == [("a", 11, 70), ("b", 201, 60)][: i + 1]


def test_windowed_events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=m), kind, float(m)) for m in range(0, 240, 7) for kind in ("x", "y")]
    rows.append((start + timedelta(days=2), "late", 0.0))
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events")
    df = inventory.windowed_events(spark, f"{tmp_path}/events", schema)
    q = df.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window.start, r.event_type): (r.n, r.value) for r in spark.table("windowed").collect()}
    want: dict = {}
    for t, kind, v in rows:
        k = (t.replace(minute=0), kind)
        want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0.0))[1] + v)
    assert got == want


def test_gc_cost_without_bases(spark):
    """a text without letters is no division by zero."""
    from helixar.functions import sequences as S
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("",), ("GGCC",), (None,)], "s string").select(S.gc_cost(F.col("s")).alias("x")).collect()
    assert [r.x for r in got] == [None, 34.0, None]


def test_components_of_odd_graphs(spark):
    """Long ways, dense parts, loops, equal edges and nulls, by contraction: the least node of each component, in a number of rounds that does not grow with the way."""
    from helixar.operators import library

    way = [(i, i + 1) for i in range(1000, 1300)]
    rows = [*way, *way[:5], (7, 7), (1, 2), (2, 1), (2, 2), (3, 4), (4, 5), (5, 3), (None, 9), (9, None), *((a, b) for a in range(50, 60) for b in range(80, 99))]
    got = {r.node: r.component for r in library.connected(spark.createDataFrame(rows, "a long, b long"), rounds=12).collect()}
    want = {i: 1000 for i in range(1000, 1301)} | {7: 7, 1: 1, 2: 1, 3: 3, 4: 3, 5: 3} | dict.fromkeys([*range(50, 60), *range(80, 99)], 50)
    assert got == want
    assert library.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_by_a_part_of_the_edges_first(spark):
    """a part of the edges first, then all, by rounds or in one task: nodes that the part has no edge of, texts as nodes and loops come out as by union-find."""
    import random

    from helixar.operators import library

    rng = random.Random(3)
    dense = [(rng.randrange(40), 100 + rng.randrange(40)) for _ in range(900)]
    rows = [*dense, *((1000 + i, 1001 + i) for i in range(0, 60, 2)), *((2000 + i, 2001 + i) for i in range(60)), (5, 1040), (7, 7), (9000, 9000)]
    least = {x: x for e in rows for x in e}
    while any(least[a] != least[b] for a, b in rows):
        for a, b in rows:
            least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame(rows, "a long, b long")
    for many, few in ((1, 0), (1, 1 << 19), (1 << 20, 0)):
        got = library.connected(df, many=many, few=few).collect()
        assert len(got) == len(least) and {r.node: r.component for r in got} == least
    assert {r.node for r in library.connected(df, rounds=0).collect()} == set(least)  # few edges take no rounds
    named = spark.createDataFrame([(f"n{a:05}", f"n{b:05}") for a, b in rows], "a string, b string")
    for few in (0, 1 << 19):
        assert {r.node: r.component for r in library.connected(named, many=1, few=few).collect()} == {f"n{x:05}": f"n{y:05}" for x, y in least.items()}
