"""Whole libraries of goals: fragments shared between goals, their clusters, and the discount for making them once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixar import constants as K
from helixar.functions import shared
from helixar.operators import cost as C
from helixar.operators import match


def shared_fragments(goals: DataFrame, least: int = 100) -> DataFrame:
    """Alignments of goals with other goals, on both strands."""
    hits = match.without_self(match.exact_matches(goals, goals.select("key", "bases"), least))
    return match.to_regions(hits, "FRAGMENT_SHARED_WITH_OTHER_QUERIES")


MANY, DEGREE = 1 << 20, 4  # edges from which a part of them comes first, and the edges of a node in that part
FEW = 1 << 19  # edges that one task settles (8 MB of numbers), however many there were


def connected(edges: DataFrame, src: str = "a", dst: str = "b", rounds: int = 64, many: int = MANY, few: int = FEW) -> DataFrame:
    """(node, component): the least node that each node reaches; edges with a null give no node.

    From `many` edges on, where nodes have far more than DEGREE of them, the components of a part of the edges come first (drawn by their hashes, DEGREE
    a node). All edges are then looked at once: those inside of such a component, nearly all, go, and the others join the components. So no edge is left
    out, and the rounds of _contracted see a few edges of each node alone.
    """
    c = F.col
    whole = shared.held(edges.select(c(src).alias("a"), c(dst).alias("b")).dropna(), "links")
    e, first = whole.filter("a <> b"), None
    n = whole.count()
    if n >= many:
        nodes = sum(whole.agg(F.approx_count_distinct("a"), F.approx_count_distinct("b")).first())
        share = DEGREE * nodes / 2 / n
        if share < 0.3:
            first = _contracted(e.filter(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)) < int(share * (1 << 20))), rounds, few)
    if first is not None:
        e = shared.held(_moved(e, first.select("x", c("root").alias("to")).hint("shuffle_hash")), "links")
    root = _contracted(e, rounds, few)
    if first is not None:
        if root is None:
            root = first
        else:
            late = root.join(first, "x", "left_anti")  # nodes that the part had no edge of
            root = _followed(first.withColumnRenamed("root", "to"), root).unionByName(late)
    alone = whole.filter("a = b").select(c("a").alias("x")).distinct()
    if root is None:
        return alone.select(c("x").alias("node"), c("x").alias("component"))
    root = shared.held(root.unionByName(alone.join(root, "x", "left_anti").select("x", c("x").alias("root"))), "roots")
    least = root.groupBy("root").agg(F.min("x").alias("component"))
    return root.join(least, "root").select(c("x").alias("node"), "component")


def _moved(e: DataFrame, step: DataFrame) -> DataFrame:
    """Edges (a, b) between what step(x, to) makes of their ends, each once; a node that it doesn't name stays."""
    c = F.col
    at = lambda x: step.select(c("x").alias(x), c("to").alias(f"to_{x}"))
    ends = e.join(at("a"), "a", "left").select("b", F.coalesce("to_a", "a").alias("to_a")).join(at("b"), "b", "left").select("to_a", F.coalesce("to_b", "b").alias("to_b"))
    return ends.filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()


def _followed(step: DataFrame, root: DataFrame) -> DataFrame:
    """step(x, to) with the root of what it leads to."""
    c = F.col
    return step.join(root.select(c("x").alias("to"), "root"), "to", "left").select("x", F.coalesce("root", "to").alias("root"))


def _settled(e: DataFrame) -> DataFrame:
    """(x, root) of few edges, by union-find in one task."""

    def run(batches):
        if not (got := list(batches)):
            return
        both = pa.concat_arrays([x.column(i) for i in (0, 1) for x in got]).dictionary_encode()
        ids, root = both.indices.to_pylist(), list(range(len(both.dictionary)))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        half = len(ids) // 2
        for a, b in zip(ids[:half], ids[half:], strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([both.dictionary, both.dictionary.take(pa.array(map(find, range(len(root)))))], ["x", "root"])

    kind = e.schema["a"].dataType.simpleString()
    return e.select("a", "b").repartition(1).mapInArrow(run, f"x {kind}, root {kind}")


def _contracted(e: DataFrame, rounds: int, few: int) -> DataFrame | None:
    """(x, root) of every node of edges (a, b) without loops, None if there are none. By random contraction: every node takes the neighbour of the least
    rank, or itself, and edges inside of a group go, so a round leaves far fewer edges than it found, the more so the denser they are. Each round is held;
    up to `few` edges are settled at once."""
    c = F.col
    steps: list[DataFrame] = []
    last = None
    while (n := e.count()) > 0:
        if n <= few:
            last = shared.held(_settled(e), "roots")
            break
        if len(steps) == rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        rank = lambda x, r=len(steps): F.struct(F.xxhash64(F.lit(r), x).alias("r"), c(x).alias("to"))
        near = e.unionByName(e.select(c("b").alias("a"), c("a").alias("b"))).groupBy("a").agg(F.min(rank("b")).alias("m"))
        steps.append(shared.held(near.select(c("a").alias("x"), F.least(rank("a"), "m")["to"].alias("to")), "step"))
        e = shared.held(_moved(e, steps[-1]), "links")
    if not steps:
        return last
    root = steps.pop().select("x", c("to").alias("root")) if last is None else last
    for step in reversed(steps):
        root = _followed(step, root)
    return shared.held(root, "roots")


def clusters(aligned: DataFrame) -> DataFrame:
    """Clusters of shared regions: (query_key, a, b, component, n_clusters); clusters that hold two regions of one goal are dropped."""
    name = lambda k, a, b: F.concat_ws(":", k, a, b)
    c = F.col
    pairs = aligned.dropna(subset=["a", "b", "sa", "sb"]).select(name(c("query_key"), c("a"), c("b")).alias("a"), name(c("subject_key"), c("sa"), c("sb")).alias("b"))
    # A region is read from its node's name again, so alignments are looked at once.
    kind = dict(aligned.dtypes)
    part = lambda i: F.regexp_extract("node", r"(?s)^(?:(.*):)?(-?\d+):(-?\d+)$", i)
    key = F.when(~c("node").rlike(r"^-?\d+:-?\d+$"), part(1)).cast(kind["query_key"])
    named = connected(pairs).select("node", "component", key.alias("query_key"), *[part(i).cast(kind[x]).alias(x) for i, x in ((2, "a"), (3, "b"))]).checkpoint()
    twice = named.groupBy("component", "query_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component").distinct()
    good = named.join(twice, "component", "left_anti")
    size = good.groupBy("component").agg(F.count(F.lit(1)).alias("n_clusters"))
    return good.join(size, "component").select("query_key", "a", "b", "component", "n_clusters").orderBy(F.desc("n_clusters"), "component", "query_key")


def discount(edges: DataFrame, factor: float = 2.0) -> DataFrame:
    """Shared synthesized fragments cost material / n_clusters / factor."""
    m = F.when(F.col("mtype") == K.SHARED, F.col("material") / F.col("n_clusters") / factor).otherwise(F.col("material"))
    return edges.withColumn("material", m).withColumn("cost", C.adjust(F.col("material"), F.col("efficiency")))


def shared_groups(goals: DataFrame, least: int = 100) -> DataFrame:
    """Groups of fragments that several goals share, to be synthesized once: query_key, atype, a, b, n, length, cyclic, n_clusters."""
    c = F.col
    aligned = shared_fragments(goals, least)
    size = aligned.select("query_key", "a", "b", "n", "length", "cyclic").distinct()
    known = clusters(aligned).select("query_key", "a", "b", "n_clusters")
    return size.join(known, ["query_key", "a", "b"]).select("query_key", F.lit(K.SHARED).alias("atype"), "a", "b", "n", "length", "cyclic", c("n_clusters"))


def discount_shared(edges: DataFrame, groups: DataFrame, factor: float = 2.0) -> DataFrame:
    """discount() with the number of goals looked up by the region of each shared edge."""
    c = F.col
    known = groups.select("query_key", c("a").alias("_a"), c("b").alias("_b"), "n_clusters").distinct()
    at = edges.withColumns({"_a": F.pmod(c("src.index"), c("length")), "_b": F.pmod(c("dst.index") - 1, c("length")) + 1})
    return discount(at.join(known, ["query_key", "_a", "_b"], "left"), factor).select(*edges.columns)
