"""Counts along sequences and regions: coverage, windows, tiled profiles, partition points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixar import constants as K
from helixar.functions import intervals as I
from helixar.functions import sequences as S
from helixar.operators import cost as C
from helixar.operators import expand, graph


def coverage(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches [start, end) of constant depth of regions(a, n, length): events and a running sum, never a row per base."""
    p = regions.withColumn("_p", F.explode(I.pieces(F.col("a"), F.col("n"), F.col("length"))))
    events = p.select(*keys, F.explode(F.array(F.struct(F.col("_p.lo").alias("at"), F.lit(1).alias("step")), F.struct(F.col("_p.hi").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = events.groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("start")
    deep = steps.withColumn("depth", F.sum("step").over(w)).withColumn("end", F.lead("start").over(w))
    return deep.filter((F.col("depth") > 0) & (F.col("end") > F.col("start"))).select(*keys, "start", "end", "depth")


def window_counts(sequences: DataFrame, w: int = K.STATS_WINDOW) -> DataFrame:
    """Of every sequence(key, bases): windows over the base, GC and AT fractions, by an Arrow kernel."""
    parts = S.complexity_parts(F.col("bases"))
    return sequences.select("key", parts.alias("p")).select("key", "p.n_base_windows", "p.n_gc_windows", "p.n_at_windows")


def tiled_complexity(sequences: DataFrame, sizes: tuple = (100, 500, 1000, 2000), step: int = 100) -> DataFrame:
    """Complexity of windows of each size every `step` bases around circular sequences(key, bases)."""
    n = F.length("bases")
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    tiles = F.flatten(F.transform(F.filter(F.array(*[F.lit(x) for x in sizes]), lambda k: k <= n), lambda k: F.transform(starts, lambda a: F.struct(k.alias("size"), a.cast("int").alias("start")))))
    t = sequences.filter(n >= min(sizes)).select("key", "bases", tiles.alias("tiles"))
    costs = S.slice_complexities(F.col("bases"), F.transform("tiles", lambda x: x["start"]), F.transform("tiles", lambda x: x["start"] + x["size"]))
    t = t.select("key", F.explode(F.arrays_zip("tiles", costs.alias("complexity"))).alias("x"))  # a sequence is sent and profiled once
    return t.select("key", "x.tiles.size", "x.tiles.start", "x.complexity")


def best_cut(p: S.Profile, i: int, j: int, step: int, overlap: int) -> tuple[int | None, float]:
    """The cut of [i, j) that leaves the least complexity on both sides (the right side starts `overlap` later)."""
    at = np.arange(i + step, j - overlap, step)
    if not len(at):
        return None, float("inf")
    c = p.prefix_costs(i, at) + p.suffix_costs(at + overlap, j)
    best = int(np.argmin(c))
    return int(at[best]), float(c[best])


def cuts_of(bases: str, cyclic: bool, threshold: float, step: int, overlap: int, again: int = 100) -> list[int]:
    """Cut points, coarse then fine, parts cut again in steps of `again` while over the threshold; circles are searched from two origins."""

    def search(p: S.Profile, i: int, j: int, out: list[int], step: int = again, costs: float | None = None) -> None:
        if j - i < 2 * step or (p.cost(i, j) if costs is None else costs) < threshold:
            return
        x, c = best_cut(p, i, j, step, overlap)
        if x is None:
            return
        if c >= threshold:
            fine, d = best_cut(p, max(i, x - step), min(j, x + step), max(1, step // 10), overlap)
            x = fine if fine is not None and d < c else x
        if x in out:
            return
        out.append(x)
        for a, b in ((i, x), (x, j)):
            if (own := p.cost(a, b)) > threshold:
                search(p, a, b, out, costs=own)

    found: list[int] = []
    search(S.Profile(bases), 0, len(bases), found, step)
    if cyclic and bases:
        half = len(bases) // 2
        more: list[int] = []
        search(S.Profile(bases[half:] + bases[:half]), 0, len(bases), more, step)
        found += [(x + half) % len(bases) for x in more]
    return sorted(set(found))


def partition_points(sequences: DataFrame, threshold: float = K.COMPLEXITY_THRESHOLD, step: int = K.PARTITION_STEP, overlap: int = K.PARTITION_OVERLAP) -> DataFrame:
    """(key, cut) for sequences(key, bases, is_circular); `step` is that of the first search."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([cuts_of(x, y, threshold, step, overlap) for x, y in zip(s, c, strict=True)])

    return sequences.select("key", F.explode(run("bases", "is_circular")).alias("cut"))


def partition_edges(edges: DataFrame, cuts: DataFrame, overlap: int = K.PARTITION_OVERLAP, least: int = K.MIN_GENE) -> DataFrame:
    """For gap edges B -> A too complex to synthesize and longer than two genes of the least size, the three edges through each cut in them, without cost."""
    c = F.col
    wide = edges.filter((c("mtype") == K.GAP) & (c("span") > 2 * least) & (c("complexity") >= K.COMPLEXITY_THRESHOLD))
    e = wide.join(cuts.select(c("key").alias("query_key"), "cut"), "query_key").filter(I.has(c("cut"), F.pmod(c("src.index"), c("length")), c("span"), c("length")))
    turns = c("src.index") - F.pmod(c("src.index"), c("length"))
    at = F.when(c("cut") < F.pmod(c("src.index"), c("length")), c("cut") + c("length")).otherwise(c("cut")) + turns
    node = lambda i, kind: F.struct(i.cast("int").alias("index"), F.lit(False).alias("expandable"), F.lit(kind).alias("ntype"), F.lit(True).alias("overhang"))
    span1 = at + overlap - c("src.index")
    made = F.array(
        F.struct(c("src").alias("src"), node(at + overlap, "BC").alias("dst"), F.lit(K.GAP).alias("mtype"), span1.cast("int").alias("span")),
        F.struct(node(at + overlap, "BC").alias("src"), node(at, "CA").alias("dst"), F.lit(K.OVERLAP).alias("mtype"), F.lit(-overlap).alias("span")),
        F.struct(node(at, "CA").alias("src"), c("dst").alias("dst"), F.lit(K.GAP).alias("mtype"), (c("span") - span1 + overlap).cast("int").alias("span")),
    )
    x = e.select("query_key", "length", F.explode(made).alias("x")).select("query_key", "x.*", "length")
    return x.withColumns({"l": c("src.expandable"), "r": c("dst.expandable"), "kind": F.lit("external")}).distinct()


def template_misprimings(regions: DataFrame, alignments: DataFrame, templates: DataFrame, width: int = 500) -> DataFrame:
    """The template with the fewest misprimings for each product of regions(query_key, mtype, a, b, n, length).

    Candidates are alignments(query_key, subject_key, a, n, sa, sb, direction) of templates(key, bases) that hold the middle of the
    product and every end of it that no primer gives. (query_key, mtype, a, b, template, n_misprimings, n_templates)
    """
    c = F.col
    r = regions.select("query_key", "mtype", "a", "b", "n", "length").distinct().withColumn("_mid", F.pmod(c("a") + F.floor(c("n") / 2), c("length")))
    t = alignments.filter(c("atype").isin([K.PCR, K.FRAGMENT])).select("query_key", "subject_key", c("a").alias("_ta"), c("n").alias("_tn"), "sa", "sb", "direction", F.explode(I.pieces(c("a"), c("n"), c("length"))).alias("_p"))
    t = t.select("*", c("_p.lo").alias("_lo"), c("_p.hi").alias("_hi")).drop("_p")
    pairs = I.range_join(t, r, ["query_key"], "_lo", "_hi", "_mid", width)
    first, last = F.pmod(c("a") - c("_ta"), c("length")), F.pmod(c("b") - 1 - c("_ta"), c("length")) + 1
    starts_in, ends_in = first < c("_tn"), last <= c("_tn")
    free_left, free_right = c("mtype").isin([K.PCR_PRIMERS, K.PCR_LEFT]), c("mtype").isin([K.PCR_PRIMERS, K.PCR_RIGHT])
    pairs = pairs.filter((starts_in | free_left) & (ends_in | free_right))
    pairs = pairs.withColumns({"_i": F.when(starts_in, first).otherwise(0), "_j": F.when(ends_in, last).otherwise(c("_tn"))}).filter("_i < _j")
    sub = expand.sub_alignment(c("_i"), c("_j") - c("_i"), c("sa"), c("sb"), c("direction"))
    pairs = pairs.withColumn("_s", sub).select("query_key", "mtype", "a", "b", "subject_key", c("_s.sa").alias("_sa"), c("_s.sb").alias("_sb"))
    once = pairs.select("subject_key", "_sa", "_sb").distinct().join(templates.select(c("key").alias("subject_key"), F.upper("bases").alias("_bases")), "subject_key")
    scored = once.select("subject_key", "_sa", "_sb", S.misprimings(c("_bases"), c("_sa"), c("_sb"), F.lit(False)).alias("_m"))
    best = pairs.join(scored, ["subject_key", "_sa", "_sb"]).groupBy("query_key", "mtype", "a", "b").agg(F.min(F.struct("_m", "subject_key")).alias("_w"), F.count_distinct("subject_key").alias("n_templates"))
    return best.select("query_key", "mtype", "a", "b", c("_w.subject_key").alias("template"), c("_w._m").alias("n_misprimings"), "n_templates")


def score_misprimings(edges: DataFrame, alignments: DataFrame, templates: DataFrame) -> DataFrame:
    """PCR edges with the efficiency of their best template; edges without a candidate keep theirs."""
    c = F.col
    at = edges.withColumns({"_a": F.pmod(c("src.index"), c("length")), "_b": F.pmod(c("dst.index") - 1, c("length")) + 1})
    inner = at.filter(c("mtype").isin(graph.PCR_TYPES)).select("query_key", "mtype", c("_a").alias("a"), c("_b").alias("b"), c("span").alias("n"), "length")
    best = template_misprimings(inner, alignments, templates).select("query_key", "mtype", c("a").alias("_a"), c("b").alias("_b"), "n_misprimings")
    out = at.join(best, ["query_key", "mtype", "_a", "_b"], "left")
    e = F.coalesce(graph.mispriming_efficiency(c("n_misprimings"), c("efficiency")), c("efficiency"))
    out = out.withColumn("efficiency", e).withColumn("cost", C.adjust(c("material"), c("efficiency")))
    return out.select(*edges.columns)


def remove_inefficient(edges: DataFrame, least: float = K.EDGE_EFFICIENCY) -> DataFrame:
    return edges.filter(F.col("efficiency") >= least)


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, into: str = "mean") -> DataFrame:
    """Mean of each row and the n - 1 before it; null for the first n - 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    full = F.row_number().over(w) >= n
    return df.withColumn(into, F.when(full, F.avg(value).over(w.rowsBetween(1 - n, 0))))
