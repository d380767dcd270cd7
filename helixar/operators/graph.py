"""Assembly graph: nodes, internal and external edges of every goal at once. A node is (index, expandable, ntype, overhang)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixar import constants as K
from helixar.functions import intervals as I
from helixar.operators import cost as C


def molecule_types(spark) -> DataFrame:
    """The fixed table of types: bounded, broadcast."""
    return F.broadcast(spark.createDataFrame(K.MOLECULE_TYPES, K.MOLECULE_SCHEMA))


def internal_edges(groups: DataFrame) -> DataFrame:
    """Edges inside each group(query_key, atype, a, b, n, length, cyclic): on a circle twice, on the doubled axis, and each
    with and without overhang at both ends."""
    c = F.col
    types = molecule_types(groups.sparkSession).select(c("name").alias("atype"), "l", "r", c("cost").alias("material"), "efficiency")
    pair = lambda a, b: F.struct(a.cast("int").alias("i"), b.cast("int").alias("j"))
    two = F.when(c("b") < c("a"), F.array(pair(c("a"), c("b") + c("length")), pair(c("a") + c("length"), c("b")))).otherwise(F.array(pair(c("a"), c("b")), pair(c("a") + c("length"), c("b") + c("length"))))
    at = F.explode(F.when(c("cyclic"), two).otherwise(F.array(pair(c("a"), c("b"))))).alias("x")
    flags = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (True, False) for j in (True, False)])).alias("o")
    e = groups.join(types, "atype").select("query_key", "atype", "l", "r", "material", "efficiency", c("n").alias("span"), "length", at).select("*", flags)
    node = lambda i, expand, kind, over: F.struct(i.alias("index"), expand.alias("expandable"), F.lit(kind).alias("ntype"), over.alias("overhang"))
    return e.select("query_key", node(c("x.i"), c("l"), "A", c("o.i")).alias("src"), node(c("x.j"), c("r"), "B", c("o.j")).alias("dst"), c("atype").alias("mtype"), F.lit("internal").alias("kind"), "span", "l", "r", "material", "efficiency", (c("material") / c("efficiency")).alias("cost"), "length")


def nodes_of(edges: DataFrame) -> DataFrame:
    both = edges.select("query_key", "length", F.explode(F.array("src", "dst")).alias("node"))
    return both.select("query_key", "length", "node.*").distinct()


def _pairs_within(ends: DataFrame, begins: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs of end and start nodes whose span can lie in [least, most]: spans are a - b and whole turns, so each start stands
    for itself and its copies, and these meet the ends in buckets of positions. No pair comes twice."""
    c = F.col
    copies = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((2 * c("length") + most - c("a_i")) / c("length")).cast("int")))
    points = begins.withColumn("_k", F.explode(copies)).select("*", (c("a_i") + c("_k") * c("length")).alias("_p")).drop("_k")
    near = I.range_join(ends.withColumns({"_lo": c("b_i") + least, "_hi": c("b_i") + most}), points.drop("length"), ["query_key", "over"], "_lo", "_hi", "_p", max(64, (most - least) // 4), closed=True)
    return near.drop("_lo", "_hi", "_p").distinct()


def external_edges(nodes: DataFrame, starts: DataFrame, spans: tuple[int, int] | None = None) -> DataFrame:
    """Overlap and gap edges from end (B) to start (A) nodes of each goal, also over the origin, without costs.

    starts(query_key, start): starts of the goal's groups; an overlap needs one of them in its region. Of edges with equal
    ends the one over the origin stays. spans: only edges of these spans, and only pairs that can have one are made.
    """
    c = F.col
    pick = lambda kind, p: nodes.filter(c("ntype") == kind).select("query_key", "length", c("index").alias(f"{p}_i"), c("expandable").alias(f"{p}_x"), c("overhang").alias("over"))
    # Of a start node and the goal's starts all that an overlap asks is the next start from the node on, and the first one.
    own = pick("A", "a").withColumns({"_at": F.pmod(c("a_i"), c("length")).cast("int"), "_s": F.lit(None).cast("int")})
    own = own.unionByName(starts.distinct().select("query_key", c("start").cast("int").alias("_at"), c("start").cast("int").alias("_s")), allowMissingColumns=True)
    from_here = Window.partitionBy("query_key").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    begins = own.withColumns({"_next": F.min("_s").over(from_here), "_first": F.min("_s").over(Window.partitionBy("query_key"))}).filter("a_i IS NOT NULL").drop("_at", "_s")
    if spans is None:  # by the goal's key alone, so that nodes which are dealt by it stay where they are
        with_over, without = (pick("B", "b").filter(x).join(begins.filter(x).drop("length", "over"), "query_key") for x in (c("over"), ~c("over")))
    else:
        with_over = without = _pairs_within(pick("B", "b"), begins, *spans)
    a, b, n = c("a_i"), c("b_i"), c("length")
    meets = (a <= n) & (b >= n)  # such a pair may close over the origin
    # Every pair has one place over the origin and one not, so the edge that stays is chosen in its row. What is asked of a pair in
    # the join is short, as a condition that spells out a region for each comparison is too long a method to be compiled.
    kept = lambda df, turns, far, near, mtype: df.select("*", F.when(turns, far).otherwise(near).cast("int").alias("span"), F.when(turns, 1).otherwise(0).alias("origin"), F.lit(mtype).alias("mtype"))
    gaps = kept(without.filter(~c("over") & (meets | (b <= a))), meets, F.when(b == n, I.along(F.lit(0), a, n)).otherwise(I.along(b, a, n)), a - b, K.GAP)
    last = I.end(b, n)
    around = meets & (c("_next").isNotNull() | (c("_first") <= last))
    overlaps = kept(with_over.filter(c("over") & (a != b) & (around | ((b > a) & (c("_next") <= last)))), around, -I.along(a, b, n), a - b, K.OVERLAP)
    tagged = overlaps.unionByName(gaps)
    if spans is not None:
        tagged = tagged.filter(c("span").between(*spans))
    node = lambda p, kind: F.struct(c(f"{p}_i").alias("index"), c(f"{p}_x").alias("expandable"), F.lit(kind).alias("ntype"), c("over").alias("overhang"))
    return tagged.select("query_key", node("b", "B").alias("src"), node("a", "A").alias("dst"), "mtype", F.lit("external").alias("kind"), "span", c("b_x").alias("l"), c("a_x").alias("r"), "origin", "length")


def priced(external: DataFrame, table: DataFrame, threshold: float = K.COST_THRESHOLD, spans: tuple[int, int] | None = None) -> DataFrame:
    """External edges with material, efficiency and cost; those over the threshold (or impossible) are dropped."""
    e = external.withColumns({"l": F.col("l").cast("int"), "r": F.col("r").cast("int")})
    return C.lookup(e, table.select("l", "r", "span", "cost", "efficiency", "material"), spans=spans).filter(F.col("cost") <= threshold)


def assembly_graph(groups: DataFrame, table: DataFrame, threshold: float = K.COST_THRESHOLD) -> DataFrame:
    """All edges: query_key, src, dst, mtype, kind, span, material, efficiency, cost, length."""
    cols = ["query_key", "src", "dst", "mtype", "kind", "span", "material", "efficiency", "cost", "length"]
    inner = internal_edges(groups)
    inner = inner.groupBy("query_key", "src", "dst").agg(F.max(F.struct("mtype", "kind", "span", "material", "efficiency", "cost", "length")).alias("w")).select("query_key", "src", "dst", "w.*")
    spans = table.agg(F.min("span"), F.max("span")).first()  # beyond them nothing has a price
    outer = priced(external_edges(nodes_of(inner), groups.select("query_key", F.col("a").alias("start")), tuple(spans)), table, threshold, spans)
    return inner.select(*cols).unionByName(outer.select(*cols))


def band_multiplier(span: Column, bands: list[tuple] = K.PCR_BANDS) -> Column:
    """Factor of the first half-open band that holds the span; 1 outside (an empty band never matches)."""
    return F.coalesce(*[F.when((span >= lo) & (span < hi), F.lit(x)) for lo, hi, x in bands], F.lit(1.0))


def complexity_efficiency(complexity: Column, efficiency: Column, threshold: float = K.COMPLEXITY_THRESHOLD) -> Column:
    """Too complex to synthesize well: the efficiency is replaced, not multiplied."""
    ratio = complexity / threshold
    return F.when(ratio >= 1, K.NOT_SYNTHESIZABLE / ratio).otherwise(efficiency)


def mispriming_efficiency(score: Column, efficiency: Column, penalty: float = K.MISPRIMING_PENALTY) -> Column:
    return efficiency * F.pow(F.lit(penalty), score)


PCR_TYPES = [K.PCR, K.PCR_PRIMERS, K.PCR_RIGHT, K.PCR_LEFT]


def score_long_products(edges: DataFrame, bands: list[tuple] = K.PCR_BANDS) -> DataFrame:
    e = F.when(F.col("mtype").isin(PCR_TYPES), F.col("efficiency") * band_multiplier(F.col("span"), bands)).otherwise(F.col("efficiency"))
    return edges.withColumn("efficiency", e).withColumn("cost", C.adjust(F.col("material"), F.col("efficiency")))


def score_complexity(edges: DataFrame, goals: DataFrame, threshold: float = K.COMPLEXITY_THRESHOLD) -> DataFrame:
    """Gap and shared synthesized edges with span > 0 get the complexity of their stretch of the (doubled) goal."""
    from helixar.functions import sequences as S

    c = F.col
    wanted = (c("mtype").isin([K.GAP, K.SHARED])) & (c("span") > 0)
    start = F.when(c("src.index") >= c("length"), c("src.index") - c("length")).otherwise(c("src.index"))
    keyed = edges.withColumn("_a", F.when(wanted, start))
    # a goal's stretches go to its bases in one row, so each goal is profiled once
    asked = keyed.filter(wanted).groupBy("query_key").agg(F.collect_set(F.struct("_a", "span")).alias("at"))
    asked = asked.join(goals.select(c("key").alias("query_key"), c("bases").alias("_s")), "query_key")
    costs = S.slice_complexities(c("_s"), F.transform("at", lambda x: x["_a"]), F.transform("at", lambda x: x["_a"] + x["span"]))
    parts = asked.select("query_key", F.explode(F.arrays_zip("at", costs.alias("complexity"))).alias("x")).select("query_key", "x.at._a", "x.at.span", "x.complexity")
    out = keyed.join(parts, ["query_key", "_a", "span"], "left").drop("_a")
    out = out.withColumn("efficiency", F.coalesce(complexity_efficiency(c("complexity"), c("efficiency"), threshold), c("efficiency")))
    return out.withColumn("cost", C.adjust(c("material"), c("efficiency")))
