"""Simulated joining: simple cycles of the graph of overlapping ends, and the circles that they give.

Nodes are pieces in one of two orientations. A cycle begins with its least piece, forward, and holds greater pieces only, each
once and in one orientation; so every cycle comes once, whatever its turn and whichever strand is read. Paths grow by a
join with the edges at their end, all mixes at once, and those that come back to their start are cycles. Every round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixar.functions import sequences as S
from helixar.functions import shared
from helixar.operators import features as feat

STEP = "struct<key:string,strand:int,n:int>"


def cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(mix, path) of the simple cycles of edges(mix, left, left_strand, right, right_strand, n); path: array of STEP, n being
    the overlap with the next piece. most: pieces that a cycle has at most."""
    c = F.col
    spark = edges.sparkSession
    shared.folder(spark)
    step = lambda key, strand: F.struct(c(key).cast("string").alias("key"), c(strand).cast("int").alias("strand"), c("n").cast("int").alias("n"))
    edges = edges.select("mix", "left", "left_strand", "right", "right_strand", "n").checkpoint()
    paths = edges.filter((c("left_strand") == 1) & (c("right") > c("left")))
    paths = paths.select("mix", c("left").alias("start"), c("right").alias("end"), c("right_strand").alias("end_strand"), F.array(step("left", "left_strand")).alias("path")).checkpoint()
    found, size = [], 2
    while not paths.isEmpty() and (most is None or size <= most):
        on = paths.withColumnsRenamed({"end": "left", "end_strand": "left_strand"}).join(edges, ["mix", "left", "left_strand"])
        on = on.withColumn("path", F.array_append("path", step("left", "left_strand")))
        found.append(on.filter((c("right") == c("start")) & (c("right_strand") == 1)).select("mix", "path").checkpoint())
        fresh = (c("right") > c("start")) & ~F.exists("path", lambda x: x["key"] == c("right"))
        paths = on.filter(fresh).select("mix", "start", c("right").alias("end"), c("right_strand").alias("end_strand"), "path").checkpoint()
        size += 1
    out = found[0] if found else spark.createDataFrame([], f"mix {dict(edges.dtypes)['mix']}, path array<{STEP}>")
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def products(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """(mix, cycle, n_pieces, bases, length, holds, features) of cycles: the circle from the start of its first piece on.

    cycle names the pieces with their strands, in order. holds: whether every piece stands in the circle at its place; it
    does not where two overlaps share bases of a short piece and disagree. pieces(mix, key, bases[, features as LOCATED]).
    """
    c = F.col
    name = F.array_join(F.transform("path", lambda x: F.concat(x["key"], F.when(x["strand"] == 1, "+").otherwise("-"))), ",")
    steps = found.select("mix", name.alias("cycle"), F.size("path").alias("n_pieces"), F.posexplode("path").alias("pos", "x")).select("mix", "cycle", "n_pieces", "pos", "x.*")
    p = pieces.select("mix", "key", F.upper("bases").alias("_s"), *([c("features").alias("_f")] if "features" in pieces.columns else []))
    rows = steps.join(p, ["mix", "key"])
    forward, n = c("strand") == 1, F.length("_s")
    rows = rows.withColumn("_o", F.when(forward, c("_s")).otherwise(S.reverse_complement(c("_s"))))
    w = Window.partitionBy("mix", "cycle").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(n - c("n")).over(w), F.lit(0)).cast("int"))
    whole = Window.partitionBy("mix", "cycle")
    rows = rows.withColumn("length", F.sum(n - c("n")).over(whole).cast("int"))
    own = F.struct("pos", F.expr("substring(_o, 1, length(_o) - n)").alias("part"), "at", c("_o").alias("piece"))
    aggs = [F.first("length").alias("length"), F.sort_array(F.collect_list(own)).alias("parts")]
    if "features" in pieces.columns:
        there = F.when(forward, c("_f")).otherwise(feat.reversed_(c("_f"), n))
        rows = rows.withColumn("_m", feat.moved(there, c("at"), c("length")))
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_m")))).alias("features"))
    out = rows.groupBy("mix", "cycle", "n_pieces").agg(*aggs).withColumn("bases", F.array_join(F.transform("parts", lambda x: x["part"]), ""))
    # a piece may be as long as the circle and more, so it is compared with as many turns as it needs
    turns = lambda x: F.repeat(c("bases"), F.ceil((x["at"] + F.length(x["piece"])) / F.greatest(c("length"), F.lit(1))).cast("int"))
    holds = F.forall("parts", lambda x: F.substring(turns(x), x["at"] + 1, F.length(x["piece"])) == x["piece"])
    return out.filter("length > 0").select("mix", "cycle", "n_pieces", "bases", "length", holds.alias("holds"), *(["features"] if "features" in pieces.columns else []))
