"""Interval joins that derive alignments from alignments: primer pairs, extension products, overlaps; dedup and grouping.

Regions are (a, b, n, length): start, exclusive end and size on a circle or line of `length`; see functions.intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixar import constants as K
from helixar.functions import intervals as I

KEY = ["query_key", "subject_key", "atype", "a", "b", "n", "length", "cyclic", "sa", "sb", "s_length"]


def dedup_alignments(alignments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per alignment; direction is not part of the key (the least one stays, whatever the order of rows)."""
    keys = keys or [c for c in KEY if c in alignments.columns]
    rest = [c for c in alignments.columns if c not in keys]
    return alignments.groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest]) if rest else alignments.distinct()


def group_alignments(alignments: DataFrame, subject: str = "subject_key") -> DataFrame:
    """Alignments with equal query region and type: their number and sorted subjects."""
    return alignments.groupBy("query_key", "a", "b", "n", "length", "cyclic", "atype").agg(F.count(F.lit(1)).alias("n_alignments"), F.sort_array(F.collect_list(subject)).alias("subjects"))


def min_size(atype: Column) -> Column:
    return F.coalesce(*[F.when(atype == x[0], F.lit(x[8])) for x in K.MOLECULE_TYPES if x[8] is not None])


def size_ok(n: Column, atype: Column) -> Column:
    """n within the bounds of the molecule type (no type has an upper one)."""
    return F.coalesce(n >= min_size(atype), F.lit(True))


def _piecewise(df: DataFrame, start: Column, n: Column) -> DataFrame:
    return df.filter(n > 0).withColumn("_piece", F.explode(I.pieces(F.pmod(start, F.col("length")), n, F.col("length")))).select("*", F.col("_piece.lo").alias("_lo"), F.col("_piece.hi").alias("_hi")).drop("_piece")


def _product(a: Column, b: Column, length: Column) -> Column:
    return F.pmod(b - a - 1, length) + 1


def primer_pairs(groups: DataFrame, primers: DataFrame, bind: int = K.MIN_BIND, width: int = 500, lim_size: bool = True) -> DataFrame:
    """PCR products of groups(query_key, gid, a, b, n, length) with primers(query_key, pid, a, b, n, direction).

    A forward primer's end lies in [a + bind, c], a reverse primer's start in [a, c - bind]. One row per product:
    gid, fwd and rev (null: to be designed), atype, a, b, n.
    """
    p = primers.select("query_key", F.col("pid"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("n").alias("pn"), "direction")
    fwd = p.filter("direction = 1").withColumn("_at", F.col("pb") - 1)
    rev = p.filter("direction <> 1").withColumn("_at", F.col("pa"))
    g = groups.select("query_key", "gid", "a", "b", "n", "length")
    f = I.range_join(_piecewise(g, F.col("a") + (bind - 1), F.col("n") - (bind - 1)), fwd, ["query_key"], "_lo", "_hi", "_at", width)
    f = f.select("query_key", "gid", "a", "b", "n", "length", F.col("pid").alias("fwd"), F.col("pa").alias("fa"), F.col("pb").alias("fb"), F.col("pn").alias("fn"))
    r = I.range_join(_piecewise(g, F.col("a"), F.col("n") - (bind - 1)), rev, ["query_key"], "_lo", "_hi", "_at", width)
    r = r.select("query_key", "gid", "a", "b", "n", "length", F.col("pid").alias("rev"), F.col("pa").alias("ra"), F.col("pb").alias("rb"), F.col("pn").alias("rn"))
    c = F.col
    length = c("length")
    both = f.join(r.select("query_key", "gid", "rev", "ra", "rb", "rn"), ["query_key", "gid"])
    off = lambda x: F.pmod(x - c("a"), length)
    wraps = c("a") + c("n") > length
    after = F.when(wraps, (off(c("fa")) >= c("n")) | (off(c("ra")) >= off(c("fa")))).otherwise(c("ra") >= c("fa"))
    fa_in_r = I.has(c("fa"), c("ra"), c("rn"), length) & (c("fa") != c("ra"))
    rb_in_f = (c("rb") < length) & I.has(c("rb"), c("fa"), c("fn"), length) & (c("rb") != c("fb"))
    both = both.filter(after & ~fa_in_r & ~rb_in_f)
    none = F.lit(None).cast("string")

    def out(df: DataFrame, atype: str, fwd: Column, rev: Column, a: Column, b: Column) -> DataFrame:
        d = df.select("query_key", "gid", fwd.cast("string").alias("fwd"), rev.cast("string").alias("rev"), F.lit(atype).alias("atype"), a.alias("a"), b.alias("b"), _product(a, b, length).alias("n"), "length")
        return d.filter(size_ok(c("n"), c("atype"))) if lim_size else d

    return out(both, K.PCR_PRIMERS, c("fwd"), c("rev"), c("fa"), c("rb")).unionByName(out(f, K.PCR_LEFT, c("fwd"), none, c("fa"), c("b"))).unionByName(out(r, K.PCR_RIGHT, none, c("rev"), c("a"), c("rb")))


def extension_products(primers: DataFrame, bind: int = K.MIN_BIND, width: int = 100, only_one: bool = False) -> DataFrame:
    """Products of two primers that bind each other: the reverse primer starts in the forward one less its last `bind`."""
    c = F.col
    p = primers.select("query_key", "pid", "a", "b", "n", "length", "direction")
    f = p.filter("direction = 1").withColumnRenamed("pid", "fwd").drop("direction")
    r = p.filter("direction <> 1").select("query_key", c("pid").alias("rev"), c("a").alias("ra"), c("b").alias("rb"))
    pairs = I.range_join(_piecewise(f, c("a"), c("n") - (bind - 1)), r, ["query_key"], "_lo", "_hi", "ra", width)
    inside = (c("rb") < c("length")) & I.has(c("rb"), c("a"), c("n"), c("length")) & (c("rb") != c("b"))
    pairs = pairs.filter(~inside).select("query_key", "fwd", "rev", F.lit(K.EXT_PRIMERS).alias("atype"), "a", c("rb").alias("b"), _product(c("a"), c("rb"), c("length")).alias("n"), "length")
    if not only_one:
        return pairs
    left = f.select("query_key", "fwd", F.lit(None).cast("string").alias("rev"), F.lit(K.EXT_LEFT).alias("atype"), "a", "b", "n", "length")
    right = p.filter("direction <> 1").select("query_key", F.lit(None).cast("string").alias("fwd"), c("pid").alias("rev"), F.lit(K.EXT_RIGHT).alias("atype"), "a", "b", "n", "length")
    return pairs.unionByName(left).unionByName(right)


def overlap_products(groups: DataFrame, atype: str = K.PCR, least: int = K.MIN_OVERLAP, width: int = 500, lim_size: bool = True, include_left: bool = True, condition: Column | None = None) -> DataFrame:
    """For group A and another group B that starts in A and does not end in it: A up to B's start, and A from there on.

    groups(query_key, gid, a, b, n, length). `condition` may compare A's columns with B's (prefixed o_).
    """
    c = F.col
    other = groups.select("query_key", *[c(x).alias(f"o_{x}") for x in groups.columns if x not in ("query_key", "length")])
    pairs = I.range_join(_piecewise(groups, c("a"), c("n")), other, ["query_key"], "_lo", "_hi", "o_a", width).filter(c("gid") != c("o_gid"))
    pairs = pairs.filter(~((c("o_b") < c("length")) & I.has(c("o_b"), c("a"), c("n"), c("length"))))
    if condition is not None:
        pairs = pairs.filter(condition)
    k = F.pmod(c("o_a") - c("a"), c("length"))
    left = F.struct(c("a").alias("a"), I.end(c("o_a"), c("length")).alias("b"), k.alias("n"), F.lit("left").alias("side"))
    rest = F.struct(c("o_a").alias("a"), c("b").alias("b"), (c("n") - k).alias("n"), F.lit("overlap").alias("side"))
    made = pairs.filter(k > 0).select("query_key", "gid", c("o_gid"), "length", F.explode(F.array(left, rest) if include_left else F.array(rest)).alias("x"))
    out = made.select("query_key", "gid", "o_gid", "length", F.lit(atype).alias("atype"), "x.a", "x.b", "x.n", "x.side").filter(c("n") > least)
    return out.filter(size_ok(c("n"), c("atype"))) if lim_size else out


def sub_alignment(i: Column, n: Column, sa: Column, sb: Column, direction: Column) -> Column:
    """Subject region (sa, sb) of the part of an alignment that starts i into it and has n positions."""
    return F.when(direction == 1, F.struct((sa + i).alias("sa"), (sa + i + n).alias("sb"))).otherwise(F.struct((sb - i - n).alias("sa"), (sb - i).alias("sb")))
