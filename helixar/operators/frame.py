"""Named columns over explicit axes: the tidy form of multi-dimensional column tables.

A frame is a DataFrame whose `axes` columns identify a cell; the others hold values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixar.functions import shared


def values_of(df: DataFrame, axes: list[str]) -> list[str]:
    return [c for c in df.columns if c not in axes]


def apply(df: DataFrame, axes: list[str], f: Callable[[Column], Column]) -> DataFrame:
    """f on every value column."""
    return df.select(*axes, *[f(F.col(c)).alias(c) for c in values_of(df, axes)])


def aggregate(df: DataFrame, axes: list[str], over: str, f: Callable[[str], Column]) -> DataFrame:
    """f over one axis, for every value column."""
    rest = [a for a in axes if a != over]
    return df.groupBy(*rest).agg(*[f(c).alias(c) for c in values_of(df, axes)])


def prefix(df: DataFrame, axes: list[str], text: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{text}{c}" for c in values_of(df, axes)})


def suffix(df: DataFrame, axes: list[str], text: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{text}" for c in values_of(df, axes)})


def concat(frames: list[DataFrame], axis: str) -> DataFrame:
    """Frames on end along a new axis; columns that a frame lacks are null."""
    tagged = [f.withColumn(axis, F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge(left: DataFrame, right: DataFrame, axes: list[str]) -> DataFrame:
    """Columns of both by cell; of equal names the right one's values stay."""
    return left.drop(*[c for c in values_of(right, axes) if c in left.columns]).join(right, axes)


def arithmetic(left: DataFrame, right: DataFrame, axes: list[str], f: Callable[[Column, Column], Column]) -> DataFrame:
    """f of the two frames' equal value columns, cell by cell."""
    names = [c for c in values_of(left, axes) if c in right.columns]
    r = right.select(*axes, *[F.col(c).alias(f"_r_{c}") for c in names])
    return left.join(r, axes).select(*axes, *[f(F.col(c), F.col(f"_r_{c}")).alias(c) for c in names])


def lex_argmin(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the least values of `order`, in that order; NaN comes last."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("w")).select(*keys, "w.*")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that come more than once, with their count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def prioritize(items: Column, first: Column) -> Column:
    """The items at the 0-based indices of `first`, in that order, then the others in theirs."""
    there = F.filter(first, lambda i: (i >= 0) & (i < F.size(items)))
    rest = F.filter(items, lambda x, i: ~F.array_contains(first, i))
    return F.when((F.size(there) == F.size(first)), F.concat(F.transform(there, lambda i: F.get(items, i)), rest)).otherwise(items)


def last_of(df: DataFrame, keys: list[str], order: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """The last row by `order` of each key; `names` renames value columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    out = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("w")).select(*keys, "w.*")
    return out.withColumnsRenamed(names or {})


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """df with dense numbers from 0 in an order that tells all rows apart (null first): places in the parts of a range sort plus
    the sizes of the parts before. Rows move once, the parts are held; only a count per part reaches the driver."""
    spark = df.sparkSession
    shared.folder(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the part's number in the upper bits, the place in it in the lower 33
    dealt = shared.held(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at), "numbered")
    part = F.shiftright("_at", 33).cast("int")
    sizes = sorted(dealt.groupBy(part.alias("_part")).count().collect())  # a row per part
    bases = [(part, sum(k for _, k in sizes[:i])) for i, (part, _) in enumerate(sizes)]
    base = F.broadcast(spark.createDataFrame(bases, "_part int, _base long"))
    number = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_base")
    return dealt.withColumn("_part", part).join(base, "_part").withColumn(into, number).drop("_part", "_base", "_at")
