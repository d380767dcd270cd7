"""Features carried through slices, turns, reverse complements and joins of sequences, as expressions over arrays of LOCATED.

A feature has parts in the order of the top strand; on a circle a part that ends at the last base and one that starts at the
first are neighbours. `restored` finds features again by their bases, wherever these stand in a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixar.functions import sequences as S
from helixar.operators import match
from helixar.sources.sequences import LOCATED


def _part(start: Column, end: Column, strand: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), strand.cast("int").alias("strand"))


def _with(f: Column, parts: Column, strand: Column | None = None) -> Column:
    """f at other parts."""
    own = f["strand"] if strand is None else strand
    return F.struct(parts[0]["start"].alias("start"), F.element_at(parts, -1)["end"].alias("end"), own.cast("int").alias("strand"), f["name"].alias("name"), f["type"].alias("type"), parts.alias("parts"))


def annotation(name: Column, start: Column, n: Column, length: Column, kind: str = "misc_feature", strand: int = 1) -> Column:
    """A feature of n bases from start, in two parts if it crosses the origin."""
    s, k = F.pmod(start, length), F.lit(strand)
    parts = F.when(s + n > length, F.array(_part(s, length, k), _part(F.lit(0), s + n - length, k))).otherwise(F.array(_part(s, s + n, k)))
    return _with(F.struct(name.cast("string").alias("name"), F.lit(kind).alias("type"), k.alias("strand")), parts)


def located(features: Column, length: Column, has_parts: bool) -> Column:
    """Features with parts; those of FEATURES get one, or two over the origin where the end is not behind the start. Null gives none."""
    if has_parts:
        out = features
    else:
        one = lambda f: F.array(_part(f["start"], f["end"], f["strand"]))
        two = lambda f: F.array(_part(f["start"], length, f["strand"]), _part(F.lit(0), f["end"], f["strand"]))
        out = F.transform(features, lambda f: _with(f, F.when((f["end"] < f["start"]), two(f)).otherwise(one(f))))
    return F.coalesce(out, F.array()).cast(LOCATED)


def sliced(features: Column, a: Column, n: Column, length: Column, partial: bool = False) -> Column:
    """Features of the slice of n bases from a, around the origin if need be, counted from its start.

    Only features whose bases all lie in it are kept; partial: what lies in it of all others, too.
    """
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda t, p: t + p["end"] - p["start"])

    def pieces(p: Column) -> Column:
        at, m = F.pmod(p["start"] - a, length), p["end"] - p["start"]
        piece = lambda x, y, first, last: F.struct(x.cast("int").alias("start"), y.cast("int").alias("end"), p["strand"].alias("strand"), first.alias("first"), last.alias("last"))
        # first, last: whether it begins at the origin and ends there, uncut
        whole = (p["start"] == 0, p["end"] == length)
        head = F.when(at < n, F.array(piece(at, F.least(at + m, n), whole[0], whole[1] & (at + m <= n)))).otherwise(F.array())
        tail = F.when(at + m > length, F.array(piece(F.lit(0), F.least(at + m - length, n), F.lit(False), whole[1] & (at + m - length <= n)))).otherwise(F.array())
        return F.concat(head, tail)

    def joined(all_pieces: Column) -> Column:
        last = lambda t: F.element_at(t, -1)
        meets = lambda t, p: (F.size(t) > 0) & F.try_element_at(t, F.lit(-1))["last"] & p["first"] & (F.try_element_at(t, F.lit(-1))["end"] == p["start"]) & (F.try_element_at(t, F.lit(-1))["strand"] == p["strand"])
        grown = lambda t, p: F.concat(F.slice(t, 1, F.size(t) - 1), F.array(F.struct(last(t)["start"].alias("start"), p["end"].alias("end"), p["strand"].alias("strand"), last(t)["first"].alias("first"), p["last"].alias("last"))))
        none = F.array().cast("array<struct<start:int,end:int,strand:int,first:boolean,last:boolean>>")
        out = F.aggregate(all_pieces, none, lambda t, p: F.when(meets(t, p), grown(t, p)).otherwise(F.array_append(t, p)))
        return F.transform(out, lambda p: _part(p["start"], p["end"], p["strand"]))

    cut = F.transform(features, lambda f: F.struct(f.alias("f"), joined(F.flatten(F.transform(f["parts"], pieces))).alias("parts")))
    fits = lambda x: (F.size(x["parts"]) > 0) if partial else (F.size(x["parts"]) > 0) & (size(x["parts"]) == size(x["f"]["parts"]))
    return F.transform(F.filter(cut, fits), lambda x: _with(x["f"], x["parts"])).cast(LOCATED)


def turned(features: Column, origin: Column, length: Column) -> Column:
    """Features of a circle whose first base is `origin` from now on."""
    return sliced(features, origin, length, length)


def reversed_(features: Column, length: Column) -> Column:
    """Features of the reverse complement."""
    flip = lambda f: F.reverse(F.transform(f["parts"], lambda p: _part(length - p["end"], length - p["start"], -p["strand"])))
    return F.transform(features, lambda f: _with(f, flip(f), -f["strand"])).cast(LOCATED)


def moved(features: Column, by: Column, length: Column) -> Column:
    """Features of a sequence that stands from `by` on in a circle of `length`."""

    def parts(p: Column) -> Column:
        at, m = F.pmod(p["start"] + by, length), p["end"] - p["start"]
        return F.when(at + m > length, F.array(_part(at, length, p["strand"]), _part(F.lit(0), at + m - length, p["strand"]))).otherwise(F.array(_part(at, at + m, p["strand"])))

    return F.transform(features, lambda f: _with(f, F.flatten(F.transform(f["parts"], parts)))).cast(LOCATED)


def bases_of(bases: Column, f: Column) -> Column:
    """The bases of a feature, in reading order."""
    top = F.array_join(F.transform(f["parts"], lambda p: F.substring(bases, p["start"] + 1, p["end"] - p["start"])), "")
    return F.when(f["strand"] == -1, S.reverse_complement(top)).otherwise(top)


def restored(products: DataFrame, sources: DataFrame, least: int = 14) -> DataFrame:
    """(key, features): all places in products(key, bases, is_circular) where the bases of a feature of sources(key, bases,
    features) stand, on either strand; the features' bases are one piece there, so parts that a gap kept apart are not looked for."""
    c = F.col
    known = sources.select(F.upper("bases").alias("bases"), F.explode("features").alias("f")).filter(c("f.strand") != 0)
    known = known.select(bases_of(c("bases"), c("f")).alias("bases"), c("f.name").alias("name"), c("f.type").alias("type")).distinct().filter(F.length("bases") >= least)
    subjects = known.select(F.sha1("bases").alias("key"), "bases").distinct()
    hits = match.to_regions(match.whole_matches(products, subjects, least), "")
    found = hits.join(known.select(F.sha1("bases").alias("subject_key"), "name", "type"), "subject_key")
    one = annotation(c("name"), c("a"), c("n"), c("length"))
    f = F.transform(F.array(one), lambda x: _with(F.struct(x["name"].alias("name"), c("type").alias("type")), F.transform(x["parts"], lambda p: _part(p["start"], p["end"], c("direction"))), c("direction")))[0]
    placed = found.select(c("query_key").alias("key"), f.alias("f"))
    return placed.groupBy("key").agg(F.sort_array(F.collect_set("f")).alias("features"))


def of_molecules(reactions: DataFrame, goals: DataFrame) -> DataFrame:
    """The different molecules of reactions as records (key, name, bases, length, is_circular, features): products with the
    features of goals(key[, features]) that lie in their regions, the others without."""
    c = F.col
    side = F.explode(F.concat(F.col("inputs"), F.col("outputs"))).alias("m")
    m = reactions.select("design_key", side).select("design_key", "m.mtype", "m.seq", "m.key", "m.region").filter(F.length("seq") > 0)
    if "features" in goals.columns:
        has_parts = "parts" in goals.schema["features"].dataType.elementType.names
        g = goals.select(c("key").alias("design_key"), located(c("features"), F.length("bases"), has_parts).alias("_f"))
        n = F.when(c("region.b") > c("region.a"), c("region.b") - c("region.a")).otherwise(c("region.b") - c("region.a") + c("region.context_length"))
        m = m.join(g, "design_key", "left").withColumn("features", F.when(c("region").isNotNull() & (F.length("seq") == n), sliced(c("_f"), c("region.a"), n, c("region.context_length"))))
    else:
        m = m.withColumn("features", F.lit(None).cast(LOCATED))
    name = F.coalesce("key", F.concat_ws("_", F.lower("mtype"), F.substring(S.content_key(c("seq")), 1, 10)))
    rows = m.select(F.regexp_replace(name, r"\s+", "_").alias("key"), c("mtype").alias("name"), c("seq").alias("bases"), F.length("seq").alias("length"), (c("mtype") == "PLASMID").alias("is_circular"), F.coalesce("features", F.array().cast(LOCATED)).alias("features"))
    return rows.groupBy("key", "name", "bases", "length", "is_circular").agg(F.max("features").alias("features"))
