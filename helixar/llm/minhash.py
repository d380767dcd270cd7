"""Near-duplicates by the Jaccard similarity of word shingles: candidates by MinHash bands, each verified exactly.

Texts with the same set of shingles (XXH64 of lower-cased words) are one node, so groups of copies cost nothing. 32 bands of
4 minima each miss a pair of similarity s with chance (1 - s ** 4) ** 32, at 0.8 less than one in ten million; what is
below the least similarity never links, as the sets themselves are compared.

Buckets of up to `small` nodes are compared pair by pair. In larger ones two bounds from above spare comparisons. In
buckets of over `huge` nodes those shingles with an even hash are counted that stand in no other such node: a node with more of
them than a similar one may lack cannot link at all and leaves these buckets. (A counted shingle costs as much as some dozen looks
at a pair's bitmaps, so in smaller buckets the count costs more than it spares.) And each node has a bitmap of parities, one bit for all shingles whose hashes
agree in their last bits: a shingle that only one of two sets holds turns one bit, so the sets differ in at least as many
shingles as the bitmaps do in bits. (Sets of over 2,300 shingles may differ in more than 1,024 bits can show; they are
compared on the sets themselves.) Then a few rounds compare every node with one node of the bucket, if the two are not in one
component yet, first with the one of the smallest share of shingles of its own, then with drawn ones, until a round adds few links; last, whatever stands outside of
the bucket's largest component is compared with all the rest. So large groups of near copies take few comparisons, and no
pair is left out that could join two components.

With a `radius`, sets whose SimHash fingerprints differ in at most so many bits link as well: these links come first, all of them, from
the covering tables of simhash.py, and MinHash adds the similar sets that lie further apart.

Cases: null or empty text has the empty set, linked like any other; a text of fewer words than a shingle is one shingle;
null doc_id is kept and never names a component unless the whole component has none; repeated rows are kept; an empty
table gives no rows; other columns are carried on request.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from helixar.llm import common, simhash

BANDS, ROWS = 32, 4
BITMAP = 16  # longs of 64 bits
_rng = np.random.default_rng(17)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)


def shingles(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = text.encode().translate(simhash._LOWER).split() if text else []
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(b" ".join(words[i : i + shingle]), seed) for i in range(max(len(words) - shingle + 1, min(len(words), 1)))], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; equal keys make two sets candidates."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[i : i + 4096, None] * _TIMES + _PLUS).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The parities of a set: bit i is the number of hashes that leave i, modulo 2."""
    return np.packbits(np.bincount((hashes % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1, bitorder="little").view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set: each of 64 bits is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[i : i + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def text_hashes(text_col: str) -> list[Column]:
    """Two 64-bit hashes of the text (null as the empty text), by which rows of documents are met again."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(7), text).alias("_h2")]


def signatures(docs: DataFrame, text_col: str, carry: list[str], shingle: int) -> DataFrame:
    """`carry` columns, hashes of the text, _node (hash of the set), _n (its size), _fp (its fingerprint) and _bands, written to the shared folder."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), shingle) for t in batch.column(0)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            keys = np.concatenate([np.empty(0, np.uint64), *map(band_keys, sets)]).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            fps = pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(node), pa.array([len(s) for s in sets], pa.int32()), fps, bands], [*batch.schema.names[1:], "_node", "_n", "_fp", "_bands"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias(common.free_name(carry, "_text")), *[F.col(f"`{c}`") for c in carry], *text_hashes(text_col))
    schema = docs.select(*[F.col(f"`{c}`") for c in carry], *text_hashes(text_col)).schema.add("_node", "long").add("_n", "integer").add("_fp", "long").add("_bands", ArrayType(LongType()))
    return common.materialize(rows.mapInArrow(common.tidy(run), schema), "signatures")


def shingle_sets(docs: DataFrame, known: DataFrame, wanted: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, set, bits) of the wanted nodes, from one text of each."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), shingle) for t in batch.column(1)]
            columns = [pa.array([f(x) for x in sets], pa.list_(pa.int64())) for f in (lambda x: x.view(np.int64), bitmap)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["node", "set", "bits"])

    # copies of a text end in the task that reads them, before the nodes are dealt out
    one = known.groupBy(F.col("_node").alias("node")).agg(F.min(F.struct("_h1", "_h2")).alias("h")).join(wanted, "node", "left_semi").select("node", "h._h1", "h._h2")
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *text_hashes(text_col)).join(one, ["_h1", "_h2"])
    return common.materialize(texts.groupBy("node").agg(F.min("text").alias("text")).mapInArrow(common.tidy(run), "node long, set array<long>, bits array<long>"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar."""
    x = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    x = x.withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return x.filter(F.col("i") >= F.lit(least) * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): how many of a node's shingles with an even hash stand in no other node; nodes without any are left out.

    Half of the shingles take half of the rows, and what they count is a lower bound of the whole count.
    """
    even = sets.select("node", F.explode(F.filter("set", lambda x: x.bitwiseAND(F.lit(1)) == 0)).alias("x"))
    alone = even.groupBy("x").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1")
    return alone.groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("own"))


def fingerprint_edges(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b) edges with the same components as all links of fingerprints within the radius among nodes(node, fp)."""
    first = common.materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "first")
    equal = nodes.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    at_a, at_b = (first.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    near = simhash.link_edges(first.select("fp"), radius).join(at_a, "a").join(at_b, "b")
    return equal.unionByName(near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def link_edges(docs: DataFrame, nodes: DataFrame, known: DataFrame, text_col: str, least: float, shingle: int, small: int, rounds: int, huge: int = 1000, radius: int | None = None) -> DataFrame:
    """(a, b) edges with the same components as all verified candidates among nodes(node, n, fp, bands), and as all links of fingerprints
    within the radius, if there is one."""
    spark = nodes.sparkSession
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = common.materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    live = common.materialize(keyed.join(sizes, "key"), "live")
    sets = shingle_sets(docs, known, live.select("node").distinct(), text_col, shingle)
    near = F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb")

    most = F.least("ma", "mb")  # shingles that two sets can have in common
    able = most >= F.lit(least) * (F.col("na") + F.col("nb") - most)
    apart = F.lit((1 - least) / (1 + least)) * (F.col("na") + F.col("nb")) + 1e-6  # shingles of one alone that two similar sets can have
    bits = [f"bit{i}" for i in range(BITMAP)]

    def pairs(x: DataFrame, y: DataFrame, condition) -> DataFrame:
        a, b = (z.select("key", F.col("node").alias(s), *[F.col(c).alias(f"{c[0]}{s}") for c in ("n", "m", "comp")], *[F.col(c).alias(f"{c}{s}") for c in z.columns if c in bits]) for s, z in (("a", x), ("b", y)))
        both = a.join(b, (a["key"] == b["key"]) & near & able & condition)
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    large = live.filter(F.col("size") > small)
    single = live.filter(F.col("size") <= small).withColumns({"comp": F.col("node"), "m": F.col("n")})
    edges = verified(pairs(single, single, F.col("a") < F.col("b")), sets, least)
    edges = common.materialize(edges if radius is None else fingerprint_edges(nodes, radius).unionByName(edges), "links")
    if large.isEmpty():
        return edges
    sets = common.materialize(sets.join(large.select("node").distinct(), "node", "left_semi"), "sets")
    most_shared = F.col("n") - F.coalesce("own", F.lit(0))
    own = own_shingles(sets.join(large.filter(F.col("size") > huge).select("node").distinct(), "node", "left_semi"))
    fits = F.col("m") >= F.lit(least) * F.col("n")  # the nodes of other buckets were not counted, so these keep all theirs
    large = large.join(own, "node", "left").withColumn("m", F.when(F.col("size") > huge, most_shared).otherwise(F.col("n"))).drop("own")
    large = common.materialize(large.filter(fits), "large")
    r, links = 0, edges.count()
    while r <= rounds:
        roots = simhash.components(edges).select("node", F.col("root").alias("comp"))
        at = common.materialize(large.join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
        split = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64(F.lit(r), "node").alias("r") if r else ((F.col("n") - F.col("m")) / F.greatest("n", F.lit(1))).alias("r"), "node", "n", "m", "comp")).alias("one")).filter("lo <> hi")
        split = common.materialize(split, "split")
        if split.isEmpty():
            break
        other = F.col("ca") != F.col("cb")
        if r < rounds:
            found = pairs(split.select("key", "one.*"), at, other)
        else:
            open_ = at.join(split.select("key"), "key", "left_semi")
            main = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
            open_ = common.materialize(open_.join(sets.select("node", *[F.col("bits")[i].alias(c) for i, c in enumerate(bits)]), "node"), "open")
            # The pairs of a large bucket are a grid of k parts by k, each a key of its own, so a row goes to k of them.
            k = F.least(F.lit(64), F.ceil(F.col("size") / 512)).cast("int")
            part, each = F.pmod(F.xxhash64("node"), k).cast("int"), F.explode(F.sequence(F.lit(0), k - 1))
            cells = lambda x, i, j: x.withColumns({"own": part, "each": each}).withColumn("key", F.struct("key", F.col(i).alias("i"), F.col(j).alias("j"))).drop("own", "each")
            turned = sum((F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in bits), F.lit(0))
            outside = open_.join(main, "key").filter("comp <> main")
            found = pairs(cells(outside, "own", "each"), cells(open_, "each", "own"), other & (turned <= apart))
        edges, before = common.materialize(edges.unionByName(verified(found, sets, least)), "links"), links
        links = edges.count()
        r = rounds if r < rounds and links - before <= before // 100 else r + 1
    return edges


def near_duplicates(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, small: int = 32, rounds: int = 4, huge: int = 1000, radius: int | None = None) -> DataFrame:
    """`carry` columns (default: the id) with root (stands for the component) and component_id.

    Carried columns named like a result, in any case, give way to it.
    """
    carry = [c for c in (carry or [id_col]) if c.lower() not in ("root", "component_id")]
    own = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*carry, id_col]))}
    slim = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    out = _linked(slim, least, shingle, own[id_col], "text", list(own.values()), small, rounds, huge, radius)
    return out.select(*[F.col(own[c]).alias(c) for c in carry], "root", "component_id")


def _linked(docs: DataFrame, least: float, shingle: int, id_col: str, text_col: str, carry: list[str], small: int, rounds: int, huge: int = 1000, radius: int | None = None) -> DataFrame:
    known = signatures(docs, text_col, list(dict.fromkeys([*carry, id_col])), shingle)
    nodes = known.groupBy(F.col("_node").alias("node")).agg(F.min(F.col(f"`{id_col}`")).alias("least"), F.first("_n").alias("n"), F.first("_fp").alias("fp"), F.first("_bands").alias("bands"))
    nodes = common.materialize(nodes, "nodes")
    roots = common.materialize(simhash.components(link_edges(docs, nodes, known, text_col, least, shingle, small, rounds, huge, radius)), "roots")
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = roots.join(nodes, "node").groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("_least"))
    table = named.join(first, named["root"] == F.col("_root"), "left").select(F.col("node").alias("_node"), "root", F.coalesce("_least", "least").alias("component_id"))
    return common.join_spread(known.drop("_bands", "_fp"), table, "_node")  # copies of a text, and all empty ones, are one key


def keep_one(docs: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", small: int = 32, rounds: int = 4, radius: int | None = None) -> DataFrame:
    """One row of every component: of the rows with its least id (null last) the one with the least hashes of the text, and of
    equal ids and texts the one with the least other columns, so a second run keeps the same rows.

    Ids and hashes alone are searched and written; the working tables of the search are deleted before this returns, and
    whole rows move once, to meet the keys that stay.
    """
    spark, names = docs.sparkSession, docs.columns
    made: list[str] = []
    for x in ("_a1", "_a2", "_none", "_id", "_rank"):
        made.append(common.free_name([*names, *made], x))
    a1, a2, none, own, rank = made
    with common.Working(spark) as working:
        key = F.struct(F.col("c0").isNull().alias("none"), F.col("c0").alias("id"), "_h1", "_h2")
        slim = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("c0"))
        kept = _linked(slim, least, shingle, "c0", "text", [], small, rounds, radius=radius).groupBy("root").agg(F.min(key).alias("k")).select(F.col("k._h1").alias(a1), F.col("k._h2").alias(a2), F.col("k.none").alias(none), F.col("k.id").alias(own))
        path = f"{common.shared_dir(spark)}/kept-{common.uuid.uuid4().hex}"
        kept.write.parquet(path)
        kept = spark.read.schema(kept.schema).parquet(path)
    working.release()
    common.note(path)
    h1, h2 = text_hashes(text_col)
    rows = docs.withColumns({a1: h1, a2: h2, none: F.col(f"`{id_col}`").isNull(), own: F.col(f"`{id_col}`")})
    same = [rows[f"`{x}`"] == kept[f"`{x}`"] for x in (a1, a2, none)]
    rows = rows.join(kept, [*same, rows[f"`{own}`"].eqNullSafe(kept[f"`{own}`"])], "left_semi")
    order = [F.xxhash64(*[F.col(f"`{c}`") for c in names]), *[F.col(f"`{c}`").cast("string") for c in names if c != text_col]]
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy(*[F.col(f"`{x}`") for x in (a1, a2, none, own)]).orderBy(*order)))
    return rows.filter(F.col(f"`{rank}`") == 1).select(*[F.col(f"`{c}`") for c in names])
