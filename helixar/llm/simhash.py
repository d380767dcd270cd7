"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits over word shingles, each bit 1 if set in over half of the shingles' XXH64 hashes.

Covering tables: every bit position i gets a random nonzero vector m(i) of radius + 1 bits; table v (each nonzero vector)
keeps the bits with <m(i), v> = 1. Two fingerprints that differ in at most `radius` bits have at most `radius`
vectors m(i) in the way, to which some nonzero v is orthogonal: in that table they collide. So no pair is lost, whatever
the vectors; links are then verified exactly.

Equal fingerprints are one node, so groups of copies cost nothing. A bucket is searched by spreading from node to node
over what is not reached yet, and gives one edge per reached node, never all pairs. A bucket beyond `most` nodes
is dealt anew: the bits that its table does not keep fall in radius + 1 parts, and two linked nodes agree in all bits of
one part at least, so fixing each part in turn reaches every link; what is still too large is cut again. With f bits
left free a bucket has at most 2 ** f nodes, so this ends.
Components: random contraction rounds (every node takes the smallest random rank near it), each a few joins over a
shrinking edge table written to the shared folder.

Cases: null or empty text has fingerprint zero, linked like any other; null doc_id is kept and never names a component unless
the whole component has none; repeated rows are kept; an empty table gives no rows; other columns are carried on request.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixar.llm import common

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        ends_all = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends_all[:-shingle] + 1]).tolist()
        ends = ends_all[shingle - 1 :].tolist()
    hash_of = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        h = np.array([hash_of(joined[a:b], seed) for a, b in zip(starts[i : i + 65536], ends[i : i + 65536], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, shingle: int = 3, into: str = "fp") -> DataFrame:
    """`carry` columns and the fingerprint as a signed long, written to the shared folder."""
    carry = carry or docs.columns

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps)], [*batch.schema.names[1:], into])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias(common.free_name(carry, "_text")), *[F.col(f"`{c}`") for c in carry])
    schema = docs.select(*[F.col(f"`{c}`") for c in carry]).schema.add(into, "long")
    return common.materialize(rows.mapInArrow(run, schema), "fingerprints")


def covering_masks(radius: int = 3, bits: int = 64, seed: int = 5) -> list[int]:
    """2 ** (radius + 1) - 1 masks; every set of at most `radius` bits is outside of one of them."""
    rng = np.random.default_rng(seed)
    vectors = rng.permutation([1 + i % ((2 << radius) - 1) for i in range(bits)]).tolist()
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 << radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spread(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest of its component, node) of the components of distinct fps under links within the radius."""
    left, a, b = np.sort(fps), [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            for x in front:
                reached |= np.bitwise_count(left ^ x) <= radius
            front, left = left[reached], left[~reached]
            a.append(np.full(len(front), root))
            b.append(front)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _bucket_edges(batches, radius: int):
    """Sorted (bucket hash.., fp) rows in; edges out. Runs of equal buckets may cross batches."""
    rest: list[np.ndarray] = []

    def edges(table, key, fp):
        new = np.concatenate([[True], (table[1:] != table[:-1]) | (key[1:] != key[:-1])])
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate([at, [len(fp)]]))
        run = np.repeat(np.arange(len(at)), size)
        small = np.repeat(size <= 8, size)
        a, b = [], []
        u = fp.view(np.uint64)
        for d in range(1, min(8, int(size.max()))):
            ok = small[:-d] & (run[d:] == run[:-d]) & (np.bitwise_count(u[d:] ^ u[:-d]) <= radius)
            a.append(fp[:-d][ok])
            b.append(fp[d:][ok])
        for i in np.flatnonzero(size > 8):
            x, y = spread(u[at[i] : at[i] + size[i]], radius)
            a.append(x.view(np.int64))
            b.append(y.view(np.int64))
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        cols = [np.asarray(batch.column(i)) for i in range(3)]
        if not len(cols[0]):
            continue
        cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)] if rest else cols
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield edges(*[c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
    if rest and len(rest[0]):
        yield edges(*rest)


def link_edges(nodes: DataFrame, radius: int = 3, most: int = 16_384) -> DataFrame:
    """(a, b) edges, a < b, with the same components as all links among the distinct `fp` of nodes."""
    masks, most = covering_masks(radius), max(most, 2 << radius)  # so a larger bucket has more than radius + 1 free bits, to be cut
    keyed = nodes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"), F.lit(_signed(~m & (1 << 64) - 1)).alias("free")) for i, m in enumerate(masks)])).alias("x"), "fp").select(F.col("x.t").cast("long").alias("t"), "x.key", "x.free", "fp")
    keyed = common.materialize(keyed, "keyed")
    found = []
    while True:
        sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sizes = common.materialize(sizes, "sizes")
        live = keyed.join(sizes.filter(F.col("n") <= most).select("t", "key"), ["t", "key"], "left_semi")
        ordered = live.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
        found.append(ordered.mapInArrow(lambda batches: _bucket_edges(batches, radius), "a long, b long"))
        if sizes.filter(F.col("n") > most).isEmpty():
            break
        # Of radius + 1 parts of the free bits, two linked nodes agree in one: fix each part in turn.
        large = keyed.join(sizes.filter(F.col("n") > most).select("t", "key"), ["t", "key"], "left_semi")
        splits = {}
        for m in {r[0] for r in keyed.select("free").distinct().collect()}:  # at most masks * (radius + 1) ** depth values
            own = [i for i in range(64) if (m >> i) & 1]
            parts = [sum(1 << i for i in own[j :: radius + 1]) for j in range(radius + 1)]
            splits[m] = parts
        rows = [(m, j, _signed(part), _signed((m & (1 << 64) - 1) & ~part)) for m, parts in splits.items() for j, part in enumerate(parts)]
        table = common.small_frame(nodes.sparkSession, rows, "free long, j long, part long, rest long")
        keyed = common.materialize(
            large.join(table, "free").select(F.xxhash64("t", "key", "j").alias("t"), F.xxhash64("t", "key", "j", F.col("fp").bitwiseAND(F.col("part"))).alias("key"), F.col("rest").alias("free"), "fp"), "keyed"
        )
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def components(edges: DataFrame, seed: int = 11) -> DataFrame:
    """(node, root): every node of the edges with one node of its component, by random contraction."""
    spark = edges.sparkSession
    edges = common.materialize(edges.select("a", "b"), "edges")
    label, rounds, done = None, 0, []
    while not edges.isEmpty():
        rank = lambda c, r=rounds: F.xxhash64(F.lit(seed + r), F.col(c))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("to"))
        step = common.materialize(near.select(F.col("a").alias("node"), F.least(own, "m")["to"].alias("to")), "step")
        at_b = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        merged = edges.join(step.withColumnRenamed("node", "a"), "a").select("b", F.col("to").alias("to_a")).join(at_b, "b")
        edges = common.materialize(merged.filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        done.append(step)
        rounds += 1
    for step in reversed(done):  # from the last round back: each node's root is its target's root
        if label is None:
            label = step.select("node", F.col("to").alias("root"))
            continue
        later = label.select(F.col("node").alias("to"), "root")
        label = common.materialize(step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "label")
    return label if label is not None else spark.createDataFrame([], "node long, root long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, most: int = 16_384) -> DataFrame:
    """`carry` columns (default: the id) with fingerprint (hex), root (signed fingerprint that stands for the component) and component_id.

    Carried columns named like a result, in any case, give way to it.
    """
    carry = [c for c in (carry or [id_col]) if c.lower() not in ("fingerprint", "component_id", "root")]
    own = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*carry, id_col]))}
    slim = docs.select(F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(x) for c, x in own.items()])
    known = fingerprints(slim, "text", list(own.values()), shingle, "fp")
    nodes = common.materialize(known.groupBy("fp").agg(F.min(own[id_col]).alias("least")), "nodes")
    roots = common.materialize(components(link_edges(nodes, radius, most)), "roots")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = roots.join(nodes, roots["node"] == nodes["fp"]).groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("_least"))
    table = named.join(least, named["root"] == F.col("_root"), "left").select("fp", "root", F.coalesce("_least", "least").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    # copies of a text, and all empty ones, are one key
    return common.join_spread(known, table, "fp").select(*[F.col(own[c]).alias(c) for c in carry], hexed.alias("fingerprint"), "root", "component_id")
