"""Benchmark decontamination by winnowing.

Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters. A shared span of `span` words (an item of
fewer: the whole item) holds `span - k + 1` consecutive k-grams; the k-gram with the smallest hash of each such window is
kept on both sides, so both sides keep the same one inside every shared span. Kept fingerprints of documents are
joined with those of the benchmark. A hit is extended to all spans of the document that hold its k-gram: each is looked up by its
hash among the benchmark's different spans and compared word by word (words as numbers given by the benchmark's
vocabulary). A place is looked at once, however many hits are around it, so the work is linear in the text, repetitive
ones too; the items of a span are kept once per different span.

A benchmark of up to block_words words is one broadcast block, and documents are read once and never shuffled. A larger one
goes in such blocks, over candidates alone: a Bloom filter of all kept fingerprints (bloom_bits, a parameter, so bounded;
it loses none) picks the different texts that hold one, which are written once; each block reads these and writes its hits, and the
hits of a text meet the documents by the text's hashes.

Cases: null or empty text has no words, so no hits; an item without words never occurs; a null item_id is written as an
empty string; repeated items count once by id; repeated documents give a row each; empty tables give no rows or no
hits; with `carry`, columns named like a result give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixar.llm import common

_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
MADE = ("n_words", "n_hit", "items", "spans")
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    """The words, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word numbers."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        h = (h ^ (ids[i : i + n].astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


def gram_hashes_of_rows(rows: np.ndarray) -> np.ndarray:
    """The same hash of each row's words."""
    h = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        h = (h ^ (rows[:, i].astype(np.uint64) + np.uint64(1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest hash (the last one of equals) of every `width` consecutive hashes."""
    if len(h) < width:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, width)[:, ::-1]
    return np.unique(np.arange(len(views)) + width - 1 - views.argmin(1))


def stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of every run of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


class Spans:
    """The different spans of t words of a block's items: fingerprints, hashes, words and items of each."""

    def __init__(self, items: list[np.ndarray], which: list[int], t: int, k: int):
        self.t, self.k = t, min(k, t)
        self.prints = np.unique(np.concatenate([(h := gram_hashes(items[j], self.k))[winnow(h, t - self.k + 1)] for j in which]))
        words = np.concatenate([np.lib.stride_tricks.sliding_window_view(items[j], t) for j in which]).astype(np.int32)
        of = np.repeat(np.asarray(which), [len(items[j]) - t + 1 for j in which])
        raw = np.ascontiguousarray(words).view(np.dtype((np.void, 4 * t))).ravel()
        _, first, number = np.unique(raw, return_index=True, return_inverse=True)
        hashes = gram_hashes_of_rows(words[first])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.words = hashes[order], words[first][order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(rank[number.ravel()] * (int(of.max()) + 1) + of)
        span, self.item = np.divmod(pairs, int(of.max()) + 1)
        self.bounds = np.searchsorted(span, np.arange(len(order) + 1))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the spans of ids (all known words) that occur, and the numbers of the spans."""
        t, k = self.t, self.k
        at = winnow(h := gram_hashes(ids, k), t - k + 1)
        at = at[np.isin(h[at], self.prints)]
        if not len(at):
            return at, at
        n = len(ids) - t + 1
        around = np.zeros(n + 1, np.int64)  # spans that hold a hit's k-gram
        np.add.at(around, np.maximum(at - (t - k), 0), 1)
        np.add.at(around, np.minimum(at + 1, n), -1)
        start = np.flatnonzero(np.cumsum(around[:-1]) > 0)
        views = np.lib.stride_tricks.sliding_window_view(ids, t)
        h = gram_hashes_of_rows(views[start])
        place = np.searchsorted(self.hashes, h)
        starts, found = [], []
        while len(start):  # once, and again for spans of equal hash
            ok = place < len(self.hashes)
            ok[ok] = self.hashes[place[ok]] == h[ok]
            start, place, h = start[ok], place[ok], h[ok]
            same = (views[start] == self.words[place]).all(1)
            starts.append(start[same])
            found.append(place[same])
            start, place, h = start[~same], place[~same] + 1, h[~same]
        return np.concatenate(starts), np.concatenate(found)


class Block:
    """A bounded part of the benchmark: its vocabulary, its items as numbers, and their spans for each length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], span: int, k: int):
        self.names = [name for name, _ in items]
        self.vocab: dict[bytes, int] = {}
        numbers = [np.asarray([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int64) for _, words in items]
        by_length: dict[int, list[int]] = {}
        for j, x in enumerate(numbers):
            by_length.setdefault(min(span, len(x)), []).append(j)
        self.spans = [Spans(numbers, which, t, k) for t, which in sorted(by_length.items())]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray | None, set[int]]:
        """Which words lie in a shared span (None: none), and the items that have one."""
        mask, found = None, np.zeros(len(self.names), bool)
        runs = stretches(ids >= 0)
        for s in self.spans:
            for a, b in runs:
                if b - a < s.t:
                    continue
                start, number = s.find(ids[a:b])
                if len(start):
                    step = np.zeros(b - a + 1, np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + s.t, -1)
                    mask = np.zeros(len(ids), bool) if mask is None else mask
                    mask[a:b] |= np.cumsum(step[:-1]) > 0
                    for x in np.unique(number).tolist():
                        found[s.item[s.bounds[x] : s.bounds[x + 1]]] = True
        return mask, set(np.flatnonzero(found).tolist())


class Bloom:
    """Fingerprints of (span length, k-gram of hashed words): a bit array of fixed size with `ways` bits a fingerprint."""

    def __init__(self, bits: int, ways: int = 4):
        self.bits, self.ways, self.words, self.lengths = bits, ways, np.zeros(bits >> 6, np.uint64), []

    def places(self, h: np.ndarray, t: int) -> np.ndarray:
        """(ways, n) bit numbers."""
        x = h ^ (np.uint64(t) * _MIX)
        step = (x >> np.uint64(32)) | np.uint64(1)
        return np.stack([(x + np.uint64(i) * step) % np.uint64(self.bits) for i in range(self.ways)])

    def holds(self, ids: np.ndarray, span: int, k: int) -> bool:
        """Whether a kept fingerprint of hashed words is, perhaps, in the filter."""
        for t in self.lengths:
            if len(ids) >= t:
                h = gram_hashes(ids, min(k, t))
                p = self.places(h[winnow(h, t - min(k, t) + 1)], t)
                if ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(0).any():
                    return True
        return False


def hashed(words: list[bytes]) -> np.ndarray:
    return np.asarray([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def bloom_of(items: DataFrame, span: int, k: int, bits: int) -> Bloom:
    """The filter of all items' kept fingerprints, put together from the partitions' words of 64 bits."""
    out = Bloom(bits)

    def run(batches):
        own, lengths = Bloom(bits), set()
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                if words:
                    t = min(span, len(words))
                    h = gram_hashes(hashed(words), min(k, t))
                    p = own.places(h[winnow(h, t - min(k, t) + 1)], t).ravel()
                    np.bitwise_or.at(own.words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
                    lengths.add(t)
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), *(-t for t in lengths)], pa.int64()), pa.array([*own.words[at].view(np.int64).tolist(), *(0 for _ in lengths)], pa.int64())], ["at", "bits"])

    got = items.select("text").mapInArrow(common.tidy(run), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most bits / 64 + span rows
    at, words = got.column("at").to_numpy(), got.column("bits").to_numpy()
    out.words[at[at >= 0]] = words[at >= 0].view(np.uint64)
    out.lengths = sorted(-at[at < 0])
    return out


def _blocks(benchmark: DataFrame, span: int, k: int, block_words: int):
    """Blocks of at most block_words words (a longer item is alone), streamed one partition of items at a time."""
    part: list[tuple[str, list[bytes]]] = []
    n = 0
    for name, text in benchmark.toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        if part and n + len(words) > block_words:
            yield Block(part, span, k)
            part, n = [], 0
        part.append(("" if name is None else name, words))
        n += len(words)
    if part:
        yield Block(part, span, k)


def _hits(block: Block, words: list[bytes]) -> tuple[list[str], list[dict]]:
    number = block.vocab.get
    mask, found = block.hits(np.asarray([number(w, -1) for w in words], np.int64)) if words else (None, set())
    spans = [] if mask is None else [{"start": a, "end": b} for a, b in stretches(mask)]
    return sorted({block.names[j] for j in found}), spans


_ITEMS, _SPANS = pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _in_one_pass(docs: DataFrame, block: Block | None, carry: list[str], text_col: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        block = held.value
        for batch in batches:
            words = [words_of(x.as_py()) for x in batch.column(0)]
            got = [_hits(block, w) if block is not None else ([], []) for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([len(w) for w in words], pa.int64()), pa.array([x for x, _ in got], _ITEMS), pa.array([x for _, x in got], _SPANS)], [*carry, "n_words", "items", "spans"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias(common.free_name(carry, "_text")), *[F.col(f"`{c}`") for c in carry])
    schema = docs.select(*[F.col(f"`{c}`") for c in carry]).schema.add("n_words", "long")
    return rows.mapInArrow(common.tidy(run), schema.add("items", T.ArrayType(T.StringType())).add("spans", T._parse_datatype_string("array<struct<start:int,end:int>>")))


def _in_blocks(docs: DataFrame, items: DataFrame, carry: list[str], text_col: str, span: int, k: int, block_words: int, bloom_bits: int, few: int) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    bloom = context.broadcast(bloom_of(items, span, k, bloom_bits))

    def maybe(batches):
        for batch in batches:
            yield batch.filter(pa.array([bloom.value.holds(hashed(words_of(x.as_py())), span, k) for x in batch.column(2)], pa.bool_()))

    texts = docs.select(h1.alias("h1"), h2.alias("h2"), text.alias("text")).mapInArrow(common.tidy(maybe), "h1 long, h2 long, text string")
    texts = common.materialize(texts.groupBy("h1", "h2").agg(F.min("text").alias("text")), "candidates")
    found = spark.createDataFrame([], "h1 long, h2 long, items array<string>, spans array<struct<start:int,end:int>>")
    for block in _blocks(items.select("item", "text"), span, k, block_words):
        held = context.broadcast(block)

        def run(batches, held=held):
            for batch in batches:
                got = [_hits(held.value, words_of(x.as_py())) for x in batch.column(2)]
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], _ITEMS), pa.array([x for _, x in got], _SPANS)], ["h1", "h2", "items", "spans"])
                yield out.filter(pa.array([bool(x) for x, _ in got], pa.bool_()))

        found = found.unionByName(common.materialize(texts.mapInArrow(common.tidy(run), found.schema), "hits"))
        held.destroy()
    both = found.groupBy("h1", "h2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # a row per block

    def merge(batches):
        for batch in batches:
            out = []
            for spans in batch.column(3).to_pylist():
                whole: list[dict] = []
                for s in spans:
                    if whole and s["start"] <= whole[-1]["end"]:
                        whole[-1]["end"] = max(whole[-1]["end"], s["end"])
                    else:
                        whole.append(s)
                out.append(whole)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, _SPANS)], batch.schema.names)

    both = common.materialize(both.mapInArrow(common.tidy(merge), both.schema), "hits")
    made: list[str] = []
    for x in ("_h1", "_h2"):
        made.append(common.free_name([*carry, *made], x))
    own = docs.select(*[F.col(f"`{c}`") for c in carry], F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("n_words"), h1.alias(made[0]), h2.alias(made[1]))
    right = F.broadcast(both) if both.limit(few + 1).count() <= few else both
    joined = own.join(right, (F.col(f"`{made[0]}`") == right["h1"]) & (F.col(f"`{made[1]}`") == right["h2"]), "left")
    return joined.select(*[own[f"`{c}`"] for c in carry], "n_words", F.coalesce(right["items"], F.array().cast("array<string>")).alias("items"), F.coalesce(right["spans"], F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, span: int = 10, k: int = 5, block_words: int = 500_000, bloom_bits: int = 1 << 27, few: int = 10_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """`carry` columns of every document (default: its id), with n_words, n_hit, items (sorted strings) and spans.

    spans: word intervals [start, end) inside occurrences.
    """
    carry = [c for c in (carry or [id_col]) if c.lower() not in MADE]
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(_WORDS)))).first()[0] or 0
    if words <= block_words:
        state = _in_one_pass(docs, next(_blocks(items, span, k, block_words), None), carry, text_col)
    else:
        state = _in_blocks(docs, items, carry, text_col, span, k, block_words, bloom_bits, few)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return state.select(*[F.col(f"`{c}`") for c in carry], "n_words", n_hit.alias("n_hit"), "items", "spans")
