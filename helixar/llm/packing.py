"""Packing along a space-filling curve.

1. Every document is encoded once; its ids are hashed with signs into a vector, which a fixed random projection takes
   to a few dimensions; the ranks of the coordinates on a grid give a Hilbert key.
2. Keys alone (a few bytes a document) are range-sorted along the curve and get their place in the stream of all ids:
   a running sum in each partition plus the partitions' prefix sums.
3. Ids meet their places by a sort-merge join, which can spill, and each document is cut where the stream crosses a
   multiple of the sequence length. Only the very last sequence can be short.

Cases: null or empty text is the end id alone; null doc_id is kept, first among equal keys; repeated rows are packed
each; equal keys are ordered by doc_id; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixar.llm import common, wordtok

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each integer point (n x d, `bits` bits a coordinate, bits * d <= 62)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        turn ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curve:
    """From ids to Hilbert keys: signed hashing to `width` buckets, projection to `dims` grid coordinates."""

    def __init__(self, vocab: int, width: int = 256, dims: int = 4, bits: int = 15, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, width, vocab)
        self.sign = rng.choice([-1.0, 1.0], vocab)
        self.project = rng.standard_normal((width, dims))
        self.width, self.bits = width, bits
        self.grid = np.asarray([0.5 * (1 + erf(z / sqrt(2))) for z in np.linspace(-6, 6, 4097)])

    def keys(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ids of several documents on end, and how many each has."""
        out = np.empty(len(sizes), np.int64)
        ends = np.cumsum(sizes)
        for i in range(0, len(sizes), 1024):
            n = sizes[i : i + 1024]
            vec = np.zeros((len(n), self.width))
            at, first = ends[i] - n[0], np.concatenate([[0], np.cumsum(n)])
            for a in range(0, int(first[-1]), 1 << 20):  # bounded, however long the texts
                part = ids[at + a : min(at + a + (1 << 20), at + int(first[-1]))]
                doc = np.searchsorted(first, np.arange(a, a + len(part)), "right") - 1 if a else np.repeat(np.arange(len(n)), n)[: len(part)]
                low, high = int(doc[0]), int(doc[-1]) + 1
                vec[low:high] += np.bincount((doc - low) * self.width + self.bucket[part], self.sign[part], (high - low) * self.width).reshape(-1, self.width)
            norm = np.sqrt((vec * vec).sum(1, keepdims=True))
            z = (vec / np.where(norm > 0, norm, 1)) @ self.project
            u = np.interp(z, np.linspace(-6, 6, 4097), self.grid)
            out[i : i + len(n)] = hilbert_keys(np.minimum((u * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1), self.bits)
        return out


def encode_documents(docs: DataFrame, tokenizer: str | None, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, n_tokens, curve key and ids of every row, written to the shared folder."""
    kind = wordtok.id_type(tokenizer)

    def encode(batches):
        enc = wordtok.encoder(tokenizer)
        curve = Curve(max(enc.vocab_size, end_id + 1))
        for batch in batches:
            for part in wordtok.slices(batch, 2):
                ids, sizes = enc.encode(part.column(2), end_id)
                raw = pa.py_buffer(ids.astype(kind))
                cut = pa.py_buffer((np.concatenate([[0], np.cumsum(sizes)]) * np.dtype(kind).itemsize).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes), pa.array(curve.keys(ids, sizes)), pa.Array.from_buffers(pa.binary(), len(sizes), [None, cut, raw])], ["uid", "doc_id", "n_tokens", "curve_key", "ids"]
                )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.materialize(rows.mapInArrow(common.tidy(encode), "uid long, doc_id long, n_tokens long, curve_key long, ids binary"), "encoded")


def stream_places(encoded: DataFrame) -> DataFrame:
    """uid and first place of each document in the stream along the curve."""
    spark = encoded.sparkSession

    def running(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.asarray(batch.column("n_tokens"))
            after = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column("uid"), pa.array(after - n), batch.column("n_tokens")], ["part", "uid", "local", "n_tokens"])
            before = int(after[-1]) if len(n) else before

    order = ["curve_key", "doc_id", "uid"]
    keys = encoded.select("uid", "doc_id", "n_tokens", "curve_key")
    placed = common.materialize(keys.repartitionByRange(common.partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(common.tidy(running), "part int, uid long, local long, n_tokens long"), "places")
    bases, total = [], 0
    for part, n in sorted(placed.groupBy("part").agg(F.sum("n_tokens")).collect()):  # a row per partition
        bases.append((part, total))
        total += n
    return placed.join(common.small_frame(spark, bases, "part int, base long"), "part").select("uid", (F.col("base") + F.col("local")).alias("place"))


def pack(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of every document: PIECE's columns, and the piece's ids (binary, narrowest type) unless with_ids is false."""
    kind = wordtok.id_type(tokenizer)
    encoded = encode_documents(docs, tokenizer, end_id, id_col, text_col)
    places = stream_places(encoded)

    def cut(batches):
        names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            for part in wordtok.slices(batch, 1):
                raws = [np.frombuffer(x.as_buffer(), kind) for x in part.column(1)]
                sizes = np.asarray([len(x) for x in raws], np.int64)
                place = part.column(2).to_numpy()
                n = (place + sizes - 1) // length - place // length + 1  # pieces of each document, which is never empty
                doc = np.repeat(np.arange(len(sizes)), n)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                sequence = place[doc] // length + nth
                start = np.maximum(sequence * length - place[doc], 0)
                stop = np.minimum((sequence + 1) * length - place[doc], sizes[doc])
                pieces = [raws[d][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True)]
                crc = [zlib.crc32(x.astype("<u4")) for x in pieces]
                cols = [part.column(0).take(pa.array(doc)), pa.array(start), pa.array(stop - start), pa.array(crc, pa.int64()), pa.array(sizes[doc]), pa.array(sequence), pa.array(place[doc] + start - sequence * length)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([x.tobytes() for x in pieces], pa.binary())] * with_ids, names)

    joined = encoded.select("uid", "doc_id", "ids").join(places, "uid").drop("uid")
    return joined.mapInArrow(common.tidy(cut), PIECE + ", ids binary" * with_ids)
