"""Sequence matches: every maximal exact match of an inventory with goals, on both strands, on circles too.

Seed: hashes of the goals' k-mers at every (least - k + 1)-th position (a match of `least` bases holds one) meet those of the
inventory in an equi-join. Extend: each (goal, subject, strand, diagonal) is looked at once, in an Arrow kernel, where bases
are compared. Goals go to the kernel by a join on their key, so neither side is collected. Where the inventory is small beside
the goals, a sieve of its k-mers leaves only goals that can match, and these are held, so that goals are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixar.functions import sequences as S
from helixar.functions import shared

WORDS = 1 << 18  # of a sieve, of 64 bits
_BLOCK = 65536  # places that are hashed together
HIT = "query_key string, subject_key string, strand int, q_start int, q_raw_end int, s_start int, s_raw_end int, q_length int, s_length int, q_circular boolean, n int"


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), "<u4")


def kmer_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k codes from each start."""
    x = x.astype(np.uint64)
    n = max(len(x) - k + 1, 0)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h + x[i : i + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def seeds(seqs: DataFrame, k: int, step: int, most: int | None = None) -> DataFrame:
    """(key, strand, 0-based position, hash of the k-mer) at every step-th start of `s` (the first `most` starts), by an Arrow kernel."""

    def run(batches):
        for batch in batches:
            for key, strand, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = kmer_hashes(codes(s.as_py()), k)
                at = np.arange(0, len(h), step)[:most]
                for j in range(0, len(at), 65536):
                    own = at[j : j + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.string()), pa.array(np.full(len(own), strand, np.int32)), pa.array(own.astype(np.int32)), pa.array(h[own].view(np.int64))], ["key", "strand", "at", "seed"])

    return seqs.select("key", "strand", "s").mapInArrow(run, "key string, strand int, at int, seed long")


def sieve(seeds: DataFrame) -> np.ndarray:
    """A bit for every hash in `seed`, in a table of fixed size: what is not in it is no seed, so exact comparison is left to the rest."""
    word, bit = F.col("seed").bitwiseAND(WORDS - 1), F.expr("shiftleft(1L, cast(shiftrightunsigned(seed, 18) & 63 as int))")
    table = np.zeros(WORDS, np.int64)
    for w, bits in seeds.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit")).collect():
        table[w] = bits
    return table.view(np.uint64)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash has its bit in the sieve."""
    return (table[h & np.uint64(WORDS - 1)] >> (h >> np.uint64(18) & np.uint64(63)) & np.uint64(1)).astype(bool)


def _hashes_at(x: np.ndarray, first: np.ndarray, size: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """kmer_hashes from the places `at` alone of sequences that begin at `first` in x; a place past the end is taken around the circle."""
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        p = at + i
        h = (h + x[first + np.where(p < size, p, p - size)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def goal_seeds(goals: DataFrame, k: int, step: int, least: int, table: np.ndarray | None = None) -> DataFrame:
    """(key, at, hash of the k-mer) at every step-th start of goals(key, bases, is_circular). On a circle a match begins before
    the end, so starts go no further over the origin than its first seed can lie. Short goals are hashed together, long ones by blocks.

    table: a sieve of the inventory's k-mers and (for steps) `least`-mers: (key, bases, is_circular, array of at, array of seed) of the
    goals with a seed that passes, each such seed within `least` bases that pass, too.
    """

    def near(x, first, n, reach, row, at, h):
        there = passes(table, h)
        row, at, h = row[there], at[there], h[there]
        if step == 1:  # the seed is the whole least match
            return row, at, h
        w = at[:, None] - np.arange(step)
        inside = (w >= 0) & (w + least <= reach[row][:, None])
        of = np.broadcast_to(row[:, None], w.shape)[inside]
        held = np.zeros(w.shape, bool)
        held[inside] = passes(table, _hashes_at(x, first[of], n[of], w[inside], least))
        held = held.any(axis=1)
        return row[held], at[held], h[held]

    def run(batches):
        for batch in batches:
            texts, circles = batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), bool)
            sizes = np.array([len(x) for x in texts], np.int64)
            group = np.cumsum(sizes) // _BLOCK
            bounds = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(texts)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                x, n, circle = codes("".join(texts[a:b])).astype(np.uint64), sizes[a:b], circles[a:b]
                first, reach = np.cumsum(n) - n, np.where(circle, 2 * n - 1, n)
                stop = np.maximum(np.minimum(reach - k + 1, np.where(circle, n + step - 1, reach)), 0)
                last = np.cumsum(-(-stop // step))
                begin = np.concatenate([[0], last])
                kept = []
                for i in range(0, int(last[-1]), _BLOCK):
                    number = np.arange(i, min(i + _BLOCK, int(last[-1])))
                    row = np.searchsorted(last, number, "right")
                    at = (number - begin[row]) * step
                    h = _hashes_at(x, first[row], n[row], at, k)
                    if table is None:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + a)), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], ["key", "at", "seed"])
                    else:
                        kept.append(near(x, first, n, reach, row, at, h))
                if sum(len(r) for r, _, _ in kept):
                    row, at, h = (np.concatenate(v) for v in zip(*kept, strict=True))
                    rows, starts = np.unique(row, return_index=True)
                    offsets = pa.array(np.append(starts, len(row)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (at.astype(np.int32), h.view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(v).take(pa.array(rows + a)) for v in range(3)), *lists], ["key", "bases", "is_circular", "at", "seed"])

    made = "key string, at int, seed long" if table is None else "key string, bases string, is_circular boolean, at array<int>, seed array<long>"
    return goals.select("key", "bases", F.coalesce("is_circular", F.lit(False)).alias("is_circular")).filter("bases IS NOT NULL").mapInArrow(run, made)


def _strands(inventory: DataFrame, both: bool, fold: bool) -> DataFrame:
    plus = inventory.select("key", F.lit(1).alias("strand"), (F.upper("bases") if fold else F.col("bases")).alias("s"))
    return plus.unionByName(plus.select("key", F.lit(-1).alias("strand"), S.reverse_complement(F.col("s")).alias("s"))) if both else plus


def _matches(goals: DataFrame, subjects: DataFrame, k: int, step: int, first_only: bool, least: int, fold: bool, sieved: bool) -> DataFrame:
    g = goals.select(F.col("key"), (F.upper("bases") if fold else F.col("bases")).alias("bases"), "is_circular")
    subjects = subjects.filter("s IS NOT NULL")
    s = seeds(subjects, k, 1, 1 if first_only else None)
    if sieved:
        table = sieve((s if step == 1 else s.unionByName(seeds(subjects, least, 1))).select("seed"))
        own = shared.held(goal_seeds(g, k, step, least, table), "goals")
        g = own.select("key", "bases", "is_circular")
        q = own.select("key", F.explode(F.arrays_zip("at", "seed")).alias("x")).select(F.col("key").alias("query_key"), F.col("x.at").alias("q"), "x.seed")
    else:
        q = goal_seeds(g, k, step, least).select(F.col("key").alias("query_key"), F.col("at").alias("q"), "seed")
    s = s.select(F.col("key").alias("subject_key"), "strand", F.col("at").alias("p"), "seed")
    diagonals = q.join(s, "seed").select("query_key", "subject_key", "strand", (F.col("q") - F.col("p")).alias("diagonal")).distinct()
    per_pair = diagonals.groupBy("query_key", "subject_key", "strand").agg(F.collect_set("diagonal").alias("diagonals"))
    full = per_pair.join(g.withColumnRenamed("key", "query_key"), "query_key").join(subjects.withColumnRenamed("key", "subject_key"), ["subject_key", "strand"])

    def run(batches):
        names = [x.split()[0] for x in HIT.split(", ")]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 7, pa.bool_(), pa.int32()]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                base, y = codes(r["bases"]), codes(r["s"])
                x = np.concatenate([base, base[:-1]]) if r["is_circular"] else base
                size = len(base)
                for d in r["diagonals"]:
                    lo, hi = max(d, 0), min(len(x), d + len(y))
                    same = np.concatenate([[False], x[lo:hi] == y[lo - d : hi - d], [False]])
                    edge = np.flatnonzero(same[1:] != same[:-1])
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        a, b = a + lo, b + lo
                        wraps = r["is_circular"] and a == 0 and d < 0 and base[-1] == y[-d - 1]
                        b = min(b, a + size)
                        if b - a < least or a >= size or wraps:
                            continue
                        p, e = a - d + 1, b - d
                        if r["strand"] == -1:
                            p, e = len(y) - p + 1, len(y) - e + 1
                        rows.append((r["query_key"], r["subject_key"], r["strand"], a + 1, (b - 1) % size + 1, p, e, size, len(y), r["is_circular"], b - a))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return full.select("query_key", "subject_key", "strand", "diagonals", "bases", "is_circular", "s").mapInArrow(run, HIT)


def exact_matches(goals: DataFrame, inventory: DataFrame, least: int = 30, k: int = 16, both_strands: bool = True, fold: bool = True, sieved: bool = False) -> DataFrame:
    """Hits (HIT) of goals(key, bases, is_circular) and inventory(key, bases): every maximal match of `least` bases or more.

    Positions are 1-based and inclusive; on strand -1 the subject runs from s_start down to s_raw_end. fold: ignore case.
    sieved: for many goals and a small inventory, reads the goals once and at once; the hits are the same.
    """
    k = min(k, least)
    return _matches(goals, _strands(inventory, both_strands, fold), k, max(1, least - k + 1), False, least, fold, sieved)


def whole_matches(goals: DataFrame, inventory: DataFrame, least: int = 14, both_strands: bool = True, fold: bool = True, sieved: bool = False) -> DataFrame:
    """Hits where a goal holds a whole subject of at least `least` bases (primers, fragments): only the subject's first
    `least` bases are a seed."""
    hits = _matches(goals, _strands(inventory, both_strands, fold), least, 1, True, least, fold, sieved)
    return hits.filter(perfect_subject())


def perfect_subject() -> Column:
    """Whether a hit uses its whole subject, on either strand."""
    plus = (F.col("strand") == 1) & (F.col("s_start") == 1) & (F.col("s_raw_end") == F.col("s_length"))
    minus = (F.col("strand") == -1) & (F.col("s_raw_end") == 1) & (F.col("s_start") == F.col("s_length"))
    return plus | minus


def to_regions(hits: DataFrame, atype: str) -> DataFrame:
    """Alignments: 0-based half-open query [a, b) with length n and subject [sa, sb) with its direction."""
    lo = F.when(F.col("strand") == 1, F.col("s_start")).otherwise(F.col("s_raw_end")) - 1
    hi = F.when(F.col("strand") == 1, F.col("s_raw_end")).otherwise(F.col("s_start"))
    return hits.select("query_key", "subject_key", F.lit(atype).alias("atype"), (F.col("q_start") - 1).alias("a"), F.col("q_raw_end").alias("b"), "n", F.col("q_length").alias("length"), F.col("q_circular").alias("cyclic"), lo.alias("sa"), hi.alias("sb"), F.col("s_length"), F.col("strand").alias("direction"))


def without_self(hits: DataFrame) -> DataFrame:
    return hits.filter(F.col("query_key") != F.col("subject_key"))
