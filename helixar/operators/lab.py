"""Bench operations on sequences: primer annealing, in-silico PCR, restriction digests, junctions of fragments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixar.functions import sequences as S
from helixar.functions import shared
from helixar.operators import match


def _near(templates: DataFrame, sieve: np.ndarray, least: int, reach: int) -> DataFrame:
    """(key, strand, i, length, tail, before): the starts on both strands of templates(key, bases) whose `least` bases, the tail, pass the
    sieve, with up to `reach` bases before them. Short templates are hashed together, long ones by blocks."""
    flip = str.maketrans("ACGTacgt", "TGCAtgca")

    def passed(s: str) -> np.ndarray:
        x, out = match.codes(s), [np.zeros(0, np.int64)]
        for i in range(0, len(x) - least + 1, 65536):
            h = match.kmer_hashes(x[i : i + 65535 + least], least)
            out.append(np.flatnonzero(match.passes(sieve, h)) + i)
        return np.concatenate(out)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.array([len(x) for x in texts], np.int64)
            group = np.cumsum(sizes) // 65536
            bounds = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(texts)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                text, stop = "".join(texts[a:b]), np.cumsum(sizes[a:b])
                start, n, own = stop - sizes[a:b], len(text), np.arange(a, b)
                for strand, s, first, last, rows in ((1, text, start, stop, own), (-1, text.translate(flip)[::-1], (n - stop)[::-1], (n - start)[::-1], own[::-1])):
                    every = passed(s)
                    of = np.searchsorted(last, every, "right")
                    inside = every + least <= last[of]  # not over the end of a template
                    for k in range(0, int(inside.sum()), 65536):
                        at, r = every[inside][k : k + 65536], of[inside][k : k + 65536]
                        tail = [s[x : x + least] for x in at.tolist()]
                        before = [s[max(x - reach, f) : x] for x, f in zip(at.tolist(), first[r].tolist(), strict=True)]
                        numbers = [pa.array(x.astype(np.int32)) for x in (np.full(len(at), strand), at - first[r], (last - first)[r])]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[r])), *numbers, pa.array(tail, pa.string()), pa.array(before, pa.string())], ["key", "strand", "i", "length", "tail", "before"])

    t = templates.select("key", F.upper("bases").alias("bases")).filter(F.length("bases") >= least)
    return t.mapInArrow(run, f"key {dict(t.dtypes)['key']}, strand int, i int, length int, tail string, before string")


def anneal(primers: DataFrame, templates: DataFrame, least: int = 14) -> DataFrame:
    """Where the last `least` bases of primers(primer_key, primer) lie in templates(key, bases): strand, 0-based `end` of
    the annealed part on the top strand (its start for strand -1), annealed bases and overhang, extended as far as equal.

    Templates are read once; only places that pass a sieve of the primers' hashes leave the kernel, with the bases that a primer reaches.
    """
    p = primers.filter(F.length("primer") >= least).select("primer_key", F.upper("primer").alias("primer"), F.expr(f"right(upper(primer), {least})").alias("tail"))
    tails = match.seeds(p.select(F.lit("").alias("key"), F.lit(1).alias("strand"), F.col("tail").alias("s")), least, 1)
    reach = (p.agg(F.max(F.length("primer"))).first()[0] or least) - least
    hit = _near(templates, match.sieve(tails), least, reach).join(p, "tail")
    more = F.expr(f"size(filter(sequence(0, length(primer) - {least}), k -> k > 0 AND k <= length(before) AND right(before, k) = substring(primer, length(primer) - {least} - k + 1, k)))")
    n = (F.lit(least) + more).cast("int")
    stop = F.col("i") + least
    return hit.withColumn("n", n).select("primer_key", "key", "strand", F.when(F.col("strand") == 1, stop).otherwise(F.col("length") - stop).cast("int").alias("end"), "n", F.expr("right(primer, n)").alias("annealed"), F.expr("substring(primer, 1, length(primer) - n)").alias("overhang"))


def pcr(anneals: DataFrame, templates: DataFrame) -> DataFrame:
    """Products of a forward and a reverse annealing on linear templates, one row per different product."""
    anneals = shared.held(anneals.select("key", "primer_key", "strand", "end", "n", "overhang"), "anneals")  # as it is read twice
    f = anneals.filter("strand = 1").select("key", F.col("primer_key").alias("fwd"), (F.col("end") - F.col("n")).alias("i"), F.col("overhang").alias("head"))
    r = anneals.filter("strand = -1").select("key", F.col("primer_key").alias("rev"), (F.col("end") + F.col("n")).alias("j"), F.col("overhang").alias("tail"))
    pairs = f.join(r, "key").filter("j > i").join(templates.select("key", F.upper("bases").alias("bases")), "key")
    product = F.concat("head", F.expr("substring(bases, i + 1, j - i)"), S.reverse_complement(F.col("tail")))
    return pairs.select("key", "fwd", "rev", "i", "j", product.alias("product")).dropDuplicates(["product"])


def digest(sequences: DataFrame, site: str, cut: int) -> DataFrame:
    """Fragments of sequences(key, bases, is_circular) cut `cut` bases into every site; circles join the last with the first.

    (key, piece, start, n); sequences without a site give one piece.
    """
    s = sequences.select("key", F.upper("bases").alias("bases"), "is_circular")
    scan = F.when(F.col("is_circular"), F.concat("bases", F.expr(f"substring(bases, 1, {len(site) - 1})"))).otherwise(F.col("bases"))
    # Split before every site, overlapping ones too: one pass over the bases, then sums of the pieces' lengths.
    pieces = F.split(scan, rf"(?=\Q{site}\E)", -1)
    none = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("pos"))
    step = lambda a, x: F.struct(F.when((a["pos"] > 0) | F.startswith(scan, F.lit(site)), F.array_append(a["at"], a["pos"])).otherwise(a["at"]).alias("at"), (a["pos"] + F.length(x)).alias("pos"))
    starts = F.aggregate(pieces, none, step)["at"]
    hits = s.select("key", "is_circular", F.length("bases").alias("length"), F.transform(starts, lambda i: i + cut).alias("at"))
    cuts = F.array_sort(F.array_distinct(F.when(F.col("is_circular"), F.transform("at", lambda x: F.pmod(x, F.col("length")))).otherwise(F.concat(F.array(F.lit(0)), F.col("at")))))
    d = hits.select("key", "is_circular", "length", F.posexplode_outer(cuts).alias("piece", "start"))
    w = Window.partitionBy("key").orderBy("piece")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.when(F.col("is_circular"), F.first("start").over(whole) + F.col("length")).otherwise(F.col("length"))
    return d.select("key", F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("start", F.lit(0)).alias("start"), F.when(F.col("start").isNull(), F.col("length")).otherwise(F.coalesce(F.lead("start").over(w), last) - F.col("start")).alias("n")).filter("n > 0")


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


def _end_hashes(seqs: DataFrame, least: int) -> DataFrame:
    """(mix, key, strand, at_end, n, h): a hash of the first and of the last n bases of mix, key, strand, s, for every n from least on.

    Hashes are polynomials, so all of a piece's come from one running sum.
    """

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                mix, key, strand = (batch.column(i).slice(row, 1) for i in range(3))
                x = np.frombuffer(batch.column(3)[row].as_py().encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
                powers = np.cumprod(np.full(len(x), _BASE, np.uint64))
                inverse = np.cumprod(np.full(len(x) + 1, pow(_BASE, -1, 1 << 64), np.uint64))
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers)])
                n = np.arange(least, len(x) + 1)
                ends = (total[-1] - total[len(x) - n]) * np.where(n < len(x), inverse[np.maximum(len(x) - n - 1, 0)], np.uint64(1))
                for i in range(0, len(n), 65536):
                    for at_end, h in ((False, total[n[i : i + 65536]]), (True, ends[i : i + 65536])):
                        k = len(h)
                        same = [v.take(pa.array(np.zeros(k, np.int64))) for v in (mix, key, strand)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(k, at_end)), pa.array(n[i : i + 65536].astype(np.int32)), pa.array(h.view(np.int64))], ["mix", "key", "strand", "at_end", "n", "h"])

    kinds = dict(seqs.dtypes)
    return seqs.filter(F.length("s") >= least).select("mix", "key", "strand", "s").mapInArrow(run, f"mix {kinds['mix']}, key {kinds['key']}, strand int, at_end boolean, n int, h long")


def junctions(sequences: DataFrame, least: int = 15, mix: str | None = None) -> DataFrame:
    """Pairs of linear sequences(key, bases) where the end of one is the start of the other (or of its reverse complement):
    (left, left_strand, right, right_strand, n, tm) with the longest such overlap, of any length from `least` on, and the
    melting temperature of its last 60 bases. mix: only sequences with equal values of this column, which comes first then.

    Ends and starts meet by length and hash, so only bases that are equal all along do, and are compared then.
    """
    one = F.lit("") if mix is None else F.col(mix)
    s = sequences.select(one.alias("mix"), "key", F.upper("bases").alias("s")).filter(F.length("s") >= least)
    both = s.select("mix", "key", F.lit(1).alias("strand"), "s").unionByName(s.select("mix", "key", F.lit(-1).alias("strand"), S.reverse_complement(F.col("s")).alias("s")))
    hashed = _end_hashes(both, least)
    ends = hashed.filter("at_end").select("mix", F.col("key").alias("left"), F.col("strand").alias("left_strand"), "n", "h")
    starts = hashed.filter("NOT at_end").select("mix", F.col("key").alias("right"), F.col("strand").alias("right_strand"), "n", "h")
    hit = ends.join(starts, ["mix", "n", "h"]).filter("left <> right").drop("h")
    for side in ("left", "right"):
        hit = hit.join(both.select("mix", F.col("key").alias(side), F.col("strand").alias(f"{side}_strand"), F.col("s").alias(f"_{side}")), ["mix", side, f"{side}_strand"])
    hit = hit.filter(F.expr("right(_left, n) = left(_right, n)"))
    longest = hit.groupBy("mix", "left", "left_strand", "right", "right_strand").agg(F.max(F.struct("n", F.expr("right(_left, least(n, 60))").alias("x"))).alias("m"))
    return longest.select(*([F.col("mix").alias(mix)] if mix else []), "left", "left_strand", "right", "right_strand", "m.n", S.primer_tm(F.col("m.x")).alias("tm"))
