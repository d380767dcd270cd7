"""Sequence functions: Column expressions, and Arrow kernels for the statistics of whole sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixar import constants as K

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i


def complement(s: Column) -> Column:
    return F.translate(s, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def dna_like(s: Column, least: int = 10) -> Column:
    return (F.length(s) > least) & s.rlike("^[AGTCagctnNuU]+$")


def content_key(s: Column) -> Column:
    """Identity of a molecule: sha1 of its upper-case, trimmed bases."""
    return F.sha1(F.upper(F.trim(s)).cast("binary"))


def gc_cost(s: Column) -> Column:
    u = F.upper(s)
    gc = F.length(s) - F.length(F.regexp_replace(u, "[GC]", ""))
    return F.when(F.length(s) > 0, F.abs(100.0 * gc / F.length(s) - 50) * 17 / 25)  # null without bases


def slice_region(s: Column, a: Column, n: Column) -> Column:
    """n bases from 0-based a, around the origin if need be (n <= length)."""
    return F.substring(F.concat(s, s), (a + 1).cast("int"), n.cast("int"))


def sort_cycle(arr: Column) -> Column:
    """The array turned so that its least element comes first."""
    at = F.array_position(arr, F.array_min(arr)).cast("int")
    return F.when(F.size(arr) == 0, arr).otherwise(F.concat(F.slice(arr, at, F.size(arr)), F.slice(arr, 1, at - 1)))


def codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]


def kmers(code: np.ndarray, k: int) -> np.ndarray:
    """Exact number of each k-mer, by start (k <= 27), put together from those of 1, 2, 4, .. bases."""
    n = len(code)
    out, size = np.zeros(n + 1, np.int64), 0
    part, width = code.astype(np.int64), 1
    while size < k <= n:
        if k & width:
            out = out[: n - size - width + 1] * 5**width + part[size:]
            size += width
        part = part[: n - 2 * width + 1] * 5**width + part[width:] if size < k else part
        width *= 2
    return out if k <= n else np.zeros(0, np.int64)


def kmers_rc(code: np.ndarray, k: int) -> np.ndarray:
    """Number of the reverse complement of the k-mer at each start."""
    flipped = np.where(code < 4, 3 - code.astype(np.int16), 4)[::-1]
    return kmers(flipped, k)[::-1]


def repeated(x: np.ndarray) -> int:
    """How many different values come more than once."""
    return int((np.unique(x, return_counts=True)[1] > 1).sum())


def neighbours(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each value stands before and before that (-1: nowhere), and next and after that (len(x): nowhere)."""
    n = len(x)
    bits = max(n - 1, 1).bit_length()
    if n and int(x.max()) < 1 << (63 - bits):  # sorting values with their places is faster than an argsort
        held = np.sort((x << bits) | np.arange(n))
        order, y = held & ((1 << bits) - 1), held >> bits
    else:
        order = np.argsort(x, kind="stable")
        y = x[order]
    before, before2, after, after2 = (np.full(n, k, np.int64) for k in (-1, -1, n, n))
    for k, left, right in ((1, before, after), (2, before2, after2)):
        same = np.flatnonzero(y[k:] == y[:-k])
        a, b = order[same], order[same + k]
        left[b], right[a] = a, b
    return before, before2, after, after2


class Repeats:
    """How many different values come more than once in stretches [i, j), over several lists (values, their ascending places, weight) at once:
    as many as there are second places of values in it. Only places of values that have come before, or come again, are kept."""

    def __init__(self, *lists: tuple[np.ndarray, np.ndarray, int]):
        made = []
        for x, at, weight in lists:
            before, before2, after, after2 = neighbours(x)
            at = np.concatenate([at, [1 << 62, -1]])  # the last two for "nowhere" behind and in front
            later, sooner = np.flatnonzero(before >= 0), np.flatnonzero(after < len(x))
            made.append((at[later], at[before[later]], at[before2[later]], np.full(len(later), weight), at[sooner], at[after[sooner]], at[after2[sooner]], np.full(len(sooner), weight)))
        columns = [np.concatenate(c) for c in zip(*made, strict=True)]
        first, second = (np.argsort(columns[i], kind="stable") for i in (0, 4))
        self.later, self.before, self.before2, self.worth = (c[first] for c in columns[:4])
        self.sooner, self.after, self.after2, self.worth2 = (c[second] for c in columns[4:])

    def _second(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.later.searchsorted((i, j))
        two = (self.before[a:b] >= i) & (self.before2[a:b] < i)
        return self.later[a:b][two], self.worth[a:b][two]

    def count(self, i: int, j: int) -> int:
        return int(self._second(i, j)[1].sum())

    def upto(self, i: int, ends: np.ndarray) -> np.ndarray:
        """Of [i, j) for every j."""
        places, worth = self._second(i, int(ends.max()))
        return _running(worth)[places.searchsorted(ends)]

    def since(self, starts: np.ndarray, j: int) -> np.ndarray:
        """Of [i, j) for every i."""
        a, b = self.sooner.searchsorted((int(starts.min()), j))
        two = (self.after[a:b] < j) & (self.after2[a:b] >= j)
        run = _running(self.worth2[a:b][two])
        return run[-1] - run[self.sooner[a:b][two].searchsorted(starts)]

    def within(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of every [i, j), both in ascending order: a second place counts for the stretches, in a row, that begin between the first two places and reach it."""
        a, b = self.later.searchsorted((int(starts[0]), int(ends[-1])))
        first = np.maximum(starts.searchsorted(self.before2[a:b], "right"), ends.searchsorted(self.later[a:b], "right"))
        last = starts.searchsorted(self.before[a:b], "right")
        met = first < last
        size, worth = len(starts) + 1, self.worth[a:b][met]
        steps = np.bincount(first[met], worth, size) - np.bincount(last[met], worth, size)
        return np.cumsum(steps.astype(np.int64))[:-1]


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


class Profile:
    """Statistics of one sequence; slices follow the start of windows and hairpin k-mers and the end of repeat k-mers."""

    def __init__(self, bases: str):
        self.code = codes(bases)
        self.repeat = kmers(self.code, K.REPEAT_K)
        self.fwd, self.rev = kmers(self.code, K.HAIRPIN_K), kmers_rc(self.code, K.HAIRPIN_K)
        w = K.STATS_WINDOW
        hot = np.stack([self.code == i for i in range(4)]).astype(np.int64)
        run = np.concatenate([np.zeros((4, 1), np.int64), hot.cumsum(1)], 1)
        self.sums = run
        self.windows = run[:, w:] - run[:, :-w] if len(self.code) >= w else np.zeros((4, 0), np.int64)

    def parts(self, i: int = 0, j: int | None = None) -> tuple[int, int, int, int, int, float]:
        """repeats, hairpins, base windows, GC windows, AT windows, GC cost of [i, j)."""
        j = len(self.code) if j is None else min(j, len(self.code))
        k = K.REPEAT_K - 1
        repeats = repeated(self.repeat[max(i - k, 0) : max(j - k, 0)])
        f, r = self.fwd[i:j], self.rev[i:j]
        hairpins = repeated(np.concatenate([f, r])) - 2 * repeated(f)
        d = self.windows[:, i:j] / K.STATS_WINDOW
        gc = (self.windows[1, i:j] + self.windows[2, i:j]) / K.STATS_WINDOW
        at = (self.windows[0, i:j] + self.windows[3, i:j]) / K.STATS_WINDOW
        n = j - i
        total = self.sums[1, j] + self.sums[2, j] - self.sums[1, i] - self.sums[2, i]
        cost = abs(100.0 * total / n - 50) * 17 / 25 if n > 0 else 0.0
        return repeats, hairpins, int((d > K.BASE_FRACTION).sum()), int((gc > K.GC_FRACTION).sum()), int((at > K.AT_FRACTION).sum()), cost

    def cost(self, i: int = 0, j: int | None = None) -> float:
        """Complexity: AT windows are reported but do not count."""
        if not hasattr(self, "_held"):
            repeats, hairpins, base, gc, _, gc_part = self.parts(i, j)
            return repeats + hairpins + base + gc + gc_part
        j = len(self.code) if j is None else min(j, len(self.code))
        counts = self._held.count(i, j)
        if j <= i:
            return counts + 0.0
        run, total = self._hots()
        hot = int(run[j] - run[i])
        return counts + hot + abs(100.0 * int(total[j] - total[i]) / (j - i) - 50) * 17 / 25

    def _places(self) -> Repeats:
        """Repeats and hairpins by base, made when first asked for: k-mers that end at it, less twice the k-mers that start there, with these
        and their reverse complements by turns."""
        if not hasattr(self, "_held"):
            start = np.arange(len(self.fwd))
            both = np.stack([self.fwd, self.rev], 1).ravel()
            self._held = Repeats((self.repeat, np.arange(len(self.repeat)) + K.REPEAT_K - 1, 1), (both, np.repeat(start, 2), 1), (self.fwd, start, -2))
        return self._held

    def costs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """cost(i, j) of every slice, those of equal size together."""
        out = np.zeros(len(a))
        places = self._places()
        b = np.minimum(b, len(self.code))
        order = np.lexsort((a, b - a))
        sizes = (b - a)[order]
        for part in np.split(order, np.flatnonzero(sizes[1:] != sizes[:-1]) + 1) if len(order) else []:
            i, j = a[part], b[part]
            if len(part) < 4 or j[0] <= i[0]:
                out[part] = [self.cost(int(x), int(y)) for x, y in zip(i, j, strict=True)]
                continue
            hot, rest = self._hot(i, j)
            out[part] = places.within(i, j) + hot + rest
        return out

    def prefix_costs(self, i: int, at: np.ndarray) -> np.ndarray:
        """cost(i, x) of every x, by running counts."""
        x = np.minimum(at, len(self.code))
        return self._places().upto(i, x) + self._rest(np.full(len(x), i), x)

    def suffix_costs(self, at: np.ndarray, j: int) -> np.ndarray:
        """cost(x, j) of every x, by running counts from the right."""
        j = min(j, len(self.code))
        return self._places().since(at, j) + self._rest(at, np.full(len(at), j))

    def _rest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Base and GC windows and the GC cost of every [a, b)."""
        hot, part = self._hot(a, b)
        return hot + part

    def _hots(self) -> tuple[np.ndarray, np.ndarray]:
        """Running counts of base and GC windows, and of bases G and C."""
        if not hasattr(self, "_run"):
            d = self.windows / K.STATS_WINDOW
            gc = (self.windows[1] + self.windows[2]) / K.STATS_WINDOW
            hot = (d > K.BASE_FRACTION).sum(0) + (gc > K.GC_FRACTION)
            run = _running(np.concatenate([hot, np.zeros(len(self.code) - len(hot), np.int64)]))  # no window begins at the last bases
            self._run = run, self.sums[1] + self.sums[2]
        return self._run

    def _hot(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run, total = self._hots()
        size = b - a
        part = np.where(size > 0, np.abs(100.0 * (total[b] - total[a]) / np.maximum(size, 1) - 50) * 17 / 25, 0.0)
        return run[b] - run[a], part


PARTS = "n_repeats long, n_hairpins long, n_base_windows long, n_gc_windows long, n_at_windows long, gc_cost double, complexity double"


def complexity_parts(bases: Column) -> Column:
    """Struct PARTS of each whole sequence, by an Arrow kernel: no k-mer leaves the task."""

    @F.pandas_udf(PARTS)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            p = Profile(x or "").parts()
            rows.append((*p, p[0] + p[1] + p[2] + p[3] + p[5]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    return run(bases)


def slice_complexity(bases: Column, i: Column, j: Column) -> Column:
    """Complexity of [i, j)."""

    @F.pandas_udf("double")
    def run(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        held: tuple = (None, None)
        out = []
        for x, p, q in zip(s, a, b, strict=True):
            if held[0] != x:
                held = (x, Profile(x or ""))
            out.append(held[1].cost(int(p), int(q)))
        return pd.Series(out, dtype="float64")

    return run(bases, i, j)


def slice_complexities(bases: Column, starts: Column, ends: Column, turns: int = 2) -> Column:
    """Complexity of every [i, j) of two arrays on `turns` turns of the sequence, which is profiled once."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, p, q in zip(s, a, b, strict=True):
            i, j = (np.asarray(v, np.int64) for v in (p, q))
            reach = int(j.max(initial=0)) + K.STATS_WINDOW + K.HAIRPIN_K  # bases behind it are in no window or k-mer of a slice
            out.append(Profile(((x or "") * turns)[:reach]).costs(i, j))
        return pd.Series(out)

    return run(bases, starts, ends)


def flank_misprimings(code: np.ndarray, i: int, j: int, k: int = K.MIN_ANNEAL, fwd: np.ndarray | None = None, rev: np.ndarray | None = None) -> int:
    """Priming sites of [i, j) elsewhere: k-mers of the slice met in the flanks on the top strand, on the bottom
    strand (plus repeats of the bottom k-mers), and k-mers repeated within the slice."""
    fwd = kmers(code, k) if fwd is None else fwd
    rev = kmers_rc(code, k) if rev is None else rev
    src, src_rc = fwd[i : max(j - k + 1, i)], rev[i : max(j - k + 1, i)]
    dest = np.concatenate([fwd[:i], fwd[j:]])
    top = int(np.isin(src, dest).sum())
    bottom = int(np.isin(src_rc, dest).sum()) + len(src_rc) - len(np.unique(src_rc))
    return top + bottom + repeated(src)


def amplicon_misprimings(bases: str, i: int, j: int, cyclic: bool, k: int = K.MIN_ANNEAL, most: int = K.MAX_ANNEAL) -> int:
    """Misprimings of both ends of the amplicon [i, j) of a template (j < i: over the origin of a circle)."""
    if i == j:
        return 0
    if i < 0 or j < 0 or (j < i and not cyclic):
        raise ValueError(f"no amplicon [{i}, {j}) on a {'circle' if cyclic else 'line'}")
    if cyclic:
        n = len(bases) - i + j if j < i else j - i
        bases, i, j = bases[i:] + bases[:i], 0, n
    code = codes(bases)
    fwd, rev = kmers(code, k), kmers_rc(code, k)
    left = flank_misprimings(code, i, min(i + most, len(code) - 1), k, fwd, rev)
    return left + (flank_misprimings(code, max(j - most, 0), j, k, fwd, rev) if j >= most else 0)


def misprimings(bases: Column, i: Column, j: Column, cyclic: Column) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([amplicon_misprimings(*x) for x in zip(s, a.astype(int), b.astype(int), c, strict=True)], dtype="int64")

    return run(bases, i, j, cyclic)


def primer_tm(s: Column) -> Column:
    """Melting temperature by the GC rule (short primers: 2 degrees per A or T, 4 per G or C). A stand-in for thermodynamics."""
    n, u = F.length(s), F.upper(s)
    gc = n - F.length(F.regexp_replace(u, "[GC]", ""))
    return F.when(n < 14, 2.0 * (n - gc) + 4.0 * gc).otherwise(64.9 + 41.0 * (gc - 16.4) / n)


def design_primer(template: Column, least: int = K.MIN_ANNEAL, most: int = 60, target: float = 60.0) -> Column:
    """The shortest prefix of at least `least` bases that melts at `target` or above; else the longest allowed."""
    cuts = F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.substring(template, F.lit(1), n))
    fit = F.filter(cuts, lambda p: (primer_tm(p) >= target) & (F.length(p) >= least))
    return F.coalesce(F.get(fit, F.lit(0)), F.substring(template, 1, most))
