"""Melting temperatures and structures of primers by nearest neighbours, and the joint choice of a primer pair.

Energies are the unified nearest-neighbour set of SantaLucia (1998), loops those of SantaLucia and Hicks (2004). Structures are
duplexes without bulges: the best hairpin and the best dimer come from dynamic programming over pairs of bases.
"""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Enthalpy (kcal/mol) and entropy (cal/mol/K) of two neighbouring pairs, the top strand read 5' to 3'.
STACKS = {
    "AA": (-7.9, -22.2),
    "AT": (-7.2, -20.4),
    "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7),
    "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0),
    "GA": (-8.2, -22.2),
    "CG": (-10.6, -27.2),
    "GC": (-9.8, -24.4),
    "GG": (-8.0, -19.9),
}
# Initiation with a terminal A-T or G-C pair, the same pair of figures.
END_AT, END_GC = (2.3, 4.1), (0.1, -2.8)
# Free energy (kcal/mol) of hairpin loops by their bases.
LOOPS = {3: 3.5, 4: 3.5, 5: 3.3, 6: 4.0, 7: 4.2, 8: 4.3, 9: 4.5, 10: 4.6, 12: 5.0, 14: 5.1, 16: 5.3, 18: 5.5, 20: 5.7, 25: 6.1, 30: 6.3}
# Initiation of a duplex, and each end with an A-T pair.
DUPLEX, TERMINAL_AT = 1.96, 0.05
GAS, ZERO, BODY = 1.987, 273.15, 310.15

_PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}
#: all sixteen, by the other strand where the table has that one
ALL_STACKS = {a + b: STACKS.get(a + b) or STACKS[_PAIR[b] + _PAIR[a]] for a in "ACGT" for b in "ACGT"}
_H, _S = (np.array([[ALL_STACKS[a + b][i] for b in "ACGT"] for a in "ACGT"]) for i in (0, 1))
_G = _H - BODY * _S / 1000
_CODES = np.full(256, -1, np.int64)
for _i, _b in enumerate(b"ACGT"):
    _CODES[_b] = _CODES[_b + 32] = _i


def melting_of_prefixes(bases: str, salt: float = 0.05, strands: float = 12.5e-9) -> np.ndarray:
    """Temperature (degrees C) at which half of the duplex of the first n bases has melted, for every n; NaN for n < 2 and
    from the first base on that is none of ACGT.

    salt: monovalent ions (mol/l), by entropy; strands: the effective concentration of strands (mol/l).
    """
    x = _CODES[np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)]
    n = len(x)
    out = np.full(n + 1, np.nan)
    bad = np.flatnonzero(x < 0)
    m = int(bad[0]) if len(bad) else n
    if m < 2:
        return out
    x = x[:m]
    h, s = (np.concatenate([[0.0, 0.0], np.cumsum(t[x[:-1], x[1:]])]) for t in (_H, _S))
    ends = np.array([[END_AT, END_GC][i in (1, 2)] for i in range(4)])
    k = np.arange(2, m + 1)
    h = h[2:] + ends[x[0], 0] + ends[x[k - 1], 0]
    s = s[2:] + ends[x[0], 1] + ends[x[k - 1], 1] + 0.368 * (k - 1) * log(salt)
    out[k] = 1000 * h / (s + GAS * log(strands)) - ZERO
    return out


def melting(s: Column, salt: float = 0.05, strands: float = 12.5e-9) -> Column:
    """The melting temperature of a whole sequence as an expression; null for under two bases or any but ACGT."""
    u = F.upper(s)
    table = lambda i: F.create_map(*[F.lit(x) for k, v in ALL_STACKS.items() for x in (k, v[i])])
    ends = lambda i: sum((F.when(F.substring(u, p, 1).isin("A", "T"), END_AT[i]).otherwise(END_GC[i]) for p in (1, -1)), F.lit(0.0))
    total = lambda i: F.aggregate(F.sequence(F.lit(1), F.length(u) - 1), F.lit(0.0), lambda t, p: t + F.element_at(table(i), F.substring(u, p, F.lit(2)))) + ends(i)
    tm = 1000 * total(0) / (total(1) + 0.368 * (F.length(u) - 1) * log(salt) + GAS * log(strands)) - ZERO
    return F.when((F.length(u) > 1) & u.rlike("^[ACGT]+$"), tm)


def _loop(n: int) -> float:
    if n in LOOPS:
        return LOOPS[n]
    known = [k for k in LOOPS if k < n]
    return LOOPS[max(known)] + (1.75 * GAS * BODY / 1000 * log(n / 30) if n > 30 else 0.0)


def hairpin(bases: str) -> float:
    """Free energy at 37 degrees of the most stable hairpin (kcal/mol), 0 if none is stable."""
    x = _CODES[np.frombuffer(bases.encode("latin-1", "replace"), np.uint8)]
    n, best = len(x), 0.0
    stem = np.full((n, n), np.inf)
    for size in range(4, n):  # from inner pairs to outer ones
        for i in range(n - size):
            j = i + size
            if x[i] < 0 or x[j] < 0 or x[i] + x[j] != 3:
                continue
            inner = stem[i + 1, j - 1]
            stem[i, j] = min(_loop(size - 1), _G[x[i], x[i + 1]] + inner if inner < np.inf else np.inf)
            best = min(best, stem[i, j])
    return best


def dimer(a: str, b: str) -> float:
    """Free energy at 37 degrees of the most stable duplex of two strands, both read 5' to 3' (kcal/mol), 0 if none is stable."""
    x, y = (_CODES[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)] for s in (a, b[::-1]))
    if not len(x) or not len(y):
        return 0.0
    fits = (x[:, None] >= 0) & (y[None, :] >= 0) & (x[:, None] + y[None, :] == 3)
    at = np.where((x == 0) | (x == 3), TERMINAL_AT, 0.0)
    run, best = np.full(len(y), np.inf), 0.0  # best duplex that ends with the pair of this row's base
    for i in range(len(x)):
        longer = np.full(len(y), np.inf)
        if i:
            longer[1:] = run[:-1] + _G[x[i - 1], x[i]]
        run = np.where(fits[i], np.minimum(longer, at[i]), np.inf)
        best = min(best, float(run.min()) + DUPLEX + at[i])
    return best


PAIR = "left string, right string, left_tm double, right_tm double, left_hairpin double, right_hairpin double, dimer double, penalty double"


def choose_pair(bases: str, left: str | None = None, right: str | None = None, target: float = 60.0, least: int = 16, most: int = 36, salt: float = 0.05, strands: float = 12.5e-9) -> tuple | None:
    """PAIR of the primers that anneal to the ends of a piece; a given primer is kept and the other one chosen to suit it.

    The pair of least penalty: degrees off the target, the difference of the two, half the free energy of hairpins and dimers below -1
    kcal/mol, and 0.1 a base; of equal ones the shorter left, then right. Structures, which cost more to know, are looked
    at from the least of the rest on, until no pair can be better. None if a piece has fewer than two bases or others than ACGT at an end.
    """
    top, bottom = bases.upper(), bases.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))

    def candidates(whole: str, fixed: str | None) -> list[tuple[str, float]]:
        if fixed:
            return [(fixed, float(melting_of_prefixes(fixed, salt, strands)[len(fixed)]))]
        tm = melting_of_prefixes(whole[:most], salt, strands)
        sizes = range(min(least, len(whole)), min(most, len(whole)) + 1)
        return [(whole[:n], float(tm[n])) for n in sizes if not np.isnan(tm[n])]

    ls, rs = candidates(top, left), candidates(bottom, right)
    rough = sorted((abs(a - target) * (left is None) + abs(b - target) * (right is None) + abs(a - b) + 0.1 * (len(p) + len(q)), len(p), len(q), i, j) for i, (p, a) in enumerate(ls) for j, (q, b) in enumerate(rs) if not (np.isnan(a) or np.isnan(b)))
    best, folds = None, {}
    for cost, _, _, i, j in rough:
        if best and cost >= best[0]:
            break
        (p, a), (q, b) = ls[i], rs[j]
        for s in (p, q):
            if s not in folds:
                folds[s] = (hairpin(s), dimer(s, s))
        cross = dimer(p, q)
        structures = [folds[p][0], folds[q][0], folds[p][1], folds[q][1], cross]
        total = cost + sum(0.5 * max(0.0, -1.0 - g) for g in structures)
        if best is None or total < best[0]:
            best = (total, (p, q, a, b, folds[p][0], folds[q][0], cross, total))
    return best and best[1]


def primer_pair(bases: Column, left: Column | None = None, right: Column | None = None, target: float = 60.0) -> Column:
    """Struct PAIR for each piece, by an Arrow kernel; left and right: primers that are given, null where they are not."""

    @F.pandas_udf(PAIR)
    def run(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(x and choose_pair(x, p or None, q or None, target)) or (None,) * 8 for x, p, q in zip(s, a, b, strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR.split(", ")])

    none = F.lit(None).cast("string")
    return run(bases, none if left is None else left, none if right is None else right)
