"""Primer thermodynamics against published values and plain enumeration."""

import random

import pytest
from pyspark.sql import functions as F

from helixar.functions import thermo

RC = str.maketrans("ACGT", "TGCA")


def test_a_published_temperature():
    """The worked example of the nearest-neighbour set at 50 mM salt and 25 nM of each strand."""
    s = "CGTTCCAAAGATGTGGGCATGAGCTTAC"
    assert thermo.melting_of_prefixes(s)[len(s)] == pytest.approx(60.32, abs=0.01)


def test_published_free_energies():
    """Free energies at 37 degrees as printed with the set."""
    want = {"AA": -1.00, "AT": -0.88, "TA": -0.58, "CA": -1.45, "GT": -1.44, "CT": -1.28, "GA": -1.30, "CG": -2.17, "GC": -2.24, "GG": -1.84}
    for k, v in want.items():
        h, s = thermo.STACKS[k]
        assert h - thermo.BODY * s / 1000 == pytest.approx(v, abs=0.05)
    assert len(thermo.ALL_STACKS) == 16 and all(v == thermo.ALL_STACKS[k[::-1].translate(RC)] for k, v in thermo.ALL_STACKS.items())


def test_expression_as_kernel(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choices("ACGT", k=rng.randrange(2, 50))) for _ in range(60)] + ["A", "", None, "ACGNAC", "acgtacgttt"]
    got = spark.createDataFrame([(x,) for x in rows], "s string").select("s", thermo.melting(F.col("s")).alias("t")).collect()
    for r in got:
        if not r.s or len(r.s) < 2 or "N" in r.s:
            assert r.t is None
        else:
            assert r.t == pytest.approx(thermo.melting_of_prefixes(r.s)[len(r.s)])


def stack_sum(top):
    return sum(thermo.ALL_STACKS[top[i : i + 2]][0] - thermo.BODY * thermo.ALL_STACKS[top[i : i + 2]][1] / 1000 for i in range(len(top) - 1))


def brute_hairpin(s):
    best = 0.0
    for i in range(len(s)):
        for j in range(i + 4, len(s)):
            for k in range(1, (j - i - 2) // 2 + 1):  # three bases are left for the loop
                if s[i : i + k].translate(RC) == s[j - k + 1 : j + 1][::-1]:
                    best = min(best, stack_sum(s[i : i + k]) + thermo._loop(j - i + 1 - 2 * k))
    return best


def brute_dimer(a, b):
    best, other = 0.0, b[::-1].translate(RC)
    for n in range(1, min(len(a), len(b)) + 1):
        for i in range(len(a) - n + 1):
            top = a[i : i + n]
            if top in other:
                best = min(best, stack_sum(top) + thermo.DUPLEX + sum(thermo.TERMINAL_AT for x in (top[0], top[-1]) if x in "AT"))
    return best


def test_structures_as_enumerated():
    rng = random.Random(2)
    for _ in range(40):
        a, b = ("".join(rng.choices("ACGT", k=rng.randrange(1, 26))) for _ in range(2))
        assert thermo.hairpin(a) == pytest.approx(brute_hairpin(a))
        assert thermo.dimer(a, b) == pytest.approx(brute_dimer(a, b)) == pytest.approx(thermo.dimer(b, a))
    stem = "GCGCGGAT"
    assert thermo.hairpin(stem + "TTTT" + stem[::-1].translate(RC)) < -8
    assert thermo.dimer(stem, stem[::-1].translate(RC)) < -8 and thermo.dimer("", "A") == 0 and thermo.hairpin("") == 0


def test_pairs():
    rng = random.Random(3)
    for _ in range(10):
        s = "".join(rng.choices("ACGT", k=rng.randrange(40, 200)))
        left, right, a, b, *_, dimer, penalty = thermo.choose_pair(s)
        assert s.startswith(left) and s[::-1].translate(RC).startswith(right) and 16 <= len(left) <= 36 and 16 <= len(right) <= 36
        assert abs(a - b) <= 5 and abs(a - 60) <= 8 and dimer == pytest.approx(brute_dimer(left, right))
        every = []
        for m in range(16, 37):
            for n in range(16, 37):
                p, q = s[:m], s[::-1].translate(RC)[:n]
                t, u = (float(thermo.melting_of_prefixes(x)[len(x)]) for x in (p, q))
                rough = abs(t - 60) + abs(u - 60) + abs(t - u) + 0.1 * (m + n)
                if rough < penalty:
                    folds = [thermo.hairpin(p), thermo.hairpin(q), thermo.dimer(p, p), thermo.dimer(q, q), thermo.dimer(p, q)]
                    every.append(rough + sum(0.5 * max(0.0, -1 - g) for g in folds))
        assert penalty == pytest.approx(min(every, default=penalty))


def test_a_given_primer_stays(spark):
    rng = random.Random(4)
    s = "".join(rng.choices("ACGT", k=120))
    given = "ACGTACGTACGTACGT"
    left, right, a, b, *_ = thermo.choose_pair(s, left=given)
    free = thermo.choose_pair(s)
    assert left == given and s[::-1].translate(RC).startswith(right) and abs(a - b) <= abs(a - free[3]) + 2
    df = spark.createDataFrame([(s, None), (s, given), ("", None), (None, None), ("NNNN" * 9, None), ("A", None)], "s string, g string")
    got = [r.p for r in df.select(thermo.primer_pair(F.col("s"), F.col("g")).alias("p")).collect()]
    assert (got[0].left, got[0].right) == free[:2] and got[1].left == given
    assert all(x is None or x.left is None for x in got[2:])
