"""Fill-in-the-middle against plain Python, exact round trips, odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixar.llm import fim

DOCS = "doc_id long, text string, N string, Output string, nth int, id int"
PARTS = ["a", "b\n", "\n", "\r\n", "é", "日本", "😀\n", "é", "\x00", " ", "<", "<P", ">", "S>", " ", "'", "\\n", "line of words\n"]


def expected(doc_id, text, seed=7, rate=100, spm=50, marks=fim.MARKS):
    """(n, form, prefix chars, middle chars, output)"""
    text, (p, s, m) = text or "", marks
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    if not text or any(x in text for x in marks) or c % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if d % 100 < spm else "psm"
    return len(units), form, len(pre), len(mid), f"{s}{suf}{p}{pre}{m}{mid}" if form == "spm" else f"{p}{pre}{s}{suf}{m}{mid}"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))) for i in range(-20, 300)]
    out += [(None, "a\nb\nc\nd"), (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "x<P>y\nz"), (6, "x<S>\n"), (7, "<M>"), (8, out[40][1]), (8, out[40][1])]
    return [*out, (9, "w" * 2_000_000), (10, "long line of it\n" * 200_000)]


@pytest.mark.parametrize(("rate", "spm", "marks"), [(100, 50, fim.MARKS), (40, 0, fim.MARKS), (90, 100, ("<|'p|>", "<|s|>", "<|m|>"))])
def test_as_plain_python(spark, rows, rate, spm, marks):
    docs = spark.createDataFrame([(*r, "n", "o", 1, 2) for r in rows], DOCS).repartition(4)
    got = fim.transform(docs, carry=["doc_id", "text", "N", "nth", "id"], rate=rate, spm=spm, marks=marks).collect()
    assert got[0].__fields__ == ["doc_id", "text", "nth", "id", *fim.MADE]
    want = Counter()
    for d, t in rows:
        n, form, a, b, out = expected(d, t, rate=rate, spm=spm, marks=marks)
        want[d, t, n, form, a, b, sha(out), sha(t or "")] += 1
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got) == want
    assert all(sha(r.output) == r.output_sha256 and fim.restored(r.output, r.form, marks) == (r.text or "") for r in got)
    assert len({r.form for r in got}) == (3 if 0 < spm < 100 else 2)


def test_without_text(spark, rows):
    docs = spark.createDataFrame([(*r, "n", "o", 1, 2) for r in rows[:50]], DOCS)
    a, b = (sorted(map(str, fim.transform(docs, with_text=x).drop("output").collect())) for x in (True, False))
    assert a == b and fim.transform(docs, with_text=False).filter("output IS NOT NULL").count() == 0
    assert fim.transform(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS)).map("".join), st.integers(0, 1 << 40))
def test_restored_is_exact(text, doc_id):
    _, form, _, _, out = expected(doc_id, text)
    assert fim.restored(out, form) == text
