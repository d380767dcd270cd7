"""Secret scans against plain regular expressions, the ledger's increments, odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from helixar.llm import common, secrets

DOCS = "doc_id long, text string, Blob string, spans string, rules string, rule string"
PARTS = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "ſecret", "\"", "'", " ", "  ", ":", "=", "==", "hunter22", "abcdefgh", "short", "A1b2/+_.=-9", "AKIA", "AKIAABCDEFGHIJKL", "AKIAAKIA", "0123456789abcdef" * 2, "deadbeef", "é", "😀", "\n", "\x00", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "xoxb-0123456789", "https://u:pw12@h", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "\\", "word"]


def brute(text, rules=secrets.RULES):
    """[(start, order, end, kind)] of every rule's matches, in characters."""
    found = []
    for i, r in enumerate(rules):
        found += [(m.start(), i, m.end(), r.kind) for m in re.finditer(r.pattern, text or "") if m.end(r.group) - m.start(r.group) >= r.least]
    return sorted(found)


def given_base(text):
    """The three base rules as they are given."""
    text, found = text or "", []
    ascii_any = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(map(ascii_any, ("password", "passwd", "secret", "token", "api_?key")))
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    out += [(None, "token=abcdefgh"), (301, None), (302, ""), (303, "token=api_key: abcdefgh1"), (304, "password==abcdefgh"), (305, "AKIAAAAAKIABBBBBBBB AKIA1"), (306, "ab" * 40), (306, "ab" * 40)]
    return [*out, *[(400 + i, "the same secret: abcdefgh") for i in range(50)], (500, "x token=abcdefgh " * 20_000), (501, "f" * 300_000), (502, "token" + " " * 100_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "s", "x", "y") for r in rows], DOCS).repartition(4)


def spans(row):
    return [(x["start"], x["nth"], x["end"], x["kind"]) for x in row.spans]


def test_as_regular_expressions(spark, rows):
    got = secrets.find(frame(spark, rows), common.new_path(spark, "ledger"), carry=["doc_id", "rules", "rule", "SPANS"]).collect()
    assert got[0].__fields__ == ["doc_id", "rules", "rule", "blob", "spans"]
    blob = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r.doc_id, r.blob, str(spans(r))) for r in got) == Counter((d, blob(t), str(brute(t))) for d, t in rows)
    assert len({x[3] for r in got for x in spans(r)}) == len(secrets.RULES)


def test_base_rules_as_given(rows):
    for _, t in rows:
        assert [x for x in brute(t) if x[1] < 3] == given_base(t)


def test_listed(spark):
    df = spark.createDataFrame([([(3, 0, 9, "assign"), (3, 2, 50, "hex")],), ([],)], f"spans {secrets.SPANS}")
    assert [r[0] for r in df.select(secrets.listed(df["spans"])).collect()] == ["assign:3:9,hex:3:50", ""]


def test_only_unseen_pairs_are_scanned(spark, rows):
    ledger, old, new = common.new_path(spark, "ledger"), secrets.RULES[:3], (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{40,}"), *secrets.RULES[3:])
    first, second = rows[:150], rows[100:]
    n = secrets.update(frame(spark, first), ledger, old)
    assert n == len({t or "" for _, t in first}) and secrets.update(frame(spark, first), ledger, old) == 0
    assert secrets.update(frame(spark, second), ledger, old) == len({t or "" for _, t in second} - {t or "" for _, t in first})
    for few in (1_000_000, 0):  # the rules of version 2 and those added are run on all blobs, the others on none
        copy = common.new_path(spark, "ledger")
        for t in ("scanned", "findings"):
            spark.read.parquet(f"{ledger}/{t}").write.parquet(f"{copy}/{t}")
        assert secrets.update(frame(spark, rows), copy, new, few=few) == len({t or "" for _, t in rows})
        pairs = [(bytes(r.blob), k) for r in spark.read.parquet(f"{copy}/scanned").collect() for k in r.rules]
        assert len(pairs) == len(set(pairs)) == len({t or "" for _, t in rows}) * len({r.key for r in (*old, *new)})
        got = secrets.find(frame(spark, rows), copy, new).collect()
        assert Counter((r.doc_id, str(spans(r))) for r in got) == Counter((d, str(brute(t, new))) for d, t in rows)


def test_a_repeated_write_changes_nothing(spark, rows):
    ledger = common.new_path(spark, "ledger")
    secrets.update(frame(spark, rows), ledger)
    twice = common.materialize(spark.read.parquet(f"{ledger}/findings"), "twice")
    twice.write.mode("append").parquet(f"{ledger}/findings")  # a run that died before its note
    got = secrets.find(frame(spark, rows), ledger).collect()
    assert Counter((r.doc_id, str(spans(r))) for r in got) == Counter((d, str(brute(t))) for d, t in rows)


def test_no_rows(spark, rows):
    ledger = common.new_path(spark, "ledger")
    assert secrets.find(frame(spark, rows).limit(0), ledger).count() == 0 and not common.exists(spark, ledger)


def test_spread_join(spark):
    many = common.materialize(spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "i long, k string"), "many")
    few = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9999", 3)], "k string, v int")
    got = {(r.i, r.k, r.v) for r in common.join_spread(many, few, "k", salts=8, share=10).collect()}
    assert got == {(i, k, {"hot": 1, "k3": 2}.get(k)) for i in range(3000) for k in ["hot" if i % 3 else f"k{i}"]}
