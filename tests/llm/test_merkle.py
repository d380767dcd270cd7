"""The manifest against a plain tree, and on odd rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixar.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Root string, leaf string, tree string, pos int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, fanout):
    """(digest, siblings of each node from itself up) by plain levels."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // fanout * fanout
            ways[k].append((i - run, nodes[run:i] + nodes[i + 1 : run + fanout]))
            at[k] = i // fanout
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def brute(rows, fanout):
    """Counter of (doc_id, leaf, subroot, root, proof)."""
    order = lambda x: (x is not None, x if x is not None else 0)
    by_lang: dict = {}
    for doc_id, text, lang, source, n in rows:
        by_lang.setdefault(lang, []).append((order(doc_id), leaf(doc_id, source, lang, n, text), doc_id))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([d for _, d, _ in sorted(by_lang[x])], fanout) for x in langs}
    root, above = climb([trees[x][0] for x in langs], fanout)
    out = Counter()
    for x, more in zip(langs, above, strict=True):
        for (_, d, doc_id), way in zip(sorted(by_lang[x]), trees[x][1], strict=True):
            out[doc_id, d, trees[x][0], root, str(way + more)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, f"text {i} ä", rng.choice(["en", "en", "en", "de", "ß", "Z"]), rng.choice(["s", None]), i if i % 5 else None) for i in rng.sample(range(400), 300)]
    return [*out, (None, "x", "en", "s", 1), (None, None, None, None, None), (7, "", None, "", 0), (7, "", None, "", 0), (8, "-", None, "s", 1), (9, "y" * 300_000, "one", "s", 300_000), *[(500, "same", "en", "s", 4)] * 40]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", "l", "t", 1) for r in rows], DOCS).repartition(5)


@pytest.mark.parametrize(("fanout", "height"), [(2, 10), (2, 2), (2, 1), (3, 2), (5, 1)])
def test_as_plain_tree(spark, rows, fanout, height):
    got = merkle.manifest(frame(spark, rows), fanout=fanout, height=height).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, str([(s["at"], s["others"]) for s in r.proof])) for r in got) == brute(rows, fanout)


def test_proofs_hold_for_their_rows_alone(spark, rows):
    docs = frame(spark, rows)
    other = merkle.leaf_of(*[F.concat(F.col(c), F.lit("!")) if c == "text" else F.col(c) for c in merkle.COLUMNS])
    m = merkle.manifest(docs, carry={"doc_id": F.col("doc_id"), "text": F.col("text"), "other": other, "ROOT": F.lit(1)}, height=3)
    assert m.columns == ["doc_id", "text", "other", "leaf", "subroot", "root", "proof"]
    got = m.select("text", (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("holds"), (merkle.fold(F.col("other"), F.col("proof")) == F.col("root")).alias("forged"), merkle.proof_digest(F.col("proof")).alias("p"), "proof").collect()
    assert len(got) == len(rows) and all(r.holds for r in got) and all(r.forged == (r.text is None) for r in got)  # a null text stays null
    assert all(r.p == sha(*[x for s in r.proof for x in s["others"]]) for r in got)


def test_one_row_is_its_own_root(spark):
    r = merkle.manifest(frame(spark, [(1, "a", None, None, 2)])).collect()[0]
    assert r.leaf == r.subroot == r.root == leaf(1, None, None, 2, "a") and r.proof == []


def test_no_rows(spark):
    assert merkle.manifest(frame(spark, [(1, "a", None, None, 2)]).limit(0)).count() == 0
