"""The pipeline on a small corpus against a plain version of each stage."""

import os
import random
from collections import Counter

import corpus_pipeline
import pytest
from helixar.llm import common, decontam, packing, quality, simhash
from tests.llm.test_minhash import sets_of
from tests.llm.test_operators import brute_counts, brute_hits, brute_lines, crc, ids_of


def brute_lines_in_order(rows):
    """The rows of brute_lines, which keeps none apart, in the order given."""
    made = {}
    for doc, text, n, k in brute_lines(rows):
        made.setdefault((doc, n), []).append((doc, text, n, k))
    by_row = []
    whole = [(d, t, s) for d, t, _, s in rows]
    for d, t, s in whole:
        lines = [] if t is None else t.split("\n")
        fit = [x for x in made[d, len(lines)] if x[1] == t or x[1] is not None and set(x[1].split("\n")) <= set(lines)]
        by_row.append(fit[0])
    return by_row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string"


def test_stages_return_their_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, "r")], SCHEMA)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "q")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_lines_on_a_tenth_of_the_pages(spark, tmp_path):
    """A line on 10 of 100 different pages goes; the lines of a page with 50 copies stay."""
    rows = [(i, f"body {i}\nmenu" if i < 10 else f"body {i}", "en", "s", 6, "r") for i in range(100)]
    rows += [(100 + i, "copied\npage", "en", "s", 11, "r") for i in range(50)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()}
    assert got[3] == ("body 3", 6) and got[50] == ("body 50", 6) and got[120] == ("copied\npage", 11) and len(got) == 150


def tables(spark, path, docs, labels, benchmark, schema=SCHEMA):
    spark.createDataFrame(docs, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def brute_pipeline(docs, labels, benchmark):
    """The rows that the last stage packs, by plain Python: base rules and level path, lines, components, spans."""
    from math import comb

    def ratios(text):
        n, chars, symbols, dup, rep = brute_counts(text)
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        over = lambda a, b: a / b if b else 0.0
        t = text or ""
        return (n < 50 or 100 * rep > 50 * n), {"symbols": over(symbols, chars), "marks": over(t.count("!") + t.count("?"), n), "dup_lines": over(dup, len(lines)), "repeats": over(rep, n), "capitals": over(sum(c.isascii() and c.isupper() for c in t), chars)}

    good = {d for d, q, _ in labels if q == 1}
    made = [(d, *ratios(d[1])) for d in docs]
    strata = {d[2] for d, failed, _ in made if not failed and d[0] in good}
    level = {}
    for s in strata:
        held = [max(sum(r[k] > g for g in grid) for k, (_, _, grid) in quality.RULES.items()) for d, failed, r in made if not failed and d[0] in good and d[2] == s]
        for i in range(4, -1, -1):
            x = sum(v > i for v in held)
            if sum(comb(len(held), j) * 0.05**j * 0.95 ** (len(held) - j) for j in range(x + 1)) > 0.05 / len(strata):
                break
            level[s] = i
    kept = [d for d, failed, r in made if not failed and not (d[2] in level and any(r[k] > grid[level[d[2]]] for k, (_, _, grid) in quality.RULES.items()))]
    out = []
    for d, (_, text, _, n) in zip(kept, brute_lines_in_order([(d[0], d[1], d[2], d[3]) for d in kept]), strict=True):
        out.append((d[0], text, *d[2:]))
    sets, groups = [sets_of(d[1]) for d in out], list(range(len(out)))

    def root(i):
        while groups[i] != i:
            i = groups[i]
        return i

    for i in range(len(out)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                groups[root(i)] = root(j)
    first: dict = {}
    for i, d in enumerate(out):
        key = (d[0] is None, d[0] or 0)
        if root(i) not in first or key < first[root(i)][0]:
            first[root(i)] = (key, d)
    items = [(str(i), decontam.words_of(t)) for i, t in benchmark]
    return [d for _, d in first.values() if not brute_hits(decontam.words_of(d[1]), items, 10)[0]]


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(40)]
    docs = []
    for i in range(260):
        t = words(rng.randrange(60, 120))
        if i % 9 == 0:
            t += passage[:20] if i % 18 else passage[3:9]
        text = " ".join(t) + ("\nshared menu" if i % 3 == 0 else "") + (" #$%" * 60 if i % 50 == 7 else "")
        docs.append((i, text, "en" if i < 200 else "de", f"s{i % 2}", 1, "r"))
    for i in range(0, 40, 4):  # near copies and copies
        t = docs[i][1].split(" ")
        t[5] = "changed"
        docs.append((300 + i, " ".join(t), "en", "s0", 1, "r"))
        docs.append((400 + i, docs[i][1], "en", "s1", 1, "r"))
    docs += [(900, None, "en", "s0", None, None), (901, "", None, None, 0, "r"), (902, "few words", "en", "s0", 1, "r"), (902, docs[1][1], "en", "s0", 1, "r"), (None, " ".join(words(70)), None, None, None, None), (903, " ".join(words(9000)), "en", "s0", 1, "r")]
    labels = [(i, int(i % 50 != 7), 0) for i in range(240)]
    benchmark = [(1, " ".join(passage)), (2, None), (3, "x y z")]
    sf = tables(spark, tmp_path, docs, labels, benchmark)
    other = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), with_ids=False)
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, sf).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus_pipeline.run(spark, f"{sf}/none")
    assert len(set(os.listdir(folder)) - before) == 1 and before <= set(os.listdir(folder))  # the result alone stays, and what others wrote
    assert {r.doc_id for r in other.collect()} == {d[0] for d in docs}
    want = Counter((d[0], len(ids := ids_of(d[1])), crc(ids)) for d in brute_pipeline(docs, labels, benchmark))
    assert 150 < len(want) < 260
    whole: dict = {}
    for r in got:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert {(d, n) for d, n, _ in want} == set(whole) and all(sum(r.length for r in rs) == n for (_, n), rs in whole.items())
    assert all(want[d, n, rs[0].ids_crc32] == 1 for (d, n), rs in whole.items() if len(rs) == 1) and any(len(rs) > 1 for rs in whole.values())


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0


def test_clashing_columns(spark, tmp_path):
    schema = SCHEMA.replace("root string", "root string, kept string, counts string, n_dropped string, n_hit string, items string, _h1 string, component_id string, _rank string")
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{rng.randrange(9999)}" for _ in range(80)), "en", "s", 1, "r", *"abcdefgh") for i in range(20)]
    d, sf = spark.createDataFrame(docs, schema), tables(spark, tmp_path, docs, [(1, 1, 0)], [(1, "a b c")], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, d, sf)
        assert got.columns == d.columns and sorted(map(tuple, got.collect())) == sorted(docs)
