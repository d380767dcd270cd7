"""Near duplicates by shingle similarity against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from helixar.llm import minhash, simhash


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))}


def brute(rows, least=0.8):
    sets = [sets_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    parts = {}
    for i, r in enumerate(rows):
        parts.setdefault(find(i), set()).add(r[0])
    return {r[0]: min(parts[find(i)]) for i, r in enumerate(rows)}


def corpus():
    rng = random.Random(3)
    rows, at = [], 0
    for size in (60, 200):
        for n_copies in (1, 1, 3, 40):
            base = [f"w{rng.randrange(9999)}" for _ in range(size)]
            for _ in range(n_copies):
                words = list(base)
                for _ in range(rng.randrange(1 + size // 20)):
                    words[rng.randrange(size)] = f"x{rng.randrange(9999)}"
                rows.append((at, " ".join(words)))
                at += 1
    return [*rows, (at, rows[3][1].upper()), (at + 1, None), (at + 2, ""), (at + 3, "a b"), (at + 4, "A  b")]


@pytest.mark.parametrize("small,rounds,huge", [(32, 4, 1000), (2, 0, 2), (2, 1, 1000), (2, 1, 20)])
def test_components(spark, small, rounds, huge):
    rows = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=small, rounds=rounds, huge=huge).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows) and len(got) == len(rows)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_drops_near_copies(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{rng.randrange(9999)}" for _ in range(400)]
    other = [f"x{i}" if i in range(25, 400, 50) else w for i, w in enumerate(words)]  # similarity 356 / 436
    far = words[:200] + [f"y{i}" for i in range(200)]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((words, other, far))]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, str(tmp_path)).collect()} == {0, 2}


def test_bitmap_never_shows_more_than_the_difference():
    rng = random.Random(7)
    for size in (0, 1, 90, 5000):
        words = [f"w{rng.randrange(99999)}" for _ in range(size)]
        other = [f"x{rng.randrange(99999)}" if rng.random() < 0.1 else w for w in words]
        a, b = (minhash.shingles(" ".join(t)) for t in (words, other))
        bits = minhash.bitmap(a) ^ minhash.bitmap(b)
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert int(np.bitwise_count(bits.view(np.uint64)).sum()) <= apart
        if size == 90:
            assert np.bitwise_count(bits.view(np.uint64)).sum() > 0.8 * apart


def test_own_shingles_are_a_lower_bound(spark):
    sets = {1: [2, 4, 6, 7], 2: [4, 7, 9], 3: [9, 11]}
    got = minhash.own_shingles(spark.createDataFrame(list(sets.items()), "node long, set array<long>")).collect()
    assert {r.node: r.own for r in got} == {1: 2}


def test_pipeline_keeps_links_of_both_kinds(spark, tmp_path):
    """Near fingerprints of sets just below the least similarity link as much as similar sets of distant fingerprints."""

    def pair(seed, step):
        rng = random.Random(seed)
        a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        return [" ".join(a), " ".join("changed" if i % step == 8 else x for i, x in enumerate(a))]

    texts = [*pair(29, 44), *pair(0, 50), "another text"]
    sets, fps = [sets_of(t) for t in texts], [minhash.fingerprint(minhash.shingles(t)) for t in texts]
    similar, bits = (lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])), (lambda i, j: (fps[i] ^ fps[j]).bit_count())
    assert bits(0, 1) <= 3 and similar(0, 1) < 0.8 and bits(2, 3) > 3 and similar(2, 3) >= 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, str(tmp_path)).collect()) == [0, 2, 4]
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == [0, 1, 2, 4]


def test_fingerprint_is_the_majority_of_a_set():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64)
    for n in (0, 1, 2, 254, 255, 256, 1000):
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[:n]) > n)
        assert minhash.fingerprint(hashes[:n]) == want
