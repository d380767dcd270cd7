"""Expansion, cost, graph and path operators on small cases with hand-written results."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixar import constants as K
from helixar.functions import intervals as I
from helixar.functions import sequences as S
from helixar.operators import cost, expand, graph, lab, library, match, paths, score
from helixar.plans import queries
from helixar.plans.design import design
from helixar.sources import params
from helixar.sources import sequences as files


@pytest.fixture(scope="module")
def table(spark):
    return cost.span_cost(spark).cache()


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def frame(spark, rows, circular):
    return spark.createDataFrame([(k, b, circular) for k, b in rows], "key string, bases string, is_circular boolean")


def test_regions_against_positions(spark):
    rows = [(a, b) for a in range(12) for b in range(12)]
    df = spark.createDataFrame(rows, "a int, b int").withColumn("r", I.make(F.col("a"), F.col("b"), F.lit(10), F.lit(True)))
    df = df.withColumn("pieces", I.pieces(F.col("r.a"), F.least("r.n", F.lit(10)), F.lit(10)))
    for r in df.collect():
        a, b = r.a % 10, (r.b - 1) % 10 + 1
        assert r.r.a == a
        if r.a == r.b:
            assert r.r.n == 0
            continue
        assert r.r.b == b
        assert (a + r.r.n - 1) % 10 + 1 == b
        if r.r.n <= 10:
            got = {p for lo, hi in r.pieces for p in range(lo, hi)}
            assert got == {(a + i) % 10 for i in range(r.r.n)}


def test_range_join_is_exact(spark):
    rng = random.Random(3)
    left = [(rng.randrange(3), rng.randrange(100), rng.randrange(60)) for _ in range(80)]
    right = [(rng.randrange(3), rng.randrange(150)) for _ in range(80)]
    l = spark.createDataFrame([(i, k, a, a + n) for i, (k, a, n) in enumerate(left)], "i int, k int, lo int, hi int")
    r = spark.createDataFrame([(j, k, p) for j, (k, p) in enumerate(right)], "j int, k int, p int")
    for closed in (False, True):
        got = sorted((x.i, x.j) for x in I.range_join(l, r, ["k"], "lo", "hi", "p", 7, closed).select("i", "j").collect())
        want = sorted((i, j) for i, (k, a, n) in enumerate(left) for j, (m, p) in enumerate(right) if k == m and (a <= p < a + n or (closed and p == a + n)))
        assert got == want


def test_primer_costs(spark):
    got = {(r.l, r.r, r.span): r for r in cost.primer_model(spark).filter(F.col("span").isin([-40, -30, -20, 0, 20, 60, 200])).collect()}
    want = {(0, 0, -40): (0, 0.9), (0, 0, -30): (0, 0.9), (0, 0, -20): (0, 0.8), (1, 0, -30): (36.0, 0.9), (0, 1, -30): (36.0, 0.9), (1, 0, 0): (41.0, 0.9), (1, 0, 60): (80.4444, 0.75 * 1.2), (1, 1, 0): (43.6667, 0.9), (1, 1, 60): (58.5, 0.8), (1, 1, 200): (145.0625, 0.8)}
    for k, (c, e) in want.items():
        assert got[k].cost == pytest.approx(c, abs=1e-3), k
        assert got[k].efficiency == pytest.approx(e), k
    assert got[0, 0, 20].cost == float("inf")


def test_span_costs(table):
    got = {(r.l, r.r, r.span): r for r in table.collect()}
    for k, c, m in (((0, 0, 100), 146.9136, 89.0), ((0, 0, 512), 196.2963, 129.0), ((0, 0, 1000), 344.4444, 209.0), ((1, 1, 512), 242.0988, 166.1), ((1, 1, 2000), 585.5556, 404.3)):
        assert got[k].cost == pytest.approx(c, abs=1e-3), k
        assert got[k].material == pytest.approx(m, abs=1e-6), k


def test_parameters_are_checked(tmp_path):
    assert params.validate(params.DEFAULTS) is params.DEFAULTS
    for bad in (params.DEFAULTS | {"more": 1}, {k: v for k, v in params.DEFAULTS.items() if k != "primer_cost"}, params.DEFAULTS | {"global_time_cost": "x"}):
        with pytest.raises(params.ParameterError):
            params.validate(bad)


def test_matches_on_both_strands_and_over_the_origin(spark):
    g = dna(600, 1)
    rc = g[100:200].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    goals = frame(spark, [("g", g)], True)
    inv = frame(spark, [("plus", "AC" + g[50:150] + "GT"), ("minus", rc), ("wrap", g[560:] + g[:60])], False)
    got = {(r.subject_key, r.strand, r.q_start, r.q_raw_end, r.n) for r in match.exact_matches(goals, inv, 40).filter("n > 90").collect()}
    assert {(k, s, n) for k, s, _, _, n in got if k != "plus"} == {("minus", -1, 100), ("wrap", 1, 100)}
    assert ("wrap", 1, 561, 60, 100) in got and ("minus", -1, 101, 200, 100) in got
    whole = {(r.subject_key, r.strand, r.q_start, r.q_raw_end) for r in match.whole_matches(goals, inv, 14).collect()}
    assert whole == {("minus", -1, 101, 200), ("wrap", 1, 561, 60)}


def _hits_by_looking(goals, inventory, least):
    """(goal, subject, strand, q_start, s_start, n) of every maximal match, diagonal by diagonal."""
    out = set()
    for (g, base, circle), (key, subject, _) in itertools.product(goals, inventory):
        size, x = len(base or ""), base or ""
        for strand, y in ((1, subject), (-1, subject.translate(str.maketrans("ACGT", "TGCA"))[::-1])):
            for d in range(-len(y) + 1, 2 * size if circle else size):
                same = lambda q: 0 <= q - d < len(y) and x[q % size] == y[q - d]
                a = max(d, 0)
                while a < min(size, d + len(y)):
                    b = a
                    while b < min((2 * size - 1 if circle else size), d + len(y)) and same(b):
                        b += 1
                    wraps = circle and a == 0 and d < 0 and base[-1] == y[-d - 1]
                    n = min(b, a + size) - a
                    if n >= least and not wraps:
                        out.add((g, key, strand, a + 1, a - d + 1 if strand == 1 else len(y) - a + d, n))
                    a = b + 1
    return out


@pytest.mark.parametrize("sieved", [True, False])
def test_goals_are_read_once_for_a_small_inventory(spark, sieved):
    seen = spark.sparkContext.accumulator(0)
    g = [dna(n, n) for n in (400, 333, 31, 30, 29, 16, 15, 1)]
    rc = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    goals = [(f"{i}{circle}", x, circle) for i, x in enumerate([*g, "", "ACG" * 40, "A" * 50 + dna(70, 3) + "A" * 50]) for circle in (True, False)]
    planted = [("30", g[0][37:67]), ("29", g[0][101:130]), ("over", g[1][-17:] + g[1][:14]), ("back", rc(g[1][-60:] + g[1][:50])), ("whole", g[2] * 3), ("small", g[3] + g[4]), ("again", "ACG" * 15), ("same", "A" * 35 + "C"), ("two", g[0][200:240] + "T" + g[0][210:260])]
    inventory = [(k, x, False) for k, x in planted]
    pads = [(f"p{i}", dna(1500, 100 + i), i % 2 == 0) for i in range(60)]  # further than one block of places
    source = counted(spark.createDataFrame([*pads, *goals, ("none", None, True)], "key string, bases string, is_circular boolean").coalesce(1), seen)
    got = match.exact_matches(source, frame(spark, planted, False), 30, sieved=sieved).collect()
    found = {(r.query_key, r.subject_key, r.strand, r.q_start, r.s_start, r.n) for r in got}
    assert len(found) == len(got) and found == _hits_by_looking(goals, inventory, 30)
    assert {"30", "over", "back", "whole", "again", "same", "two"} <= {x[1] for x in found} and "29" not in {x[1] for x in found}
    if sieved:  # a goal without a match goes no further, and none is made again
        assert seen.value == len(pads) + len(goals) + 1
    whole = {(r.query_key, r.subject_key, r.strand, r.q_start) for r in match.whole_matches(source, frame(spark, planted, False), 14, sieved=sieved).collect()}
    size = {k: len(x) for k, x, _ in inventory}
    assert whole == {(q, k, t, a) for q, k, t, a, _, n in _hits_by_looking([x for x in goals if x[1]], inventory, 14) if n == size[k]}


def test_bases_are_letters_alone(spark):
    odd = ["Az, by!", "\u00e9t\u00e9 K\u212a \u0131I \u00dfs \u017fx", "\U0001f600q\x00r\n", "", None, "".join(map(chr, range(256)))]
    d = queries.bases(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), "doc_id").collect()
    letters = [None if x is None else "".join(queries.DNA[queries.ALPHABET.index(y.upper())] for y in x if y.isascii() and y.isalpha()) for x in odd]
    assert [tuple(r) for r in d] == [(str(i), x) for i, x in enumerate(letters)]


def test_small_goals_are_dealt_for_the_search(spark, table):
    groups = spark.createDataFrame([(f"g{i}", K.FRAGMENT, a, b, 500, 1000, True) for i in range(16) for a, b in ((0, 500), (500, 1000))], "query_key string, atype string, a int, b int, n int, length int, cyclic boolean")
    d = paths.assemblies(graph.assembly_graph(groups, table), 1).select("query_key", F.spark_partition_id().alias("part")).collect()
    assert len(d) == 16 and len({r.part for r in d}) > 1


def test_overlap_products(spark):
    g = spark.createDataFrame([("q", "x", 0, 300, 300, 1000), ("q", "y", 150, 500, 350, 1000), ("q", "z", 900, 120, 220, 1000)], "query_key string, gid string, a int, b int, n int, length int")
    got = {(r.gid, r.o_gid, r.side, r.a, r.b, r.n) for r in expand.overlap_products(g).collect()}
    assert got == {("x", "y", "left", 0, 150, 150), ("x", "y", "overlap", 150, 300, 150), ("z", "x", "left", 900, 1000, 100), ("z", "x", "overlap", 0, 120, 120)}


def test_primer_pairs(spark):
    g = spark.createDataFrame([("q", "t", 100, 600, 500, 1000)], "query_key string, gid string, a int, b int, n int, length int")
    p = spark.createDataFrame([("q", "f", 150, 180, 30, 1), ("q", "r", 400, 430, 30, -1), ("q", "early", 80, 110, 30, 1), ("q", "late", 590, 620, 30, -1)], "query_key string, pid string, a int, b int, n int, direction int")
    got = {(r.atype, r.fwd, r.rev, r.a, r.b) for r in expand.primer_pairs(g, p).collect()}
    assert got == {(K.PCR_PRIMERS, "f", "r", 150, 430), (K.PCR_LEFT, "f", None, 150, 600), (K.PCR_RIGHT, None, "r", 100, 430)}


def test_path_goldens(spark):
    e = [(0, 1, 100.0, 0.5), (1, 2, 100.0, 0.5), (2, 3, 100.0, 0.5), (3, 4, 100.0, 0.5), (0, 5, 200.0, 0.75), (5, 6, 200.0, 0.75), (6, 7, 200.0, 0.75), (7, 4, 200.0, 0.75)]
    df = spark.createDataFrame([("k", *x) for x in e], "query_key string, src int, dst int, material double, efficiency double")
    got = {(r.src, r.dst): r.cost for r in paths.path_distances(df).collect()}
    for n, c in {0: 0, 1: 200, 2: 800, 3: 2400, 4: 800 / 0.75**4}.items():
        assert got[0, n] == pytest.approx(c)
    adjacency: dict = {}
    for a, b, m, f in e:
        adjacency.setdefault(a, {})[b] = (m, f)
    assert paths.path_to(paths.shortest(adjacency, 0), 4) == [0, 5, 6, 7, 4]


def brute_components(pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_connected(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in library.connected(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == brute_components(pairs)


def plan(spark, table, goal, templates, **more):
    d = design(frame(spark, [("g", goal)], True), frame(spark, templates, False), table=table, n_paths=3, postprocess=False, **more)
    best = d.assemblies.filter("rank = 0").collect()
    return d, [tuple(x) for x in best[0].path] if best else None


def test_plan_without_gaps(spark, table):
    g = dna(3000, 7)
    d, path = plan(spark, table, g, [("a", "N" * 6 + g[:1000] + "N" * 6), ("b", g[1000:2000]), ("c", g[2000:])])
    assert [(x[0] % 3000, x[1], x[2], x[3]) for x in path] == [(0, True, "A", False), (1000, True, "B", False), (1000, True, "A", False), (2000, True, "B", False), (2000, True, "A", False), (0, True, "B", False)]
    steps = d.steps().filter("rank = 0").collect()
    assert sum(s.span for s in steps) == 3000
    assert d.reactions().filter("assembly_id = 0 and name = 'Assembly'").count() == 1


def test_plan_with_gaps(spark, table):
    g = dna(3000, 8)
    _, path = plan(spark, table, g, [("a", g[:950]), ("b", g[1000:2000]), ("c", g[2050:])])
    assert [(x[0] % 3000, x[2]) for x in path] == [(0, "A"), (950, "B"), (1000, "A"), (2000, "B"), (2050, "A"), (0, "B")]


def test_plan_over_the_origin(spark, table):
    g = dna(5000, 9)
    _, path = plan(spark, table, g, [("a", g[1000:2000]), ("b", g[3500:] + g[:500])])
    assert sorted((x[0] % 5000, x[2]) for x in path) == [(500, "B"), (1000, "A"), (2000, "B"), (3500, "A")]


def test_profile_against_strings():
    rng = random.Random(2)
    motif = dna(30, 4)
    s = dna(200, 5) + motif + dna(50, 6) + motif + motif.translate(str.maketrans("ACGT", "TGCA"))[::-1] + "A" * 40 + dna(60, rng.randrange(9))
    r, h, base, gc, at, _ = S.Profile(s).parts()

    def many(xs):
        return sum(1 for x in set(xs) if xs.count(x) > 1)

    k14 = [s[i : i + 14] for i in range(len(s) - 13)]
    f = [s[i : i + 20] for i in range(len(s) - 19)]
    rc = [x.translate(str.maketrans("ACGT", "TGCA"))[::-1] for x in f]
    assert (r, h) == (many(k14), many(f + rc) - 2 * many(f))
    assert base == sum(x.count(b) / 20 > 0.75 for x in f for b in "ACGT") and at == sum((x.count("A") + x.count("T")) / 20 > 0.9 for x in f)


def test_planted_repeat_is_cut():
    m = dna(30, 11)
    s = dna(1000, 12) + m + dna(20, 13) + m + dna(1000, 14)
    assert any(1000 < x < 1080 for x in score.cuts_of(s, False, 10, 100, 30))


def counted(df, seen):
    """df, with the rows that are made of it counted in an accumulator."""

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_anneal_reads_templates_once(spark):
    seen = spark.sparkContext.accumulator(0)
    t = [dna(n, n) for n in (13, 14, 500, 70_000, 300)]
    rc = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    temp = counted(frame(spark, [(str(i), x) for i, x in enumerate(t)], False).coalesce(1), seen)
    over = t[1][-4:] + t[2][:10]  # over the end of a template into the next: no place
    ends = {"a": t[1], "b": "TTT" + t[2][-20:], "c": "G" * 8 + t[3][65_530:65_550], "d": "AC" + rc(t[3][2:22]), "e": over}
    got = lab.anneal(spark.createDataFrame(list(ends.items()), "primer_key string, primer string"), temp).collect()
    want = set()
    for key, x in enumerate(t):
        for strand, s in ((1, x), (-1, rc(x))):
            for name, primer in ends.items():
                for i in range(len(s) - 13):
                    if s[i : i + 14] == primer[-14:]:
                        n = max(n for n in range(14, len(primer) + 1) if n <= i + 14 and s[i + 14 - n : i + 14] == primer[-n:])
                        want.add((name, str(key), strand, i + 14 if strand == 1 else len(s) - i - 14, n, primer[-n:], primer[:-n]))
    assert {tuple(r) for r in got} == want and {x[0] for x in want} == set("abcd")
    assert seen.value == len(t)


def test_pcr_anneals_once(spark):
    seen = spark.sparkContext.accumulator(0)
    t = dna(300, 21)
    temp = frame(spark, [("t", t)], False)
    p = spark.createDataFrame([("f", t[50:70]), ("r", t[180:200].translate(str.maketrans("ACGT", "TGCA"))[::-1])], "primer_key string, primer string")
    assert [r["product"] for r in lab.pcr(counted(lab.anneal(p, temp), seen), temp).collect()] == [t[50:200]]
    assert seen.value == 2


def _repeated_calls(monkeypatch):
    """The calls of S.repeated, which sorts the k-mers of one slice, from here on."""
    calls, own = [], S.repeated
    monkeypatch.setattr(S, "repeated", lambda x: calls.append(len(x)) or own(x))
    return calls


def test_cuts_sort_a_sequence_once(monkeypatch):
    s = (dna(300, 1) + "ACGTTGCATTAGGCCA" * 3 + dna(150, 2)) * 4 + "G" * 90 + "ACGN" * 20
    p, q = S.Profile(s), S.Profile(s)
    q._places()
    for i in range(0, len(s), 97):
        for j in range(i, len(s) + 1, 131):
            assert p.cost(i, j) == q.cost(i, j)
    calls = _repeated_calls(monkeypatch)
    assert len(score.cuts_of(s, False, 10, 10, 30)) > 5
    assert len(calls) <= 3


def test_slices_of_equal_size_are_counted_together(monkeypatch):
    s = (dna(300, 1) + "ACGTTGCATTAGGCCA" * 3 + dna(150, 2)) * 4 + "G" * 90 + "ACGN" * 20
    p = S.Profile(s)
    a = np.array([*range(0, 1500, 10), 3, 1400, 1400, 0])
    b = a + np.array([200, 77] * 75 + [5, 0, 9000, 9000])
    want = [p.cost(int(i), int(j)) for i, j in zip(a, b, strict=True)]
    calls = _repeated_calls(monkeypatch)
    assert S.Profile(s).costs(a, b).tolist() == want and not calls


def test_lab(spark):
    t = dna(300, 21)
    rc = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    temp = frame(spark, [("t", t)], False)
    p = spark.createDataFrame([("f", "GGGG" + t[50:70]), ("r", "CCC" + rc(t[180:200]))], "primer_key string, primer string")
    a = lab.anneal(p, temp)
    assert {(r.primer_key, r.strand, r.end) for r in a.collect()} == {("f", 1, 70), ("r", -1, 180)}
    (prod,) = [r["product"] for r in lab.pcr(a, temp).collect()]
    assert prod.endswith(t[50:200] + "GGG") or prod == "GGGG"[: 70 - 50] + t[50:200] + "GGG"
    d = lab.digest(frame(spark, [("c", "AAGAATTCAAAAAGAATTCAA")], True), "GAATTC", 1).collect()
    assert sorted((r.start, r.n) for r in d) == [(3, 11), (14, 10)]


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACGT\nAC\n>y\nGG\n")
    assert {(r.key, r.bases) for r in files.read_fasta(spark, f"{tmp_path}/*.fa").collect()} == {("x", "ACGTAC"), ("y", "GG")}
    s = spark.createDataFrame([("k", "a name", "ACGTACGTAC", 10, True, [(0, 4, -1, "p", "gene")])], files.SEQUENCES)
    files.write_genbank(s, f"{tmp_path}/gb")
    back = files.read_genbank(spark, f"{tmp_path}/gb/part*").collect()
    assert [(r.key, r.name, r.bases.upper(), r.is_circular) for r in back] == [("k", "a name", "ACGTACGTAC", True)]
    assert tuple(back[0].features[0]) == (0, 4, -1, "p", "gene")


def test_bands_and_penalties(spark):
    df = spark.createDataFrame([(3999,), (4000,), (5999,), (6500,)], "span int").select(graph.band_multiplier(F.col("span")).alias("x"))
    assert [r.x for r in df.collect()] == [1.0, 0.8, 0.5, 1.0]
    r = spark.range(1).select(graph.complexity_efficiency(F.lit(20.0), F.lit(0.9)).alias("a"), graph.mispriming_efficiency(F.lit(2), F.lit(0.8)).alias("b"), cost.adjust(F.lit(5.0), F.lit(0.0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (0.05, pytest.approx(0.2), float("inf"))


def test_misprimings_on_a_turned_circle():
    m = dna(14, 30)
    s = dna(400, 31) + m + dna(100, 32) + m + dna(300, 33)
    turned = s[500:] + s[:500]
    assert S.amplicon_misprimings(s, 390, 600, True) == S.amplicon_misprimings(turned, 390 + len(s) - 500, 100, True) > 0


def test_cyclic_weights_need_the_copy():
    nodes = [(0, True, "A", False), (5, True, "B", False), (10, True, "A", False), (15, True, "B", False)]
    m, e = paths.all_pairs(4, np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([1.0, 2.0, 1.0]), np.ones(3))
    w = paths.cyclic_weights(nodes, m, e, 10)
    assert w[0, 1] == m[0, 1] + m[1, 3]


def test_digest_of_overlapping_sites(spark):
    d = lab.digest(frame(spark, [("l", "GACGACGACTT"), ("m", "TTGACGAC"), ("n", "AAAA"), ("e", "")], False), "GACGAC", 1).collect()
    assert sorted((r.key, r.start, r.n) for r in d) == [("l", 0, 1), ("l", 1, 3), ("l", 4, 7), ("m", 0, 3), ("m", 3, 5), ("n", 0, 4)]


def test_template_with_fewest_misprimings(spark):
    rng_seq, noise = dna(400, 31), dna(200, 32)
    bad = rng_seq + noise + rng_seq[:60]  # its first 60 bases prime again
    al = spark.createDataFrame(
        [("g", "bad", K.PCR, 100, 400, 0, 400, 1), ("g", "good", K.PCR, 100, 400, 0, 400, -1), ("g", "far", K.PCR, 900, 400, 0, 400, 1)],
        "query_key string, subject_key string, atype string, a int, n int, sa int, sb int, direction int",
    ).withColumn("length", F.lit(2000))
    rc = rng_seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    stock = frame(spark, [("bad", bad), ("good", rc), ("far", dna(400, 33))], False)
    regions = spark.createDataFrame([("g", K.PCR, 100, 500, 400, 2000), ("g", K.PCR, 700, 900, 200, 2000), ("g", K.PCR_LEFT, 80, 500, 420, 2000), ("g", K.PCR_RIGHT, 80, 500, 420, 2000)], "query_key string, mtype string, a int, b int, n int, length int")
    got = {(r.mtype, r.a): (r.template, r.n_misprimings, r.n_templates) for r in score.template_misprimings(regions, al, stock).collect()}
    want = S.amplicon_misprimings(rc, 0, 400, False)
    assert want < S.amplicon_misprimings(bad, 0, 400, False)
    assert got == {(K.PCR, 100): ("good", want, 2), (K.PCR_LEFT, 80): ("good", want, 2)}


def test_misprimings_lower_the_efficiency_of_pcr_edges(spark):
    s = dna(400, 41)
    stock = frame(spark, [("t", s + dna(100, 42) + s[:40])], False)
    al = spark.createDataFrame([("g", "t", K.PCR, 0, 400, 0, 400, 1)], "query_key string, subject_key string, atype string, a int, n int, sa int, sb int, direction int").withColumn("length", F.lit(1000))
    groups = spark.createDataFrame([("g", K.PCR, 0, 400, 400, 1000, True), ("g", K.FRAGMENT, 0, 400, 400, 1000, True)], "query_key string, atype string, a int, b int, n int, length int, cyclic boolean")
    edges = graph.internal_edges(groups)
    got = {(r.mtype, round(r.efficiency, 12)) for r in score.score_misprimings(edges, al, stock).collect()}
    n = S.amplicon_misprimings(s + dna(100, 42) + s[:40], 0, 400, False)
    assert n > 0 and got == {(K.PCR, round(0.95 * 0.5**n, 12)), (K.FRAGMENT, 0.98)}
    assert score.remove_inefficient(edges.withColumn("efficiency", F.lit(0.01))).count() == 0


def test_plan_of_a_library(spark, table):
    part = dna(600, 51)
    goals = frame(spark, [("g1", dna(800, 52) + part + dna(900, 53)), ("g2", dna(700, 54) + part + dna(1100, 55))], True)
    shared = library.shared_groups(goals)
    assert {(r.query_key, r.n, r.n_clusters) for r in shared.collect()} == {("g1", 600, 2), ("g2", 600, 2)}
    g1 = goals.filter("key = 'g1'").first().bases
    g2 = goals.filter("key = 'g2'").first().bases
    d = design(goals, frame(spark, [("a", g1[:800]), ("b", g1[1400:]), ("c", g2[:700]), ("d", g2[1300:])], False), table=table, library=True, partition=False)
    costs = {r.material for r in d.edges.filter(F.col("mtype") == K.SHARED).select("material").distinct().collect()}
    assert costs == {1000.0 / 2 / 2}
    assert {r.query_key for r in d.assemblies.select("query_key").distinct().collect()} == {"g1", "g2"}


def test_paths_from_a_source(spark):
    rows = [("k", 0, 1, 100.0, 0.5), ("k", 1, 4, 100.0, 0.5), ("k", 0, 5, 200.0, 0.75), ("k", 5, 4, 10.0, 0.75), ("k", 8, 9, 1.0, 1.0)]
    e = spark.createDataFrame(rows, "query_key string, src int, dst int, material double, efficiency double")
    src = spark.createDataFrame([("k", 0)], "query_key string, source int")
    got = {r.node: round(r.cost, 6) for r in paths.distances_from(e, src).collect()}
    assert got == {0: 0.0, 1: 200.0, 5: round(200 / 0.75, 6), 4: round(210 / 0.5625, 6)}
    assert {r.node for r in paths.distances_from(e, src, cutoff=250).collect()} == {0, 1}


def test_items_first(spark):
    from helixar.operators import frame as tidy

    d = spark.createDataFrame([([1, 2, 3],), ([4],), ([],)], "x array<int>")
    got = [r.y for r in d.select(tidy.prioritize(F.col("x"), F.array(F.lit(2), F.lit(0))).alias("y")).collect()]
    assert got == [[3, 1, 2], [4], []]


def test_tiles_around_a_circle(spark):
    s = dna(230, 61) + "A" * 40
    got = {(r["size"], r["start"]): round(r.complexity, 9) for r in score.tiled_complexity(frame(spark, [("k", s)], True), (100, 500), 100).collect()}
    gc = {i: (s + s)[i : i + 100].count("G") + (s + s)[i : i + 100].count("C") for i in (0, 100, 200)}
    assert set(got) == {(100, i) for i in gc}
    assert all(got[100, i] >= round(abs(n - 50) * 17 / 25, 9) for i, n in gc.items())
    assert got == {(100, i): round(S.Profile(s + s).cost(i, i + 100), 9) for i in gc}


def test_partition_points_of_short_documents(spark, tmp_path):
    """The query cuts documents under 1,000 bases, on the grid of 10; running counts give the cost of every slice."""
    import random

    from helixar.functions import sequences as S
    from helixar.plans import queries

    rng = random.Random(4)
    x = "".join(rng.choice("ACGT") for _ in range(200))
    text = x + "".join(rng.choice("ACGT") for _ in range(100)) + x
    p = S.Profile(text)
    at = [*range(40, 460)]
    assert p.prefix_costs(30, S.np.array(at)).tolist() == [p.cost(30, i) for i in at]
    assert p.suffix_costs(S.np.array(at), 470).tolist() == [p.cost(i, 470) for i in at]
    letters = text.translate(str.maketrans("CGT", "BCD"))
    spark.createDataFrame([(1, letters)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cuts = [r.cut for r in queries.partition_points(spark, str(tmp_path)).collect()]
    best = min(range(10, 470, 10), key=lambda i: p.cost(0, i) + p.cost(i + 30, 500))
    assert best in cuts


def test_shared_queries_over_all_lines(spark, tmp_path):
    """Components and clusters of all order lines against union-find; no quantity or discount leaves a line out."""
    import random

    from helixar.plans import part_queries, queries

    rng = random.Random(8)
    pairs = [(rng.randrange(40), rng.randrange(60)) for _ in range(45)]
    spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, b, 1.0, 0.0) for i, (_, b) in enumerate(pairs)], "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")

    def components(edges):
        root = {x: x for e in edges for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {x: find(x) for x in root}

    got = {r.node: r.component for r in queries.shared_components_all(spark, str(tmp_path)).collect()}
    assert got == components([(a, 1_000_000_000 + b) for a, b in pairs])
    by = components([(f"c{a}:0:100", f"p{b}:{a % 2}:100") for a, b in pairs])
    parts = {}
    for x, k in by.items():
        parts.setdefault(k, []).append(x)
    good = {k: v for k, v in parts.items() if len({x.split(":")[0] for x in v}) == len(v)}
    rows = part_queries.shared_clusters_all(spark, str(tmp_path)).collect()
    assert {(f"{r.query_key}:{r.a}:{r.b}", r.component, r.n_clusters) for r in rows} == {(x, k, len(v)) for k, v in good.items() for x in v}
    assert good


def test_tiled_complexity_of_documents(spark, tmp_path):
    """The query profiles documents in all four sizes."""
    import random

    from helixar.functions import sequences as S
    from helixar.plans import part_queries

    rng = random.Random(6)
    text = "".join(rng.choice("ABCD") for _ in range(2050))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    dna = text.translate(str.maketrans("BCD", "CGT"))
    want = {(n, i): round(S.Profile(dna + dna).cost(i, i + n), 6) for n in (100, 500, 1000, 2000) for i in range(0, 2050, 100)}
    got = {(r["size"], r["start"]): r.complexity for r in part_queries.tiled_complexity(spark, str(tmp_path)).collect()}
    assert got == want


def test_reactions_join_to_the_goal(spark):
    """Products reach into their neighbours by the extensions of their new primers, so that the pieces on end are the goal."""
    rng = random.Random(12)
    goal = "".join(rng.choice("ACGT") for _ in range(3000))
    templates = [("t1", "GATTACA" + goal[:960]), ("t2", goal[1000:2000]), ("t3", goal[2010:3000])]
    d = design(frame(spark, [("g", goal)], True), frame(spark, templates, False), postprocess=False, n_paths=1)
    table = [r for r in d.reaction_table(rank=0).collect()]
    assert len(table[0]) == 13 and {r.DESIGN_ID for r in table} == {0}
    by: dict = {}
    for r in table:
        by.setdefault(r.REACTION_ID, []).append(r)
    twice = goal + goal
    pieces, stock = [], dict(templates)
    for rows in by.values():
        out = next(r for r in rows if r.ROLE == "OUTPUT")
        if rows[0].REACTION_NAME == "Assembly":
            assert out.SEQUENCE == goal and sum(r.ROLE == "INPUT" for r in rows) == len(by) - 1
            continue
        a = out.REGION.a
        assert out.SEQUENCE == twice[a : a + out.LENGTH] and out.REGION.b == (a + out.LENGTH - 1) % 3000 + 1
        pieces.append((a, out.LENGTH))
        if rows[0].REACTION_NAME == "PCR":
            left, right, template = [r for r in rows if r.ROLE == "INPUT"]
            assert template.TYPE == "TEMPLATE" and template.SEQUENCE == stock[template.KEY] and template.SEQUENCE != out.SEQUENCE
            other = out.SEQUENCE[::-1].translate(str.maketrans("ACGT", "TGCA"))
            assert out.SEQUENCE.startswith(left.SEQUENCE) and other.startswith(right.SEQUENCE)
            tail = next(n for n in range(len(left.SEQUENCE)) if left.SEQUENCE[n:] in template.SEQUENCE)
            assert out.SEQUENCE[tail:][:200] in template.SEQUENCE  # overhang, then what anneals
    pieces.sort()
    assert len(pieces) >= 3
    for (a, n), (b, _) in zip(pieces, pieces[1:] + [(pieces[0][0] + 3000, 0)], strict=True):
        assert 10 <= a + n - b <= 200  # neighbours overlap
