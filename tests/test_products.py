"""Junctions, cycles, features and sources against plain Python."""

import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixar.operators import assemble, features, lab
from helixar.sources import sequences as files

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def dna(rng, n):
    return "".join(rng.choices("ACGT", k=n))


def overlaps(pieces, least=15):
    """{(left, strand, right, strand): longest overlap}"""
    both = [(k, s, x if s == 1 else rc(x)) for k, x in pieces for s in (1, -1)]
    out = {}
    for (a, s, x), (b, t, y) in itertools.product(both, both):
        fits = [n for n in range(least, min(len(x), len(y)) + 1) if x[-n:] == y[:n]]
        if a != b and fits:
            out[a, s, b, t] = max(fits)
    return out


def brute_cycles(pieces):
    """{names: product} by trying every order and orientation."""
    edges, own, out = overlaps(pieces), dict(pieces), {}
    for k in range(2, len(pieces) + 1):
        for keys in itertools.permutations(sorted(own), k):
            if keys[0] != min(keys):
                continue
            for strands in itertools.product((1, -1), repeat=k - 1):
                nodes = list(zip(keys, (1, *strands), strict=True))
                steps = [edges.get((*a, *b)) for a, b in zip(nodes, nodes[1:] + nodes[:1], strict=True)]
                if None not in steps:
                    bases = "".join((own[p] if s == 1 else rc(own[p]))[: len(own[p]) - n] for (p, s), n in zip(nodes, steps, strict=True))
                    out[",".join(p + ("+" if s == 1 else "-") for p, s in nodes)] = bases
    return out


def ring(rng, laps, turn=()):
    """Pieces of a random circle that overlap by `laps`; those in `turn` are turned."""
    size = [rng.randrange(180, 260) for _ in laps]
    whole, at, out = dna(rng, sum(size)), 0, []
    for i, (n, lap) in enumerate(zip(size, laps, strict=True)):
        x = (whole + whole)[at : at + n + lap]
        out.append((f"p{i}", rc(x) if i in turn else x))
        at += n
    return whole, out


@pytest.fixture(scope="module")
def mixes():
    rng = random.Random(12)
    out = {"plain": ring(rng, (20, 60, 80))[1], "turned": ring(rng, (15, 150, 40, 33), turn=(0, 2))[1]}
    whole, p = ring(rng, (20, 30, 25, 22))
    out["branched"] = [*p, ("q1", p[1][1][:40] + dna(rng, 90) + p[1][1][-40:]), ("r9", dna(rng, 80))]  # another way from p0 to p2
    out["open"] = ring(rng, (20, 30, 20))[1][:2]
    a, b, x = dna(rng, 30), dna(rng, 30), dna(rng, 100)
    out["two of three"] = [("a", a + x + b), ("b", b + dna(rng, 90) + a), ("c", b + dna(rng, 50) + a)]
    return out


def pieces_of(spark, mixes):
    return spark.createDataFrame([(m, k, x) for m, p in mixes.items() for k, x in p], "mix string, key string, bases string")


def test_junctions_of_any_length(spark, mixes):
    got = {(r.mix, r.left, r.left_strand, r.right, r.right_strand): r.n for r in lab.junctions(pieces_of(spark, mixes), mix="mix").collect()}
    want = {(m, *k): n for m, p in mixes.items() for k, n in overlaps(p).items()}
    assert got == want and max(got.values()) == 150
    one = spark.createDataFrame(mixes["turned"], "key string, bases string")
    assert {(r.left, r.left_strand, r.right, r.right_strand): r.n for r in lab.junctions(one).collect()} == overlaps(mixes["turned"])


def test_a_shared_end_is_no_hot_pair(spark):
    rng = random.Random(2)
    rows = [(f"s{i}", dna(rng, 60) + "A" * 40) for i in range(30)]  # 30 equal seeds, no overlap of any two
    assert lab.junctions(spark.createDataFrame(rows, "key string, bases string")).filter("n >= 15 and left_strand = right_strand").count() == 0


def test_cycles_as_all_orders(spark, mixes):
    p = pieces_of(spark, mixes)
    got = assemble.products(assemble.cycles(lab.junctions(p, mix="mix")), p).collect()
    want = {(m, k): x for m, own in mixes.items() for k, x in brute_cycles(own).items()}
    assert {(r.mix, r.cycle): r.bases for r in got} == want
    assert {m for m, _ in want} == {"plain", "turned", "branched", "two of three"} and sum(m == "branched" for m, _ in want) == 2
    for r in got:
        own = dict(mixes[r.mix])
        assert r.holds and r.length == len(r.bases)
        assert all((own[k[:-1]] if k[-1] == "+" else rc(own[k[:-1]])) in r.bases * 3 for k in r.cycle.split(","))


def test_cycles_of_few_pieces(spark, mixes):
    j = lab.junctions(pieces_of(spark, mixes), mix="mix")
    assert {r.n for r in assemble.cycles(j, most=3).select(F.size("path").alias("n")).collect()} == {2, 3}
    assert assemble.cycles(j.filter("mix = 'open'")).count() == 0


def test_features_of_products(spark, mixes):
    """A feature of every piece lies in the product where its bases are."""
    one = features.annotation(F.col("key"), F.lit(30), F.lit(45), F.length("bases"), strand=1)
    p = pieces_of(spark, mixes).withColumn("features", F.array(one))
    for r in assemble.products(assemble.cycles(lab.junctions(p, mix="mix")), p).collect():
        own = dict(mixes[r.mix])
        assert len(r.features) == len(r.cycle.split(","))
        for f in r.features:
            top = "".join(r.bases[x.start : x.end] for x in f.parts)
            assert (top if f.strand == 1 else rc(top)) == own[f.name][30:75]


def positions(parts, n=None):
    return [p for x in parts for p in range(x[0], x[1])]


def as_rows(fs):
    return [(f["name"], f["strand"], [(p["start"], p["end"], p["strand"]) for p in f["parts"]]) for f in fs]


def located(name, strand, parts):
    return (parts[0][0], parts[-1][1], strand, name, "gene", [(a, b, strand) for a, b in parts])


def test_slices_against_positions(spark):
    rng, n = random.Random(5), 40
    fs = []
    for i in range(40):
        cuts = sorted(rng.sample(range(n + 1), rng.choice([2, 2, 4])))
        parts = list(zip(cuts[::2], cuts[1::2], strict=True))
        if rng.random() < 0.4:
            parts = [(rng.randrange(30, n), n), (0, rng.randrange(1, 20))]
        fs.append(located(f"f{i}", rng.choice([1, -1]), parts))
    cases = [(a, k) for a in range(0, n, 3) for k in (1, 7, 25, n)]
    df = spark.createDataFrame([(a, k, fs) for a, k in cases], f"a int, k int, features {files.LOCATED}")
    length = F.lit(n)
    cols = [features.sliced(F.col("features"), F.col("a"), F.col("k"), length, x).alias(y) for x, y in ((True, "some"), (False, "all"))]
    for r in df.select("a", "k", *cols).collect():
        got, whole = {f["name"]: f for f in r["some"]}, {f["name"]: f for f in r["all"]}
        for start, end, strand, name, kind, parts in fs:
            where = [(p - r.a) % n for p in positions(parts) if (p - r.a) % n < r.k]
            assert (name in got) == bool(where), (name, r.a, r.k)
            assert (name in whole) == (len(where) == len(positions(parts)))
            if where:
                assert sorted(positions([(p["start"], p["end"]) for p in got[name]["parts"]])) == sorted(where)
                assert (got[name]["strand"], got[name]["type"]) == (strand, kind) and all(p["strand"] == strand for p in got[name]["parts"])
            if name in whole and len(parts) == 2 and parts[1][0] == 0 and r.k < n:
                assert len(whole[name]["parts"]) == 1  # joined again where the origin was
    back = df.filter("a = 3 and k = 40").select(features.reversed_(features.reversed_(F.col("features"), length), length).alias("twice"), features.turned(features.turned(F.col("features"), F.lit(11), length), F.lit(n - 11), length).alias("turned"), "features").first()
    assert as_rows(back.twice) == as_rows(back.features)
    assert [(x[0], sorted(positions(x[2]))) for x in as_rows(back.turned)] == [(x[0], sorted(positions(x[2]))) for x in as_rows(back.features)]


def test_simple_features_get_parts(spark):
    df = spark.createDataFrame([([(30, 5, 1, "over", "gene"), (2, 9, -1, "plain", "gene")],), (None,)], f"features {files.FEATURES}")
    got = [as_rows(r[0]) for r in df.select(features.located(F.col("features"), F.lit(40), False)).collect()]
    assert got == [[("over", 1, [(30, 40, 1), (0, 5, 1)]), ("plain", -1, [(2, 9, -1)])], []]


def test_restored_features(spark):
    rng = random.Random(8)
    gene, other = dna(rng, 50), dna(rng, 30)
    circle = gene[20:] + dna(rng, 60) + rc(other) + dna(rng, 40) + gene[:20]  # over the origin
    sources = spark.createDataFrame([("s", "TT" + gene + other, [located("g", 1, [(2, 52)]), located("o", 1, [(52, 82)]), located("short", 1, [(0, 5)])])], f"key string, bases string, features {files.LOCATED}")
    products = spark.createDataFrame([("c", circle, True), ("none", dna(rng, 80), False), ("twice", gene + "A" + gene.lower(), False)], "key string, bases string, is_circular boolean")
    got = {r.key: as_rows(r.features) for r in features.restored(products, sources).collect()}
    n = len(circle)
    assert sorted(got["c"]) == [("g", 1, [(n - 20, n, 1), (0, 30, 1)]), ("o", -1, [(90, 120, -1)])]
    assert sorted(got["twice"]) == [("g", 1, [(0, 50, 1)]), ("g", 1, [(51, 101, 1)])] and "none" not in got


def test_headers_with_marks(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">r1 promoter->gene x\r\nACGT\r\nAC\r\n>r2 >>y\nGG\n\n>r3\n")
    (tmp_path / "b.fa").write_text(">r4 a>b\n" + "A" * 100 + "\n")
    got = {r.key: (r.name, r.bases) for r in files.read_fasta(spark, f"{tmp_path}/*.fa").collect()}
    assert got == {"r1": ("r1 promoter->gene x", "ACGTAC"), "r2": ("r2 >>y", "GG"), "r3": ("r3", ""), "r4": ("r4 a>b", "A" * 100)}


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("5..9", [(4, 9, 1)]),
        ("7", [(6, 7, 1)]),
        ("<1..>9", [(0, 9, 1)]),
        ("12^13", [(12, 12, 1)]),
        ("(3.5)..9", [(2, 9, 1)]),
        ("complement(5..9)", [(4, 9, -1)]),
        ("join(25..30,1..5)", [(24, 30, 1), (0, 5, 1)]),
        ("complement(join(2..4,8..9))", [(7, 9, -1), (1, 4, -1)]),
        ("join(complement(8..9),complement(2..4))", [(7, 9, -1), (1, 4, -1)]),
        ("join(1..2,complement(join(5..6,8..9)),12..13)", [(0, 2, 1), (7, 9, -1), (4, 6, -1), (11, 13, 1)]),
        ("order(1..2,7..8)", [(0, 2, 1), (6, 8, 1)]),
        ("J00194.1:100..202", []),
        ("join(J00194.1:100..202,3..5)", [(2, 5, 1)]),
    ],
)
def test_locations(text, parts):
    assert files.parse_location(text) == parts
    if parts:
        f = files.located("n", "gene", parts)
        assert files.parse_location(files.location_text(f)) == parts


def test_genbank_workers_hold_few_records():
    made = [{"key": f"k{i}", "name": "n", "bases": "ACGT" * 100_000, "is_circular": i % 2 == 0, "features": [{"start": 1, "end": 9, "strand": -1, "name": "p", "type": "gene"}]} for i in range(12)]
    asked = []

    def batches():
        for i in range(0, 12, 6):
            asked.append(i)
            yield pa.RecordBatch.from_pylist(made[i : i + 6])

    texts = list(files._texts(batches()))
    assert max(x.num_rows for x in texts) <= 3 and sum(x.num_rows for x in texts) == 12
    whole = pa.RecordBatch.from_arrays([pa.concat_arrays([x.column(0) for x in texts])], ["value"])
    records = list(files._records(iter([whole])))
    assert max(x.num_rows for x in records) <= 3
    back = [r for x in records for r in x.to_pylist()]
    assert [(r["key"], r["bases"].upper(), r["is_circular"], r["length"]) for r in back] == [(r["key"], r["bases"], r["is_circular"], 400_000) for r in made]
    assert back[0]["features"][0]["start"] == 1 and back[0]["features"][0]["strand"] == -1


def test_genbank_round_trip(spark, tmp_path):
    rng = random.Random(1)
    fs = [located("a", 1, [(0, 4)]), located('b "x"', -1, [(2, 5), (9, 20)]), located("c", 1, [(55, 60), (0, 6)])]
    rows = [(f"k{i}", f"name {i}", dna(rng, 60), 60, i % 2 == 0, fs) for i in range(50)]
    df = spark.createDataFrame(rows, files.RECORDS)
    files.write_genbank(df.coalesce(1), f"{tmp_path}/gb")
    back = {r.key: r for r in files.read_genbank(spark, f"{tmp_path}/gb/part*", parts=True).collect()}
    for key, name, bases, length, circular, own in rows:
        r = back[key]
        assert (r.name, r.bases.upper(), r.length, r.is_circular) == (name, bases, length, circular)
        assert as_rows(r.features) == [(f[3].replace('"', "'"), f[2], f[5]) for f in own]


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(f"LOCUS       r{i} 600 bp DNA linear\nFEATURES             Location/Qualifiers\n     CDS             join(1..10,\n                     20..30)\n                     /gene=\"g{i}\"\nORIGIN\n        1 {dna(rng, 600).lower()}\n//\n" for i in range(400))
    (tmp_path / "big.gb").write_text(text.replace("\n", "\r\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = files.read_genbank(spark, f"{tmp_path}/big.gb", parts=True).withColumn("task", F.spark_partition_id())
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert Counter(r.key for r in got) == Counter(f"r{i}" for i in range(400)) and len({r.task for r in got}) > 4
    assert all(r.length == 600 and [(p.start, p.end) for p in r.features[0].parts] == [(0, 10), (19, 30)] and r.features[0].name == "g" + r.key[1:] for r in got)
