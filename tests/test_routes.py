"""Objectives, searches and sets of regions against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixar.functions import intervals as I
from helixar.operators import objective, paths, routes
from helixar.operators.objective import MAX, MIN, PRODUCT, Objective
from helixar.plans import product_queries


def graphs(seed, n_graphs=6, loops=True):
    rng = random.Random(seed)
    rows = []
    for g in range(n_graphs):
        n = rng.randrange(2, 9)
        for a, b in itertools.permutations(range(n), 2):
            if rng.random() < 0.5 and (loops or a < b):
                rows.append((f"g{g}", a * 3, b * 3, float(rng.randrange(1, 50)), rng.choice([0.5, 0.8, 0.9, 1.0]), float(rng.randrange(1, 9))))
    return rows


SCHEMA = "query_key string, src int, dst int, material double, efficiency double, width double"


def ways(rows, key, a, b):
    """All simple ways from a to b as lists of edges."""
    out = {}
    for k, s, d, *x in rows:
        if k == key:
            out.setdefault(s, {}).setdefault(d, x)
            out[s][d] = min(out[s][d], x)

    def go(at, seen):
        if at == b:
            yield []
            return
        for d, x in out.get(at, {}).items():
            if d not in seen:
                for rest in go(d, seen | {d}):
                    yield [(at, d, x), *rest]

    yield from go(a, {a})


OPTIMAL = [
    (Objective("material"), lambda e: sum(x[0] for *_, x in e)),
    (Objective("material + 3 * width"), lambda e: sum(x[0] + 3 * x[2] for *_, x in e)),
    (Objective("-log(efficiency)", {"efficiency": PRODUCT}), lambda e: -math.log(math.prod(x[1] for *_, x in e))),
    (Objective("material", {"material": MAX}), lambda e: max(x[0] for *_, x in e)),
    (Objective("1 / width", {"width": MIN}), lambda e: 1 / min(x[2] for *_, x in e)),
]


@pytest.mark.parametrize("most", [3000, 1])
@pytest.mark.parametrize(("f", "plain"), OPTIMAL, ids=lambda x: x.f if isinstance(x, Objective) else "")
def test_all_pairs_of_objectives(spark, f, plain, most):
    rows = graphs(3)
    got = {(r.query_key, r.src, r.dst): r.cost for r in routes.all_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), f, most).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for a, b in itertools.permutations({x for r in rows if r[0] == key for x in r[1:3]}, 2):
            costs = [plain(w) for w in ways(rows, key, a, b)]
            if costs:
                want[key, a, b] = min(costs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def dense(n, src, dst, m, e):
    """The sweep with whole matrices."""
    M, E = np.full((n, n), np.inf), np.ones((n, n))
    M[src, dst], E[src, dst] = m, e
    np.fill_diagonal(M, 0)
    np.fill_diagonal(E, 1)
    with np.errstate(all="ignore"):
        for k in range(n):
            pm, pe = M[:, [k]] + M[[k]], E[:, [k]] * E[[k]]
            better = np.nan_to_num(M / E, nan=np.inf, posinf=np.inf) > pm / pe
            M, E = np.where(better, pm, M), np.where(better, pe, E)
    return M, E


def test_sum_over_product_follows_the_sweep():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(3, 25))
        at = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.25]
        if not at:
            continue
        src, dst = np.array(at).T
        m, e = rng.integers(1, 40, len(at)).astype(float), rng.choice([0.0, 0.5, 0.9, 1.0], len(at))
        for x, y in zip(paths.all_pairs(n, src, dst, m, e), dense(n, src, dst, m, e), strict=True):
            assert np.allclose(x, y)


@pytest.mark.parametrize("bad", ["", "1 + 2", "a.b", "__import__('os')", "a if b else c", "[a]", "a < b", "log", "a + 'x'", "f(a)", "log(a, x=1)", "True * a", "a +"])
def test_bad_expressions(bad):
    with pytest.raises(objective.BadObjective):
        Objective(bad)
    with pytest.raises(objective.BadObjective):
        Objective("a", {"a": "mean"})


def test_objective_as_column_and_totals(spark):
    f = Objective("material / efficiency + least(width, 3) ** 2 - abs(-1)", {"efficiency": PRODUCT, "width": MIN})
    assert f.names == ["efficiency", "material", "width"]
    rows = graphs(7)
    df = spark.createDataFrame(rows, SCHEMA)
    for r in f.totals(df, ["query_key"]).collect():
        own = [x for x in rows if x[0] == r.query_key]
        e, m, w = math.prod(x[4] for x in own), sum(x[3] for x in own), min(x[5] for x in own)
        assert r.cost == pytest.approx(m / e + min(w, 3) ** 2 - 1) == pytest.approx(float(f.value([e, m, w])))
    assert float(Objective("a / b").value([1.0, 0.0])) == math.inf and float(Objective("a / b").value([0.0, 0.0])) == math.inf


def test_routes(spark):
    rows = graphs(11, loops=True)
    f = Objective("material")
    edges = spark.createDataFrame(rows, SCHEMA)
    rng, points = random.Random(0), []
    for key in sorted({r[0] for r in rows}):
        nodes = sorted({x for r in rows if r[0] == key for x in r[1:3]})
        for j in range(4):
            points += [(key, j, i, v) for i, v in enumerate(rng.sample(nodes, min(len(nodes), 3)))]
    points += [("g0", 9, 0, 999), ("g0", 9, 1, 0), ("g0", 10, 0, 0), (None, 1, 0, 0)]
    p = spark.createDataFrame(points, "query_key string, route int, pos int, node int")
    for cyclic in (False, True):
        got = {(r.query_key, r.route): r for r in routes.routes(edges, p, f, cyclic).collect()}
        n = 0
        for key, route in {(k, j) for k, j, *_ in points if k}:
            at = [v for k, j, _, v in points if (k, j) == (key, route)]
            legs = list(zip(at, at[1:] + at[:1], strict=True)) if cyclic else list(itertools.pairwise(at))
            best = [min((sum(x[0] for *_, x in w) for w in ways(rows, key, a, b)), default=None) for a, b in legs]
            if len(at) < 2 or None in best:
                assert (key, route) not in got
                continue
            n += 1
            r = got[key, route]
            assert r.cost == pytest.approx(sum(best))
            price = {(s, d): x for k, s, d, x, *_ in rows if k == key}
            steps = list(itertools.pairwise([*r.path, r.path[0]] if cyclic else r.path))
            assert sum(price[s] for s in steps) == pytest.approx(r.cost)
            assert r.path[0] == min(r.path) if cyclic else (r.path[0], r.path[-1]) == (at[0], at[-1])
            assert set(at) <= set(r.path)
        assert n > 5


def test_a_cutoff_and_lost_sources(spark):
    edges = spark.createDataFrame([("g", 0, 1, 2.0, 1.0, 1.0), ("g", 1, 2, 5.0, 1.0, 1.0), ("g", None, 2, 1.0, 1.0, 1.0)], SCHEMA)
    wanted = spark.createDataFrame([("g", 0, 1), ("g", 0, 2), ("g", 7, 7), ("h", 0, 1)], "query_key string, source int, target int")
    got = {(r.source, r.target): r.path for r in routes.legs(edges, wanted, Objective("material"), cutoff=4.0).collect()}
    assert got == {(0, 1): [0, 1], (7, 7): [7]}
    assert routes.all_pairs(edges.limit(0), Objective("material")).count() == 0


def test_a_large_graph_is_searched_all_the_same(spark):
    """Small goals give the same assemblies over matrices and over lists; one of more nodes than the limit fails nothing."""
    rng = random.Random(2)
    rows = []
    for g in range(3):
        cuts = [0, 30, 60, 100]
        for a, b in itertools.pairwise(cuts):
            for turn in (0, 100):
                rows.append((f"g{g}", (a + turn, True, "A", False), (b + turn, True, "B", False), float(rng.randrange(1, 9)), 0.9, b - a, "PCR_PRODUCT", 100))
        for b in (*cuts[1:], *(x + 100 for x in cuts[1:])):
            if b < 200:
                rows.append((f"g{g}", (b, True, "B", False), (b, True, "A", False), float(rng.randrange(1, 9)), 0.8, 0, "GAP", 100))
        rows.append((f"g{g}", (100, True, "B", False), (0, True, "A", False), 3.0, 0.8, 0, "GAP", 100))  # over the origin
    node = "struct<index:int,expandable:boolean,ntype:string,overhang:boolean>"
    edges = spark.createDataFrame(rows, f"query_key string, src {node}, dst {node}, material double, efficiency double, span int, mtype string, length int")
    for exact in (False, True):
        small, large = ({(r.query_key, r.rank, r.cost, str(r.path)) for r in paths.assemblies(edges, 3, most, exact).collect()} for most in (3000, 2))
        assert small == large and (exact or len(small) == 3)


def islands(found):
    """[(start, n)] of runs in a list of increasing positions."""
    out = []
    for u in found:
        if out and out[-1][0] + out[-1][1] == u:
            out[-1][1] += 1
        else:
            out.append([u, 1])
    return out


@pytest.fixture(scope="module")
def regions():
    rng, rows = random.Random(9), []
    for k in range(40):
        length = rng.choice([20, 37])
        for i in range(rng.randrange(1, 7)):
            rows.append((k, i, rng.randrange(length), rng.choice([0, 1, 3, 8, length // 2, length]), length))
    return [*rows, (99, 0, 5, 30, 30), (99, 1, 0, 30, 30), (98, 0, 0, 10, 30), (98, 1, 20, 10, 30)]


def covered(rows, key):
    return {(a + o) % length for k, _, a, n, length in rows if k == key for o in range(n)}


def test_differences(spark, regions):
    df = spark.createDataFrame(regions, "k int, i int, a int, n int, length int")
    left, right = [r for r in regions if r[1] % 2 == 0], [r for r in regions if r[1] % 2]
    for got, other in ((I.difference(df.filter("i % 2 = 0"), df.filter("i % 2 = 1"), ["k"], ["i"], width=5), None), (I.exclusive(df, ["k"], ["i"]), "own")):
        want = set()
        for k, i, a, n, length in left if other is None else regions:
            rest = right if other is None else [r for r in regions if r[1] != i]
            free = [u for u in range(a, a + n) if u % length not in covered(rest, k)]
            want |= {(k, i, u % length, m) for u, m in islands(free)}
        assert {(r.k, r.i, r.a, r.n) for r in got.collect()} == want and got.count() == len(want)


def test_touched(spark, regions):
    df = spark.createDataFrame(regions, "k int, i int, a int, n int, length int")
    right = [r for r in regions if r[1] % 2]
    want = {(k, i) for k, i, a, n, length in regions if i % 2 == 0 and {(a + o) % length for o in range(n)} & covered(right, k)}
    assert sorted((r.k, r.i) for r in I.touched(df.filter("i % 2 = 0"), df.filter("i % 2 = 1"), ["k"], ["i"], 5).collect()) == sorted(want)


def test_unions_and_gaps(spark, regions):
    df = spark.createDataFrame(regions, "k int, i int, a int, n int, length int")
    contexts = spark.createDataFrame([(k, length) for k, _, _, _, length in regions] + [(1000, 12)], "k int, length int").distinct()
    lengths = {k: length for k, _, _, _, length in regions} | {1000: 12}
    for cyclic in (True, False):
        for got, inside in ((I.union(df, ["k"], cyclic), True), (I.gaps(df, ["k"], contexts, cyclic), False)):
            want = set()
            for k, length in lengths.items():
                there = covered(regions, k)
                wanted = [p for p in range(length) if (p in there) == inside]
                start = next((p for p in range(length) if p not in wanted), None) if cyclic else 0
                if start is None:
                    want.add((k, 0, length))
                    continue
                order = [u for u in range(start, start + length) if u % length in wanted]
                want |= {(k, u % length, m) for u, m in islands(order)}
            assert {(r.k, r.a, r.n) for r in got.collect()} == want, (cyclic, inside)
    assert I.union(df, ["k"], least=2).filter("k = 99").select("a", "n").first() == (0, 30)


def test_exclusive_parts_move_lines_once(spark):
    """Regions that are dealt by their circle are not moved again, neither by their buckets nor by themselves."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = product_queries.region_exclusive(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)


def test_regions_of_nothing(spark):
    none = spark.createDataFrame([], "k int, i int, a int, n int, length int")
    assert I.union(none, ["k"]).count() == I.gaps(none, ["k"]).count() == I.exclusive(none, ["k"], ["i"]).count() == 0
    one = spark.createDataFrame([(1, 0, 3, 4, 10)], "k int, i int, a int, n int, length int")
    assert [tuple(r) for r in I.difference(one, none, ["k"], ["i"]).select("a", "n").collect()] == [(3, 4)]


def test_token_edits(spark):
    rng = random.Random(6)

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
            d = new
        return d[-1]

    rows = [([rng.choice(["a", "bb", "c", None]) for _ in range(rng.randrange(8))], [rng.choice(["a", "bb", "c", None]) for _ in range(rng.randrange(8))]) for _ in range(80)] + [(None, ["a"]), (None, None)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    f = lambda **x: paths.token_edits(df["a"], df["b"], **x)
    for r in df.select("a", "b", f(cyclic=False).alias("line"), f().alias("circle"), f(most=2).alias("near")).collect():
        a, b = r.a or [], r.b or []
        turns = [plain(a[i:] + a[:i], b) for i in range(max(len(a), 1))]
        assert (r.line, r.circle, r.near) == (plain(a, b), min(turns), min(turns) if min(turns) <= 2 else None)


def test_small_graphs_are_swept_together():
    """graphs of equal size at once, with the bits of one sweep each; large ones go their own way."""
    import numpy as np
    from helixar.operators.objective import MATERIAL_OVER_EFFICIENCY, MAX, Objective, pairs_of_many, sweep

    rng = np.random.default_rng(3)
    for objective in (MATERIAL_OVER_EFFICIENCY, Objective("material", {"material": MAX})):
        rows = []
        for key in range(40):
            edges = sorted({tuple(rng.integers(0, 3 + key % 6, 2) * 5) for _ in range(12)})
            rows += [(key, a, b, *rng.uniform(0.1, 1, len(objective.names))) for a, b in edges for _ in range(1 + (a + b) % 2)]
        cols = [np.array(x) for x in zip(*rows, strict=True)]
        start = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        stop = np.concatenate([start[1:], [len(rows)]])

        def one(key, src, dst, *attributes, f=objective):
            nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
            last = np.arange(len(src))[::-1]
            cost, parts, reached = sweep(len(nodes), at[: len(src)][last], at[len(src) :][last], [a[last] for a in attributes], f)
            i, j = np.nonzero(reached & (cost < np.inf))
            return np.full(len(i), key), nodes[i], nodes[j], *(m[i, j] for m in parts), cost[i, j]

        keep = lambda cost, parts, reached: reached & (cost < np.inf)
        want = sorted(r for a, b in zip(start, stop, strict=True) for r in zip(*map(np.ndarray.tolist, one(cols[0][a], *[x[a:b] for x in cols[1:]])), strict=True))
        for small, cells in ((64, 100), (64, 1 << 20), (5, 1 << 20), (0, 1)):
            found = pairs_of_many(cols, start, stop, objective, keep, one, backward=True, small=small, cells=cells)
            assert sorted(r for x in found for r in zip(*map(np.ndarray.tolist, x), strict=True)) == want


def test_searches_of_many_graphs_are_those_of_one():
    """Graphs searched together give what nearest() gives for each, with costs that tie, equal edges, cutoffs and graphs above the size."""
    rng = np.random.default_rng(4)
    for objective in (routes.MATERIAL_OVER_EFFICIENCY, Objective("material", {"material": MAX})):
        for cutoff, small in ((None, 64), (6.0, 64), (None, 3)):
            rows, wanted = set(), set()
            for g in range(60):
                n = int(rng.integers(1, 9))
                rows |= {(g, *map(int, rng.integers(0, n, 2)), *(float(x) for x in rng.integers(1, 4, len(objective.names)))) for _ in range(3 * n)}
                wanted |= {(g, *map(int, rng.integers(0, n + 1, 2))) for _ in range(int(rng.integers(0, 4)))}
            rows, wanted = sorted(rows), sorted(wanted)
            edges = [np.array(x) for x in zip(*rows, strict=True)]
            asked = tuple(np.array(x) for x in zip(*wanted, strict=True))
            found, got, cost, length, path = routes._searched(60, (*edges[:3], edges[3:]), asked, objective, cutoff, small, 100)
            ends = np.cumsum(length)
            for i, (g, a, b) in enumerate(wanted):
                own = edges[0] == g
                one = routes.nearest(routes._nearby(edges[1][own], edges[2][own], [x[own] for x in edges[3:]]), a, objective, cutoff, {b})
                assert found[i] == (b in one)
                if found[i]:
                    assert one[b][0] == [x[i] for x in got] and one[b][1] == cost[i] and routes.way(one, b) == path[ends[i] - length[i] : ends[i]].tolist()


def test_rows_are_dealt_in_as_many_parts_as_the_session_names(spark):
    """Small tables, too, whose parts would be put together: what is sorted in a task does not grow with them."""
    rows = paths.by_key(spark.range(100).select(F.col("id").alias("query_key"), "id"), "id")
    rows.count()
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
