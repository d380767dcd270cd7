"""Path search over assembly graphs: objective SUM(material) / PROD(efficiency), per goal in an Arrow kernel.

The objective has no optimal substructure, so all-pairs search follows the sweep over intermediate nodes in node order
(by index), and every tie is broken by position: results do not depend on row order. A kernel holds one goal's graph. Up to
`most` nodes it holds matrices of all pairs; a larger graph is searched from one node after the other over its lists of
edges, in memory that grows with nodes and edges alone.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixar.operators.objective import MATERIAL_OVER_EFFICIENCY, pairs_of_many, sweep

INF = float("inf")


def all_pairs(n: int, src: np.ndarray, dst: np.ndarray, material: np.ndarray, efficiency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(material, efficiency) matrices of the paths found; no path: infinite material, efficiency 1."""
    _, (e, m), reached = sweep(n, src, dst, [efficiency, material], MATERIAL_OVER_EFFICIENCY)
    return np.where(reached, m, INF), np.where(reached, e, 1.0)


def shortest(adjacency: dict, start, goal=None) -> dict:
    """Greedy search from start: node -> (cost, material, efficiency, previous); stops at goal."""
    best = {start: (0.0, 0.0, 1.0, None)}
    done: dict = {}
    queue = [(0.0, 0, start)]
    count = 0
    while queue:
        cost, _, u = heapq.heappop(queue)
        if u in done:
            continue
        done[u] = best[u]
        if u == goal:
            break
        _, m, e, _ = best[u]
        for v, (dm, de) in adjacency.get(u, {}).items():
            nm, ne = m + dm, e * de
            c = nm / ne if ne else INF
            if v not in done and c < INF and (v not in best or c < best[v][0]):
                best[v] = (c, nm, ne, u)
                count += 1
                heapq.heappush(queue, (c, count, v))
    return done


def path_to(found: dict, goal) -> list | None:
    if goal not in found:
        return None
    out = [goal]
    while found[out[-1]][3] is not None:
        out.append(found[out[-1]][3])
    return out[::-1]


def multipoint(adjacency: dict, points: list, cyclic: bool) -> list | None:
    """The legs between the points on end (the last point is not repeated on a cycle); None if a leg has no path."""
    legs = list(zip(points, points[1:], strict=False)) + ([(points[-1], points[0])] if cyclic else [])
    out: list = []
    for a, b in legs:
        leg = path_to(shortest(adjacency, a, b), b)
        if leg is None:
            return None
        out += leg[:-1]
    return out if cyclic else out + [points[-1]]


def cyclic_weights(nodes: list[tuple], m: np.ndarray, e: np.ndarray, length: int) -> np.ndarray:
    """w[i, j]: path i -> j, and j's best way once around the circle to its own copy at index + length."""
    at = {x: i for i, x in enumerate(nodes)}
    close_m, close_e = np.full(len(nodes), INF), np.zeros(len(nodes))
    for x, i in at.items():
        j = at.get((x[0] + length, *x[1:]))
        if j is not None and m[i, j] < INF:
            close_m[i], close_e[i] = m[i, j], e[i, j]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (m + close_m[None, :]) / (e * close_e[None, :])
    w[np.isnan(w)] = INF
    np.fill_diagonal(w, INF)
    return w


def _close(nodes: list[tuple], adjacency: dict, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(material, efficiency) of each node's way once around to its copy, by a search; none: infinite, 0."""
    here, m, e = set(nodes), np.full(len(nodes), INF), np.zeros(len(nodes))
    for i, x in enumerate(nodes):
        copy = (x[0] + length, *x[1:])
        found = shortest(adjacency, x, copy) if copy in here else {}
        if copy in found:
            m[i], e[i] = found[copy][1:3]
    return m, e


def lazy_pairs(nodes: list[tuple], adjacency: dict, length: int, exact: bool):
    """(weight, i, j) of all pairs in the order of cyclic_weights (exact: i -> j -> i), by a search from each node: rows of weights are made when they
    are wanted, and the least of each row is all that is kept of it."""
    at = {x: i for i, x in enumerate(nodes)}
    if exact:
        back: dict = {}
        for a, nexts in adjacency.items():
            for b, step in nexts.items():
                back.setdefault(b, {})[a] = step
    else:
        close_m, close_e = _close(nodes, adjacency, length)

    def row(i: int) -> np.ndarray:
        m, e = np.full(len(nodes), INF), np.ones(len(nodes))
        for x, (_, dm, de, _) in shortest(adjacency, nodes[i]).items():
            m[at[x]], e[at[x]] = dm, de
        if exact:
            back_m, back_e = np.full(len(nodes), INF), np.ones(len(nodes))
            for x, (_, dm, de, _) in shortest(back, nodes[i]).items():
                back_m[at[x]], back_e[at[x]] = dm, de
        else:
            back_m, back_e = close_m, close_e
        with np.errstate(divide="ignore", invalid="ignore"):
            w = (m + back_m) / (e * back_e)
        w[np.isnan(w)] = INF
        w[i] = INF
        return w

    queue = []
    for i in range(len(nodes)):
        w = row(i)
        if w.min() < INF:
            queue.append((float(w.min()), i, int(w.argmin())))
    heapq.heapify(queue)
    held: tuple = (None, None, None)  # the last row looked at, in order
    while queue:
        weight, i, j = queue[0]
        yield weight, i, j
        if held[0] != i:
            w = row(i)
            order = np.argsort(w, kind="stable")
            place = np.empty(len(w), np.int64)
            place[order] = np.arange(len(w))
            held = (i, w, (order, place))
        w, (order, place) = held[1], held[2]
        k = int(place[j]) + 1
        if k < len(w) and w[order[k]] < INF:
            heapq.heapreplace(queue, (float(w[order[k]]), i, int(order[k])))
        else:
            heapq.heappop(queue)


ASSEMBLY = "query_key string, rank int, cost double, material double, efficiency double, n_nodes int, path array<struct<index:int,expandable:boolean,ntype:string,overhang:boolean>>"


def assemblies(edges: DataFrame, n_paths: int = 3, most: int = 3000, exact: bool = False) -> DataFrame:
    """The best cyclic assemblies of every goal, checked and ranked by real cost (then fewer nodes, then path).

    exact ranks by i -> j -> i instead of the heuristic of cyclic_weights. Assemblies whose spans do not sum to the
    goal's length, or whose node types do not alternate, are dropped.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        node = lambda s: (int(s["index"]), bool(s["expandable"]), s["ntype"], bool(s["overhang"]))
        src, dst = [node(s) for s in pdf["src"]], [node(s) for s in pdf["dst"]]
        length = int(pdf["length"].iloc[0])
        nodes = sorted({*src, *dst})
        at = {x: i for i, x in enumerate(nodes)}
        data = {(a, b): (x, y, int(s), k) for a, b, x, y, s, k in zip(src, dst, pdf["material"], pdf["efficiency"], pdf["span"], pdf["mtype"], strict=True)}
        adjacency: dict = {}
        for (a, b), (x, y, _, _) in sorted(data.items()):
            adjacency.setdefault(a, {})[b] = (x, y)

        def pairs():
            if len(nodes) > most:
                yield from lazy_pairs(nodes, adjacency, length, exact)
                return
            keys = sorted(data)
            m, e = all_pairs(len(nodes), *(np.array([at[k[i]] for k in keys], int) for i in (0, 1)), np.array([data[k][0] for k in keys]), np.array([data[k][1] for k in keys]))
            if exact:
                with np.errstate(divide="ignore", invalid="ignore"):
                    w = (m + m.T) / (e * e.T)
                w[np.isnan(w)] = INF
                np.fill_diagonal(w, INF)
            else:
                w = cyclic_weights(nodes, m, e, length)
            for f in np.argsort(w, axis=None, kind="stable").tolist():
                yield w.flat[f], *divmod(f, len(nodes))

        found, rows = [], []
        for weight, i, j in pairs():
            if not weight < INF or len(found) >= n_paths:
                break
            path = multipoint(adjacency, [nodes[i], nodes[j]], True)
            if path is None:
                continue
            turned = [(x[0] % length, *x[1:]) for x in path]
            steps = [data.get(x) for x in zip(path, path[1:] + path[:1], strict=True)]
            again = next((k for k in range(1, len(turned)) if turned[k] in turned[:k]), len(turned))
            turned, path, steps = turned[:again], path[:again], steps[:again]  # a way twice around the circle is one turn
            k = turned.index(min(turned, key=lambda x: (x[2], x)))
            turned, path, steps = turned[k:] + turned[:k], path[k:] + path[:k], steps[k:] + steps[:k]
            if any(t == turned for t, _ in found):
                continue
            found.append((turned, path))
            whole = None not in steps and sum(s[2] for s in steps) == length
            alternate = all(a[2] != b[2] for a, b in zip(turned, turned[1:] + turned[:1], strict=True))
            if whole and alternate:
                material, eff = sum(s[0] for s in steps), float(np.prod([s[1] for s in steps]))
                rows.append((material / eff if eff else INF, len(path), turned, material, eff, path))
        rows.sort(key=lambda r: r[:3])
        key = pdf["query_key"].iloc[0]
        named = lambda p: [dict(zip(("index", "expandable", "ntype", "overhang"), x, strict=True)) for x in p]
        return pd.DataFrame([(key, r, c, mat, eff, n, named(path)) for r, (c, n, _, mat, eff, path) in enumerate(rows)], columns=[x.split()[0] for x in ASSEMBLY.split(", ")[:6]] + ["path"])

    # Goals are dealt in as many parts as the session names: their edges are small beside the search, so by size they would come together in few tasks.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = edges.select("query_key", "src", "dst", "material", "efficiency", "span", "mtype", "length").repartition(parts, "query_key")
    return asked.groupBy("query_key").applyInPandas(kernel, ASSEMBLY)


def path_distances(edges: DataFrame, most: int = 3000) -> DataFrame:
    """All pairs of plain graphs edges(query_key, src, dst, material, efficiency) with numeric nodes: the best paths found."""

    def solve(key, src, dst, material, efficiency):
        nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        if len(nodes) > most:
            near: dict = {}
            for a, b, m, e in zip(src.tolist(), dst.tolist(), material.tolist(), efficiency.tolist(), strict=True):
                near.setdefault(a, {})[b] = (m, e)
            rows = [(a, b, x[1], x[2]) for a in nodes.tolist() for b, x in shortest(near, a).items()]
            i, j, m, e = (np.asarray(x) for x in zip(*rows, strict=True))
            return np.full(len(i), key), i, j, e, m, m / e
        m, e = all_pairs(len(nodes), at[: len(src)], at[len(src) :], material, efficiency)
        i, j = np.nonzero(m < INF)
        return np.full(len(i), key), nodes[i], nodes[j], e[i, j], m[i, j], m[i, j] / e[i, j]

    def run(batches):
        for (key, src, dst, material, efficiency), start, stop in whole_keys(batches):
            there = lambda cost, parts, reached: reached & (parts[1] < INF)
            for k, s, d, e, m, _ in pairs_of_many([key, src, dst, efficiency, material], start, stop, MATERIAL_OVER_EFFICIENCY, there, large, backward=False):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, s, d, m, e, m / e)], ["query_key", "src", "dst", "material", "efficiency", "cost"])

    large = lambda key, src, dst, efficiency, material: solve(key, src, dst, material, efficiency)
    keyed = edges.select("query_key", F.col("src").cast("long"), F.col("dst").cast("long"), F.col("material").cast("double"), F.col("efficiency").cast("double"))
    kind = dict(keyed.dtypes)["query_key"]
    return by_key(keyed, "src", "dst").mapInArrow(run, f"query_key {kind}, src long, dst long, material double, efficiency double, cost double")


def by_key(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by query_key and sorted by it and `order`, in as many parts as the session names: these are not put together to fewer, as what
    a part holds is sorted in its task's memory."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By a hash of the key, as a union of frames dealt by the key itself counts as dealt, though parts of one of them may have been put together.
    return rows.repartition(n, F.xxhash64("query_key")).sortWithinPartitions("query_key", *order)


def _by_key(batches, solve):
    """Joined results of solve(key, *columns) for all keys that end in a batch."""
    for cols, start, stop in whole_keys(batches):
        done = [solve(cols[0][a], *[x[a:b] for x in cols[1:]]) for a, b in zip(start, stop, strict=True)]
        yield [np.concatenate(x) for x in zip(*done, strict=True)]


def whole_keys(batches):
    """(columns, start, stop) of the keys that end in a batch. Rows come by key, the first column; the last key of a batch waits
    for the next batch."""
    rest = None
    for batch in _then_none(batches):
        new = [np.asarray(x) for x in batch.columns] if batch is not None else None
        cols = new if rest is None else rest if new is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
        if cols is None or not len(cols[0]):
            continue
        start = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        stop = np.concatenate([start[1:], [len(cols[0])]])
        ready = len(start) if batch is None else len(start) - 1
        rest = [x[start[ready] :] for x in cols] if ready < len(start) else None
        if ready:
            yield [x[: stop[ready - 1]] for x in cols], start[:ready], stop[:ready]


def _then_none(batches):
    yield from batches
    yield None


def assembly_edges(plans: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges of every assembly in order, the closing one last; a missing edge has infinite cost."""
    c = F.col
    nxt = F.expr("concat(slice(path, 2, size(path) - 1), slice(path, 1, 1))")
    steps = plans.select("query_key", "rank", F.posexplode(F.arrays_zip(c("path").alias("src"), nxt.alias("dst"))).alias("pos", "x")).select("query_key", "rank", "pos", "x.src", c("x.dst").alias("_dst"))
    e = edges.select("query_key", "src", "dst", "mtype", "kind", "span", "material", "efficiency", "cost", "length")
    same = (F.pmod(c("dst.index") - c("_dst.index"), c("length")) == 0) & (c("dst.ntype") == c("_dst.ntype")) & (c("dst.expandable") == c("_dst.expandable")) & (c("dst.overhang") == c("_dst.overhang"))
    found = steps.join(e, ["query_key", "src"]).filter(same)  # the next node may be its copy one turn on
    best = found.groupBy("query_key", "rank", "pos").agg(F.min(F.struct("cost", "src", "dst", "mtype", "kind", "span", "material", "efficiency", "length")).alias("w")).select("query_key", "rank", "pos", "w.*")
    out = steps.select("query_key", "rank", "pos", c("src").alias("_src"), "_dst").join(best, ["query_key", "rank", "pos"], "left")
    out = out.withColumns({"src": F.coalesce("src", "_src"), "dst": F.coalesce("dst", "_dst")}).drop("_src", "_dst")
    return out.withColumns({"cost": F.coalesce("cost", F.lit(INF)), "efficiency": F.coalesce("efficiency", F.lit(0.0)), "mtype": F.coalesce("mtype", F.lit("__MISSING"))})


def total_cost(edges: DataFrame, keys: list[str]) -> DataFrame:
    """material, efficiency and cost of each assembly: SUM / PROD; infinite if the product is 0."""
    t = edges.groupBy(*keys).agg(F.sum("material").alias("material"), F.product("efficiency").alias("efficiency"), F.count(F.lit(1)).alias("n_edges"))
    return t.withColumn("cost", F.when(F.col("efficiency") == 0, F.lit(INF)).otherwise(F.try_divide("material", "efficiency")))


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def closed_pairs(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """(value, next) of consecutive rows, the last one with the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("next", F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))


def edit_steps(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Position by position, how many fields differ between two assemblies' nodes (a lacking node: all)."""
    l, r = (d.select(*keys, "pos", *[F.col(f).alias(f"{p}_{f}") for f in fields], F.lit(True).alias(f"{p}_here")) for d, p in ((left, "l"), (right, "r")))
    d = l.join(r, [*keys, "pos"], "full")
    differ = sum((F.when(F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), 0).otherwise(1) for f in fields), F.lit(0))
    return d.select(*keys, "pos", F.when(F.col("l_here").isNull() | F.col("r_here").isNull(), len(fields)).otherwise(differ).alias("n_differ"))


_LETTERS = 20_000  # from U+4E00 on, none of them a surrogate


def token_edits(left: Column, right: Column, cyclic: bool = True, most: int | None = None) -> Column:
    """Edit distance of two arrays of tokens: insertions, deletions and replacements of whole tokens, those that are null being equal.

    cyclic: of the turn of `left` that is nearest. most: distances over it are null, and only a band of that width is looked at.
    Tokens become letters of one text, the same for equal ones, and texts are compared by the built-in function.
    """
    text = lambda x: F.coalesce(x.cast("string"), F.lit("\x00"))
    l, r = (F.coalesce(F.transform(x, text), F.array().cast("array<string>")) for x in (left, right))
    known = F.array_distinct(F.concat(l, r))
    letters = F.lit("".join(chr(0x4E00 + i) for i in range(_LETTERS)))
    spell = lambda x: F.array_join(F.transform(x, lambda t: F.substring(letters, F.array_position(known, t).cast("int"), F.lit(1))), "")
    a, b = spell(l), spell(r)

    def distance(x: Column) -> Column:
        if most is None:
            return F.levenshtein(x, b)
        d = F.levenshtein(x, b, most)
        return F.when(d >= 0, d)

    if not cyclic:
        d = distance(a)
    else:
        turns = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.concat(F.substring(a, i, F.length(a)), F.substring(a, F.lit(1), i - 1)))
        d = F.array_min(F.transform(turns, distance))
    return F.when(F.size(known) <= _LETTERS, d).otherwise(F.raise_error(F.lit(f"over {_LETTERS} different tokens")).cast("int"))


def distances_from(edges: DataFrame, sources: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Best paths from sources(query_key, source) of plain graphs edges(query_key, src, dst, material, efficiency) by a search
    ordered by SUM / PROD: (query_key, source, node, material, efficiency, cost), to a cost of `cutoff` at most. Nodes are numbers."""

    def solve(key, is_source, src, dst, material, efficiency):
        nearby: dict = {}
        for a, b, m, f in zip(*(x[~is_source].tolist() for x in (src, dst, material, efficiency)), strict=True):
            nearby.setdefault(a, []).append((b, m, f))
        out = []
        for source in src[is_source].tolist():
            queue, done = [(0.0, source, 0.0, 1.0)], set()
            while queue:
                cost, at, m, f = heapq.heappop(queue)
                if at in done or (cutoff is not None and cost > cutoff):
                    continue
                done.add(at)
                out.append((source, at, m, f, cost))
                for b, dm, df in nearby.get(at, ()):
                    if b not in done and f * df > 0:
                        heapq.heappush(queue, ((m + dm) / (f * df), b, m + dm, f * df))
        kinds = (np.int64, np.int64, np.float64, np.float64, np.float64)
        columns = zip(*out, strict=True) if out else [()] * 5
        return np.full(len(out), key), *(np.asarray(x, t) for x, t in zip(columns, kinds, strict=True))

    def run(batches):
        for done in _by_key(batches, solve):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], ["query_key", "source", "node", "material", "efficiency", "cost"])

    e = edges.select("query_key", F.lit(False).alias("is_source"), F.col("src").cast("long"), F.col("dst").cast("long"), F.col("material").cast("double"), F.col("efficiency").cast("double"))
    s = sources.select("query_key", F.lit(True).alias("is_source"), F.col("source").cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.0).alias("material"), F.lit(0.0).alias("efficiency")).distinct()
    kind = dict(edges.dtypes)["query_key"]
    return by_key(e.unionByName(s), "src", "dst", "material").mapInArrow(run, f"query_key {kind}, source long, node long, material double, efficiency double, cost double")
