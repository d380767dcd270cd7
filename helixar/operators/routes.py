"""Searches of plain graphs under any objective: all pairs, from sources with the paths, and through given points.

Graphs are edges(query_key, src, dst, attributes..) with whole numbers as nodes, one graph per query_key, each in one kernel, as a
path may use any edge of its graph. An objective such as a sum over a product has no optimal substructure, so what
a search finds is what its order of looking finds: all pairs by a sweep over intermediate nodes in order, the others by a search that
takes the nearest node first. Of equal edges the one of the least attributes counts.

Cases: a source or point that has no edge reaches itself alone; a node that is not reached has no row; a route with a leg
that has no path has no row; nulls in keys or nodes give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixar.functions import sequences as S
from helixar.operators import paths
from helixar.operators.objective import MATERIAL_OVER_EFFICIENCY, Objective, pairs_of_many, sweep


def _numbers(edges: DataFrame, objective: Objective) -> DataFrame:
    attributes = [F.col(f"`{x}`").cast("double").alias(x) for x in objective.names]
    return edges.select("query_key", F.col("src").cast("long"), F.col("dst").cast("long"), *attributes).dropna(subset=["query_key", "src", "dst"])


def _nearby(src: np.ndarray, dst: np.ndarray, attributes: list[np.ndarray]) -> dict:
    """node: (next nodes, their edges' attributes), of equal edges the first."""
    if not len(src):
        return {}
    new = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
    src, dst, attributes = src[new], dst[new], [a[new] for a in attributes]
    first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
    return {int(src[a]): (dst[a:b].tolist(), [x[a:b] for x in attributes]) for a, b in zip(first, [*first[1:], len(src)], strict=True)}


def nearest(nearby: dict, source: int, objective: Objective, cutoff: float | None = None, targets: set | None = None) -> dict:
    """node: (attributes, cost, node before) of what is reached from source at a cost of `cutoff` at most, the nearest first, until
    all targets are reached."""
    best, done, wanted = {source: (objective.identity, 0.0, None)}, {}, None if targets is None else set(targets)
    queue = [(0.0, source)]
    while queue and wanted != set():
        cost, at = heapq.heappop(queue)
        if at in done or cost > best[at][1]:
            continue
        done[at] = best[at]
        if wanted is not None:
            wanted.discard(at)
        if at not in nearby:
            continue
        nodes, steps = nearby[at]
        new = objective.along(best[at][0], steps)
        for i, (v, c) in enumerate(zip(nodes, np.broadcast_to(objective.value(new), len(nodes)).tolist(), strict=True)):
            if v not in done and c < np.inf and (cutoff is None or c <= cutoff) and (v not in best or c < best[v][1]):
                best[v] = ([float(np.broadcast_to(x, len(nodes))[i]) for x in new], c, at)
                heapq.heappush(queue, (c, v))
    return done


def way(found: dict, target: int) -> list[int]:
    """The nodes from the source of a search to a target that it reached."""
    out = [target]
    while found[out[-1]][2] is not None:
        out.append(found[out[-1]][2])
    return out[::-1]


def all_pairs(edges: DataFrame, objective: Objective = MATERIAL_OVER_EFFICIENCY, most: int = 3000) -> DataFrame:
    """(query_key, src, dst, attributes, cost) of the best paths found between all pairs of different nodes.

    The kernel holds matrices of all pairs of a graph; one of over `most` nodes is searched from each of its nodes instead.
    """
    names = objective.names

    def solve(key, src, dst, *attributes):
        nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        if len(nodes) > most:
            nearby = _nearby(src, dst, attributes)
            rows = [(s, v, *got, cost) for s in nodes.tolist() for v, (got, cost, _) in nearest(nearby, s, objective).items() if v != s]
            cols = list(zip(*rows, strict=True)) if rows else [()] * (3 + len(names))
            return np.full(len(rows), key), *(np.asarray(x, np.int64 if i < 2 else np.float64) for i, x in enumerate(cols))
        s, d = at[: len(src)], at[len(src) :]
        last = np.arange(len(s))[::-1]  # rows come in order, and the least of equal edges is to be set last
        cost, parts, reached = sweep(len(nodes), s[last], d[last], [a[last] for a in attributes], objective)
        np.fill_diagonal(reached, False)
        i, j = np.nonzero(reached & (cost < np.inf))
        return np.full(len(i), key), nodes[i], nodes[j], *(m[i, j] for m in parts), cost[i, j]

    def run(batches):
        for cols, start, stop in paths.whole_keys(batches):
            # rows come in order, and the least of equal edges is to be set last
            for done in pairs_of_many(cols, start, stop, objective, others, solve, backward=True):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], ["query_key", "src", "dst", *names, "cost"])

    def others(cost, parts, reached):
        return reached & (cost < np.inf) & ~np.eye(cost.shape[-1], dtype=bool)

    keyed = _numbers(edges, objective)
    kind = dict(keyed.dtypes)["query_key"]
    schema = f"query_key {kind}, src long, dst long, {', '.join(f'`{x}` double' for x in names)}, cost double"
    return paths.by_key(keyed, "src", "dst", *names).mapInArrow(run, schema)


def _searched(count: int, edges: tuple, wanted: tuple, objective: Objective, cutoff: float | None, small: int = 64, cells: int = 1 << 21) -> tuple:
    """(found, attributes, cost, path lengths, path nodes) of wanted(graph, source, target) in `count` graphs of edges(graph, src, dst, attributes), which come
    in order. Graphs of up to `small` nodes are searched step by step together with those of equal size, with the results of nearest()."""
    graph, src, dst, attributes = edges
    if len(graph):
        new = np.concatenate([[True], (graph[1:] != graph[:-1]) | (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
        graph, src, dst, attributes = graph[new], src[new], dst[new], [x[new] for x in attributes]
    at, source, target = wanted
    of, node = np.concatenate([graph, graph, at, at]), np.concatenate([src, dst, source, target])
    order = np.lexsort((node, of))
    first_of = np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (node[order][1:] != node[order][:-1])])[: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first_of) - 1
    nodes = node[order][first_of]
    sizes = np.bincount(of[order][first_of], minlength=count)
    first = np.cumsum(sizes) - sizes
    local = number - first[of]
    s, d, a, b = np.split(local, [len(src), 2 * len(src), 2 * len(src) + len(at)])
    found, cost, got = np.zeros(len(at), bool), np.zeros(len(at)), [np.zeros(len(at)) for _ in objective.names]
    length, ways = np.zeros(len(at), np.int64), []
    asked = np.bincount(at, minlength=count) > 0
    for g in np.flatnonzero(asked & (sizes > small)):
        own, lo, hi = np.flatnonzero(at == g), *np.searchsorted(graph, [g, g + 1])
        nearby = _nearby(src[lo:hi], dst[lo:hi], [x[lo:hi] for x in attributes])
        for x in np.unique(source[own]).tolist():
            mine = own[source[own] == x]
            reached = nearest(nearby, x, objective, cutoff, set(target[mine].tolist()))
            for i in mine[[t in reached for t in target[mine].tolist()]]:
                parts, cost[i], _ = reached[int(target[i])]
                for m, v in zip(got, parts, strict=True):
                    m[i] = v
                ways.append((np.array([i]), np.array(way(reached, int(target[i])), np.int64)))
                found[i], length[i] = True, len(ways[-1][1])
    for n in np.unique(sizes[asked & (sizes <= small)]).tolist():
        same = np.flatnonzero(asked & (sizes == n))
        most = max(1, cells // (n * n))
        for i in range(0, len(same), most):
            _together(n, same[i : i + most], (graph, s, d, attributes), (at, a, b), objective, cutoff, count, nodes, first, (found, cost, got, length, ways))
    start = np.cumsum(length) - length
    path = np.empty(int(length.sum()), np.int64)
    for legs_, values in ways:
        n = length[legs_]
        path[np.repeat(start[legs_] - (np.cumsum(n) - n), n) + np.arange(len(values))] = values
    return found, got, cost, length, path


def _together(n: int, own: np.ndarray, edges: tuple, wanted: tuple, objective: Objective, cutoff: float | None, count: int, nodes: np.ndarray, first: np.ndarray, results: tuple) -> None:
    """nearest() of all sources asked for in the graphs `own` of n nodes each, one node of every search at a time."""
    graph, s, d, attributes = edges
    at, a, b = wanted
    found, cost, got, length, ways = results
    place = np.full(count, -1)
    place[own] = np.arange(len(own))
    rows = np.flatnonzero(place[graph] >= 0)
    g, s, d, attributes = place[graph[rows]], s[rows], d[rows], [x[rows] for x in attributes]
    cell = g * n + s  # rows come by cell, so a node's edges lie side by side
    degree = np.bincount(cell, minlength=len(own) * n)
    begin = np.cumsum(degree) - degree
    mine = np.flatnonzero(place[at] >= 0)
    searches, of = np.unique(place[at[mine]] * n + a[mine], return_inverse=True)
    sg, p = searches // n, len(searches)
    best = np.full((p, n), np.inf)
    parts = [np.full((p, n), x) for x in objective.identity]
    before = np.full((p, n), -1)
    done, open_ = np.zeros((p, n), bool), np.zeros((p, n), bool)
    best[np.arange(p), searches % n] = 0.0
    open_[of, b[mine]] = True
    live = np.arange(p)
    while len(live):
        waiting = np.where(done[live], np.inf, best[live])
        u = waiting.argmin(1)  # of equal costs the least node
        on = waiting[np.arange(len(live)), u] < np.inf
        live, u = live[on], u[on]
        done[live, u] = True
        open_[live, u] = False
        on = open_[live].any(1)
        live, u = live[on], u[on]
        c = sg[live] * n + u
        k = degree[c]
        x = np.repeat(np.arange(len(live)), k)
        e = np.repeat(begin[c] - (np.cumsum(k) - k), k) + np.arange(len(x))
        if not len(e):
            continue
        row, v = live[x], d[e]
        new = [np.broadcast_to(y, len(e)) for y in objective.along([m[row, u[x]] for m in parts], [y[e] for y in attributes])]
        value = np.broadcast_to(objective.value(new), len(e))
        better = ~done[row, v] & (value < best[row, v])
        if cutoff is not None:
            better &= value <= cutoff
        row, v, x = row[better], v[better], x[better]
        best[row, v] = value[better]
        before[row, v] = u[x]
        for m, y in zip(parts, new, strict=True):
            m[row, v] = y[better]
    there = done[of, b[mine]]
    mine, of = mine[there], of[there]
    found[mine], cost[mine] = True, best[of, b[mine]]
    for m, y in zip(got, parts, strict=True):
        m[mine] = y[of, b[mine]]
    steps, now = [], b[mine]
    while (now >= 0).any():
        steps.append(now)
        now = np.where(now >= 0, before[of, now], -1)
    if steps:
        back = np.stack(steps[::-1], 1)
        length[mine] = (back >= 0).sum(1)
        ways.append((mine, nodes[(first[at[mine]][:, None] + back)[back >= 0]]))


def legs(edges: DataFrame, wanted: DataFrame, objective: Objective = MATERIAL_OVER_EFFICIENCY, cutoff: float | None = None) -> DataFrame:
    """(query_key, source, target, attributes, cost, path) of every different one of wanted(query_key, source, target) that has a
    path at a cost of `cutoff` at most; path: nodes from source to target. A source is searched once for all its targets."""
    names = objective.names

    def run(batches):
        for (key, is_leg, src, dst, *attributes), start, stop in paths.whole_keys(batches):
            graph, e = np.repeat(np.arange(len(start)), stop - start), ~is_leg
            found, got, cost, length, path = _searched(len(start), (graph[e], src[e], dst[e], [x[e] for x in attributes]), (graph[is_leg], src[is_leg], dst[is_leg]), objective, cutoff)
            if not found.any():
                continue
            ends = pa.array(np.concatenate([[0], np.cumsum(length[found])]), pa.int32())
            columns = [*(pa.array(x[is_leg][found]) for x in (key, src, dst)), *(pa.array(x[found]) for x in (*got, cost)), pa.ListArray.from_arrays(ends, pa.array(path))]
            yield pa.RecordBatch.from_arrays(columns, ["query_key", "source", "target", *names, "cost", "path"])

    e = _numbers(edges, objective)
    w = wanted.select("query_key", F.lit(True).alias("is_leg"), F.col("source").cast("long").alias("src"), F.col("target").cast("long").alias("dst"), *[F.lit(0.0).alias(x) for x in names])
    rows = e.select("query_key", F.lit(False).alias("is_leg"), "src", "dst", *names).unionByName(w.dropna(subset=["query_key", "src", "dst"]).distinct())
    kind = dict(e.dtypes)["query_key"]
    schema = f"query_key {kind}, source long, target long, {', '.join(f'`{x}` double' for x in names)}, cost double, path array<long>"
    return paths.by_key(rows, "src", "dst", *names).mapInArrow(run, schema)


def routes(edges: DataFrame, points: DataFrame, objective: Objective = MATERIAL_OVER_EFFICIENCY, cyclic: bool = False, cutoff: float | None = None) -> DataFrame:
    """(query_key, route, cost, path) through all of points(query_key, route, pos, node) in the order of pos: legs on end, costs
    summed. cyclic: back to the first point, which is not named again, and turned so that the least node comes first.

    Points come to the kernel of their graph, behind its edges, so that legs are put together where they are found."""
    c = F.col
    names = objective.names

    def run(batches):
        for (key, is_point, route, known, src, dst, *attributes), start, stop in paths.whole_keys(batches):
            graph, e = np.repeat(np.arange(len(start)), stop - start), ~is_point
            g, r, n, here = (x[is_point] for x in (graph, route, src, known))
            if not len(g):
                continue
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])])
            head = np.flatnonzero(new)
            size = np.diff(np.concatenate([head, [len(g)]]))
            of = np.repeat(np.arange(len(head)), size)
            after = np.arange(1, len(g) + 1)
            last = head + size - 1
            after[last] = head  # of a circle
            leg = here[after] & (size[of] > 1)
            if not cyclic:
                leg[last] = False
            whole = np.bincount(of[leg], minlength=len(head)) > 0
            whole[of[leg & ~here]] = False
            leg &= whole[of]
            found, _, cost, length, path = _searched(len(start), (graph[e], src[e], dst[e], [x[e] for x in attributes]), (g[leg], n[leg], n[after][leg]), objective, cutoff)
            of = of[leg]
            whole[of[~found]] = False
            if not whole.any():
                continue
            keep = whole[of]  # of a whole route every leg is found
            total = np.bincount(of[keep], cost[keep], len(head))
            stays = np.repeat(keep, length)
            ends = np.cumsum(length) - 1
            final = np.concatenate([of[1:] != of[:-1], [True]])[: len(of)]
            drop = ends[keep] if cyclic else ends[keep & ~final]
            stays[drop] = False
            sizes = np.bincount(of[keep], (length - (1 if cyclic else ~final))[keep], len(head)).astype(np.int64)[whole]
            made = [pa.array(key[is_point][head][whole]), pa.array(r[head][whole], routed), pa.array(total[whole]), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(path[stays]))]
            yield pa.RecordBatch.from_arrays(made, ["query_key", "route", "cost", "path"])

    e = _numbers(edges, objective)
    p = points.dropna(subset=["query_key", "route"]).withColumn("node", c("node").cast("long"))
    kind = dict(p.dtypes)["route"]
    routed = to_arrow_type(p.schema["route"].dataType)
    position = lambda x: x.cast(p.schema["pos"].dataType).alias("pos")
    e = e.select("query_key", F.lit(False).alias("is_point"), F.lit("0").try_cast(kind).alias("route"), position(F.lit(None)), F.lit(True).alias("known"), "src", "dst", *names)
    p = p.select("query_key", F.lit(True).alias("is_point"), "route", "pos", c("node").isNotNull().alias("known"), F.coalesce("node", F.lit(0).cast("long")).alias("src"), F.lit(0).cast("long").alias("dst"), *[F.lit(0.0).alias(x) for x in names])
    rows = paths.by_key(e.unionByName(p), "is_point", "route", "pos", "known", "src", "dst", *names).drop("pos")
    found = rows.mapInArrow(run, f"query_key {dict(e.dtypes)['query_key']}, route {kind}, cost double, path array<long>")
    return found.withColumn("path", S.sort_cycle(c("path"))) if cyclic else found
