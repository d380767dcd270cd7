"""Path objectives chosen by the caller: an arithmetic expression over attributes, each accumulated along the path.

An expression is compiled once, from Python's own syntax, and evaluated on whatever its names stand for: numbers in a
search, NumPy matrices in an all-pairs kernel, Columns in a plan.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM, PRODUCT, MIN, MAX = "sum", "product", "min", "max"
#: accumulator: (of two paths on end, of a path without edges, of the rows of a group)
ACCUMULATORS: dict[str, tuple[Callable, float, Callable[[str], Column]]] = {
    SUM: (np.add, 0.0, F.sum),
    PRODUCT: (np.multiply, 1.0, F.product),
    MIN: (np.minimum, float("inf"), F.min),
    MAX: (np.maximum, float("-inf"), F.max),
}
_NUMPY = {"log": np.log, "exp": np.exp, "sqrt": np.sqrt, "abs": np.abs, "least": np.minimum, "greatest": np.maximum}
_COLUMNS = {k: lambda *x, f=f: f(*[v if isinstance(v, Column) else F.lit(v) for v in x]) for k, f in {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "least": F.least, "greatest": F.greatest}.items()}
_NODES = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Call, ast.Name, ast.Load, ast.Constant, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.USub, ast.UAdd)


class BadObjective(ValueError):
    """An expression that is no arithmetic over names, or an accumulator that is not known."""


@dataclass(frozen=True)
class Objective:
    """f: arithmetic (+ - * / **, log, exp, sqrt, abs, least, greatest) over attributes of edges; accumulators: how an attribute
    goes along a path, `sum` if not given."""

    f: str
    accumulators: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        tree = self._tree
        calls = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
        for n in ast.walk(tree):
            if not isinstance(n, _NODES) or (isinstance(n, ast.Constant) and (isinstance(n.value, bool) or not isinstance(n.value, int | float))):
                raise BadObjective(f"{self.f}: only arithmetic")
            if isinstance(n, ast.Call) and (not isinstance(n.func, ast.Name) or n.func.id not in _NUMPY or n.keywords):
                raise BadObjective(f"{self.f}: only {', '.join(_NUMPY)} can be called")
            if isinstance(n, ast.Name) and n.id in _NUMPY and id(n) not in calls:
                raise BadObjective(f"{self.f}: {n.id} is a function")
        unknown = [x for x in self.accumulators.values() if x not in ACCUMULATORS]
        if unknown or not self.names:
            raise BadObjective(f"no accumulator {unknown[0]!r}; one of {', '.join(ACCUMULATORS)}" if unknown else f"{self.f}: no attribute")

    @property
    def _tree(self) -> ast.Expression:
        try:
            return ast.parse(self.f.strip(), mode="eval")
        except SyntaxError as e:
            raise BadObjective(f"{self.f}: {e.msg}") from e

    @cached_property
    def names(self) -> list[str]:
        """The attributes, in alphabetical order."""
        return sorted({n.id for n in ast.walk(self._tree) if isinstance(n, ast.Name)} - set(_NUMPY))

    @cached_property
    def _code(self):
        return compile(self._tree, self.f, "eval")

    def _kind(self, name: str) -> tuple:
        return ACCUMULATORS[self.accumulators.get(name, SUM)]

    @property
    def identity(self) -> list[float]:
        """The attributes of a path without edges, in the order of `names`."""
        return [self._kind(x)[1] for x in self.names]

    def along(self, left: list, right: list) -> list:
        """The attributes of two paths on end."""
        return [self._kind(x)[0](a, b) for x, a, b in zip(self.names, left, right, strict=True)]

    def value(self, attributes: list) -> np.ndarray:
        """The objective of numbers or arrays in the order of `names`; what is no number is infinite."""
        with np.errstate(all="ignore"):
            out = eval(self._code, {"__builtins__": {}}, _NUMPY | dict(zip(self.names, map(np.float64 if np.ndim(attributes[0]) == 0 else np.asarray, attributes), strict=True)))
            return np.where(np.isnan(out), np.inf, out)

    def column(self, attributes: Mapping[str, Column] | None = None) -> Column:
        """The objective as an expression over columns (default: those named like the attributes); null if it is no number."""
        given = attributes or {}
        return eval(self._code, {"__builtins__": {}}, _COLUMNS | {x: given.get(x, F.col(f"`{x}`")) for x in self.names})

    def totals(self, edges: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, the attributes accumulated over each group's edges, cost)."""
        t = edges.groupBy(*keys).agg(*[self._kind(x)[2](x).alias(x) for x in self.names])
        return t.withColumn("cost", self.column())


#: What an assembly costs
MATERIAL_OVER_EFFICIENCY = Objective("material / efficiency", {"efficiency": PRODUCT})


def sweep(n: int, src: np.ndarray, dst: np.ndarray, attributes: list[np.ndarray], objective: Objective) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(cost, attributes, reached) matrices of the paths found; a node reaches itself without edges.

    Only the rows and columns that reach the node in the middle, and are reached from it, are looked at.
    """
    reached = np.zeros((n, n), bool)
    parts = [np.full((n, n), x) for x in objective.identity]
    for m, a in zip(parts, attributes, strict=True):
        m[src, dst] = a
    reached[src, dst] = True
    for m, x in zip(parts, objective.identity, strict=True):
        np.fill_diagonal(m, x)
    np.fill_diagonal(reached, True)
    cost = np.where(reached, objective.value(parts), np.inf)
    np.fill_diagonal(cost, 0.0)
    for k in range(n):
        rows, cols = np.flatnonzero(reached[:, k]), np.flatnonzero(reached[k])
        rows, cols = rows[rows != k], cols[cols != k]
        if not len(rows) or not len(cols):
            continue
        at = np.ix_(rows, cols)
        new = objective.along([m[rows, k][:, None] for m in parts], [m[k, cols][None, :] for m in parts])
        value = objective.value(new)
        value = np.broadcast_to(value, (len(rows), len(cols)))
        better = value < cost[at]
        cost[at] = np.where(better, value, cost[at])
        reached[at] |= better
        for m, x in zip(parts, new, strict=True):
            m[at] = np.where(better, x, m[at])
    return cost, parts, reached


def sweep_many(count: int, n: int, graph: np.ndarray, src: np.ndarray, dst: np.ndarray, attributes: list[np.ndarray], objective: Objective) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """sweep() of `count` graphs of n nodes each at once, with the same results; the first axis of the matrices is the graph."""
    reached = np.zeros((count, n, n), bool)
    parts = [np.full((count, n, n), x) for x in objective.identity]
    for m, a in zip(parts, attributes, strict=True):
        m[graph, src, dst] = a
    reached[graph, src, dst] = True
    own = np.arange(n)
    for m, x in zip(parts, objective.identity, strict=True):
        m[:, own, own] = x
    reached[:, own, own] = True
    cost = np.where(reached, objective.value(parts), np.inf)
    cost[:, own, own] = 0.0
    for k in range(n):
        via = reached[:, :, k, None] & reached[:, k, None, :]
        via[:, k, :] = via[:, :, k] = False
        with np.errstate(all="ignore"):  # of pairs that do not meet, which are not looked at
            new = objective.along([m[:, :, k, None] for m in parts], [m[:, k, None, :] for m in parts])
        value = objective.value(new)
        better = via & (value < cost)
        cost = np.where(better, value, cost)
        reached |= better
        parts = [np.where(better, x, m) for m, x in zip(parts, new, strict=True)]
    return cost, parts, reached


def pairs_of_many(cols: list[np.ndarray], start: np.ndarray, stop: np.ndarray, objective: Objective, keep, large, backward: bool, small: int = 64, cells: int = 1 << 20) -> list[tuple]:
    """[(key, src, dst, *attributes, cost)] arrays of the pairs that keep(cost, attributes, reached) names in the graphs of cols(key, src,
    dst, *attributes) from start to stop. Graphs of up to `small` nodes are swept together with those of equal size, `cells` matrix
    cells at once; larger ones go to large(key, src, dst, *attributes). Of equal edges the last one counts (backward: the first)."""
    key, src, dst, *attributes = cols
    graph = np.repeat(np.arange(len(start)), stop - start)
    both, node = np.concatenate([graph, graph]), np.concatenate([src, dst])
    order = np.lexsort((node, both))
    new = np.concatenate([[True], (both[order][1:] != both[order][:-1]) | (node[order][1:] != node[order][:-1])])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    nodes, of = node[order][new], both[order][new]  # by graph, then by node
    first, sizes = np.searchsorted(of, np.arange(len(start))), np.bincount(of, minlength=len(start))
    local = number - first[both]
    s, d = local[: len(src)], local[len(src) :]
    out = []
    for n in np.unique(sizes[sizes <= small]).tolist():
        graphs = np.flatnonzero(sizes == n)
        most = max(1, cells // (n * n))
        for i in range(0, len(graphs), most):
            own = graphs[i : i + most]
            place = np.full(len(start), -1)
            place[own] = np.arange(len(own))
            rows = np.flatnonzero(place[graph] >= 0)
            rows = rows[::-1] if backward else rows
            found = sweep_many(len(own), n, place[graph[rows]], s[rows], d[rows], [a[rows] for a in attributes], objective)
            g, a, b = np.nonzero(keep(*found))
            at = first[own[g]]
            out.append((key[start[own[g]]], nodes[at + a], nodes[at + b], *(m[g, a, b] for m in found[1]), found[0][g, a, b]))
    out += [large(key[start[x]], *[y[start[x] : stop[x]] for y in cols[1:]]) for x in np.flatnonzero(sizes > small)]
    return out
