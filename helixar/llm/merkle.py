"""Merkle manifest of a data set: a digest a row, a tree per group, a tree over the groups, and each row's proof.

A row's leaf is the SHA-256 of its columns, each with its length, so no two rows read alike. The leaves of a group stand
in the order of the id; a running count in each partition of a range sort plus the counts before it gives a leaf its place.
2 ** 10 neighbouring leaves are a block. One traversal of a block, in postorder, returns the digest of the subtree and
appends every node's siblings to the leaves below it while it unwinds; the digests of a group's blocks, which stand aligned
in its tree, are the leaves of the next traversal, until every group is one node. So no task holds more than a block, and
a group with most of the rows is as many blocks as it needs. The groups' digests go through the same traversals.
Coming down again, each block's proof is put behind those of its leaves. Proofs are checked in DataFrame functions.

Cases: a null column is `-`, whatever its type, an empty one `0:`; the null group is a group of its own and comes first; rows
with a null id come first in their group; equal ids are ordered by their leaves, and rows that are equal altogether get a
place each; a group of one row is its leaf; one group is the root; an empty table gives no rows; carried columns named like a
result, in any case, give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixar.llm import common

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
MADE = ("leaf", "subroot", "root", "proof")
PROOF = "array<struct<at:int,others:array<string>>>"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of strings on end."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*values: Column) -> Column:
    """The digest of a row of values, each `-` if null, else its length in bytes, a colon and itself."""
    as_text = [v.cast("string") for v in values]
    return digest(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in as_text])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""

    def up(node, step):
        others, at = step["others"], step["at"]
        return digest(F.array_join(F.slice(others, F.lit(1), at), ""), node, F.array_join(F.slice(others, at + 1, F.size(others)), ""))

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, from the leaf to the root and from left to right."""
    return digest(F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), ""))


def levels(n: int, fanout: int = 2) -> int:
    """How many times runs of `fanout` nodes are made one until a single node remains."""
    up = 0
    while n > 1:
        n, up = -(-n // fanout), up + 1
    return up


def traverse(leaves: list[str], height: int, proofs: list[list[tuple[int, list[str]]]], fanout: int = 2, start: int = 0) -> str:
    """Digest of the subtree of `height` levels from leaf `start` on; its leaves' proofs grow by one step a level."""
    if not height:
        return leaves[start]
    span = fanout ** (height - 1)
    stop = min(start + fanout * span, len(leaves))
    nodes = [traverse(leaves, height - 1, proofs, fanout, a) for a in range(start, stop, span)]
    for i, a in enumerate(range(start, stop, span)):
        step = (i, nodes[:i] + nodes[i + 1 :])
        for proof in proofs[a : min(a + span, stop)]:
            proof.append(step)
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _as_arrow(proofs: list[list[tuple[int, list[str]]]]) -> pa.Array:
    steps = [s for p in proofs for s in p]
    ends = lambda x: pa.array(np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int32))
    others = pa.ListArray.from_arrays(ends([o for _, o in steps]), pa.array([x for _, o in steps for x in o], pa.string()))
    return pa.ListArray.from_arrays(ends(proofs), pa.StructArray.from_arrays([pa.array([i for i, _ in steps], pa.int32()), others], ["at", "others"]))


def _blocks(batches, fanout: int, height: int):
    """Rows (tree, block, n, digest, others..) in order of tree and block; out come the others, proof, and block_top in each block's first row."""
    rest: list[pa.RecordBatch] = []

    def climb(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        first = _starts(rows)
        leaves, n = rows.column("digest").to_pylist(), rows.column("n").to_pylist()
        proofs: list = [[] for _ in leaves]
        tops: list = [None] * len(leaves)
        for a, b in zip(first, [*first[1:], len(leaves)], strict=True):
            own = proofs[a:b]
            tops[a] = traverse(leaves[a:b], min(height, levels(n[a], fanout)), own, fanout)
        out = rows.append_column("proof", _as_arrow(proofs)).append_column("block_top", pa.array(tops, pa.string()))
        return out.combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        rows = pa.Table.from_batches(rest)
        cut = _starts(rows.combine_chunks())[-1]
        if cut:
            yield climb(rows.slice(0, cut))
        rest = rows.slice(cut).to_batches()
    if rest:
        yield climb(pa.Table.from_batches(rest))


def _starts(rows: pa.Table) -> list[int]:
    """Where a block begins."""
    tree = pc.dictionary_encode(rows.column("tree").combine_chunks(), null_encoding="encode")
    tree = (tree.chunk(0) if isinstance(tree, pa.ChunkedArray) else tree).indices.to_numpy(zero_copy_only=False)
    block = rows.column("block").to_numpy()
    return [0, *(1 + np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1]))).tolist()]


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (written ones, with `tree`) and each one's place `pos` in its tree, by `order`, and the tree's size `n`."""
    p = common.partitions(nodes.sparkSession)
    rows = nodes.withColumn("row", F.monotonically_increasing_id())  # equal rows may part
    order = [*order, "row"]
    dealt = common.materialize(rows.repartitionByRange(p, "tree", *order).withColumn("part", F.spark_partition_id()), "leaves")
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("here"))
    by_part = Window.partitionBy("tree").orderBy("part")
    spans = counts.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"), "here",
        F.coalesce(F.sum("here").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("here").over(Window.partitionBy("tree")).alias("all"),
    )
    spans = spans.filter("all > here").drop("here")  # trees over several partitions: at most two a partition
    own = Window.partitionBy("tree", "part")
    rows = dealt.withColumns({"nth": F.row_number().over(own.orderBy(*order)) - 1, "here": F.count(F.lit(1)).over(own)})
    rows = rows.join(F.broadcast(spans), F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part")), "left")
    return rows.withColumns({"pos": F.col("nth") + F.coalesce("base", F.lit(0)), "n": F.coalesce("all", "here")}).drop("row", "part", "nth", "here", "_tree", "_part", "base", "all")


def _climb(nodes: DataFrame, fanout: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Traversals of nodes(tree, pos, n, digest, others..), from the leaves up, and (tree, digest) of the last."""
    p, size, passes = common.partitions(nodes.sparkSession), fanout**height, []
    while True:
        rows = nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
        schema = StructType.fromDDL(f"proof {PROOF}, block_top string")
        schema = StructType([*rows.schema.fields, *schema.fields])
        done = rows.repartition(p, "tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(common.tidy(lambda batches: _blocks(batches, fanout, height)), schema)
        passes.append(common.materialize(done, "blocks"))
        nodes = passes[-1].filter("block_top IS NOT NULL").select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("block_top").alias("digest"))
        if nodes.filter("n > 1").isEmpty():
            return passes, nodes.select("tree", "digest")


def _descend(passes: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The first pass's rows with whole proofs; above: (tree, pos, proof, others..) of each tree's top."""
    for i, rows in reversed(list(enumerate(passes))):
        rows = rows.drop("block_top")
        if above is not None:
            up = above.withColumnsRenamed({"tree": "_tree", "pos": "_pos", "proof": "_proof"})
            rows = rows.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_pos"))).withColumn("proof", F.concat("proof", "_proof")).drop("_tree", "_pos", "_proof")
        above = rows.drop("block", "n", "digest") if i else rows
    return above


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", carry: Mapping[str, Column] | None = None, fanout: int = 2, height: int = 10) -> DataFrame:
    """`carry` columns (name: expression over docs; default: the id) with leaf, subroot (of the group), root and proof.

    proof: from the leaf to the root, a step a level with the node's place `at` in its run and the digests of the others.
    """
    carry = {k: v for k, v in (carry or {order: F.col(f"`{order}`")}).items() if k.lower() not in MADE}
    own = {k: f"c{i}" for i, k in enumerate(carry)}
    leaves = docs.select(F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{order}`").alias("key"), leaf_of(*[F.col(f"`{c}`") for c in columns]).alias("digest"), *[v.alias(own[k]) for k, v in carry.items()])
    leaves = placed(common.materialize(leaves, "leaves"), ["key", "digest"]).drop("key")
    passes, tops = _climb(leaves, fanout, height)
    tops = common.materialize(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "groups")
    passes_of_groups, root = _climb(placed(tops, ["name"]), fanout, height)
    root = root.first()  # one row, none of an empty table
    groups = _descend([passes_of_groups[0].withColumn("subroot", F.col("digest")), *passes_of_groups[1:]], None)
    above = groups.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", "subroot")
    rows = _descend(passes, above)
    return rows.select(*[F.col(own[k]).alias(k) for k in carry], F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "proof")
