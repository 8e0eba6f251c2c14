"""A Merkle manifest of a dataset with a witness for every row.

Leaves are hashed by Spark and numbered within their group; a range partitioned count gives the numbers, so a group
may be of any size.  Trees have a fan-out of 8 and are built by streaming aligned appends: a block is 8**4 leaves that
stand together, and an :class:`Appender` holds at most 7 complete nodes a level.  A node that completes a run of 8
closes it: every leaf under the run gets the siblings of its own node, which extends the witness it has so far.
The roots of blocks are appended to the next tree in the same way, round by round, until a group has one node; groups
are then the leaves of a last tree.  Witnesses are handed down again: a block's witness follows those of its leaves.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable
from .common import partitions

FANOUT, LEVELS = 8, 4
#: ``at``: the node's place in its run; ``siblings``: digests of the others, left to right, 64 letters each.
STEP = "struct<at:int,siblings:string>"
_STEP = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))


def encoded(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    up = 0
    while n > 1:
        n, up = -(-n // FANOUT), up + 1
    return up


class Appender:
    """Takes the leaves of one block in order; ``witness[i]`` is what leaf i has been given so far."""

    def __init__(self) -> None:
        self.open: list[list[tuple[str, int, int]]] = [[]]  # of each level: (digest, first leaf, leaf after the last)
        self.witness: list[list[tuple[int, str]]] = []

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._put(0, (digest, len(self.witness) - 1, len(self.witness)))

    def _put(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for at, (_, first, after) in enumerate(run):
            step = (at, "".join(digests[:at] + digests[at + 1:]))
            for own in self.witness[first:after]:
                own.append(step)
        self._put(level + 1, (hashlib.sha256("".join(digests).encode()).hexdigest(), run[0][1], run[-1][2]))

    def close(self, levels: int) -> str:
        """Completes shorter runs, a lone node's too, up to ``levels`` and returns the one node there."""
        for level in range(levels):
            if self.open[level]:
                self._complete(level)
        return self.open[levels][0][0]


def _appended(block: pa.Table, levels: int) -> tuple[pa.Table, Appender, str]:
    block = block.sort_by("_pos")
    tree = Appender()
    for d in block["_digest"].to_pylist():
        tree.append(d)
    return block, tree, tree.close(min(levels, height(block["_n"][0].as_py())))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_pos`` (from 0, in ``order``) and ``_n`` per group; ``by`` columns must not be null.

    Rows equal in ``order`` are numbered in some order that stays; they may hold any share of a group.
    """
    placed = reliable(
        reliable(rows).withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(rows.sparkSession), *by, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "_part").count()
    offsets = counts.select(*by, "_part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"),
                            F.sum("count").over(Window.partitionBy(*by)).alias("_n"))
    local = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order, "_tie")))
    return local.join(offsets, [*by, "_part"]).withColumn("_pos", F.col("_before") + F.col("_at") - 1).drop("_part", "_tie", "_before", "_at")


def _schema(df: DataFrame, *more: str, drop: tuple[str, ...] = ()) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in drop], *more])


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("_block", F.floor(F.col("_pos") / FANOUT**levels).cast("long"))


def block_roots(nodes: DataFrame, by: list[str], levels: int) -> DataFrame:
    """The next tree's leaves: one node for each block, numbered like the blocks."""
    rows = in_blocks(nodes.select(*by, "_pos", "_n", "_digest"), levels)

    def root(block: pa.Table) -> pa.Table:
        _, _, digest = _appended(block, levels)
        one = block.slice(0, 1)
        n = -(-one["_n"][0].as_py() // FANOUT**levels)
        return pa.table({**{c: one[c] for c in by}, "_pos": one["_block"], "_n": pa.array([n], pa.int64()), "_digest": [digest]})

    return rows.groupBy(*by, "_block").applyInArrow(root, _schema(rows.select(*by, "_pos", "_n", "_digest")))


def climbed(nodes: DataFrame, by: list[str], levels: int) -> list[DataFrame]:
    """``nodes`` and the node tables of later rounds; the last has one node for each group."""
    chain = [nodes]
    while (chain[-1].agg(F.max("_n")).first()[0] or 0) > 1:
        chain.append(reliable(block_roots(chain[-1], by, levels)))
    return chain


def _extender(kept: list[str], shared: list[str], levels: int):
    def extend(block: pa.Table, above: pa.Table) -> pa.Table:
        block, tree, _ = _appended(block, levels)
        rest = [(s["at"], s["siblings"]) for s in above["_witness"][0].as_py()]
        out = pa.array([[{"at": a, "siblings": s} for a, s in own + rest] for own in tree.witness], _STEP)
        same = {c: pc.take(above[c], pa.array([0] * block.num_rows)) for c in shared}
        return pa.table({**{c: block[c] for c in kept}, "_witness": out, **same})

    return extend


def handed_down(chain: list[DataFrame], by: list[str], top: DataFrame, levels: int) -> DataFrame:
    """Rows of the first table of ``chain`` with ``_witness`` up to the end of the witnesses in ``top``.

    ``top`` has a row for each group: ``by``, ``_witness`` and columns that all rows of the group get.
    """
    if len(chain) == 1:  # every group has one node
        return chain[0].join(top, by)
    top = top.withColumn("_block", F.lit(0).cast("long"))
    shared = [c for c in top.columns if c not in (*by, "_block", "_witness")]
    for nodes in reversed(chain[:-1]):
        rows = in_blocks(nodes, levels)
        kept = [c for c in nodes.columns if c not in ("_n", "_digest") or nodes is chain[0]]

        out = _schema(rows.select(*kept), f"_witness array<{STEP}>", *[f"`{c}` {top.schema[c].dataType.simpleString()}" for c in shared])
        done = rows.groupBy(*by, "_block").cogroup(top.groupBy(*by, "_block")).applyInArrow(_extender(kept, shared, levels), out)
        top = done if nodes is chain[0] else done.withColumnRenamed("_pos", "_block")
    return top


def sealed(leaves: DataFrame, group: str, order: list[str], digest: str = "leaf", levels: int = LEVELS) -> DataFrame:
    """All columns of ``leaves`` with ``witness``, ``subroot`` of the row's group and ``root`` of the dataset.

    Leaves stand in ``order`` (nulls first, ties by digest) within their group; groups by value, null first.  Rows
    that repeat are leaves of their own.  A group of one leaf has that leaf as its subroot and no step below it.  An
    empty table gives an empty result.  Blocks have 8**levels leaves.
    """
    rows = leaves.withColumns({"_null": F.col(group).isNull().cast("int"), "_group": F.coalesce(F.col(group).cast("string"), F.lit("")), "_digest": F.col(digest)})
    by = ["_null", "_group"]
    chain = climbed(reliable(numbered(rows, by, [*order, "_digest"])), by, levels)
    subroots = chain[-1].select(*by, F.col("_digest").alias("_subroot"), "_digest").withColumns({"_all": F.lit(0), "_order": 1 - F.col("_null")})
    tree = climbed(reliable(numbered(subroots, ["_all"], ["_order", "_group"])), ["_all"], levels)
    top = tree[-1].select("_all", F.array().cast(f"array<{STEP}>").alias("_witness"), F.col("_digest").alias("_root"))
    top = handed_down(tree, ["_all"], top, levels)
    top = top.select(*by, "_witness", "_subroot", "_root")
    done = handed_down(chain, by, top, levels)
    return done.select(*[F.col(f"`{c}`") for c in leaves.columns], F.col("_witness").alias("witness"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"))


def proof(witness: Column) -> Column:
    """Digest of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: s["siblings"]), ""), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and a witness lead to."""

    def up(digest: Column, step: Column) -> Column:
        cut = (64 * step["at"]).cast("int")
        return F.sha2(F.concat(F.substr(step["siblings"], F.lit(1), cut), digest, F.substr(step["siblings"], cut + 1)), 256)

    return F.aggregate(witness, leaf, up)
