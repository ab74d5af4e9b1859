"""Approximate nearest neighbours by a randomised k-d forest: every row lies in a leaf of each tree, and a query meets a few leaves.

The trees' split planes come from a bounded sample, so that they fit in every task; rows are dealt to leaves where they
are, and leaves become blocks of rows that queries join. A query takes leaves of all trees together, those of the least
distance to it first, until they hold the number of rows asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.operators import knn as KNN
from voxelweave.stage import discard, written

#: Rows that the split planes are drawn from, and levels of a tree at most: a forest has at most trees * 2^LEVELS leaves.
SAMPLE, LEVELS = 1 << 14, 11
#: A split is along one of so many axes of the largest variance, chosen at random.
AXES = 5


@dataclass
class Tree:
    """A complete tree: node i has the children 2 i + 1 and 2 i + 2; rows above `at` along `axis` go to the latter."""

    axis: np.ndarray
    at: np.ndarray

    @property
    def levels(self) -> int:
        return (len(self.axis) + 1).bit_length() - 1

    def leaf(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node, every = np.zeros(len(v), np.int64), np.arange(len(v))
        for _ in range(self.levels):
            node = 2 * node + 1 + (v[every, self.axis[node]] > self.at[node])
        return node - len(self.axis)

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """[rows, leaves]: the squared distances to the planes between a row and a leaf, summed: 0 for its own leaf."""
        cost = np.zeros((len(v), 1))
        for level in range(self.levels):
            nodes = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            with np.errstate(invalid="ignore"):
                off = v[:, self.axis[nodes]] - self.at[nodes]
            cost = np.stack([cost + np.where(off > 0, off * off, 0.0), cost + np.where(off > 0, 0.0, off * off)], axis=2).reshape(len(v), -1)
        return cost


def grow(v: np.ndarray, levels: int, rng: np.random.Generator) -> Tree:
    """A tree over a sample: each node splits its rows at the median of a random one of its widest axes.

    A node whose rows are all equal, or that has none, sends every row to its first child.
    """
    axis, at = np.zeros(2**levels - 1, np.int64), np.full(2**levels - 1, np.inf)
    held = {0: np.arange(len(v))}
    for node in range(len(axis)):
        rows = held.pop(node, np.zeros(0, np.int64))
        spread = v[rows].var(axis=0) if len(rows) > 1 else np.zeros(v.shape[1])
        wide = np.argsort(-spread, kind="stable")[: min(AXES, int((spread > 0).sum()))]
        high = np.zeros(len(rows), bool)
        if len(wide):
            axis[node] = rng.choice(wide)
            along = v[rows, axis[node]]
            # a median that is also the largest number would leave nothing above it
            middle, top = np.median(along), along.max()
            at[node] = middle if middle < top else along[along < top].max()
            high = along > at[node]
        held[2 * node + 1], held[2 * node + 2] = rows[~high], rows[high]
    return Tree(axis, at)


@dataclass
class Forest:
    """Trees, the number of rows in each leaf of all of them, and the leaves' blocks as a written table."""

    trees: list[Tree]
    rows: np.ndarray
    blocks: DataFrame

    def leaves(self, v: np.ndarray, checks: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: for each row the leaves of the least bounds that hold `checks` rows together."""
        cost = np.concatenate([t.bounds(v) for t in self.trees], axis=1)
        cost[:, self.rows == 0] = np.inf
        order = np.argsort(cost, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        who, place = np.nonzero((before < checks) & np.isfinite(np.take_along_axis(cost, order, axis=1)))
        return who, order[who, place]


def plant(targets: DataFrame, trees: int = 8, leaf: int = 32, rows: int = 2048, seed: int = 1) -> Forest:
    """The forest over targets (id, grp, pc) with valid vectors of one length.

    Its planes come from the SAMPLE targets of the smallest hashes; every target is dealt to a leaf of each tree. A leaf
    has about `leaf` rows, or more where that would take over LEVELS levels: then a query meets more rows than it asks
    for, never fewer.
    """
    names = ["id", "grp", "pc"]
    count = targets.count()
    sample = KNN.hashed_first(targets, count, SAMPLE)
    levels = int(np.clip(np.ceil(np.log2(max(count, 1) / leaf)), 0, LEVELS))
    rng = np.random.default_rng(seed)
    grown = [grow(sample, levels, rng) for _ in range(trees)] if count else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = KNN._rows(b.column("pc"))
                for i, t in enumerate(grown):
                    yield pa.RecordBatch.from_arrays([pa.array((i << levels) + t.leaf(v)), *b.columns], names=["zone", *b.schema.names])

    kinds = {f.name: f.dataType.simpleString() for f in targets.schema}
    dealt = targets.select(*names).mapInArrow(deal, "zone long, " + ", ".join(f"`{c}` {kinds[c]}" for c in names))
    # packed where all rows of a leaf are, several tasks a leaf if it is large
    many = F.pmod(F.xxhash64("id"), F.lit(max(1, count // (rows << levels))))
    blocks = written(KNN.packed(dealt.repartition("zone", many), "t", rows, ["pc"], ["id", "grp"]), "forest")
    size = np.zeros(trees << levels, np.int64)
    for r in blocks.groupBy("t_zone").agg(F.sum(F.length("t_id") / 8).cast("long").alias("n")).collect():
        size[r["t_zone"]] = r["n"]
    return Forest(grown, size, blocks)


def search(queries: DataFrame, forest: Forest, k: int, rule: KNN.Rule, checks: int = 256, rows: int = 2048) -> DataFrame:
    """(q, t, d, rank): of the targets in the leaves that a query meets, the k nearest that rule allows, ties by id.

    Distances are exact; a neighbour in a leaf that the query does not meet is missed.
    """
    names = ["id", "grp", "pc"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if forest_.trees else 0, 128):
                b = whole.slice(at, 128)
                who, leaf = forest_.leaves(KNN._rows(b.column("pc")), checks)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *[b.column(c).take(pa.array(who)) for c in names], pa.array(np.full(len(who), np.inf))], names=["zone", *names, "kth"])

    # what tasks need of it: the blocks are read by the join
    forest_ = Forest(forest.trees, forest.rows, None)
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    asked = queries.select(*names).mapInArrow(probe, "zone long, " + ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", kth double")
    packed = KNN.packed(asked.repartition("zone", F.pmod(F.xxhash64("id"), F.lit(4))), "q", rows, ["pc"], ["kth", "id", "grp"])
    # Spark takes packed for as small as the queries' table, and would else send it to all tasks
    found = KNN.met_blocks(packed.hint("merge").join(forest.blocks, F.col("q_zone") == F.col("t_zone")), k, rule, ())
    # a target may be met in a leaf of each tree
    w = Window.partitionBy("q").orderBy("d", "t")
    return found.groupBy("q", "t").agg(F.min("d").alias("d")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def forget(forest: Forest) -> None:
    """Deletes the forest's blocks, once no plan reads them."""
    discard(forest.blocks)
