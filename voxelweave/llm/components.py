"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014), in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import release, spill


def _state(edges: DataFrame) -> tuple:
    """Rows and an order-free checksum of an edge list: two numbers come to the driver, never the edges."""
    h = F.xxhash64("u", "v")
    r = edges.agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("lo"), F.sum(F.shiftrightunsigned(h, 32)).alias("hi")).first()
    return tuple(r)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.join(low, both["u"] == low["k"]).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k")).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 100) -> DataFrame:
    """(node, component) for every node that an edge joins to another; component is the least node reachable.

    Null ends and loops add nothing; repeated edges count once; an empty table gives an empty result. Each round is
    written to the shared folder, so lineage stays short. A node with very many edges is a skewed join key, which
    adaptive execution splits, and its minimum is pre-aggregated. Not settled after `rounds` rounds: an error.
    """
    e = edges.filter(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    e = spill(e, "edges")
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        new = spill(_small(_large(e)), "edges")
        after = _state(new)
        release(e)
        e, done = new, after == before
        before = after
        if done:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
