"""Sharding by weighted rendezvous hashing: every record goes to the shard that bids most for its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import ranked, spill


def _uniform(key: Column, shard: int) -> Column:
    """A number of 52 bits from md5 of key and shard: the same on every engine and in every run."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", key, F.lit(str(shard))).cast("binary")), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest bid -weight / ln(u), u in (0, 1) from the hash of key and shard.

    A shard's share is its weight over the sum of weights. Appending a shard moves only the records that it wins.
    Equal weights need no logarithm: the largest hash wins. Ties go to the lower shard. A null key counts as the
    empty text, so all such records share a shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: at least one above 0, none below")
    k = F.coalesce(key.cast("string"), F.lit(""))
    even = len(set(weights)) == 1
    bids = []
    for s, w in enumerate(weights):
        if w == 0:
            continue
        u = _uniform(k, s)
        bid = u if even else -F.lit(float(w)) / F.log((u + 0.5) / F.lit(float(1 << 52)))
        bids.append(F.struct(bid.alias("b"), F.lit(-s).alias("s")))
    best = bids[0] if len(bids) == 1 else F.greatest(*bids)
    return -best["s"]


def shard(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """df with `shard` int, `slot` long (gapless from 0 in each shard, by key) and `grown_shard` int.

    grown: the weights after a change of shards (null column if not given). Columns of df that have these names
    are replaced. Only the narrow columns of df should be given: all rows are range-partitioned for the slots.
    An empty df gives an empty result; repeated rows each get a slot; null keys share a shard and come last.
    """
    rest = [c for c in df.columns if c not in ("shard", "slot", "grown_shard")]
    out = df.select(*rest, rendezvous(F.col(key), weights).cast("int").alias("shard"), (rendezvous(F.col(key), grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"))
    out = spill(out, "shards")
    return ranked(out, ["shard"], [F.col(key).asc_nulls_last(), *[F.col(c) for c in rest if c != key]], "slot")
