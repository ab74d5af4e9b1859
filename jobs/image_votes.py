"""Which labels the features of each image vote for: nearest neighbours, soft votes and log-likelihoods, an image a partition.

    spark-submit jobs/image_votes.py --features FOLDER --out FOLDER [--config jobs/image_votes.toml]
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line, counted
from voxelweave.operators import match as M
from voxelweave.operators import vote as VT

log = logging.getLogger("jobs.image_votes")

RESULT = "label int, votes double, cnt long, share double, loglik double, place int, image int"


def run(spark: SparkSession, features: str, out: str, neighbours: int = 20, images: list[int] | None = None) -> DataFrame:
    """Votes of each image for each label, from its features' nearest neighbours in other images.

    features: Parquet of (vec_id, label, embedding), where the label names the image. Each of an image's features gives
    soft votes to the images of its nearest `neighbours`; beside them stands the log-likelihood of every label. Rows
    without id, label or descriptor, or with null or NaN components, take no part and are counted in the log.

    Written to out, in partitions by image: (label, votes, cnt, share, loglik, place), place 1 for the most votes. A run
    replaces the partitions of the images that it works on, all or those listed, and no other; so it can be repeated
    at any time, and after new features came the images concerned can be done again alone. Returns out, read back.
    """
    table = spark.read.parquet(features).select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    whole = F.expr("vec_id is not null and label is not null and embedding is not null and not exists(embedding, e -> e is null or isnan(e))")
    read, used = table.agg(F.count(F.lit(1)), F.count_if(whole)).first()
    good = table.filter(whole)
    every = good.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), F.col("embedding").alias("pc"))
    ask = every if images is None else every.filter(F.col("grp").isin(images))
    side = every.select("id", F.col("grp").cast("int").alias("image"))
    near = M.nearest(ask, every, neighbours, False)
    near = near.join(side.select(F.col("id").alias("q"), F.col("image").alias("qimg")), "q").join(side.select(F.col("id").alias("t"), F.col("image").alias("timg")), "t")
    near = near.withColumn("label", F.col("timg"))

    votes = VT.soft_votes(near)
    loglik = VT.log_likelihood(near, VT.priors(good))
    both = loglik.join(votes, ["image", "label"], "left").select("image", "label", F.coalesce("votes", F.lit(0.0)).alias("votes"), F.coalesce("cnt", F.lit(0)).alias("cnt"), "loglik")
    share = F.coalesce(F.try_divide("votes", F.sum("votes").over(Window.partitionBy("image"))), F.lit(0.0))
    # sums of votes in another order differ in their last bits; such are one value
    place = F.row_number().over(Window.partitionBy("image").orderBy(F.round("votes", 9).desc(), "label"))
    result, wrote = counted(both.withColumn("share", share).withColumn("place", place).select("label", "votes", "cnt", "share", "loglik", "place", "image"))
    # a partition is a few rows, one for each label: one file
    result.repartition("image").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image").parquet(out)
    log.info("read %s: %d rows, %d of them features; wrote %s: %d rows for %s", features, read, used, out, wrote.get["rows"], "all images" if images is None else f"images {images}")
    return spark.read.schema(RESULT).parquet(out)


if __name__ == "__main__":
    command_line(run, {"features": "Parquet of features", "out": "folder of the result"}, os.path.splitext(os.path.abspath(__file__))[0] + ".toml")
