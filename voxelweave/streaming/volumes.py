"""A stream of volume files: each batch of new files is extracted and appended. The reference has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def on_new_voxels(spark: SparkSession, folder: str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Runs step on the voxel tables (Parquet) that arrive in a folder, appending to out; each batch is written once."""
    schema = "vol string, z int, y int, x int, v double"

    def write(batch: DataFrame, epoch: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    q = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
