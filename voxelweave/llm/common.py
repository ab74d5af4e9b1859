"""Shared pieces: tables written to the cluster's shared folder, ASCII case folding, word blocks."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts, space and tab to carriage return.
WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a local one if this machine is the whole cluster.

    On a real cluster an unset folder is an error: executors would write to their own disks.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxelweave-"))
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(hadoop).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


atexit.register(_clean)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted at the driver's exit."""
    path = f"{shared_dir(spark)}/voxelweave/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def spill(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors.

    The table is deleted at the driver's exit, or before by release().
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spilled_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a spilled table that no later plan reads."""
    path = getattr(df, "_spilled_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def give_back() -> None:
    """Returns what this worker has freed to the system, at a task's end: workers stay for later stages' tasks, and what
    their allocators keep of one stage would be held through the next ones."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. Texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold_of(key: object, folds: int) -> int | None:
    """crc32 of the key as text, modulo folds; a null key has none."""
    return None if key is None else zlib.crc32(str(key).encode()) % folds


def fold(c: Column, folds: int) -> Column:
    """The same as a column; null where the key is null."""
    return F.crc32(c.cast("string").cast("binary")) % folds


def byte_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of lower-cased data in blocks of about size bytes, each cut at white space; memory is bounded."""
    return (block.split() for block in lower_blocks(data, size))


def lower_blocks(data: bytes, size: int) -> Iterator[bytes]:
    """Lower-cased data in blocks of about size bytes, each cut at white space."""
    at, end = 0, len(data)
    while at < end:
        cut = at + size
        if cut >= end:
            cut = end
        else:
            while cut < end and data[cut] not in b" \t\n\x0b\x0c\r":
                cut += 1
        yield data[at:cut].lower()
        at = cut


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str, partitions: int | None = None) -> DataFrame:
    """df with a gapless rank from 0 in each group, without one task per group.

    Rows are range-partitioned by group and order and sorted within partitions. The position of a row in its
    partition, less that of its group's first row there, plus the group's rows in earlier partitions, is its rank.
    The table of offsets has at most one row for each partition and group that meet. Rows that tie in every order
    column get ranks in no set order.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(g).asc_nulls_last() for g in group], *order]
    seq, pid = f"__{out}_seq", f"__{out}_pid"
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    laid = spill(dealt.withColumn(seq, F.monotonically_increasing_id()), "ranked")
    laid = laid.withColumn(pid, F.shiftright(F.col(seq), 33))
    from pyspark.sql import Window

    per = laid.groupBy(pid, *group).agg(F.min(seq).alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy(*group).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    g2 = {g: f"__g{i}" for i, g in enumerate(group)}
    right = per.select(F.col(pid).alias("__pid"), *[F.col(g).alias(n2) for g, n2 in g2.items()], "__first", "__before")
    cond = laid[pid] == F.col("__pid")
    for g, n2 in g2.items():
        cond = cond & laid[g].eqNullSafe(F.col(n2))
    joined = laid.join(right, cond, "inner")
    return joined.withColumn(out, (F.col(seq) - F.col("__first") + F.col("__before")).cast("long")).select(*df.columns, out)
