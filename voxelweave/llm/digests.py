"""Exact dedup: a persistent index of text digests, bucketed and sorted by digest, in DataFrame and SQL functions alone."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm.common import ascii_lower, spill


def digest_of(text: Column) -> Column:
    """SHA-256 (32 bytes) of the UTF-8 text with A-Z lower-cased; a null text is an empty one."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """A Parquet table (digest, id) at `path`, one row for each text met so far: the row that stays.

    The table is bucketed and sorted by digest, so a lookup shuffles only what is looked up. Its number of buckets is set
    when it is made (the session's shuffle partitions unless given) and written beside it; later sessions open the index
    by its path alone. An append that was cut off may be repeated: what it had added is found again and not added twice.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        held = self._read_buckets()
        if held is None:
            held = int(buckets or spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(held).alias("buckets")).write.json(f"{self.path}/spec")
        self.buckets = held
        self.table = f"digests_{uuid.uuid4().hex}"
        where = f"{self.path}/rows".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {held} BUCKETS LOCATION '{where}'")

    def _read_buckets(self) -> int | None:
        jvm, spec = self.spark.sparkContext._jvm, f"{self.path}/spec"
        p = jvm.org.apache.hadoop.fs.Path(spec)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema("buckets int").json(spec).first()[0]

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, batch: DataFrame) -> None:
        """batch: (digest, id). Of each digest that the index lacks, the largest id (nulls are lowest) is appended.

        The batch is reduced to a row a digest before it is dealt to the index's buckets, where a sort-merge anti-join
        against the index leaves what is new, already in the order in which it is written.
        """
        best = batch.groupBy("digest").agg(F.max("id").alias("id")).repartition(self.buckets, "digest")
        known = self.rows().select(F.col("digest").alias("__known")).hint("merge")
        new = best.join(known, F.col("digest") == F.col("__known"), "left_anti")
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/rows").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forgets the session's name for the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 4) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for each row of docs, with its other columns but the text.

    Texts are equal when identical after A-Z are lower-cased; null counts as empty. The largest id of equal texts stays;
    of rows that share it, one. Null ids are the lowest. group_size counts the rows of docs with that text. Empty table:
    empty result. Columns named like the result's are left out. Texts of any length are hashed where they are read;
    only (digest, id, sequence) is shuffled.

    Rows are given to the index in `batches` runs of ids from the largest down, so that whatever the index holds comes
    before what is added: with a new index, each text's first row is the one of the largest id. A text that an older
    index holds keeps the id it has there; rows of docs with that text are kept only if that is their largest id, as it
    is where a run that was cut off is repeated.
    """
    out_names = ("keep_id", "group_size", "kept", "digest")
    rest = [c for c in docs.columns if c not in (id_col, text_col, *out_names)]
    x = docs.select(F.col(id_col).cast("long").alias("id"), digest_of(F.col(text_col)).alias("digest"), F.struct(*rest, F.lit(0).alias("__")).alias("rest"))
    # written, so that the sequence is the same for every reader
    x = spill(x.withColumn("seq", F.monotonically_increasing_id()), "digests")
    cuts = x.select(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    # above all cuts: batch 0; not above the lowest, or null: the last
    batch = sum((F.when(F.col("id") > c, 0).otherwise(1) for c in cuts), F.lit(0))
    for b in range(len(cuts) + 1):
        index.add(x.filter(batch == b).select("digest", "id"))
    held = index.rows().select(F.col("digest").alias("d2"), F.col("id").alias("keep_id"))
    top = F.max(F.struct("id", (-F.col("seq")).alias("back")))
    sizes = x.groupBy("digest").agg(F.count("*").alias("group_size"), top.alias("top"))
    # written, so that both sides of the last join are dealt for it alone and a skewed digest can be split
    groups = spill(sizes.join(held, F.col("digest") == F.col("d2")).select("d2", "keep_id", (-F.col("top.back")).alias("top_seq"), "group_size"), "groups")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("seq") == F.col("top_seq"))
    y = x.join(groups.hint("merge"), F.col("digest") == F.col("d2"))
    return y.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "digest", *[F.col(f"rest.`{c}`").alias(c) for c in rest])
