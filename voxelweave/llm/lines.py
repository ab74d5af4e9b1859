"""Line dedup across documents: levelled sorted runs of line hashes, all in DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.llm.common import WS, ascii_lower, release, spill


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WS)))


def key_hash(key: Column) -> list[Column]:
    """128 bits of the key as two columns, so that two keys don't meet in a corpus of any size."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


class LineRuns:
    """Sorted runs of (h1, h2, docs, top): a key's hash, in how many documents, and the largest document id.

    add() writes a batch's own run at level 0. When a level holds `fanout` runs, they are merged into one run of the
    next level. Runs are hash-partitioned by key and sorted in each file, and live in the cluster's shared folder.
    """

    def __init__(self, fanout: int = 4):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, runs)
        if len(runs) > 1:
            every = every.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))
        return every

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(spill(run.sortWithinPartitions("h1", "h2"), f"run{level}"))
        if len(held := self.levels[level]) >= self.fanout:
            self.levels[level] = []
            self._put(level + 1, self._merge(held))
            for r in held:
                release(r)

    def add(self, keys: DataFrame, least: int) -> None:
        """keys: a batch's (h1, h2, id), one row for each document and key in it.

        The batch is summed by key and anti-joined with the runs: a key that they show in `least` documents, one of
        them with an id as large, can't change any more. What is left becomes the batch's own run.
        """
        batch = keys.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("id").alias("top"))
        if any(self.levels):
            known = self.merged().filter(F.col("docs") >= least).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("top").alias("ktop"))
            settled = F.col("top").isNull() | (F.col("ktop") >= F.col("top"))
            batch = batch.join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & settled, "left_anti")
        self._put(0, batch)

    def merged(self) -> DataFrame:
        """One view of all runs, a row for each key."""
        runs = [r for level in self.levels for r in level]
        return self._merge(runs)

    def kept(self, lines: DataFrame, least: int) -> DataFrame:
        """The rows of lines (h1, h2, id and more) that stay: an anti-join against the runs' keys that are in `least`
        documents or more, of which another document is the largest."""
        # written, so that both sides of the join are dealt for it alone and a skewed key can be split
        taken = spill(self.merged().filter(F.col("docs") >= least).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "top"), "taken")
        return lines.join(taken, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & ~F.col("id").eqNullSafe(F.col("top")), "left_anti")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 3, min_chars: int = 20, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row of docs, with its other columns, text without the lines that repeat.

    Lines are split at \\n; a null or empty text is one empty line. Keys of min_chars code points or more that are in
    `least` documents or more lose all their lines but those in the largest id that holds them. Other lines stay,
    joined by \\n. A document is its id: rows that share an id count once for a key, and all of them keep the lines
    of the largest id. Null ids are one document, lower than any other. Empty table: empty result. Only
    (hash, id, position) rows are shuffled by key; the texts are shuffled once, by id and hash of the text.

    The documents come in `batches` batches by hash of their id, each anti-joined with the runs before it and adding
    its own; then every line is anti-joined with the merged runs. A key that very many documents hold is summed
    before it is shuffled in add() and, as a skewed key of the last anti-join, split by adaptive execution.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("t"), F.struct(*rest, F.lit(0).alias("__")).alias("rest"))
    lines = x.select("id", "th", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = lines.select("id", "th", "pos", (F.char_length("key") >= min_chars).alias("long"), *key_hash(F.col("key")), F.expr(f"pmod(hash(id), {int(batches)})").alias("batch"))
    lines = spill(lines, "lines")
    long = lines.filter("long")
    runs = LineRuns(fanout)
    for b in range(batches):
        runs.add(long.filter(F.col("batch") == b).select("id", "h1", "h2").distinct(), least)
    stay = runs.kept(long.drop("batch"), least).select("id", "th", "pos").unionByName(lines.filter("not long").select("id", "th", "pos"))
    stay = stay.groupBy(F.col("id").alias("rid"), F.col("th").alias("rth")).agg(F.collect_set("pos").alias("stay"))
    y = x.join(stay, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    y = y.withColumn("stay", F.coalesce(F.col("stay"), F.array().cast("array<int>")))
    n_lines = (F.char_length("t") - F.char_length(F.replace("t", F.lit("\n"))) + 1).cast("long")
    y = y.withColumn("n_lines", n_lines).withColumn("n_dropped", F.col("n_lines") - F.size("stay"))
    part = F.expr("concat_ws('\\n', transform(array_sort(stay), p -> element_at(ls, p + 1)))")
    y = y.withColumn("ls", F.when(F.col("n_dropped") > 0, F.split("t", "\n", -1)))
    kept = F.when(F.col("n_dropped") > 0, part).otherwise(F.col("t"))
    return y.select(F.col("id").alias(id_col), kept.alias(text_col), *[F.col(f"rest.`{c}`").alias(c) for c in rest], "n_lines", "n_dropped")
