"""Features as text and binary records; transforms, located values, lists, match reports and vote matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.operators.features import eigen_ratio
from voxelweave.schemas import DESCRIPTOR

#: The feature format's lines.
HEADER = "Scale-space location[x y z scale] orientation[o11 o12 o13 o21 o22 o23 o31 o32 o32] 2nd moment eigenvalues[e1 e2 e3] info flag[i1] descriptor[d1 .. d64]"
MARK = "Scale-space location[x y z scale]"
#: The first line of the binary format, and its record of 132 bytes.
BINARY = "# featExtract 1.1"
RECORD = np.dtype([("at", "<f4", 4), ("ori", "<f4", 9), ("eigs", "<f4", 3), ("info", "<u4"), ("pc", "u1", DESCRIPTOR)])


def read_features(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Features of one or more files: 81 tab-separated numbers a row, after comments, a count and a header.

    image_id is the file's name. strict: a file without the header is an error; else its rows are read all the same.
    Rows of fewer numbers are left out.
    """
    lines = spark.read.text(path).select("value", F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("image_id"), (F.col("_metadata.file_block_start")).alias("block"))
    if strict:
        bad = lines.groupBy("image_id").agg(F.max(F.col("value").contains(MARK)).alias("ok")).filter("not ok").select("image_id").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].image_id}: no feature header")
    rows = lines.filter(~F.col("value").startswith("#") & ~F.col("value").startswith("Features:") & ~F.col("value").contains(MARK))
    p = F.split(F.rtrim(F.col("value")), "\t")
    rows = rows.select("image_id", F.transform(p, lambda x: x.try_cast("float")).alias("p")).filter(F.size("p") >= 17 + DESCRIPTOR)
    at = lambda i: F.col("p")[i]
    return rows.select(
        "image_id", *[at(i).alias(c) for i, c in enumerate(("x", "y", "z", "scale"))], F.array(*[F.array(*[at(4 + 3 * i + j) for j in range(3)]) for i in range(3)]).alias("ori"),
        F.slice("p", 14, 3).alias("eigs"), at(16).cast("int").alias("info"), F.slice("p", 18, DESCRIPTOR).alias("pc"),
    )


def feature_lines(feats: DataFrame, limit: float = -1.0) -> DataFrame:
    """(image_id, line): features as text, those that pass the eigen filter."""
    six = lambda c: F.format_string("%.6f", c.cast("double"))
    parts = [*[six(F.col(c)) for c in ("x", "y", "z", "scale")], *[six(F.col("ori")[i][j]) for i in range(3) for j in range(3)], *[six(F.col("eigs")[i]) for i in range(3)], F.col("info").cast("string")]
    pc = F.array_join(F.transform("pc", lambda x: x.cast("int").cast("string")), "\t")
    return eigen_ratio(feats, limit).select("image_id", F.concat(F.concat_ws("\t", *parts, pc), F.lit("\t")).alias("line"))


def write_features(feats: DataFrame, path: str, limit: float = -1.0, comments: tuple[str, ...] = ()) -> None:
    """A folder of text per image, image_id=..., with comments, the count and the header first."""
    lines = feature_lines(feats, limit)
    count = lines.groupBy("image_id").agg(F.count("*").alias("n"))
    first = count.select("image_id", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit("# " + c).alias("line")) for i, c in enumerate(comments)], F.struct(F.lit(97).alias("o"), F.concat(F.lit("Features: "), F.col("n").cast("string")).alias("line")), F.struct(F.lit(98).alias("o"), F.lit(HEADER).alias("line")))).alias("r"))
    both = first.select("image_id", "r.o", "r.line").unionByName(lines.withColumn("o", F.lit(99)))
    both.repartition("image_id").sortWithinPartitions("image_id", "o").select("image_id", F.col("line").alias("value")).write.partitionBy("image_id").text(path)


def feature_files(feats: DataFrame, limit: float = -1.0) -> DataFrame:
    """(vol, content): the features of each image that pass the eigen filter, as one binary file; one image is a task's
    turn. `volumes.save` writes them. Descriptors are cut to bytes. An image that keeps none has no row."""
    cols = [F.array("x", "y", "z", "scale").cast("array<float>").alias("at"), F.flatten("ori").cast("array<float>").alias("ori"), F.col("eigs").cast("array<float>").alias("eigs"), F.col("info").cast("long").alias("info"), F.transform("pc", lambda x: x.cast("int")).alias("pc")]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(pdf), RECORD)
        for c in RECORD.names:
            v = np.array(pdf[c].tolist(), np.int64 if c in ("info", "pc") else np.float32)
            out[c] = v & 0xFF if c == "pc" else v & 0xFFFFFFFF if c == "info" else v
        head = f"{BINARY}\nFeatures: {len(pdf)}\n".encode()
        return pd.DataFrame({"vol": [key[0]], "content": [head + out.tobytes()]})

    return eigen_ratio(feats, limit).select(F.col("image_id").cast("string").alias("vol"), *cols).groupBy("vol").applyInPandas(one, "vol string, content binary")


def read_feature_files(spark: SparkSession, path: str) -> DataFrame:
    """Features of one or more binary files; image_id is the file's name. A short or foreign file is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b.path, b.content, strict=True):
                lines = bytes(data[:200]).split(b"\n", 2)
                if len(lines) < 3 or lines[0].decode("latin-1") != BINARY or not lines[1].startswith(b"Features:"):
                    raise ValueError(f"{name}: not a file of features")
                n, at = int(lines[1].split(b":")[1]), len(lines[0]) + len(lines[1]) + 2
                a = np.frombuffer(data, RECORD, n, at)
                yield pd.DataFrame({"image_id": name.rsplit("/", 1)[-1], "at": list(a["at"]), "ori": list(a["ori"]), "eigs": list(a["eigs"]), "info": a["info"].astype(np.int32), "pc": list(a["pc"].astype(np.float32))})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "image_id string, at array<float>, ori array<float>, eigs array<float>, info int, pc array<float>")
    return rows.select("image_id", *[F.col("at")[i].alias(c) for i, c in enumerate(("x", "y", "z", "scale"))], F.array(*[F.slice("ori", 3 * i + 1, 3) for i in range(3)]).alias("ori"), "eigs", "info", "pc")


def transform_lines(t: Column) -> Column:
    """Four rows of [scale R | shift] as tab-separated text."""
    row = lambda i: F.concat_ws("\t", *[F.format_string("%f", t["rot"][i][j] * t["scale"]) for j in range(3)], F.format_string("%f", t["trans"][i]))
    return F.concat_ws("\n", row(0), row(1), row(2), F.lit("0.0\t0.0\t0.0\t1.0"))


def parse_transform(text: Column) -> Column:
    """The transform of such text: the scale is the mean length of the columns, which are then of length 1."""
    m = F.transform(F.slice(F.split(F.trim(text), "\n"), 1, 3), lambda r: F.transform(F.split(F.trim(r), r"\s+"), lambda x: x.cast("double")))
    size = [F.sqrt(m[0][j] * m[0][j] + m[1][j] * m[1][j] + m[2][j] * m[2][j]) for j in range(3)]
    rot = F.array(*[F.array(*[m[i][j] / size[j] for j in range(3)]) for i in range(3)])
    return F.struct(((size[0] + size[1] + size[2]) / 3).alias("scale"), rot.alias("rot"), F.array(m[0][3], m[1][3], m[2][3]).alias("trans"))


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path, wholetext=True)
    return t.select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("name"), parse_transform(F.col("value")).alias("t"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z cut to whole numbers, and v; rows that are no four numbers are left out."""
    p = spark.read.schema("x double, y double, z double, v double").csv(path, sep="\t", mode="DROPMALFORMED").dropna()
    return p.select(*[F.col(c).cast("int").alias(c) for c in "xyz"], "v")


def write_points(pts: DataFrame, path: str) -> None:
    pts.select("x", "y", "z", F.format_string("%f", "v").alias("v")).write.csv(path, sep="\t")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines that aren't empty."""
    return spark.read.text(path).filter("length(value) > 0")


def report_lines(matches: DataFrame) -> DataFrame:
    """(pair, line): name, place, scale, tag, squared distance and frame of each match."""
    six = lambda c: F.format_string("%.6f", c.cast("double"))
    return matches.select("pair", F.concat_ws("\t", "name", *[six(F.col(c)) for c in ("x", "y", "z", "scale")], F.col("tag").cast("string"), six(F.col("d")), *[six(F.col("ori")[i][j]) for i in range(3) for j in range(3)]).alias("line"))


def summary_lines(pairs: DataFrame) -> DataFrame:
    """(pair, line): name, inliers and the transform found of each pair, the two unused counts as zeros."""
    t = F.col("transform")
    return pairs.select("pair", F.format_string("%s:\t%d\t0\t0\t%f\t%f\t%f\t%f", "name", F.col("inliers").cast("long"), t["scale"], *[t["trans"][i] for i in range(3)]).alias("line"))


def write_partitioned(lines: DataFrame, by: str, path: str, mode: str = "errorifexists") -> None:
    """Match reports by pair, or summaries with mode="append"."""
    lines.select(by, F.col("line").alias("value")).write.mode(mode).partitionBy(by).text(path)


def basename(path: Column) -> Column:
    return F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)


def rerooted(path: Column, folder: str) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), basename(path))


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(ext))
