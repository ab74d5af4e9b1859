"""Registered round trips: relations written in each format to the shared folder and read back by the format's source."""

from __future__ import annotations

from pyspark.sql import DataFrame
import pandas as pd
from pyspark.sql import functions as F

from voxelweave import catalog as C
from voxelweave.catalog import DIMS, query, r
from voxelweave.operators import features as FT
from voxelweave.operators import match as M
from voxelweave.operators import volumes as VOL
from voxelweave.sources import text as TX
from voxelweave.sources import volumes as VS
from voxelweave.stage import fresh_path

_RANK = "k AS (SELECT vec_id AS feat_id, max(CASE WHEN p = 1 THEN n END) AS pc0, max(CASE WHEN p = 64 THEN n END) AS pc63 FROM (SELECT vec_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY v, p) - 1 AS n FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings)) GROUP BY 1)"
_KEPT = "(e1 + e2 + e3) * (e1 + e2 + e3) * (e1 + e2 + e3) < 140 * e1 * e2 * e3"


def _ranked(spark, d) -> DataFrame:
    return FT.ranked(C.features(spark, d))


def _told(back: DataFrame) -> DataFrame:
    one = lambda c: F.col(c).cast("double").alias(c)
    return back.select(*[one(c) for c in ("x", "y", "z", "scale")], F.col("eigs")[0].cast("double").alias("e1"), "info", F.col("pc")[0].cast("int").alias("pc0"), F.col("pc")[63].cast("int").alias("pc63"), F.col("ori")[1][1].cast("double").alias("o11"))


def _features_sql(value: str) -> str:
    cols = ", ".join(f"{value.format(c)}::FLOAT::DOUBLE AS {c}" for c in ("x", "y", "z", "scale", "e1"))
    return f"WITH {C._F}, {_RANK} SELECT {cols}, info, pc0::INT AS pc0, pc63::INT AS pc63, 1.0::DOUBLE AS o11 FROM f JOIN k USING (feat_id) WHERE {_KEPT}"


@query(_features_sql("round({}, 6)"))
def features_text(spark, d):
    path = fresh_path(spark, "features")
    TX.write_features(_ranked(spark, d), path, limit=140.0, comments=("round trip",))
    return _told(TX.read_features(spark, f"{path}/image_id=*"))


@query(_features_sql("{}"))
def features_binary(spark, d):
    path = fresh_path(spark, "binary")
    VS.save(TX.feature_files(_ranked(spark, d), limit=140.0), path, ".feat").count()
    return _told(TX.read_feature_files(spark, path))


def _centres(spark, d) -> DataFrame:
    """A transform for each image: the planted rotation, and the middle of the image's places."""
    b = FT.bounding_box(C.features(spark, d), "image_id")
    return b.select("image_id", F.struct(F.lit(1.5).alias("scale"), C._t(*C._T1)["rot"].alias("rot"), F.array("mid_x", "mid_y", "mid_z").alias("trans")).alias("t"))


_MID = f"{C._F}, b AS (SELECT image_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM f GROUP BY 1)"


@query(f"WITH {_MID} SELECT 1.5::DOUBLE AS scale, round(mx, 6) + 0.0 AS t0, round(my, 6) + 0.0 AS t1, round(mz, 6) + 0.0 AS t2, -1.0::DOUBLE AS r01 FROM b")
def transform_text(spark, d):
    path = fresh_path(spark, "transforms")
    TX.write_partitioned(_centres(spark, d).select("image_id", TX.transform_lines(F.col("t")).alias("line")), "image_id", path)
    t = TX.read_transforms(spark, f"{path}/image_id=*")
    return t.select(r("t.scale").alias("scale"), *[r(F.col("t.trans")[i]).alias(f"t{i}") for i in range(3)], r(F.col("t.rot")[0][1]).alias("r01"))


@query(f"WITH {_MID} SELECT round(1 / 1.5::DOUBLE, 5) AS scale, round(-my / 1.5, 5) + 0.0 AS t0, round(mx / 1.5, 5) + 0.0 AS t1, round(-mz / 1.5, 5) + 0.0 AS t2 FROM b")
def inverse_text(spark, d):
    """Inverses as text; the places are turned back by what the text says."""
    path = fresh_path(spark, "inverses")
    TX.write_partitioned(_centres(spark, d).select("image_id", TX.transform_lines(M.invert(F.col("t"))).alias("line")), "image_id", path)
    t = TX.read_transforms(spark, f"{path}/image_id=*")
    return t.select(r("t.scale", 5).alias("scale"), *[r(F.col("t.trans")[i], 5).alias(f"t{i}") for i in range(3)])


@query(f"WITH {C._F} SELECT image_id, concat_ws(chr(9), 'img', printf('%.6f', round(x, 3)), printf('%.6f', round(y, 3)), printf('%.6f', round(z, 3)), printf('%.6f', round(scale, 3)), feat_id::VARCHAR, '0.000000', '1.000000', '0.000000', '0.000000', '0.000000', '1.000000', '0.000000', '0.000000', '0.000000', '1.000000') AS line FROM f")
def report_text(spark, d):
    """Match reports by image, as they are read back."""
    path = fresh_path(spark, "reports")
    # a negative number that is rounded to zero is written with its sign, as C's %f has it; Spark's round drops that
    three = {c: F.when(F.col(c).cast("string").startswith("-"), -F.abs(F.round(c, 3))).otherwise(F.round(c, 3)) for c in ("x", "y", "z", "scale")}
    m = C.features(spark, d).withColumns(three).withColumns({"pair": F.col("image_id"), "name": F.lit("img"), "tag": F.col("feat_id"), "d": F.lit(0.0)})
    TX.write_partitioned(TX.report_lines(m), "pair", path)
    return spark.read.text(path).select(F.col("pair").alias("image_id"), F.col("value").alias("line"))


@query("WITH l AS (SELECT DISTINCT label FROM embeddings) SELECT label AS pair, label || '.key:' || chr(9) || (label + 3) || chr(9) || '0' || chr(9) || '0' || chr(9) || '1.500000' || chr(9) || '10.000000' || chr(9) || '-5.000000' || chr(9) || '2.000000' AS line, 2::BIGINT AS times FROM l")
def summary_text(spark, d):
    """Summaries written, and appended once more."""
    path = fresh_path(spark, "summaries")
    labels = C.table(spark, d, "embeddings").select(F.col("label").alias("pair")).distinct()
    s = labels.select("pair", F.concat(F.col("pair").cast("string"), F.lit(".key")).alias("name"), (F.col("pair") + 3).alias("inliers"), C._t(*C._T1).alias("transform"))
    for _ in range(2):
        TX.write_partitioned(TX.summary_lines(s), "pair", path, mode="append")
    return spark.read.text(path).groupBy("pair", F.col("value").alias("line")).agg(F.count("*").alias("times"))


@query("SELECT n_name AS line FROM nation")
def line_list(spark, d):
    path = fresh_path(spark, "list")
    n = C.table(spark, d, "nation").select("n_name")
    n.unionByName(spark.createDataFrame([("",), ("",)], "n_name string")).write.text(path)
    return TX.read_list(spark, path).select(F.col("value").alias("line"))


@query(f"WITH {C._G} SELECT x, y, z, round(v, 6) AS v FROM g")
def points_text(spark, d):
    path = fresh_path(spark, "points")
    TX.write_points(C.located(spark, d), path)
    return TX.read_points(spark, path).select("x", "y", "z", r("v").alias("v"))


_FULL = f"{C._G}, cells AS (SELECT z.i::INT AS z, y.i::INT AS y, x.i::INT AS x FROM range(9) z(i), range(11) y(i), range(50) x(i)), a AS (SELECT z, y, x, coalesce(v, 0)::FLOAT::DOUBLE AS v FROM cells LEFT JOIN g USING (z, y, x))"


def _nifti(spark, d) -> str:
    path = fresh_path(spark, "nifti")
    v = C.volume(spark, d)
    both = v.withColumn("t", F.lit(0)).unionByName(v.withColumn("t", F.lit(1)).withColumn("v", F.col("v") / 2))
    VS.save(VS.assembled(both, DIMS, lambda a: VS.encode_nifti(a, (3.0, 2.0, 1.0))), path, ".nii").count()
    return path


@query(f"WITH {_FULL}, h AS (SELECT z, y, x, (coalesce(v, 0) / 2)::FLOAT::DOUBLE AS v FROM cells LEFT JOIN g USING (z, y, x)) SELECT 0 AS t, z, y, x, v FROM a UNION ALL SELECT 1, z, y, x, v FROM h")
def nifti(spark, d):
    return VS.read_nifti(spark, _nifti(spark, d)).select("t", "z", "y", "x", F.col("v").cast("double").alias("v"))


@query(f"WITH {_FULL}, h AS (SELECT z, y, x, (coalesce(v, 0) / 2)::FLOAT::DOUBLE AS v FROM cells LEFT JOIN g USING (z, y, x)) SELECT 1 AS t, z, y, x, v FROM h WHERE z BETWEEN 2 AND 4 AND y = 7 AND x BETWEEN 10 AND 29")
def nifti_part(spark, d):
    """One volume of two, and of it a box with one axis collapsed."""
    part = VS.read_nifti(spark, _nifti(spark, d), volumes=[1], box=((2, 3), (7, 1), (10, 20)))
    return part.select("t", "z", "y", "x", F.col("v").cast("double").alias("v"))


@query("SELECT 9 AS nz, 11 AS ny, 50 AS nx, 3.0::DOUBLE AS dz, 2.0::DOUBLE AS dy, 1.0::DOUBLE AS dx")
def nifti_header(spark, d):
    h = VS.read_headers(spark, _nifti(spark, d))
    return h.select(*[F.col("dims")[i].cast("int").alias(f"n{c}") for i, c in enumerate("zyx")], *[F.col("spacing")[i].alias(f"d{c}") for i, c in enumerate("zyx")])


def _array(spark, d) -> str:
    path = fresh_path(spark, "array")
    VS.save_arrays(C.volume(spark, d), DIMS, path).count()
    return path


@query(f"WITH {_FULL} SELECT z, y, x, v FROM a")
def array_file(spark, d):
    return VS.read_array(spark, f"{_array(spark, d)}/lineitem.txt").select("z", "y", "x", F.col("v").cast("double").alias("v"))


@query(f"WITH {_FULL} SELECT z, y, x, v FROM a")
def raw_floats(spark, d):
    return VS.read_raw(spark, f"{_array(spark, d)}/lineitem.img", DIMS).select("z", "y", "x", F.col("v").cast("double").alias("v"))


@query(f"WITH {_FULL} SELECT y, x, floor(least(255, greatest(0, v / 120000 * 255)))::INT AS v FROM a WHERE z = 4")
def pgm(spark, d):
    path = fresh_path(spark, "pgm")
    plane = VOL.plane(C.volume(spark, d), "z", 4).withColumn("z", F.lit(0))
    VS.save(VS.assembled(plane, (1, *DIMS[1:]), lambda a: VS.encode_pgm(a[0, 0].astype(float), 0, 120000)), path, ".pgm").count()
    return VS.read_pnm(spark, path).select("y", "x", F.col("v").cast("int").alias("v"))


@query(f"WITH {C._G} SELECT z AS n, round(avg(v), 2) AS mean, round(var_pop(v), 2) AS variance FROM g GROUP BY z")
def header_moments(spark, d):
    """The means and variances that a header lists, one a channel: those of the volume's planes, written and read back."""
    path = fresh_path(spark, "header")
    planes = C.volume(spark, d).groupBy("z").agg(F.avg("v").alias("m"), F.var_pop("v").alias("v"))
    listed = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", c))), lambda e: F.format_string("%.2f", e[c])), " ") for c in "mv"]
    planes.agg(F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), text) for c, text in zip("mv", listed, strict=True)]).alias("value")).coalesce(1).write.text(path)

    def parsed(batches):
        for b in batches:
            for text in b["value"]:
                got = VS.means_and_variances(text)
                yield pd.DataFrame({"n": range(len(got["means"])), "mean": got["means"], "variance": got["variances"]})

    return spark.read.text(path, wholetext=True).mapInPandas(parsed, "n int, mean double, variance double")
