"""Further registered queries: kernels, patches, resampling, small matrices, strings, visitors and a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from voxelweave import catalog as C
from voxelweave.catalog import DIMS, query, r
from voxelweave.functions import linear as L
from voxelweave.functions import vectors as V
from voxelweave.operators import bricks as BR
from voxelweave.operators import patches as PT
from voxelweave.operators import points as P
from voxelweave.operators import volumes as VOL
from voxelweave.sources import text as TX

# ------------------------------------------------------------------------------------------------------- kernels

#: A sampled Gaussian as SQL: weights as far as 0.01 of its mass is left out, of sum 1.
_KERNEL = """tail AS (SELECT i, exp(-i * i / (2 * 1.6::DOUBLE * 1.6::DOUBLE)) AS t FROM range(1, 40) n(i)),
mass AS (SELECT 1 + 2 * sum(t) AS every FROM tail WHERE t > 1e-5), got AS (SELECT i, 1 + 2 * sum(t) OVER (ORDER BY i) AS g FROM tail),
width AS (SELECT min(i) AS r, min(g) AS g FROM got, mass WHERE g > 0.99::DOUBLE * every),
kern AS (SELECT o, exp(-o * o / (2 * 1.6::DOUBLE * 1.6::DOUBLE)) / g AS w FROM width, range(-20, 21) n(o) WHERE abs(o) <= r)"""


def _pass(src: str, axis: str, name: str) -> str:
    cols = ", ".join(f"({c} - o)::INT AS {c}" if c == axis else c for c in "zyx")
    return f"{name} AS (SELECT z, y, x, sum(v * w) AS v FROM (SELECT {cols}, v, w FROM {src}, kern) WHERE {C._BOX} GROUP BY 1, 2, 3)"


@query(f"WITH {C._G}, {_KERNEL}, {_pass('g', 'x', 'b1')}, {_pass('b1', 'y', 'b2')}, {_pass('b2', 'z', 'b3')} SELECT z, y, x, round(v, 4) + 0.0 AS v FROM b3")
def gauss_blur(spark, d):
    return C._vox(BR.unpack(BR.blur(BR.pack(C.volume(spark, d), C.SIDE), C.SIDE, V.gaussian(1.6)), C.SIDE))


@query("""WITH s AS (SELECT DISTINCT label, 1 + label / 4.0::DOUBLE AS sg FROM embeddings), tail AS (SELECT label, sg, i, exp(-i * i / (2 * sg * sg)) AS t FROM s, range(1, 60) n(i)),
mass AS (SELECT label, 1 + 2 * sum(t) AS every FROM tail WHERE t > 1e-5 GROUP BY label), got AS (SELECT label, sg, i, 1 + 2 * sum(t) OVER (PARTITION BY label ORDER BY i) AS g FROM tail),
width AS (SELECT got.label, got.sg, min(i) AS r, min(g) AS g FROM got JOIN mass ON got.label = mass.label WHERE g > 0.99::DOUBLE * every GROUP BY 1, 2)
SELECT label, o::INT AS o, round(exp(-o * o / (2 * sg * sg)) / g, 9) AS w FROM width, range(-60, 61) n(o) WHERE abs(o) <= r""")
def gauss_kernel(spark, d):
    """The kernel of a width for each label."""

    def kernels(batches):
        for b in batches:
            for label in b["label"]:
                yield pd.DataFrame([(label, o, w) for o, w in V.gaussian(1 + label / 4)], columns=["label", "o", "w"])

    labels = C.table(spark, d, "embeddings").select("label").distinct()
    return labels.mapInPandas(kernels, "label int, o int, w double").select("label", "o", r("w", 9).alias("w"))


@query(f"WITH {C._DOG}, {C._strict('d2', 'd2', 'e', 26).replace('WHERE NOT (dz = 0 AND dy = 0 AND dx = 0)', 'WHERE dz = 0 AND NOT (dy = 0 AND dx = 0)').replace('abs(s) = 26', 'abs(s) = 8')} SELECT z, y, x, (s > 0)::INT AS polarity FROM e")
def extrema_flat(spark, d):
    return C._extrema(spark, d, 1, flat=True).select("z", "y", "x", "polarity")


# ------------------------------------------------------------------------------------------------------- patches

_START = (0, 13, 26, 39)
#: Four boxes of 11 voxels a side, the planes that the volume lacks as 0.
_PATCH = f"""{C._G}, full_box AS (SELECT s.v AS vol, z.i::INT AS z, y.i::INT AS y, x.i::INT AS x FROM (VALUES {', '.join(f'({i})' for i in _START)}) s(v), range(11) z(i), range(11) y(i), range(11) x(i)),
p AS (SELECT vol, b.z, b.y, b.x, coalesce(g.v, 0) AS v FROM full_box b LEFT JOIN g ON g.z = b.z AND g.y = b.y AND g.x = b.x + b.vol),
e AS (SELECT p.vol, p.z, p.y, p.x, CASE WHEN p.x IN (0, 10) THEN 0 ELSE (lead(v) OVER wx) - (lag(v) OVER wx) END AS dx, CASE WHEN p.y IN (0, 10) THEN 0 ELSE (lead(v) OVER wy) - (lag(v) OVER wy) END AS dy,
 CASE WHEN p.z IN (0, 10) THEN 0 ELSE (lead(v) OVER wz) - (lag(v) OVER wz) END AS dz FROM p WINDOW wx AS (PARTITION BY vol, z, y ORDER BY x), wy AS (PARTITION BY vol, z, x ORDER BY y), wz AS (PARTITION BY vol, y, x ORDER BY z))"""


def _patches(spark, d):
    v, out = C.volume(spark, d), None
    for s in _START:
        part = VOL.crop(v, (0, 0, s), (11, 11, 11)).withColumn("vol", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return PT.dense(out, PT.DIMS)


_HALF = "CASE WHEN {c} < 5 THEN {low} WHEN {c} = 5 THEN 0.5::DOUBLE ELSE {high} END"


@query(f"""WITH {_PATCH}, m AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS m, CASE WHEN dx < 0 THEN 4 ELSE 0 END + CASE WHEN dy < 0 THEN 2 ELSE 0 END + CASE WHEN dz < 0 THEN 1 ELSE 0 END AS k FROM e),
h(h) AS (VALUES (0), (1)), w AS (SELECT vol, k, c.h AS hz, b.h AS hy, a.h AS hx, m * {' * '.join('CASE ' + s + '.h WHEN 0 THEN ' + _HALF.format(c=c, low='1.0::DOUBLE', high='0.0::DOUBLE') + ' ELSE ' + _HALF.format(c=c, low='0.0::DOUBLE', high='1.0::DOUBLE') + ' END' for c, s in (('z', 'c'), ('y', 'b'), ('x', 'a')))} AS w FROM m, h a, h b, h c WHERE m > 0),
t AS (SELECT vol, ((hz * 2 + hy) * 2 + hx) * 8 + k AS pos, sum(w) AS v FROM w GROUP BY 1, 2),
u AS (SELECT s.vol, n.i AS pos, coalesce(t.v, 0) AS v FROM (SELECT DISTINCT vol FROM p) s CROSS JOIN range(64) n(i) LEFT JOIN t ON t.vol = s.vol AND t.pos = n.i),
l AS (SELECT vol, pos, v - min(v) OVER (PARTITION BY vol) AS v FROM u)
SELECT vol, pos::INT AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vol)), 6) + 0.0 AS v FROM l""")
def goh_hist(spark, d):
    return PT.orientation_histogram(_patches(spark, d)).select("vol", F.posexplode("pc").alias("pos", "v")).select("vol", "pos", r("v").alias("v"))


@query(f"""WITH {_PATCH}, s AS (SELECT vol, sum(dx * dx) / 1e9 AS a, sum(dx * dy) / 1e9 AS b, sum(dx * dz) / 1e9 AS c, sum(dy * dy) / 1e9 AS e, sum(dy * dz) / 1e9 AS f, sum(dz * dz) / 1e9 AS i FROM e WHERE (x - 5) ** 2 + (y - 5) ** 2 + (z - 5) ** 2 < 25 GROUP BY vol)
SELECT vol, round(a + e + i, 4) AS trace, round(a * e + a * i + e * i - b * b - c * c - f * f, 3) AS minors, round(a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c), 3) AS det, true AS falls FROM s""")
def tensor_eig(spark, d):
    """The eigenvalues by what they sum and multiply to: trace, principal minors and determinant of the second moments."""
    e = [F.col("e")[i] / 1e9 for i in range(3)]
    return PT.tensor_eigenvalues(_patches(spark, d)).select("vol", r(e[0] + e[1] + e[2], 4).alias("trace"), r(e[0] * e[1] + e[0] * e[2] + e[1] * e[2], 3).alias("minors"), r(e[0] * e[1] * e[2], 3).alias("det"), ((e[0] >= e[1]) & (e[1] >= e[2])).alias("falls"))


_POINTS = [(1, 12.3, 5.5, 4.5, 0.9, 0), (2, 30.25, 5.75, 4.25, 0.75, 1), (3, 2.0, 5.5, 4.5, 0.9, 0), (4, 25.0, 5.5, 4.5, 3.0, 0)]
_TURNED = [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]


@query(f"""WITH {C._G}, pt(id, cx, cy, cz, scale, turned) AS (VALUES {', '.join(map(str, _POINTS))}),
ok AS (SELECT * FROM pt WHERE floor(cx) - floor(2 * scale + 2) >= 0 AND floor(cx) + floor(2 * scale + 2) < 50 AND floor(cy) - floor(2 * scale + 2) >= 0 AND floor(cy) + floor(2 * scale + 2) < 11 AND floor(cz) - floor(2 * scale + 2) >= 0 AND floor(cz) + floor(2 * scale + 2) < 9),
spot AS (SELECT id, z.i AS pz, y.i AS py, x.i AS px, cx + scale * 2 / 5 * CASE WHEN turned = 1 THEN -(y.i - 5) ELSE x.i - 5 END AS fx, cy + scale * 2 / 5 * CASE WHEN turned = 1 THEN x.i - 5 ELSE y.i - 5 END AS fy, cz + scale * 2 / 5 * (z.i - 5) AS fz FROM ok, range(11) z(i), range(11) y(i), range(11) x(i)),
cl AS (SELECT *, {C._cell_sql('x', 50)}, {C._cell_sql('y', 11)}, {C._cell_sql('z', 9)} FROM spot), b2(a) AS (VALUES (0), (1)),
co AS (SELECT id, pz, py, px, iz + p.a AS z, iy + q.a AS y, ix + s.a AS x, CASE p.a WHEN 0 THEN wz ELSE 1 - wz END * CASE q.a WHEN 0 THEN wy ELSE 1 - wy END * CASE s.a WHEN 0 THEN wx ELSE 1 - wx END AS w FROM cl, b2 p, b2 q, b2 s)
SELECT id::INT AS vol, pz::INT AS z, py::INT AS y, px::INT AS x, round(sum(w * v), 3) + 0.0 AS v FROM co JOIN g USING (z, y, x) GROUP BY ALL""")
def patch_sample(spark, d):
    eye = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [("lineitem", i, x, y, z, s, _TURNED if t else eye) for i, x, y, z, s, t in _POINTS]
    p = spark.createDataFrame(rows, "vol string, id int, fx double, fy double, fz double, scale double, ori array<array<double>>")
    return PT.sampled(p, C.volume(spark, d), DIMS).select("vol", "z", "y", "x", r("v", 3).alias("v"))


@query()
def canonical_ori(spark, d):
    """Frames of four patches by their main gradient directions: peaks of histograms on a sphere, in arrays."""
    import numpy as np

    from voxelweave.plans.extract import frames, unit_patch

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((11, 11, 11))
        a[pdf.z, pdf.y, pdf.x] = pdf.v
        out = frames(unit_patch(a))
        return pd.DataFrame({"vol": [key[0]] * len(out), "n": range(len(out)), "ori": [f.tolist() for f in out]})

    return _patches(spark, d).groupBy("vol").applyInPandas(one, "vol int, n int, ori array<array<double>>")


@query(f"WITH {C._B1}, j AS (SELECT g.z, g.y, g.x, abs(g.v) + 1 AS a0, 2.0::DOUBLE AS a1, abs(b.v) + 1 AS b0, 3.0::DOUBLE AS b1, 4.0::DOUBLE AS b2 FROM g JOIN b USING (z, y, x)), s AS (SELECT *, (a0 + a1) * (b0 + b1 + b2) AS t FROM j) SELECT z, y, x, {', '.join(f'round(a{i} * b{k} / t, 9) AS s{i}{k}' for i in range(2) for k in range(3))} FROM s")
def joint_norm(spark, d):
    """Joint histograms of channels of two and three, of sum 1."""
    g = C.volume(spark, d)
    plus = lambda df: F.abs("v") + 1
    a = g.select(*VOL.KEY, F.array(plus(g), F.lit(2.0)).alias("vec"))
    b = C._blur(spark, g).select(*VOL.KEY, F.array(F.abs("v") + 1, F.lit(3.0), F.lit(4.0)).alias("vec"))
    return VOL.joint(a, b).select("z", "y", "x", *[r(F.col("share")[3 * i + k], 9).alias(f"s{i}{k}") for i in range(2) for k in range(3)])


@query(f"""WITH {C._G}, spot AS (SELECT z.i::INT AS nz, y.i::INT AS ny, x.i::INT AS nx, z.i * 0.5::DOUBLE + 0.5 AS fz, y.i + 0.5::DOUBLE AS fy, x.i + 0.5::DOUBLE AS fx FROM range(18) z(i), range(11) y(i), range(50) x(i)),
cl AS (SELECT *, {C._cell_sql('x', 50)}, {C._cell_sql('y', 11)}, {C._cell_sql('z', 9)} FROM spot), b2(a) AS (VALUES (0), (1)),
co AS (SELECT nz, ny, nx, iz + p.a AS z, iy + q.a AS y, ix + s.a AS x, CASE p.a WHEN 0 THEN wz ELSE 1 - wz END * CASE q.a WHEN 0 THEN wy ELSE 1 - wy END * CASE s.a WHEN 0 THEN wx ELSE 1 - wx END AS w FROM cl, b2 p, b2 q, b2 s),
su AS (SELECT nz, ny, nx, sum(w * v) AS v FROM co JOIN g USING (z, y, x) WHERE w > 0 GROUP BY 1, 2, 3)
SELECT spot.nz AS z, spot.ny AS y, spot.nx AS x, round(coalesce(su.v, 0), 4) + 0.0 AS v FROM spot LEFT JOIN su ON su.nz = spot.nz AND su.ny = spot.ny AND su.nx = spot.nx""")
def resample_cubic(spark, d):
    return C._vox(VOL.resample_isotropic(C.volume(spark, d), DIMS, (2.0, 1.0, 1.0))[0])


# ------------------------------------------------------------------------------------------------------- numbers


def _matrix(spark, d, n: int):
    """A matrix of n x n from each descriptor's first components, with 1 added to its diagonal."""
    e = lambda i, j: F.col("embedding")[n * i + j].cast("double") + (1.0 if i == j else 0.0)
    return C.table(spark, d, "embeddings").select("vec_id", F.array(*[F.array(*[e(i, j) for j in range(n)]) for i in range(n)]).alias("m"))


_M3 = "m AS (SELECT vec_id, " + ", ".join(f"embedding[{3 * i + j + 1}]::DOUBLE + {float(i == j)} AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM embeddings), t AS (SELECT *, m00 * (m11 * m22 - m12 * m21) - m01 * (m10 * m22 - m12 * m20) + m02 * (m10 * m21 - m11 * m20) AS det FROM m)"
_INVERSE3 = "round((m11 * m22 - m12 * m21) / det, 5) + 0.0 AS i00, round((m02 * m21 - m01 * m22) / det, 5) + 0.0 AS i01, round((m10 * m21 - m11 * m20) / det, 5) + 0.0 AS i20"


@query(f"WITH {_M3} SELECT vec_id, round(det, 6) + 0.0 AS det, {_INVERSE3} FROM t WHERE abs(det) > 0.01")
def matrix_inverse3(spark, d):
    x = _matrix(spark, d, 3).select("vec_id", V.det3(F.col("m")).alias("det"), V.invert3(F.col("m")).alias("i")).filter("abs(det) > 0.01")
    return x.select("vec_id", r("det").alias("det"), *[r(F.col("i")[a][b], 5).alias(f"i{a}{b}") for a, b in ((0, 0), (0, 1), (2, 0))])


@query("SELECT vec_id, pos::INT AS pos, CASE WHEN pos % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM embeddings, range(16) n(pos)")
def matrix_inverse4(spark, d):
    """Each 4 x 4 matrix times its inverse."""
    x = _matrix(spark, d, 4).select("vec_id", V.mat_mul(F.col("m"), V.invert4(F.col("m")), 4).alias("p"))
    return x.select("vec_id", F.posexplode(F.flatten("p")).alias("pos", "v")).select("vec_id", "pos", r("v").alias("v"))


@query(f"WITH {_M3} SELECT vec_id, {_INVERSE3} FROM t WHERE abs(det) > 0.01")
def pseudo_inverse(spark, d):
    x = _matrix(spark, d, 3).filter(F.abs(V.det3(F.col("m"))) > 0.01).select("vec_id", L.pinv(F.col("m")).alias("i"))
    return x.select("vec_id", *[r(F.col("i")[a][b], 5).alias(f"i{a}{b}") for a, b in ((0, 0), (0, 1), (2, 0))])


@query(f"WITH {_M3} SELECT vec_id, round({' + '.join(f'm{i}{j} * m{i}{j}' for i in range(3) for j in range(3))}, 6) AS squares, round(abs(det), 6) AS volume, round(m21, 6) + 0.0 AS again FROM t")
def singular_values(spark, d):
    """By what the singular values sum and multiply to, and one entry of u diag(s) vt."""
    x = _matrix(spark, d, 3).select("vec_id", L.svd(F.col("m")).alias("d"))
    s = [F.col("d.s")[i] for i in range(3)]
    again = sum((F.col("d.u")[2][k] * s[k] * F.col("d.vt")[k][1] for k in (1, 2)), F.col("d.u")[2][0] * s[0] * F.col("d.vt")[0][1])
    return x.select("vec_id", r(s[0] * s[0] + s[1] * s[1] + s[2] * s[2]).alias("squares"), r(s[0] * s[1] * s[2]).alias("volume"), r(again).alias("again"))


@query("WITH s AS (SELECT o_orderkey, o_totalprice / 1000 AS m, (o_custkey % 31) / 10.0::DOUBLE AS a, (o_orderkey % 63) / 10.0::DOUBLE AS b FROM orders) SELECT o_orderkey, trunc(m * sin(a) * cos(b))::INT AS x, trunc(m * sin(a) * sin(b))::INT AS y, trunc(m * cos(a))::INT AS z FROM s")
def spherical_place(spark, d):
    o = C.table(spark, d, "orders")
    x, y, z = V.spherical(F.col("o_totalprice") / 1000, (F.col("o_custkey") % 31) / 10.0, (F.col("o_orderkey") % 63) / 10.0)
    return o.select("o_orderkey", x.alias("x"), y.alias("y"), z.alias("z"))


@query("""WITH p AS (SELECT n_nationkey, '/data/' || lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN '/a.b.nii' ELSE chr(92) || 'plain' END AS path FROM nation)
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'a.b.nii' ELSE 'plain' END AS base, '/new/' || CASE WHEN n_nationkey % 2 = 0 THEN 'a.b.nii' ELSE 'plain' END AS moved, CASE WHEN n_nationkey % 2 = 0 THEN path[:-5] ELSE path END || '.key' AS key FROM p""")
def path_names(spark, d):
    n = C.table(spark, d, "nation")
    path = F.concat(F.lit("/data/"), F.lower("n_name"), F.when(F.col("n_nationkey") % 2 == 0, "/a.b.nii").otherwise("\\plain"))
    return n.select("n_nationkey", TX.basename(path).alias("base"), TX.rerooted(path, "/new/").alias("moved"), TX.with_extension(path, ".key").alias("key"))


# ------------------------------------------------------------------------------------------------------- points, visits, streams


@query(f"WITH {C._G} SELECT x, y, z, v FROM g ORDER BY v DESC, z, y, x LIMIT 20")
def sorted_points(spark, d):
    return P.by_value(C.located(spark, d)).limit(20).select("x", "y", "z", "v")


@query(f"WITH {C._G} SELECT x, y, z, true AS moved FROM g")
def shuffled_points(spark, d):
    """A permutation: every point once, and an order that differs from the sorted one."""
    p = P.shuffled(C.located(spark, d).select("x", "y", "z"))
    n = F.monotonically_increasing_id()
    both = p.withColumn("n", n).select(F.corr("n", F.col("x") + 50 * (F.col("y") + 11 * F.col("z"))).alias("c"))
    return p.join(both.select((F.abs("c") < 0.9).alias("moved")))


@query(f"WITH {C._G} SELECT z, y, x, round(2 * v + z, 4) AS v FROM g WHERE v > 30000")
def visited(spark, d):
    """A function over batches of voxels, which may leave rows out."""
    some = P.visit(C.volume(spark, d), lambda b: b[b.v > 30000].assign(v=2 * b.v + b.z), "vol string, z int, y int, x int, v double")
    return C._vox(some)


@query(f"WITH {C._G} SELECT count(*) AS n, round(sum(v), 2) AS total, round(min(v), 4) AS low, round(max(v), 4) AS high FROM g")
def streamed_stats(spark, d):
    """Volumes that arrive in a folder, summed up as they come."""
    from voxelweave.stage import fresh_path
    from voxelweave.streaming.volumes import on_new_voxels

    source, out, marks = (fresh_path(spark, n) for n in ("arrivals", "stats", "progress"))
    C.volume(spark, d).write.parquet(source)
    on_new_voxels(spark, source, out, marks, VOL.statistics).awaitTermination()
    return spark.read.parquet(out).select("n", r("total", 2).alias("total"), r("low", 4).alias("low"), r("high", 4).alias("high"))
