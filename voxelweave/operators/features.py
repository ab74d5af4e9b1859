"""Key-point rows: flags, filters, descriptors and transforms of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.functions import vectors as V
from voxelweave.schemas import MAXIMUM, REORIENTED

IDENTITY = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def has(bit: int) -> Column:
    return F.col("info").bitwiseAND(bit) != 0


def reoriented(feats: DataFrame, yes: bool = True) -> DataFrame:
    """Features with the bit, or those without it, whose frames are then the identity."""
    if yes:
        return feats.filter(has(REORIENTED))
    return feats.filter(~has(REORIENTED)).withColumn("ori", F.array(*[F.array(*map(F.lit, r)) for r in IDENTITY]))


def polarity(feats: DataFrame, maxima: bool) -> DataFrame:
    return feats.filter(has(MAXIMUM) if maxima else ~has(MAXIMUM))


def eigen_ratio(feats: DataFrame, limit: float = 140.0) -> DataFrame:
    """Keeps (e1 + e2 + e3)^3 < limit e1 e2 e3, all if the limit is below 0."""
    if limit < 0:
        return feats
    e = [F.col("eigs")[i].cast("double") for i in range(3)]
    s = e[0] + e[1] + e[2]
    return feats.filter(s * s * s < limit * e[0] * e[1] * e[2])


def box_inside(feats: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Keeps features whose patch's box, int(2 scale + 2) about the point, is in the volume (dims z, y, x)."""
    r = F.floor(2 * F.col("scale") + 2)
    ok = F.lit(True)
    for c, n in zip("zyx", dims, strict=True):
        ok = ok & (F.floor(F.col(c)) - r >= 0) & (F.floor(F.col(c)) + r < n)
    return feats.filter(ok)


def bounding_box(feats: DataFrame, group: str) -> DataFrame:
    """Least and largest x, y, z of a group, and the middle between them."""
    out = feats.groupBy(group).agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return out.select("*", *[((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).alias(f"mid_{c}") for c in "xyz"])


def ranked(feats: DataFrame) -> DataFrame:
    """pc as ranks from 0, ties by place."""
    return feats.withColumn("pc", V.ranks(F.col("pc")))


def rank_rows(feats: DataFrame) -> DataFrame:
    """(feat_id, pos, rank) of every component."""
    x = feats.select("feat_id", F.posexplode("pc").alias("pos", "v"))
    w = Window.partitionBy("feat_id").orderBy("v", "pos")
    return x.select("feat_id", "pos", (F.row_number().over(w) - 1).alias("rank"))


def pair_differences(feats: DataFrame, pairs: list[tuple[int, int]], how: str = "raw", spread: list[int] | None = None) -> DataFrame:
    """pc as differences of given components: raw, their sign (1 if below 0), or over a whole distance each."""
    out = []
    for i, (a, b) in enumerate(pairs):
        d = F.col("pc")[a].cast("double") - F.col("pc")[b].cast("double")
        out.append((d < 0).cast("double") if how == "sign" else d / spread[i] if how == "scaled" else d)
    return feats.withColumn("pc", F.array(*out))


def with_place(feats: DataFrame, weight: float) -> DataFrame:
    """pc with three numbers more: the place in units of the scale, times a weight. So the nearest neighbours of descriptors
    are those that also lie alike; 0 leaves the distances as they are. Null where place or scale is, or the scale is 0."""
    return feats.withColumn("pc", F.concat(F.transform("pc", lambda v: v.cast("double")), F.array(*[F.try_divide(F.lit(float(weight)) * F.col(c).cast("double"), F.col("scale").cast("double")) for c in "xyz"])))


def size_factor(feats: DataFrame, factor: float) -> DataFrame:
    """Places and scales times a factor: 0.5 after a doubled volume, 2 after a halved one."""
    return feats.withColumns({c: F.col(c) * factor for c in ("x", "y", "z", "scale")})


def world(feats: DataFrame, m: list[list[float]]) -> DataFrame:
    """Places and frames by a 4x4 matrix; scales by the mean length of its rows."""
    p = {c: sum((F.col(k) * m[i][j] for j, k in enumerate("xyz")), F.lit(float(m[i][3]))) for i, c in enumerate("xyz")}
    mean = sum(sum(v * v for v in r[:3]) ** 0.5 for r in m[:3]) / 3
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r[:3]]) for r in m[:3]])
    frame = F.transform("ori", lambda a: V.unit(V.mat_vec(rows, a)))
    return feats.withColumns({**p, "scale": F.col("scale") * mean, "ori": frame})


def aligned(feats: DataFrame, t: Column) -> DataFrame:
    """Features moved by the similarity t (scale, rot, trans): places, scales and frames; descriptors stay."""
    p = F.array(*[F.col(c).cast("double") for c in "xyz"])
    at = F.transform(V.mat_vec(t["rot"], p), lambda v: v * t["scale"])
    out = feats.withColumn("__at", V.plus(at, t["trans"]))
    frame = F.transform("ori", lambda axis: V.mat_vec(t["rot"], axis))
    return out.withColumns({**{c: F.col("__at")[i] for i, c in enumerate("xyz")}, "scale": F.col("scale") * t["scale"], "ori": frame}).drop("__at")
