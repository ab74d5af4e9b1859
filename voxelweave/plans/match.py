"""Matching: features of many images against the first, by ratios and similarity-transform voting."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.operators import features as FT
from voxelweave.operators import match as M
from voxelweave.stage import written

V = M.V


class Matched(NamedTuple):
    """transforms: (a, b, n, inliers, scale, rot, trans), from b's points to a's; inliers: (a, b, a_feat, b_feat, ratio) and
    places; aligned: the features of b moved to a's space, with a."""

    transforms: DataFrame
    inliers: DataFrame
    aligned: DataFrame


def match_images(feats: DataFrame, most: int = 3000, max_ratio: float | None = None, dedupe: bool = False, ring: bool = False) -> Matched:
    """Every image with the first, or in a ring each with the next: its transform, inliers and aligned features.

    feats: (image_id, feat_id, x, y, z, scale, ori, pc). Each feature of b is matched with its nearest of a; the ratio of
    its distance is to the nearest one of a that is not compatible with that. max_ratio: matches above it are left out;
    dedupe: of matches between the same two places the one with the lowest ratio stays. The `most` lowest ratios vote, and
    transforms counts these; inliers are all matches that the transform brings near, voters or not.
    Pairs of three matches or fewer have no transform, no inliers and no aligned features. Ties go to the lower ids.
    An image is matched once, so an image of no features is in no pair. Empty table: empty results.
    """
    pairs = M.image_pairs(feats.select("image_id").distinct(), "image_id", ring)
    num = lambda c: F.col(c).cast("double").alias(c)
    x = feats.select("image_id", "feat_id", *[num(c) for c in ("x", "y", "z", "scale")], F.transform("ori", lambda r: r.cast("array<double>")).alias("ori"), "pc")
    x = written(x.withColumn("id", F.xxhash64("image_id", "feat_id")), "features")
    side = pairs.withColumn("grp", F.xxhash64("a"))
    b = x.join(side, x["image_id"] == side["b"]).select("id", "grp", "pc")
    a = x.join(side.select("a", "grp").distinct(), x["image_id"] == F.col("a")).select("id", "grp", "pc", "x", "y", "z", "scale", "ori")
    best = M.apart(b, a, None)
    place = lambda k, n: x.select(F.col("id").alias(f"__{k}"), F.col("image_id").alias("b" if n == 0 else "a"), F.col("feat_id").alias(f"f{n}"), F.array("x", "y", "z").alias(f"p{n}"), F.col("scale").alias(f"s{n}"), F.col("ori").alias(f"o{n}"))
    corr = best.join(place("q", 0), F.col("q") == F.col("__q")).join(place("t", 1), F.col("t") == F.col("__t"))
    if max_ratio is not None:
        corr = corr.filter(F.col("ratio") <= max_ratio)
    if dedupe:
        w = M.Window.partitionBy("a", "b", "p0", "p1").orderBy(F.col("ratio").asc_nulls_last(), "q")
        corr = corr.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    corr = corr.withColumn("id", F.row_number().over(M.Window.partitionBy("a", "b").orderBy(F.col("ratio").asc_nulls_last(), "q")).cast("long"))
    corr = corr.select("a", "b", "id", "q", "f0", "f1", "ratio", "s0", "s1", "p0", "p1", "o0", "o1")
    enough = corr.groupBy(F.col("a").alias("__a"), F.col("b").alias("__b")).agg(F.count_if(F.col("id") <= most).alias("matches")).filter("matches > 3")
    corr = written(corr.join(enough, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b"))).drop("__a", "__b"), "matches")
    won = written(M.best_hypothesis(M.hough(corr.filter(F.col("id") <= most), ["a", "b"], count=True), ["a", "b"]), "won")
    inside = M.inliers(corr, won, ["a", "b"])
    out = won.withColumnRenamed("hyp", "id").join(corr, ["a", "b", "id"])
    rot = M.rotation(F.col("o0"), F.col("o1"))
    out = out.withColumn("scale", F.col("s1") / F.col("s0")).withColumn("rot", rot)
    moved = F.transform(V.mat_vec(F.col("rot"), F.col("p0")), lambda c: c * F.col("scale"))
    transforms = written(out.withColumn("trans", V.minus(F.col("p1"), moved)).select("a", "b", F.col("matches").alias("n"), "inliers", "scale", "rot", "trans"), "transforms")
    hits = corr.join(inside.select("a", "b", F.col("corr").alias("id")), ["a", "b", "id"])
    hits = hits.select("a", "b", F.col("f1").alias("a_feat"), F.col("f0").alias("b_feat"), "ratio", F.col("p1").alias("a_place"), F.col("p0").alias("b_place"))
    t = transforms.select("a", F.col("b").alias("__b"), F.struct("scale", "rot", "trans").alias("__t"))
    return Matched(transforms, hits, FT.aligned(feats.join(t, feats["image_id"] == F.col("__b")), F.col("__t")).drop("__b", "__t"))


def match_to_first(feats: DataFrame, most: int = 3000, max_ratio: float | None = None, ring: bool = False) -> DataFrame:
    """The transforms of match_images."""
    return match_images(feats, most, max_ratio, ring=ring).transforms


def match_by_polarity(feats: DataFrame, **options) -> dict[str, Matched]:
    """Three runs: all features, those of minima and those of maxima, each matched among themselves."""
    sets = {"all": feats, "minima": FT.polarity(feats, False), "maxima": FT.polarity(feats, True)}
    return {name: match_images(part, **options) for name, part in sets.items()}
