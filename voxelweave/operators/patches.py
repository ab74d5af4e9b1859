"""Patches of 11 voxels a side as voxel rows: sampling, structure tensor, gradient-orientation histograms.

The relational forms of what voxelweave.plans.extract does in arrays; many patches are many groups, summed where the
rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import vectors as V
from voxelweave.operators import volumes as VOL
from voxelweave.schemas import PATCH

DIMS = (PATCH, PATCH, PATCH)
RADIUS = PATCH // 2


def dense(vol: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Every voxel of every volume's box, 0 where there was none."""
    grid = vol.select("vol").distinct()
    for c, n in zip("zyx", dims, strict=True):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(vol.select(*VOL.KEY, "v"), VOL.KEY, "left").select(*VOL.KEY, F.coalesce("v", F.lit(0.0)).alias("v"))


def sampled(points: DataFrame, vol: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(vol, z, y, x, v) with `id` as vol: an 11^3 patch about each point (vol, id, fx, fy, fz, scale, ori), its samples
    2 scale / 5 apart and turned by the frame; points whose box, int(2 scale + 2) about them, leaves the volume go."""
    r = F.floor(2 * F.col("scale") + 2)
    for c, n in zip("zyx", dims, strict=True):
        points = points.filter((F.floor(F.col(f"f{c}")) - r >= 0) & (F.floor(F.col(f"f{c}")) + r < n))
    grid = points
    for c in "zyx":
        grid = grid.withColumn(f"p{c}", F.explode(F.sequence(F.lit(0), F.lit(PATCH - 1))))
    step = F.col("scale") * (2.0 / 5.0)
    at = {c: sum(((F.col(f"p{k}") - RADIUS) * F.col("ori")[i][j] for i, k in ((1, "y"), (2, "z"))), (F.col("px") - RADIUS) * F.col("ori")[0][j]) * step + F.col(f"f{c}") for j, c in enumerate("xyz")}
    grid = grid.select("vol", F.struct("id", "pz", "py", "px").alias("id"), *[at[c].alias(f"f{c}") for c in "xyz"])
    got = VOL.sample(grid, vol, dims)
    return got.select(F.col("id.id").alias("vol"), *[F.col(f"id.p{c}").alias(c) for c in "zyx"], F.coalesce("value", F.lit(0.0)).alias("v"))


def tensor_eigenvalues(patches: DataFrame) -> DataFrame:
    """(vol, e): eigenvalues, largest first, of the second moments of each patch's differences within radius 5."""
    d2 = sum(((F.col(c) - RADIUS) * (F.col(c) - RADIUS) for c in "yz"), (F.col("x") - RADIUS) * (F.col("x") - RADIUS))
    g = VOL.gradient(patches, DIMS).filter(d2 < RADIUS * RADIUS)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = g.groupBy("vol").agg(*[F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(a + b) for a, b in pairs])
    return sums.select("vol", V.eigenvalues3(*[F.col(a + b) for a, b in pairs]).alias("e"))


def orientation_histogram(patches: DataFrame) -> DataFrame:
    """(vol, pc): each patch's differences by the nearest of eight corner directions (+++, ++-, ... in x, y, z; the first
    one at a tie) and half of the patch, the middle plane dealt to both halves; lifted to 0 and of length 1. 64 numbers:
    halves in z, y, x, then the direction."""
    g = VOL.gradient(patches, DIMS)
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    k = sum((F.when(F.col(f"d{c}") < 0, w).otherwise(0) for c, w in (("y", 2), ("z", 1))), F.when(F.col("dx") < 0, 4).otherwise(0))
    low = lambda c: F.when(F.col(c) < RADIUS, 1.0).when(F.col(c) == RADIUS, 0.5).otherwise(0.0)
    part = lambda c, h: low(c) if h == 0 else 1 - low(c)
    cells = F.explode(F.array(*[F.struct(F.lit((c * 2 + b) * 2 + a).alias("cell"), (part("z", c) * part("y", b) * part("x", a)).alias("w")) for c in (0, 1) for b in (0, 1) for a in (0, 1)])).alias("s")
    rows = g.select("vol", k.alias("k"), size.alias("m"), cells).filter("m > 0 and s.w > 0")
    sums = rows.groupBy("vol", (F.col("s.cell") * 8 + F.col("k")).alias("at")).agg(F.sum(F.col("m") * F.col("s.w")).alias("v"))
    # patches without any difference have 64 zeros
    every = patches.select("vol").distinct().select("vol", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    full = every.join(sums, ["vol", "at"], "left").groupBy("vol").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("v", F.lit(0.0)).alias("v")))).alias("s"))
    return full.select("vol", V.positive_unit(F.transform("s", lambda x: x["v"])).alias("pc"))
