"""Dense arrays as voxel rows (vol, z, y, x, v): stencils, pyramids, reshaping and normalising.

Stencils are offset equi-joins or exploded kernels summed by shifted key, so every shuffle is a plain hash of a
voxel's key with map-side sums; nothing needs the whole volume in one task.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelweave.functions import vectors as V

KEY = ["vol", "z", "y", "x"]
OFFSETS = [(dz, dy, dx) for dz, dy, dx in product((-1, 0, 1), repeat=3)]


def neighbourhood(count: int) -> list[tuple[int, int, int]]:
    """Offsets (z, y, x): 6, 18 or 26 around a voxel, 4 or 8 in its slice; 2, 3 or 13 of them on the positive side."""
    around = [o for o in OFFSETS if o != (0, 0, 0)]
    near = lambda k: [o for o in around if sum(map(abs, o)) <= k]
    flat = [o for o in around if o[0] == 0]
    half = lambda s: [o for o in s if o > (0, 0, 0)]
    return {26: around, 18: near(2), 6: near(1), 8: flat, 4: [o for o in flat if sum(map(abs, o)) == 1], 13: half(around), 3: half(near(1)), 2: half([o for o in flat if sum(map(abs, o)) == 1])}[count]


def inside(dims: tuple[int, int, int]) -> Column:
    nz, ny, nx = dims
    return F.col("z").between(0, nz - 1) & F.col("y").between(0, ny - 1) & F.col("x").between(0, nx - 1)


def convolve(vol: DataFrame, axis: str, kernel: list[tuple[int, float]], dims: tuple[int, int, int], border: str = "zero") -> DataFrame:
    """Correlation with a 1-D kernel along an axis. border: zero, or mirror (about the edge samples)."""
    size = dict(zip("zyx", dims, strict=True))[axis]
    taps = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in kernel])).alias("k")
    out = vol.select(*KEY, "v", taps)
    at = F.col(axis) - F.col("k.o")
    if border == "mirror":
        # a tap that falls outside reads the mirrored sample: each sample also serves the places mirrored to it
        images = F.array(at, -F.col(axis) - F.col("k.o"), 2 * (size - 1) - F.col(axis) - F.col("k.o"))
        edge = F.array(F.lit(True), F.col(axis) > 0, F.col(axis) < size - 1)
        spread = out.select(*KEY, "v", "k", F.explode(F.arrays_zip(images.alias("at"), edge.alias("ok"))).alias("m")).filter("m.ok")
        out = spread.withColumn(axis, F.col("m.at"))
    else:
        out = out.withColumn(axis, at)
    return out.filter(inside(dims)).groupBy(*KEY).agg(F.sum(F.col("v") * F.col("k.w")).alias("v"))


def blur(vol: DataFrame, sigma: float | None, dims: tuple[int, int, int], kernel: list[tuple[int, float]] | None = None, axes: str = "xyz", border: str = "zero") -> DataFrame:
    """Separable blur, one pass an axis; voxels outside are 0. 2-D with axes="xy"."""
    k = kernel or V.gaussian(sigma)
    for a in axes:
        vol = convolve(vol, a, k, dims, border)
    return vol


def combine(a: DataFrame, b: DataFrame, how) -> DataFrame:
    """Element by element: how(a's value, b's value) on equal keys."""
    return a.join(b.select(*KEY, F.col("v").alias("__b")), KEY).select(*KEY, how(F.col("v"), F.col("__b")).alias("v"))


def mult_sum(a: DataFrame, b: DataFrame, k: float) -> DataFrame:
    """a + k b; the difference of two blurs with k = -1."""
    return combine(a, b, lambda x, y: x + k * y)


def neighbours(vol: DataFrame, other: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """(key, v, n): each voxel of vol with each neighbour of it in other."""
    o = F.explode(F.array(*[F.struct(*[F.lit(i).alias(c) for i, c in zip(d, "zyx", strict=True)]) for d in offsets])).alias("o")
    shifted = other.select("vol", F.col("v").alias("n"), "z", "y", "x", o).select("vol", *[(F.col(c) - F.col(f"o.{c}")).alias(c) for c in "zyx"], "n")
    return vol.join(shifted, KEY)


def extrema(vol: DataFrame, lower: DataFrame | None = None, flat: bool = False) -> DataFrame:
    """(key, v, polarity): strict extrema among 26 neighbours (8 in the slice if flat), all present; polarity 1: maximum.

    lower: also strict against all 27 voxels of an adjacent level. The six nearest are tested first, so that the
    wide join is of the few voxels left.
    """

    def strict(d: DataFrame, other: DataFrame, offsets: list) -> DataFrame:
        s = neighbours(d, other, offsets).groupBy(*KEY, "v").agg(F.sum(F.signum(F.col("v") - F.col("n"))).alias("s"))
        return s.filter(F.abs("s") == len(offsets))

    few = vol
    if not flat:
        few = strict(vol, vol, neighbourhood(6)).drop("s")
    out = strict(few, vol, neighbourhood(8 if flat else 26)).withColumn("polarity", (F.col("s") > 0).cast("int")).drop("s")
    return validate(out, lower) if lower is not None else out


def validate(points: DataFrame, level: DataFrame) -> DataFrame:
    """Extrema that are strict against all 27 voxels of another level as well."""
    s = neighbours(points, level, OFFSETS).groupBy(*KEY, "v", "polarity").agg(F.sum(F.signum(F.col("v") - F.col("n"))).alias("s"))
    return s.filter(F.col("s") == F.when(F.col("polarity") == 1, 27).otherwise(-27)).drop("s")


def refine(points: DataFrame, vol: DataFrame) -> DataFrame:
    """(key, v, polarity, fx, fy, fz): places between voxels by a parabola along each axis, samples at .5."""
    out = points
    for a in "xyz":
        for d, name in ((-1, f"{a}0"), (1, f"{a}2")):
            side = vol.select("vol", *[(F.col(c) - (d if c == a else 0)).alias(c) for c in "zyx"], F.col("v").alias(name))
            out = out.join(side, KEY)
        at = F.col(a).cast("double")
        out = out.withColumn(f"f{a}", V.parabola(at - 1, at, at + 1, F.col(f"{a}0"), F.col("v"), F.col(f"{a}2")) + 0.5).drop(f"{a}0", f"{a}2")
    return out


def pool(vol: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Means of 2x2x2 blocks; odd last planes are left out. A volume of one plane: of 2x2."""
    half = tuple(max(d // 2, 1) for d in dims)
    by = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in "zyx"]
    return vol.groupBy("vol", *by).agg(F.avg("v").alias("v")).filter(inside(half))


def decimate(vol: DataFrame, axes: str = "zyx") -> DataFrame:
    """Every second voxel along the axes."""
    for c in axes:
        vol = vol.filter(F.col(c) % 2 == 0).withColumn(c, F.floor(F.col(c) / 2).cast("int"))
    return vol


def double(vol: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Twice the size: even voxels as they were, odd ones the mean of their neighbours, the last one repeated."""
    for c, n in zip("zyx", dims, strict=True):
        place = F.array(
            F.struct((2 * F.col(c)).alias("at"), F.lit(1.0).alias("w")),
            F.struct((2 * F.col(c) + 1).alias("at"), F.when(F.col(c) == n - 1, 1.0).otherwise(0.5).alias("w")),
            F.struct((2 * F.col(c) - 1).alias("at"), F.lit(0.5).alias("w")),
        )
        vol = vol.withColumn("p", F.explode(place)).withColumn(c, F.col("p.at").cast("int")).filter(F.col(c) >= 0)
        vol = vol.groupBy(*KEY).agg(F.sum(F.col("v") * F.col("p.w")).alias("v"))
    return vol


def crop(vol: DataFrame, low: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    cut = vol
    for c, a, n in zip("zyx", low, size, strict=True):
        cut = cut.filter(F.col(c).between(a, a + n - 1)).withColumn(c, F.col(c) - a)
    return cut


def plane(vol: DataFrame, axis: str, at: int) -> DataFrame:
    """The two axes left and v, where an axis has one value."""
    return vol.filter(F.col(axis) == at).drop(axis)


def flip(vol: DataFrame, axis: str, size: int) -> DataFrame:
    return vol.withColumn(axis, size - 1 - F.col(axis))


def translate(vol: DataFrame, by: tuple[int, int, int], dims: tuple[int, int, int]) -> DataFrame:
    """Moved by whole voxels; places that nothing comes to are 0. As the original, index 0 of each axis isn't moved."""
    src = vol.filter("x > 0 and y > 0 and z > 0").select("vol", *[(F.col(c) + d).alias(c) for c, d in zip("zyx", by, strict=True)], F.col("v").alias("__s"))
    return vol.join(src.filter(inside(dims)), KEY, "left").select(*KEY, F.coalesce("__s", F.lit(0.0)).alias("v"))


def fade(vol: DataFrame, centre: tuple[float, float, float], sigma: float) -> DataFrame:
    """Towards the least value, by a Gaussian window around centre (x, y, z)."""
    low = vol.groupBy("vol").agg(F.min("v").alias("__m"))
    d2 = sum((F.col(c) - m) * (F.col(c) - m) for c, m in zip("xyz", centre, strict=True))
    return vol.join(low, "vol").select(*KEY, ((F.col("v") - F.col("__m")) * F.exp(-d2 / (2 * sigma * sigma)) + F.col("__m")).alias("v"))


def gradient(vol: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(key, dx, dy, dz): differences of the voxels on either side, 0 at the border."""
    out = vol
    for c, n in zip("xyz", dims[::-1], strict=True):
        for d, name in ((-1, "__a"), (1, "__b")):
            side = vol.select("vol", *[(F.col(k) - (d if k == c else 0)).alias(k) for k in "zyx"], F.col("v").alias(name))
            out = out.join(side, KEY, "left")
        edge = (F.col(c) == 0) | (F.col(c) == n - 1)
        out = out.withColumn(f"d{c}", F.when(edge, 0.0).otherwise(F.coalesce(F.col("__b") - F.col("__a"), F.lit(0.0)))).drop("__a", "__b")
    return out.drop("v")


def statistics(vol: DataFrame) -> DataFrame:
    """One row a volume: n, sum, mean, variance, least and largest value, and where these first are in scan order."""
    at = F.struct("z", "y", "x")
    return vol.groupBy("vol").agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.min_by(at, F.struct("v", "z", "y", "x")).alias("low_at"), F.min_by(at, F.struct(-F.col("v"), "z", "y", "x")).alias("high_at"),
    )


def normalise(vol: DataFrame, how: str, stretch: float = 1.0) -> DataFrame:
    """minmax: to 0..stretch, constant volumes to 0; l2: to length 1; zero_mean_l2: less the mean, then to length 1.

    A zero norm gives null. One pre-aggregated row a volume is joined back: no volume is windowed in one task.
    """
    s = vol.groupBy("vol").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
    j = vol.join(s, "vol")
    v = F.col("v")
    if how == "minmax":
        out = F.coalesce(F.try_divide((v - F.col("lo")) * stretch, F.col("hi") - F.col("lo")), F.lit(0.0))
    elif how == "l2":
        out = F.try_divide(v, F.sqrt("q"))
    else:
        c = vol.join(s.select("vol", "m"), "vol").groupBy("vol").agg(F.sum((v - F.col("m")) * (v - F.col("m"))).alias("cq"))
        j = j.join(c, "vol")
        out = F.try_divide(v - F.col("m"), F.sqrt("cq"))
    return j.select(*KEY, out.alias("v"))


def _corners(points: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Eight rows a point (fx, fy, fz): the voxels around it and their weights w, edges held."""
    for c, n in zip("xyz", dims[::-1], strict=True):
        cell, w = V.cell_weight(F.col(f"f{c}"), n)
        points = points.withColumn(f"__{c}", F.explode(F.array(F.struct(cell.alias("i"), w.alias("w")), F.struct((cell + 1).alias("i"), (1 - w).alias("w")))))
    w = F.col("__x.w") * F.col("__y.w") * F.col("__z.w")
    return points.select(*[c for c in points.columns if c[:2] != "__"], *[F.col(f"__{c}.i").alias(c) for c in "zyx"], w.alias("w")).filter("w > 0")


def sample(points: DataFrame, vol: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """points (vol, id, fx, fy, fz) with the trilinear value there."""
    got = _corners(points, dims).join(vol, KEY).groupBy("vol", "id").agg(F.sum(F.col("w") * F.col("v")).alias("value"))
    return points.join(got, ["vol", "id"], "left")


def along(lines: DataFrame, vol: DataFrame, dims: tuple[int, int, int], count: int) -> DataFrame:
    """(vol, id, i, value): `count` samples on each line (vol, id, x1, y1, z1, x2, y2, z2), from its start, the end left
    out. Whole coordinates are voxel centres. Lines of no length give no rows."""
    part = F.col("i") / F.lit(float(count))
    on = lines.filter("x1 != x2 or y1 != y2 or z1 != z2").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    on = on.select("vol", F.struct(F.col("id").alias("line"), "i").alias("id"), *[(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * part + 0.5).alias(f"f{c}") for c in "xyz"])
    return sample(on, vol, dims).select("vol", F.col("id.line").alias("id"), F.col("id.i").alias("i"), "value")


def scatter(points: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(key, v): the points' `value`s spread on the eight voxels around each, summed."""
    return _corners(points, dims).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("value")).alias("v"))


def resample_isotropic(vol: DataFrame, dims: tuple[int, int, int], spacing: tuple[float, float, float]) -> tuple[DataFrame, tuple[int, int, int]]:
    """To cubic voxels of the least spacing (z, y, x), by trilinear values at i * least / spacing + 0.5."""
    least = min(spacing)
    new = tuple(int(n * d / least) for n, d in zip(dims, spacing, strict=True))
    grid = vol.select("vol").distinct()
    for c, n, d in zip("zyx", new, spacing, strict=True):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(f"f{c}", F.col(c) * (least / d) + 0.5)
    grid = grid.withColumn("id", F.struct("z", "y", "x"))
    got = sample(grid.select("vol", "id", "fx", "fy", "fz"), vol, dims)
    return got.select("vol", F.col("id.z").alias("z"), F.col("id.y").alias("y"), F.col("id.x").alias("x"), F.coalesce("value", F.lit(0.0)).alias("v")), new


def joint(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, vec): the outer product of two channel vectors, scaled to a sum of 1 in `share`."""
    j = a.join(b.select(*KEY, F.col("vec").alias("__b")), KEY)
    out = j.select(*KEY, V.outer(F.col("vec"), F.col("__b")).alias("vec"))
    return out.withColumn("share", F.transform("vec", lambda x: F.try_divide(x, V.total(F.col("vec")))))


def haar(shape: tuple[int, int, int], levels: tuple[int, int, int], spark) -> DataFrame:
    """(lz, ly, lx, z, y, x, v): a bank of +1/-1 filters; a level halves the runs of its axis, level 0 is constant."""
    df = spark.range(1).select(F.lit(0).alias("__"))
    for c, n, k in zip("zyx", shape, levels, strict=True):
        df = df.withColumn(f"l{c}", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        run = F.greatest(F.lit(1), F.floor(F.lit(n) / F.pow(F.lit(2.0), F.col(f"l{c}"))).cast("int"))
        df = df.withColumn(f"s{c}", F.when(F.col(f"l{c}") == 0, 1).otherwise(1 - 2 * (F.floor(F.col(c) / run) % 2)))
    return df.select("lz", "ly", "lx", "z", "y", "x", (F.col("sz") * F.col("sy") * F.col("sx")).cast("int").alias("v"))
