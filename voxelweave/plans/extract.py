"""Extraction: volumes to key-points with frames and 64-number descriptors.

Volumes are independent, so a small one is one task's turn (applyInArrow by volume), and many run at once; a large one is
cut in bricks. The work is array arithmetic. The relational forms of the same steps are in voxelweave.operators.volumes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from voxelweave.functions.vectors import gaussian
from voxelweave.operators import bricks as BR
from voxelweave.operators.features import world
from voxelweave.operators.volumes import resample_isotropic
from voxelweave.schemas import MAXIMUM, PATCH, REORIENTED
from voxelweave.stage import discard, written

#: The first blur, levels an octave, peaks' shares of the largest, the most frames of a point.
SIGMA, LEVELS, PRIMARY, SECONDARY, MOST_FRAMES = 1.6, 6, 0.8, 0.5, 11


@dataclass(frozen=True)
class Options:
    """eigen: the limit of the eigen-ratio filter, below 0 none; size: 1, 2 (the volume is doubled first) or 0.5 (halved):
    places and scales come in the given volume's voxels; edge: how a patch reads beyond the volume, "clamp" (y and z
    held, x zero) or "zero"; descriptor: "histogram", or "raw", "sign" or "scaled" differences at `pairs`, places (x0, y0,
    z0, x1, y1, z1) of 0 to 10 in the patch; affine: 4x4 rows that take voxels to the world, applied to the features."""

    eigen: float = 140.0
    size: float = 1.0
    edge: str = "clamp"
    reoriented: bool = True
    descriptor: str = "histogram"
    pairs: tuple[tuple[int, ...], ...] = ()
    affine: tuple[tuple[float, ...], ...] | None = None

    def __post_init__(self) -> None:
        if self.size not in (0.5, 1.0, 2.0) or self.descriptor not in ("histogram", "raw", "sign", "scaled"):
            raise ValueError("size: 0.5, 1 or 2; descriptor: histogram, raw, sign or scaled")
        if (self.descriptor != "histogram") != bool(self.pairs) or any(len(p) != 6 or not all(0 <= v < PATCH for v in p) or p[:3] == p[3:] for p in self.pairs):
            raise ValueError("pairs: two places of the patch each, for a descriptor of differences")


def blurred(v: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, 0 outside."""
    for axis in range(3):
        v = BR.along(v, gaussian(sigma), axis)
    return v


def pooled(v: np.ndarray) -> np.ndarray:
    d, h, w = (n // 2 * 2 for n in v.shape)
    return v[:d, :h, :w].reshape(d // 2, 2, h // 2, 2, w // 2, 2).mean(axis=(1, 3, 5))


def doubled(v: np.ndarray, axis: int) -> np.ndarray:
    """Twice as long along an axis: samples as they were, the means of neighbours between them, the last one repeated."""
    between = (v + np.concatenate([np.take(v, range(1, v.shape[axis]), axis), np.take(v, [-1], axis)], axis)) / 2
    return np.stack([v, between], axis=axis + 1).reshape(*v.shape[:axis], -1, *v.shape[axis + 1 :])


def candidates(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(z, y, x, maximum) of interior voxels strictly beyond 26 neighbours and the 27 of either adjacent level."""
    return [(z + 1, y + 1, x + 1, sign > 0) for sign in (-1, 1) for z, y, x in np.argwhere(BR.beyond(mid, [low, high], sign)).tolist()]


def vertex(x: tuple, f: tuple) -> float:
    """The vertex of a parabola through three points, the middle if that is no extremum."""
    (x0, x1, x2), (f0, f1, f2) = x, f
    if not ((f1 > f0 and f1 > f2) or (f1 < f0 and f1 < f2)):
        return x1
    a = (f1 - f0) / (x1 - x0)
    b = ((f2 - f1) / (x2 - x1) - a) / (x2 - x0)
    return (b * (x0 + x1) - a) / (2 * b)


@dataclass(frozen=True)
class Window:
    """An array's part of its volume: the voxel at its first place, and the volume's size (z, y, x). Places are the volume's."""

    low: tuple[int, int, int]
    size: tuple[int, int, int]


def trilinear(v: np.ndarray, p: np.ndarray, edge: str, part: Window | None = None) -> np.ndarray:
    """Values at points [n, 3] (x, y, z), samples at .5."""
    part = part or Window((0, 0, 0), v.shape)
    at, size = p[:, ::-1] - 0.5, np.array(part.size)
    inside = ((at[:, 2] >= -0.5) & (at[:, 2] < size[2] - 0.5)) if edge == "clamp" else ((at >= -0.5) & (at < size - 0.5)).all(axis=1)
    at = np.clip(at, 0, size - 1)
    lo = np.minimum(np.floor(at).astype(int), np.maximum(size - 2, 0))
    w = at - lo
    out = np.zeros(len(p))
    for c in range(8):
        d = np.array([c >> 2 & 1, c >> 1 & 1, c & 1])
        i = np.minimum(lo + d, size - 1) - np.array(part.low)
        out += v[i[:, 0], i[:, 1], i[:, 2]] * np.where(d, w, 1 - w).prod(axis=1)
    return out * inside


_GRID = np.stack(np.meshgrid(*[np.arange(PATCH) - PATCH // 2] * 3, indexing="ij"), axis=-1)[..., ::-1].reshape(-1, 3).astype(float)


def patch(v: np.ndarray, at: np.ndarray, scale: float, ori: np.ndarray, edge: str, part: Window | None = None) -> np.ndarray | None:
    """11^3 samples (z, y, x) about a point, 2 scale / 5 apart, turned by the frame; None if its box leaves the volume."""
    r, part = int(2 * scale + 2), part or Window((0, 0, 0), v.shape)
    c = np.floor(at).astype(int)
    if (c - r < 0).any() or (c + r >= np.array(part.size)[::-1]).any():
        return None
    return trilinear(v, _GRID @ ori * (2 * scale / 5) + at, edge, part).reshape(PATCH, PATCH, PATCH)


def unit_patch(p: np.ndarray) -> np.ndarray:
    p = p - p.mean()
    n = np.linalg.norm(p)
    return p / n if n else p


def edges(p: np.ndarray) -> np.ndarray:
    """Differences along x, y, z [z, y, x, 3], 0 at the border."""
    g = np.zeros((*p.shape, 3))
    g[:, :, 1:-1, 0] = p[:, :, 2:] - p[:, :, :-2]
    g[:, 1:-1, :, 1] = p[:, 2:] - p[:, :-2]
    g[1:-1, :, :, 2] = p[2:] - p[:-2]
    return g


def tensor(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and their axes as rows, of the gradients' second moments within radius 5."""
    near = ((_GRID**2).sum(axis=1) < 25).reshape(p.shape)
    g = edges(p)[near]
    w, a = np.linalg.eigh(g.T @ g)
    return w[::-1], a[:, ::-1].T


def _scatter(directions: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A blurred [z, y, x] histogram of directions on the radius-5 cube."""
    at = directions * 5 + PATCH // 2
    lo = np.floor(at).astype(int)
    out = np.zeros((PATCH + 1,) * 3)
    for c in range(8):
        d = np.array([c & 1, c >> 1 & 1, c >> 2 & 1])
        w = np.where(d, at - lo, 1 - (at - lo)).prod(axis=1) * weights
        i = lo + d
        np.add.at(out, (i[:, 2], i[:, 1], i[:, 0]), w)
    return blurred(out[:PATCH, :PATCH, :PATCH], 0.5)


def _peaks(h: np.ndarray, share: float) -> list[np.ndarray]:
    """Unit directions of a histogram's strict peaks of at least a share of the largest, the largest first."""
    found = sorted(((float(h[z + 1, y + 1, x + 1]), (x + 1, y + 1, z + 1)) for z, y, x in np.argwhere(BR.beyond(h, [], 1)).tolist()), key=lambda t: (-t[0], t[1]))
    out = []
    for v, c in found:
        if v >= share * found[0][0] and v > 0:
            q = np.array([_vertex_at(h, c, k) for k in range(3)]) - PATCH // 2
            n = np.linalg.norm(q)
            if n:
                out.append(q / n)
    return out


def _vertex_at(h: np.ndarray, c: tuple, k: int) -> float:
    lo, hi = list(c), list(c)
    lo[k] -= 1
    hi[k] += 1
    return vertex((c[k] - 1, c[k], c[k] + 1), tuple(float(h[p[2], p[1], p[0]]) for p in (lo, c, hi)))


def frames(p: np.ndarray) -> list[np.ndarray]:
    """Right-handed frames (axes as rows): main gradient directions, each with the main ones at right angles to it."""
    near = ((_GRID**2).sum(axis=1) < 25).reshape(p.shape)
    g = edges(p)[near]
    size = np.linalg.norm(g, axis=1)
    g, size = g[size > 0], size[size > 0]
    if not len(g):
        return []
    out: list[np.ndarray] = []
    for first in _peaks(_scatter(g / size[:, None], size), PRIMARY):
        flat = g - np.outer(g @ first, first)
        n = np.linalg.norm(flat, axis=1)
        ok = n > 1e-12
        for second in _peaks(_scatter(flat[ok] / n[ok, None], n[ok]), SECONDARY):
            second = second - (second @ first) * first
            if (m := np.linalg.norm(second)) < 1e-9:
                continue
            second = second / m
            out.append(np.stack([first, second, np.cross(first, second)]))
            if len(out) >= MOST_FRAMES:
                return out
    return out


#: The share of each of 11 planes that the lower half of a patch has; the middle one is dealt to both halves.
LOWER = np.where(np.arange(PATCH) < PATCH // 2, 1.0, np.where(np.arange(PATCH) == PATCH // 2, 0.5, 0.0))


def descriptor(p: np.ndarray) -> np.ndarray:
    """64 numbers: gradients of 2x2x2 halves by the nearest of 8 corner directions, lifted to 0 and of length 1."""
    g = edges(p).reshape(-1, 3)
    size = np.linalg.norm(g, axis=1)
    k = (g[:, 0] < 0) * 4 + (g[:, 1] < 0) * 2 + (g[:, 2] < 0)
    low = LOWER[(_GRID + PATCH // 2).astype(int)]
    out = np.zeros(64)
    for c in range(8):
        d = np.array([c & 1, c >> 1 & 1, c >> 2 & 1])
        w = np.where(d, 1 - low, low).prod(axis=1) * size
        np.add.at(out, ((d[2] * 2 + d[1]) * 2 + d[0]) * 8 + k, w)
    out -= out.min()
    n = np.linalg.norm(out)
    return out / n if n else out


def ranks(v: np.ndarray) -> np.ndarray:
    out = np.empty(len(v))
    out[np.argsort(v, kind="stable")] = np.arange(len(v))
    return out


def random_pairs(count: int = 64, seed: int = 0, sigma: float | None = None) -> tuple[tuple[int, ...], ...]:
    """Places for a descriptor of differences, by a rule: both uniform in the patch, or Gaussian about its middle."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < count:
        p = rng.integers(0, PATCH, 6) if sigma is None else np.clip(np.rint(rng.normal(PATCH // 2, sigma, 6)), 0, PATCH - 1).astype(int)
        if (p[:3] != p[3:]).any():
            out.append(tuple(p.tolist()))
    return tuple(out)


def pair_descriptor(p: np.ndarray, pairs: np.ndarray, how: str = "raw") -> np.ndarray:
    """Differences of a blurred patch at pairs of places [n, 2, 3] (x, y, z): raw, by sign, or over the whole distance."""
    b = blurred(p, 0.95)
    v = b[pairs[..., 2], pairs[..., 1], pairs[..., 0]]
    d = v[:, 0] - v[:, 1]
    far = np.floor(np.sqrt(((pairs[:, 0] - pairs[:, 1]) ** 2).sum(axis=1)))
    return (d < 0).astype(float) if how == "sign" else d / far if how == "scaled" else d


#: The factor of scale from level to level.
K = 2 ** (1 / 3)


def sigmas() -> list[float]:
    return [SIGMA * K**j for j in range(LEVELS)]


def first_sigma(opt: Options) -> float:
    return np.sqrt(max(SIGMA**2 - (0.5 * max(opt.size, 1.0)) ** 2, 1e-6))


def next_sigma(j: int) -> float:
    """What level j - 1 is blurred with to become level j."""
    return sigmas()[j - 1] * np.sqrt(K * K - 1)


def keypoints(v: np.ndarray, opt: Options = Options()) -> list[tuple]:
    """(x, y, z, scale, frame, eigenvalues, info, ranks) of a volume [z, y, x], over its octaves."""
    out, octave = [], 0
    v = v.astype(float)
    if opt.size == 0.5:
        v = pooled(v)
    for axis in range(3) if opt.size == 2 else ():
        v = doubled(v, axis)
    v = blurred(v, first_sigma(opt))
    while min(v.shape) > 2:
        g = [v]
        for j in range(1, LEVELS):
            g.append(blurred(g[-1], next_sigma(j)))
        out += [row for _, row in octave_points(g, octave, opt, Window((0, 0, 0), v.shape), ((0, 0, 0), v.shape))]
        v = pooled(g[3])
        octave += 1
    return out


def octave_points(g: list[np.ndarray], octave: int, opt: Options, part: Window, own: tuple[tuple, tuple]) -> list[tuple[tuple, tuple]]:
    """((octave, level, maximum, z, y, x, number), key-point) of an octave's levels: those whose voxel is in `own`, given
    as its first voxel and extent, in order. The levels are the part of the volume that `part` says."""
    s, out = sigmas(), []
    # own voxels and one about them, as far as there are any
    low = [max(a - 1, f, 0) for a, f in zip(own[0], part.low, strict=True)]
    high = [min(a + e + 1, n) for a, e, n in zip(own[0], own[1], part.size, strict=True)]
    cut = tuple(slice(a - f, b - f) for a, b, f in zip(low, high, part.low, strict=True))
    dog = [a[cut] - b[cut] for a, b in zip(g, g[1:], strict=False)]
    if min(dog[0].shape) < 3:
        return out
    for j in range(1, len(dog) - 1):
        before, mid, after = dog[j - 1 : j + 2]
        for z, y, x, top in candidates(before, mid, after):
            at = np.array([vertex((c + a - 1, c + a, c + a + 1), f) + 0.5 for c, a, f in ((x, low[2], mid[z, y, x - 1 : x + 2]), (y, low[1], mid[z, y - 1 : y + 2, x]), (z, low[0], mid[z - 1 : z + 2, y, x]))])
            scale = 2 * vertex(tuple(s[j - 1 : j + 2]), (before[z, y, x], mid[z, y, x], after[z, y, x]))
            unit = 2**octave / opt.size
            for n, rest in enumerate(_described(g[j], at, scale, MAXIMUM * top, opt, part)):
                out.append(((octave, j, int(top), z + low[0], y + low[1], x + low[2], n), (*(at * unit), scale * unit, *rest)))
    return out


def _described(img: np.ndarray, at: np.ndarray, scale: float, info: int, opt: Options, part: Window) -> list[tuple]:
    p = patch(img, at, scale, np.eye(3), opt.edge, part)
    if p is None:
        return []
    p = unit_patch(p)
    e, axes = tensor(p)
    if opt.eigen >= 0 and not e.sum() ** 3 < opt.eigen * e.prod():
        return []
    numbers = lambda p: descriptor(p) if opt.descriptor == "histogram" else pair_descriptor(p, np.array(opt.pairs).reshape(-1, 2, 3), opt.descriptor)
    out = [(axes, e, info, ranks(numbers(p)))]
    for f in frames(p) if opt.reoriented else []:
        turned = patch(img, at, scale, f, opt.edge, part)
        if turned is not None:
            out.append((f, e, info | REORIENTED, ranks(numbers(unit_patch(turned)))))
    return out


_SCHEMA = "image_id string, feat_id long, x float, y float, z float, scale float, ori array<array<float>>, eigs array<float>, info int, pc array<float>"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    """x, y, z, scale, ori, eigs, info and pc of key-points."""
    cols, f4 = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)], pa.float32()
    return [*[pa.array([float(c) for c in cols[i]], f4) for i in range(4)], pa.array([o.tolist() for o in cols[4]], pa.list_(pa.list_(f4))), pa.array([e.tolist() for e in cols[5]], pa.list_(f4)), pa.array([int(i) for i in cols[6]], pa.int32()), pa.array([d.tolist() for d in cols[7]], pa.list_(f4))]


_POINT = ["x", "y", "z", "scale", "ori", "eigs", "info", "pc"]
_ORDER = ["octave", "level", "top", "pz", "py", "px", "number"]


def extract(vols: DataFrame, opt: Options = Options(), whole: int = 1 << 23, side: int = 64) -> DataFrame:
    """Features of every volume of (vol, z, y, x, v); voxels that are missing are 0. Octaves end at two voxels a side.

    A volume of at most `whole` voxels is one task's turn, with all octaves: about 100 bytes a voxel. A larger one is cut
    in bricks of `side`; its features, and their order, are the same (see extract_tiles).
    """

    def one(t: pa.Table) -> pa.Table:
        z, y, x = (t.column(c).to_numpy() for c in "zyx")
        arr = np.zeros((z.max() + 1, y.max() + 1, x.max() + 1))
        arr[z, y, x] = t.column("v").to_numpy()
        name, rows = t.column("vol")[0].as_py(), keypoints(arr, opt)
        return pa.table([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *_columns(rows)], names=["image_id", "feat_id", *_POINT])

    vols = vols.select("vol", "z", "y", "x", F.col("v").cast("double").alias("v"))
    box = vols.groupBy("vol").agg(*[(F.max(c).cast("long") + 1).alias(f"n{c}") for c in "zyx"])
    large = written(box.filter(F.col("nz") * F.col("ny") * F.col("nx") > whole).select(F.col("vol").alias("__vol")), "large")
    same = F.col("vol") == F.col("__vol")
    tiled = not large.isEmpty()
    out = (vols.join(large, same, "left_anti") if tiled else vols).groupBy("vol").applyInArrow(one, _SCHEMA)
    if tiled:
        out = out.unionByName(extract_tiles(vols.join(large, same, "left_semi"), opt, side))
    if opt.affine is None:
        return out
    moved = world(out, [list(r) for r in opt.affine])
    return moved.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in out.schema])


def extract_tiles(vols: DataFrame, opt: Options = Options(), side: int = 64) -> DataFrame:
    """Features of volumes of any size, in bricks of `side` (even) with halos: those of the whole array, bit by bit.

    Octaves are made level by level: each blur is one exchange of the bricks' borders, written before the next. Then each
    brick gets all six levels with a halo as wide as any patch reaches, finds the extrema whose voxel is its own and
    describes them; so a point is found once. A task holds six arrays of a brick and its halo. Features are numbered by
    octave, level, polarity and place, as for a whole array.
    """
    if side % 4:
        raise ValueError("side: a multiple of 4")
    # the patch of the largest scale reaches so far when turned, with a voxel to each side for the interpolation
    reach = int(np.ceil(2 * sigmas()[-2] * (2 * np.sqrt(3) + 0.1))) + 3
    if opt.size == 2:
        v = BR.double(BR.pack(vols, side // 2), side // 2)
    else:
        v = BR.pack(vols, side)
        v = BR.pool(v, side) if opt.size == 0.5 else v
    v = written(BR.blur(v, side, gaussian(first_sigma(opt)), 0), "octave0")
    octave, found, base = 0, [], v
    point = "image_id string, " + ", ".join(f"{c} int" for c in _ORDER) + ", " + _SCHEMA.split("feat_id long, ")[1]
    while not (v := v.filter("least(nz, ny, nx) > 2")).isEmpty():
        g = [v]
        for j in range(1, LEVELS):
            g.append(written(BR.blur(g[-1], side, gaussian(next_sigma(j)), j), f"level{j}"))

        def points(at: BR.Place, arrays: dict[int, np.ndarray], octave: int = octave) -> pa.Table:
            got = octave_points([arrays[j] for j in range(LEVELS)], octave, opt, Window(at.origin, at.size), (at.low, at.shape))
            keys = [pa.array([k[i] for k, _ in got], pa.int32()) for i in range(len(_ORDER))]
            return pa.table([pa.array([at.vol] * len(got), pa.string()), *keys, *_columns([r for _, r in got])], names=["image_id", *_ORDER, *_POINT])

        every = reduce(DataFrame.unionByName, g)
        found.append(written(BR.step(every, side, reach, points, point), f"points{octave}"))
        v = written(BR.pool(g[3].withColumn("level", F.lit(0)), side), f"octave{octave + 1}")
        discard(base, *g[1:])
        base, octave = v, octave + 1
    if not found:
        return vols.sparkSession.createDataFrame([], _SCHEMA)
    # a volume's features are sorted in one task, which spills where they are many
    number = F.row_number().over(SparkWindow.partitionBy("image_id").orderBy(*_ORDER)) - 1
    return reduce(DataFrame.unionByName, found).withColumn("feat_id", number.cast("long")).select("image_id", "feat_id", *_POINT)


def extract_world(vols: DataFrame, dims: tuple[int, int, int], spacing: tuple[float, float, float], affine: list[list[float]], opt: Options = Options()) -> DataFrame:
    """Features in world coordinates: the volumes, of one shape and spacing (z, y, x), are resampled to cubic voxels of the
    least spacing, and the affine, whose columns stand for x, y, z, is rescaled to these."""
    cubic, _ = resample_isotropic(vols, dims, spacing)
    share = [min(spacing) / d for d in spacing[::-1]]
    rows = tuple(tuple(v * k for v, k in zip(r, [*share, 1.0], strict=True)) for r in affine)
    return extract(cubic, replace(opt, affine=rows))
