"""Volumes as bricks: cubes of voxels in one row each, whose stencils are array arithmetic and shuffle borders alone.

A brick row is (vol, bz, by, bx, nz, ny, nx, level, data): its place in the grid of cubes of `side`, the volume's size,
and the voxels [z, y, x] as float64 bytes, cut at the volume's end. Voxels outside the volume are 0 (or `fill`). A step
gives each brick its halo, the voxels within reach in the bricks about it, and works on one brick at a time, so volumes
of any size take bounded memory, and every voxel gets the value that it has when the whole volume is one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRICK = "vol string, bz int, by int, bx int, nz int, ny int, nx int, level int, data binary"
_NAMES = [c.split()[0] for c in BRICK.split(", ")]
_KEY = ["vol", "bz", "by", "bx"]
_SLAB = f"{BRICK}, oz int, oy int, ox int, sz int, sy int, sx int"


@dataclass(frozen=True)
class Place:
    """A brick's place: volume, index in the grid, size of the volume, first voxel, extent, and the halo about it."""

    vol: str
    index: tuple[int, int, int]
    size: tuple[int, int, int]
    low: tuple[int, int, int]
    shape: tuple[int, int, int]
    halo: int

    @property
    def core(self) -> tuple[slice, ...]:
        """Of an array with halo, the brick itself."""
        return tuple(slice(self.halo, self.halo + n) for n in self.shape)

    @property
    def origin(self) -> tuple[int, int, int]:
        """The voxel at the first place of an array with halo; it may lie outside the volume."""
        return tuple(n - self.halo for n in self.low)

    def rows(self, levels: dict[int, np.ndarray]) -> pa.Table:
        """Brick rows of this place."""
        n = len(levels)
        ints = [[v] * n for v in (*self.index, *self.size)] + [list(levels)]
        data = [np.ascontiguousarray(a, np.float64).tobytes() for a in levels.values()]
        return pa.table([pa.array([self.vol] * n, pa.string()), *[pa.array(c, pa.int32()) for c in ints], pa.array(data, pa.binary())], names=_NAMES)


def _placed(vol: str, index: tuple, size: tuple, side: int, halo: int) -> Place:
    low = tuple(b * side for b in index)
    return Place(vol, tuple(index), tuple(size), low, tuple(min(side, n - a) for n, a in zip(size, low, strict=True)), halo)


def along(v: np.ndarray, kernel: list[tuple[int, float]], axis: int, fill: float = 0.0) -> np.ndarray:
    """Correlation with (offset, weight) along an axis, `fill` outside; taps are added in their order, wherever the array ends."""
    r, n = max(abs(o) for o, _ in kernel), v.shape[axis]
    wide = np.pad(v, [(r, r) if a == axis else (0, 0) for a in range(v.ndim)], constant_values=fill)
    out = np.zeros_like(v)
    for o, w in kernel:
        out += w * wide[tuple(slice(r + o, r + o + n) if a == axis else slice(None) for a in range(v.ndim))]
    return out


def pack(vols: DataFrame, side: int, fill: float = 0.0) -> DataFrame:
    """Bricks of voxel rows (vol, z, y, x, v), one for each cube of the volume's box, from 0 to its last voxel; missing
    voxels are `fill`. With a column `level`, its levels are bricks beside each other, in the box of them all."""
    level = F.col("level") if "level" in vols.columns else F.lit(0)
    x = vols.select(F.col("vol").cast("string").alias("vol"), *[F.col(c).cast("int").alias(c) for c in "zyx"], F.col("v").cast("double").alias("v"), level.cast("int").alias("level"))
    size = x.groupBy("vol").agg(*[(F.max(c) + 1).alias(f"n{c}") for c in "zyx"], F.collect_set("level").alias("levels"))
    grid = size
    for c in "zyx":
        grid = grid.withColumn(f"b{c}", F.explode(F.sequence(F.lit(0), F.floor((F.col(f"n{c}") - 1) / side).cast("int"))))
    cubes = x.withColumns({f"b{c}": F.floor(F.col(c) / side).cast("int") for c in "zyx"})

    def cube(key: tuple, voxels: pa.Table, box: pa.Table) -> pa.Table:
        n = tuple(box.column(f"n{c}")[0].as_py() for c in "zyx")
        at = _placed(key[0].as_py(), tuple(k.as_py() for k in key[1:]), n, side, 0)
        own, levels = voxels.column("level").to_numpy(), {}
        place = [voxels.column(c).to_numpy() - a for c, a in zip("zyx", at.low, strict=True)]
        v = voxels.column("v").to_numpy()
        for k in sorted(box.column("levels")[0].as_py()):
            levels[k], mine = np.full(at.shape, fill), own == k
            levels[k][tuple(p[mine] for p in place)] = v[mine]
        return at.rows(levels)

    # columns of their own, as both sides come from one table
    cubes, grid = cubes.toDF(*cubes.columns), grid.toDF(*grid.columns)
    return cubes.groupBy(*_KEY).cogroup(grid.groupBy(*_KEY)).applyInArrow(cube, BRICK)


def unpack(bricks: DataFrame, side: int, absent: bool = False) -> DataFrame:
    """(vol, z, y, x, v, level) of every voxel; without those that are NaN unless `absent`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = _placed(r["vol"], (r["bz"], r["by"], r["bx"]), (r["nz"], r["ny"], r["nx"]), side, 0)
                v = np.frombuffer(r["data"])
                keep = np.arange(len(v)) if absent else np.flatnonzero(~np.isnan(v))
                z, y, x = np.unravel_index(keep, at.shape)
                ints = [pa.array((c + a).astype(np.int32)) for c, a in zip((z, y, x), at.low, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r["vol"]] * len(keep), pa.string()), *ints, pa.array(v[keep]), pa.array(np.full(len(keep), r["level"], np.int32))], names=["vol", "z", "y", "x", "v", "level"])

    return bricks.mapInArrow(run, "vol string, z int, y int, x int, v double, level int")


def _cut(low: int, high: int, side: int, halo: int, size: int) -> list[tuple[int, int, int]]:
    """(brick, from, to) along an axis: the bricks whose cube with halo meets [low, high), and where."""
    first, last = max(0, (low - halo) // side), min((size - 1) // side, (high - 1 + halo) // side)
    return [(b, max(low, b * side - halo), min(high, (b + 1) * side + halo)) for b in range(first, last + 1)]


def _sent(bricks: DataFrame, side: int, halo: int, turn: Callable[[Place, np.ndarray], tuple[np.ndarray, tuple, tuple]] | None = None) -> DataFrame:
    """Each brick's voxels as slabs for every brick that they are part of or the halo of. turn: (array, first voxel, size
    of the volume) that a brick's array becomes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                at = _placed(r["vol"], (r["bz"], r["by"], r["bx"]), (r["nz"], r["ny"], r["nx"]), side, 0)
                v, low, size = np.frombuffer(r["data"]).reshape(at.shape), at.low, at.size
                if turn:
                    v, low, size = turn(at, v)
                    if not v.size:
                        continue
                for cut in product(*[_cut(a, a + s, side, halo, n) for a, s, n in zip(low, v.shape, size, strict=True)]):
                    part = v[tuple(slice(f - a, t - a) for (_, f, t), a in zip(cut, low, strict=True))]
                    if part.size:
                        row = [r["vol"], *[c[0] for c in cut], *size, r["level"], np.ascontiguousarray(part).tobytes(), *[c[1] for c in cut], *part.shape]
                        yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.string()), *[pa.array([c], pa.int32()) for c in row[1:8]], pa.array([row[8]], pa.binary()), *[pa.array([c], pa.int32()) for c in row[9:]]], names=[c.split()[0] for c in _SLAB.split(", ")])

    return bricks.mapInArrow(run, _SLAB)


Step = Callable[[Place, dict[int, np.ndarray]], pa.Table]


def _met(slabs: DataFrame, side: int, halo: int, step: Step, schema: str, fill: float = 0.0) -> DataFrame:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        n = tuple(t.column(f"n{c}")[0].as_py() for c in "zyx")
        at = _placed(key[0].as_py(), tuple(k.as_py() for k in key[1:]), n, side, halo)
        arrays: dict[int, np.ndarray] = {}
        for r in t.select(["level", "data", "oz", "oy", "ox", "sz", "sy", "sx"]).to_batches(max_chunksize=1):
            level, data, oz, oy, ox, *shape = (c[0].as_py() for c in r.columns)
            v = arrays.setdefault(level, np.full([s + 2 * halo for s in at.shape], fill))
            v[tuple(slice(o - a, o - a + s) for o, a, s in zip((oz, oy, ox), at.origin, shape, strict=True))] = np.frombuffer(data).reshape(shape)
        return step(at, arrays)

    return slabs.groupBy(*_KEY).applyInArrow(run, schema)


def step(bricks: DataFrame, side: int, halo: int, fn: Step, schema: str = BRICK, fill: float = 0.0) -> DataFrame:
    """fn(place, {level: array with halo}) of each brick; bricks may hold several levels. Each brick sends its voxels
    once, and again those that are another one's halo."""
    return _met(_sent(bricks, side, halo), side, halo, fn, schema, fill)


def blur(bricks: DataFrame, side: int, kernel: list[tuple[int, float]], level: int | None = None, axes: str = "xyz") -> DataFrame:
    """Separable correlation, 0 outside and for voxels that are NaN, which are absent: one exchange for all axes. level: what
    the results are named, else as they were."""

    def run(at: Place, arrays: dict[int, np.ndarray]) -> pa.Table:
        out = {}
        for k, v in arrays.items():
            v = np.where(np.isnan(v), 0.0, v)
            for c in axes:
                v = along(v, kernel, "zyx".index(c))
            out[k if level is None else level] = v[at.core]
        return at.rows(out)

    return step(bricks, side, max(abs(o) for o, _ in kernel), run)


def differences(bricks: DataFrame, side: int) -> DataFrame:
    """Of levels 0, 1, 2 and more: each less the next, named by the first; no border is needed."""

    def run(at: Place, arrays: dict[int, np.ndarray]) -> pa.Table:
        return at.rows({k: arrays[k] - arrays[k + 1] for k in sorted(arrays) if k + 1 in arrays})

    return step(bricks, side, 0, run)


def pool(bricks: DataFrame, side: int) -> DataFrame:
    """Means of 2x2x2 voxels, odd last planes left out; a volume of one plane is no more (side must be even)."""

    def turn(at: Place, v: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
        d, h, w = (n // 2 * 2 for n in v.shape)
        half = v[:d, :h, :w].reshape(d // 2, 2, h // 2, 2, w // 2, 2).mean(axis=(1, 3, 5))
        return half, tuple(a // 2 for a in at.low), tuple(n // 2 for n in at.size)

    return _met(_sent(bricks, side, 0, turn), side, 0, lambda at, arrays: at.rows({k: v[at.core] for k, v in arrays.items()}), BRICK)


def double(bricks: DataFrame, side: int) -> DataFrame:
    """Twice the size, in bricks of twice the side: samples as they were, the means of neighbours between, the last one repeated."""

    def run(at: Place, arrays: dict[int, np.ndarray]) -> pa.Table:
        out = {}
        for k, v in arrays.items():
            v = v[1:, 1:, 1:].copy()  # the brick, and the plane after it
            for a in range(3):
                part = lambda s: tuple(s if i == a else slice(None) for i in range(3))  # noqa: B023,E731
                if at.low[a] + at.shape[a] == at.size[a]:
                    v[part(-1)] = v[part(-2)]
                own, after = v[part(slice(None, -1))], v[part(slice(1, None))]
                v = np.stack([own, (own + after) / 2], axis=a + 1).reshape(*v.shape[:a], -1, *v.shape[a + 1 :])
            out[k] = v
        return Place(at.vol, at.index, tuple(2 * n for n in at.size), (0, 0, 0), at.shape, 0).rows(out)

    return step(bricks, side, 1, run)


_AROUND = list(product((-1, 0, 1), repeat=3))


def shifted(v: np.ndarray, d: tuple[int, int, int]) -> np.ndarray:
    """v without its outer voxels, moved by d."""
    return v[tuple(slice(1 + i, n - 1 + i) for i, n in zip(d, v.shape, strict=True))]


def beyond(mid: np.ndarray, others: list[np.ndarray], sign: int, near: list[tuple[int, int, int]] = _AROUND) -> np.ndarray:
    """Where mid, without its outer voxels, is strictly beyond its neighbours and all 27 of each other array; NaN is not."""
    m = sign * shifted(mid, (0, 0, 0))
    ok = np.ones(m.shape, bool)
    for v, offsets in ((mid, [d for d in near if d != (0, 0, 0)]), *[(o, _AROUND) for o in others]):
        for d in offsets:
            ok &= m > sign * shifted(v, d)
    return ok


def extrema(bricks: DataFrame, side: int, mid: int = 0, others: tuple[int, ...] = (), flat: bool = False) -> DataFrame:
    """(vol, z, y, x, v, polarity, and six neighbours x0, x2, y0, y2, z0, z2): strict extrema of level mid among its 26
    neighbours (8 in the slice if flat) and the 27 of each other level; polarity 1: maximum. A voxel one of whose neighbours
    is missing (NaN: bricks packed with that fill) is none. The neighbours are null where they are missing."""
    near = [d for d in _AROUND if not flat or d[0] == 0]
    names = [f"{c}{k}" for c in "xyz" for k in (0, 2)]

    def run(at: Place, arrays: dict[int, np.ndarray]) -> pa.Table:
        v, cols = arrays[mid], [[] for _ in range(11)]
        wide = [slice(0, None)] * 3
        for sign in (-1, 1):
            where = np.argwhere(beyond(v[tuple(wide)], [arrays[k] for k in others], sign, near)) + 1
            get = lambda d: v[tuple((where + d).T)]  # noqa: B023,E731
            sides = [get(np.array([k * (c == a) for a in "zyx"])) for c in "xyz" for k in (-1, 1)]
            for col, part in zip(cols, [*(where + np.array(at.origin)).T, get(0), np.full(len(where), int(sign > 0)), *sides], strict=True):
                col.append(part)
        kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32()] + [pa.float64()] * 6
        arrays_ = [pa.array(np.concatenate(c), k, from_pandas=True) for c, k in zip(cols, kinds, strict=True)]
        return pa.table([pa.array([at.vol] * len(arrays_[0]), pa.string()), *arrays_], names=["vol", "z", "y", "x", "v", "polarity", *names])

    return step(bricks, side, 1, run, "vol string, z int, y int, x int, v double, polarity int, " + ", ".join(f"{c} double" for c in names), float("nan"))
