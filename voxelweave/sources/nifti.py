"""Volume files by byte ranges: a data source whose partitions are runs of planes, read where they lie in the file."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from voxelweave.sources.files import listed, open_path, registered

#: The voxel codes that are read.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
VOXELS = "vol string, t int, z int, y int, x int, v double"


#: (first, size) of a part along z, y and x.
Box = tuple[tuple[int, int], tuple[int, int], tuple[int, int]]


def parse_header(data: bytes) -> dict:
    """Of the first 348 bytes: dims and spacing (z, y, x), volumes, affine, slope, intercept, the voxels' type, their first byte."""
    if len(data) < 348:
        raise ValueError("not a NIfTI header")
    end = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    if struct.unpack(end + "i", data[:4])[0] != 348:
        raise ValueError("not a NIfTI header")
    dim, code = struct.unpack(end + "8h", data[40:56]), struct.unpack(end + "h", data[70:72])[0]
    if code not in DTYPES:
        raise ValueError(f"voxel code {code} isn't read")
    pix = struct.unpack(end + "8f", data[76:108])
    offset, slope, inter = struct.unpack(end + "3f", data[108:120])
    nx, ny, nz, nt = (max(1, dim[i]) if i <= dim[0] else 1 for i in range(1, 5))
    affine = np.array(struct.unpack(end + "12f", data[280:328])).reshape(3, 4) if struct.unpack(end + "h", data[254:256])[0] > 0 else _quatern(struct.unpack(end + "6f", data[256:280]), pix)
    return {"dims": (nz, ny, nx), "volumes": nt, "spacing": (pix[3], pix[2], pix[1]), "affine": affine.tolist(), "slope": slope, "intercept": inter, "kind": end + DTYPES[code], "at": max(348, int(offset))}


def parse_nifti(data: bytes, scaled: bool = False, volumes: list[int] | None = None, box: Box | None = None) -> tuple[np.ndarray, dict]:
    """([t, z, y, x] as float32, header) of a .nii file, of .nii.gz, or of a header followed by its image.

    volumes: only these of the t axis are decoded, box: only this part (size 1 along an axis: a plane of it). scaled:
    slope and intercept are applied. Other codes, and parts that leave the volume, are errors.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    h = parse_header(data)
    nt, (nz, ny, nx), dt, at = h["volumes"], h["dims"], np.dtype(h["kind"]), h["at"]
    size = nx * ny * nz
    want = list(range(nt)) if volumes is None else volumes
    if box and any(a < 0 or k < 1 or a + k > m for (a, k), m in zip(box, (nz, ny, nx), strict=True)):
        raise ValueError(f"{box} leaves a volume of {(nz, ny, nx)}")
    part = tuple(slice(a, a + k) for a, k in box) if box else ...
    arr = np.stack([np.frombuffer(data, dt, size, at + i * size * dt.itemsize).reshape(nz, ny, nx)[part].astype(np.float32) for i in want])
    if scaled and h["slope"]:
        arr = arr * h["slope"] + h["intercept"]
    return arr, h


def _quatern(q: tuple, pix: tuple) -> np.ndarray:
    """The 3x4 affine of a quaternion, an offset and spacings."""
    b, c, d, ox, oy, oz = q
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    s = np.array([pix[1], pix[2], pix[3] * (-1 if pix[0] < 0 else 1)])
    return np.hstack([r * s, [[ox], [oy], [oz]]])


def encode_nifti(arr: np.ndarray, spacing: tuple[float, float, float] = (1, 1, 1), affine: np.ndarray | None = None) -> bytes:
    """[t, z, y, x] as a little-endian float32 .nii file."""
    t, z, y, x = arr.shape
    m = np.array([[spacing[2], 0, 0, 0], [0, spacing[1], 0, 0], [0, 0, spacing[0], 0]], float) if affine is None else np.asarray(affine)[:3]
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, 4 if t > 1 else 3, x, y, z, t, 1, 1, 1)
    struct.pack_into("<2h", h, 70, 16, 32)
    struct.pack_into("<8f", h, 76, 1, spacing[2], spacing[1], spacing[0], 1, 1, 1, 1)
    struct.pack_into("<3f", h, 108, 352, 1, 0)
    struct.pack_into("<2h", h, 252, 0, 1)
    struct.pack_into("<12f", h, 280, *m.ravel())
    h[344:348] = b"n+1\0"
    return bytes(h) + arr.astype("<f4").tobytes()


#: Bytes of a header, and voxels of a partition if the option `voxels` doesn't say otherwise.
HEADER, RUN = 352, 1 << 22
AXES = ("t", "z", "y", "x")


@dataclass
class Wanted:
    """Bounds of each axis, both ends in it, and the values of t if they are listed; None: no bound."""

    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)
    ts: set[int] | None = None

    def narrow(self, axis: str, low: int | None = None, high: int | None = None) -> None:
        if low is not None:
            self.low[axis] = max(low, self.low.get(axis, low))
        if high is not None:
            self.high[axis] = min(high, self.high.get(axis, high))

    def span(self, axis: str, size: int) -> range:
        return range(max(0, self.low.get(axis, 0)), min(size, self.high.get(axis, size - 1) + 1))

    def take(self, f: Filter) -> bool:
        """Whether f bounds an axis by whole numbers, and is now part of the bounds."""
        name = getattr(f, "attribute", ())
        if len(name) != 1 or name[0] not in AXES:
            return False
        if isinstance(f, IsNotNull):
            return True  # no row has a null place
        axis, v = name[0], getattr(f, "value", None)
        if isinstance(f, In) and all(isinstance(x, int) for x in v):
            if axis != "t":
                self.narrow(axis, min(v, default=0), max(v, default=-1))
                return False  # the numbers between are read too: the rows are still to be tested
            self.ts = set(v) if self.ts is None else self.ts & set(v)
            return True
        if not isinstance(v, int):
            return False
        match f:
            case EqualTo():
                self.narrow(axis, v, v)
            case GreaterThan():
                self.narrow(axis, low=v + 1)
            case GreaterThanOrEqual():
                self.narrow(axis, low=v)
            case LessThan():
                self.narrow(axis, high=v - 1)
            case LessThanOrEqual():
                self.narrow(axis, high=v)
            case _:
                return False
        return True


@dataclass
class Run(InputPartition):
    """Planes of a file, as numbers t * sizes[z] + z; of each the rows from y and the columns from x."""

    path: str
    name: str
    planes: list[int]
    ys: range
    xs: range
    head: dict
    packed: bool

    def range_of(self, plane: int) -> tuple[int, int]:
        """(first byte, bytes) of the rows of a plane that are read."""
        _, ny, nx = self.head["dims"]
        size = np.dtype(self.head["kind"]).itemsize
        return self.head["at"] + (plane * ny + self.ys.start) * nx * size, len(self.ys) * nx * size


def header_at(system, path: str) -> tuple[dict, bool]:
    """The header of a file, and whether it is compressed; no more than its first bytes are read."""
    with system.open_input_file(path) as f:
        head = f.read(HEADER)
    if packed := head[:2] == b"\x1f\x8b":
        with system.open_input_stream(path, compression=None) as f, gzip.GzipFile(fileobj=f) as z:
            head = z.read(HEADER)
    return parse_header(head), packed


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.options = options["path"], options
        self.want = Wanted()
        if ts := options.get("volumes"):
            self.want.ts = {int(x) for x in ts.split(",")}
        for axis in ("z", "y", "x"):
            if part := options.get(axis):
                first, size = map(int, part.split(","))
                self.want.narrow(axis, first, first + size - 1)

    def partitions(self) -> list[Run]:
        """Headers are read here, 32 files at a time; voxels in the tasks."""
        system, _ = open_path(self.path)
        out, most, files = [], int(self.options.get("voxels", RUN)), listed(self.path)
        with ThreadPoolExecutor(32) as pool:
            for info, (head, packed) in zip(files, pool.map(lambda f: header_at(system, f.path), files), strict=True):
                sizes = dict(zip(AXES, (head["volumes"], *head["dims"]), strict=True))
                self.inside(sizes)
                spans = {a: self.want.span(a, n) for a, n in sizes.items()}
                ts = [t for t in spans["t"] if self.want.ts is None or t in self.want.ts]
                planes = [t * sizes["z"] + z for t in ts for z in spans["z"]]
                # a compressed file can only be read from its start on
                step = max(1, len(planes) if packed else most // max(1, len(spans["y"]) * len(spans["x"])))
                if spans["y"] and spans["x"]:
                    out += [Run(info.path, info.base_name, planes[i : i + step], spans["y"], spans["x"], head, packed) for i in range(0, len(planes), step)]
        return out

    def inside(self, sizes: dict[str, int]) -> None:
        """A part asked for by option that leaves the volume is an error; filters are not."""
        for axis in ("z", "y", "x"):
            if part := self.options.get(axis):
                first, size = map(int, part.split(","))
                if first < 0 or size < 1 or first + size > sizes[axis]:
                    raise ValueError(f"{axis} {first}, {size} leaves a volume of {sizes}")
        if (ts := self.options.get("volumes")) and not all(0 <= int(t) < sizes["t"] for t in ts.split(",")):
            raise ValueError(f"volumes {ts} of {sizes['t']}")

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        """A batch a plane; without any runs Spark asks once, for None."""
        if run is None:
            return
        system, _ = open_path(self.path)
        nz, _, nx = run.head["dims"]
        scaled = self.options.get("scaled") == "true" and run.head["slope"]
        y, x = (a.ravel().astype(np.int32) for a in np.meshgrid(run.ys, run.xs, indexing="ij"))
        raw = system.open_input_stream(run.path, compression=None) if run.packed else system.open_input_file(run.path)
        with raw, gzip.GzipFile(fileobj=raw) if run.packed else raw as f:
            for plane in run.planes:
                at, size = run.range_of(plane)
                f.seek(at)
                data = f.read(size)
                if len(data) < size:
                    raise ValueError(f"{run.name} ends before plane {plane}")
                v = np.frombuffer(data, run.head["kind"]).reshape(len(run.ys), nx)[:, run.xs.start : run.xs.stop].astype(np.float32)
                if scaled:
                    v = v * np.float32(run.head["slope"]) + np.float32(run.head["intercept"])
                n = v.size
                cols = [pa.array([run.name]).take(pa.array(np.zeros(n, np.int32))), *[pa.array(np.full(n, c, np.int32)) for c in divmod(plane, nz)], pa.array(y), pa.array(x), pa.array(v.ravel().astype(np.float64))]
                yield pa.RecordBatch.from_arrays(cols, names=["vol", *AXES, "v"])


class PushingReader(NiftiReader):
    """Takes filters on t, z, y and x as well, so that what they rule out is not read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.want.take(f):
                yield f


class Nifti(DataSource):
    """Voxels (vol, t, z, y, x, v) of the .nii and .nii.gz files at a path.

    Options: volumes (t, t, ...), z, y, x ("first,size"), scaled, voxels (of a partition). With `pushdown`, which needs
    spark.sql.python.filterPushdown.enabled, filters that compare t, z, y and x with numbers narrow what is read.
    """

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else NiftiReader)(dict(self.options))


def read_nifti(spark: SparkSession, path: str, scaled: bool = False, volumes: list[int] | None = None, box: Box | None = None) -> DataFrame:
    """Voxels of all files at path (a file, a folder, or a pattern of names), a file's name the volume's.

    volumes, box: only these are read. Where spark.sql.python.filterPushdown.enabled is set, filters on t, z, y and x
    narrow the read as well. Voxels of a part keep their places; a part that leaves the volume is an error.
    """
    registered(spark, Nifti)
    out = spark.read.format(Nifti.name()).option("scaled", str(scaled).lower())
    out = out.option("pushdown", str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower())
    if volumes is not None:
        out = out.option("volumes", ",".join(map(str, volumes)))
    for axis, part in zip("zyx", box or (), strict=False):
        out = out.option(axis, f"{part[0]},{part[1]}")
    return out.load(path)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(vol, dims, spacing, affine), arrays in z, y, x order; of each file the header alone is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b.path:
                h = header_at(*open_path(name))[0]
                yield pd.DataFrame({"vol": [name.rpartition("/")[2]], "dims": [list(h["dims"])], "spacing": [list(map(float, h["spacing"]))], "affine": [h["affine"]]})

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(run, "vol string, dims array<int>, spacing array<double>, affine array<array<double>>")
