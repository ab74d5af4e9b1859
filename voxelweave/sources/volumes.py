"""Volume formats: NIfTI by its data source; raw arrays with a header and PGM/PPM images through Spark's reader of files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.sources.files import save
from voxelweave.sources.nifti import VOXELS, encode_nifti, parse_nifti, read_headers, read_nifti  # noqa: F401  part of the formats


def _exploded(vol: str, arr: np.ndarray) -> Iterator[pd.DataFrame]:
    """A volume as voxel rows, a plane at a time."""
    nt, nz, ny, nx = arr.shape
    y, x = np.mgrid[:ny, :nx]
    for t in range(nt):
        for z in range(nz):
            yield pd.DataFrame({"vol": vol, "t": t, "z": z, "y": y.ravel(), "x": x.ravel(), "v": arr[t, z].ravel().astype(float)})


def _read(spark: SparkSession, path: str, decode) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b.path, b.content, strict=True):
                yield from decode(os.path.basename(name), bytes(data))

    return files.mapInPandas(run, VOXELS)


def read_raw(spark: SparkSession, path: str, dims: tuple[int, int, int], channels: int = 1, channel: int = 0) -> DataFrame:
    """Little-endian float32 arrays without a header; dims (z, y, x) are required, channels lie side by side."""

    def decode(name: str, data: bytes) -> Iterator[pd.DataFrame]:
        v = np.frombuffer(data, "<f4")
        per = dims[0] * dims[1] * dims[2] * channels
        if not len(v) or len(v) % per:
            raise ValueError(f"{name}: {len(v)} numbers for {dims} and {channels} channels")
        return _exploded(name, v.reshape(-1, *dims, channels)[..., channel])

    return _read(spark, path, decode)


def array_header(text: str) -> dict:
    """Features, x, y, z, t and data of a key: value header."""
    got = dict(m.groups() for m in re.finditer(r"(?mi)^\s*(features|x|y|z|t|data)\s*:\s*(\S+)", text))
    return {k.lower(): (v if k.lower() == "data" else int(v)) for k, v in got.items()}


def save_arrays(vols: DataFrame, dims: tuple[int, int, int], folder: str) -> DataFrame:
    """Every volume as name.txt and name.img (little-endian float32) in a shared folder; (vol, bytes) of the payloads."""
    nt = vols.groupBy("vol").agg(((F.max("t") if "t" in vols.columns else F.lit(0)) + 1).alias("nt"))
    head = F.format_string(f"Features:\t1\nx:\t{dims[2]}\ny:\t{dims[1]}\nz:\t{dims[0]}\nt:\t%d\ndata:\t%s.img\n", "nt", "vol")
    save(nt.select("vol", head.cast("binary").alias("content")), folder, ".txt")
    return save(assembled(vols, dims, lambda a: a.astype("<f4").tobytes()), folder, ".img")


def read_array(spark: SparkSession, header: str, channel: int = 0) -> DataFrame:
    """An array by its header file, whose data: line names the payload, relative to its folder."""
    h = array_header("\n".join(r.value for r in spark.read.text(header).collect()))
    data = h["data"] if h["data"].startswith("/") or "://" in h["data"] else f"{header.rpartition('/')[0]}/{h['data']}"
    return read_raw(spark, data, (h.get("z", 1), h.get("y", 1), h["x"]), h.get("features", 1), channel)


def means_and_variances(text: str) -> dict[str, list[float]]:
    """The m: and v: rows of a header."""
    rows = re.findall(r"(?mi)^\s*([mv])\w*\s*:\s*(.+)$", text)
    return {{"m": "means", "v": "variances"}[k.lower()]: [float(x) for x in v.split()] for k, v in rows}


def parse_pnm(data: bytes) -> np.ndarray:
    """[y, x] or [y, x, 3] of P2, P3, P5, P6 (255 at most) and P8 (float32) images."""
    head = re.match(rb"\s*P([23568])\s+(?:#.*\n\s*)*(\d+)\s+(?:#.*\n\s*)*(\d+)\s+(?:#.*\n\s*)*(\d+)\s", data)
    if not head:
        raise ValueError("not a PGM or PPM image")
    kind, w, h, most = (int(g) for g in head.groups())
    if most > 255 and kind != 8:
        raise ValueError("over 255 levels")
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    n, body = int(np.prod(shape)), data[head.end() :]
    if kind in (2, 3):
        return np.array(body.split()[:n], np.int64).reshape(shape).astype(np.uint8)
    return np.frombuffer(body, "<f4" if kind == 8 else np.uint8, n).reshape(shape)


def encode_pgm(v: np.ndarray, low: float | None = None, high: float | None = None) -> bytes:
    """A plane of numbers as a PGM of 256 levels, from low to high (its own range if not given); values are clipped."""
    low, high = v.min() if low is None else low, v.max() if high is None else high
    span = high - low
    out = np.full(v.shape, 255) if span <= 0 else np.clip((v - low) / span * 255, 0, 255)
    return b"P5\n%d %d\n255\n" % (v.shape[1], v.shape[0]) + out.astype(np.uint8).tobytes()


def read_pnm(spark: SparkSession, path: str) -> DataFrame:
    """Images as voxels of one plane (z 0); a colour image has its channels on the t axis."""
    return _read(spark, path, lambda name, data: _exploded(name, (a[None, None] if (a := parse_pnm(data)).ndim == 2 else np.moveaxis(a, 2, 0)[:, None])))


def assembled(vols: DataFrame, dims: tuple[int, int, int], encode) -> DataFrame:
    """(vol, content): each volume's voxels as one file, by encode([t, z, y, x]); a task holds one volume."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nt = int(pdf.t.max()) + 1
        a = np.zeros((nt, *dims), np.float32)
        a[pdf.t, pdf.z, pdf.y, pdf.x] = pdf.v
        return pd.DataFrame({"vol": [key[0]], "content": [encode(a)]})

    x = vols if "t" in vols.columns else vols.withColumn("t", F.lit(0))
    return x.select("vol", "t", "z", "y", "x", "v").groupBy("vol").applyInPandas(one, "vol string, content binary")
