"""Data sources: byte ranges of volume files, filters that narrow a read, and writes of all files or none."""

import gzip
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.sources import files as FI
from voxelweave.sources import nifti as NI
from voxelweave.sources import volumes as VS

KEYS = ("t", "z", "y", "x")


def cube(df):
    return {(r.vol, *(r[k] for k in KEYS)): r.v for r in df.collect()}


def want(name, arr, part=(slice(None),) * 4):
    every = np.stack(np.meshgrid(*map(np.arange, arr.shape), indexing="ij"), axis=-1)[part].reshape(-1, 4)
    return {(name, *map(int, i)): float(arr[tuple(i)]) for i in every}


@pytest.fixture
def volume(tmp_path):
    arr = np.random.default_rng(0).normal(size=(2, 6, 5, 4)).astype(np.float32)
    (tmp_path / "a.nii").write_bytes(VS.encode_nifti(arr))
    return arr, tmp_path


def test_runs_of_planes_cover_every_voxel_once(spark, volume):
    arr, folder = volume
    (folder / "b.nii.gz").write_bytes(gzip.compress(VS.encode_nifti(arr + 1)))
    (folder / ".hidden").write_bytes(b"no volume")
    got = VS.read_nifti(spark, str(folder))
    assert cube(got) == want("a.nii", arr) | want("b.nii.gz", arr + 1) and got.count() == 2 * arr.size
    assert cube(VS.read_nifti(spark, f"file://{folder}/a*")) == want("a.nii", arr)
    runs = NI.NiftiReader({"path": str(folder), "voxels": "45"}).partitions()
    # two planes of 20 a run; the compressed file is one
    assert [r.planes for r in runs] == [[i, i + 1] for i in range(0, 12, 2)] + [list(range(12))]


def test_a_part_reads_its_own_bytes_alone(spark, volume):
    arr, folder = volume
    place = folder / "a.nii"
    data = place.read_bytes()
    (run,) = NI.NiftiReader({"path": str(place), "volumes": "1", "z": "2,1", "y": "1,3", "x": "0,4"}).partitions()
    assert run.planes == [8] and run.range_of(8) == (352 + (8 * 5 + 1) * 4 * 4, 3 * 4 * 4)
    # the file ends where the part does, and what comes before it is noise
    at, size = run.range_of(8)
    place.write_bytes(data[:352] + b"\xff" * (at - 352) + data[at : at + size])
    part = VS.read_nifti(spark, str(place), volumes=[1], box=((2, 1), (1, 3), (1, 2)))
    assert cube(part) == want("a.nii", arr, (slice(1, 2), slice(2, 3), slice(1, 4), slice(1, 3)))
    with pytest.raises(Exception, match="ends before plane"):
        VS.read_nifti(spark, str(place), volumes=[1]).collect()
    with pytest.raises(Exception, match="leaves a volume"):
        VS.read_nifti(spark, str(place), box=((5, 2), (0, 1), (0, 1))).collect()


def test_filters_narrow_the_read(spark, volume):
    arr, folder = volume
    place = folder / "a.nii"
    data = place.read_bytes()
    place.write_bytes(data[: 352 + 9 * 20 * 4])  # nothing after plane (1, 2)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = VS.read_nifti(spark, str(place)).filter("t in (1, 7) and z > 0 and z < 3 and y >= 2 and y <= 3 and x in (0, 3) and v is not null")
        assert cube(got) == {k: v for k, v in want("a.nii", arr).items() if k[1] == 1 and k[2] in (1, 2) and k[3] in (2, 3) and k[4] in (0, 3)}
        assert cube(VS.read_nifti(spark, str(place)).filter("t = 0 and z = 9")) == {}
        assert cube(VS.read_nifti(spark, str(place)).filter("t = 1 and z = 1 and y <> 2 and (x = 1 or x = 2)")) == {k: v for k, v in want("a.nii", arr).items() if k[1:3] == (1, 1) and k[3] != 2 and k[4] in (1, 2)}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_headers_take_no_voxels(spark, tmp_path):
    whole = VS.encode_nifti(np.zeros((1, 2, 3, 4), np.float32), (3.0, 2.0, 1.0))
    (tmp_path / "h.nii").write_bytes(whole[:352])
    h = VS.read_headers(spark, str(tmp_path)).first()
    assert (h.vol, h.dims, h.spacing) == ("h.nii", [2, 3, 4], [3.0, 2.0, 1.0])
    (tmp_path / "bad.nii").write_bytes(b"short")
    with pytest.raises(Exception, match="not a NIfTI header"):
        VS.read_nifti(spark, str(tmp_path)).collect()


def test_files_are_written_by_uri_and_replaced(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = spark.range(50, numPartitions=7).select(F.format_string("v%d", "id").alias("vol"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8").alias("content"))
    for _ in range(2):
        got = FI.save(rows, folder, ".bin")
        assert {(r.vol, r.bytes) for r in got.collect()} == {(f"v{i}", i) for i in range(1, 50)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"v{i}.bin" for i in range(50))
    assert (tmp_path / "out" / "v9.bin").read_bytes() == b"x" * 9
    # no rows: a folder without files
    assert FI.save(rows.limit(0), f"{tmp_path}/none", ".bin").count() == 0


def test_a_late_task_brings_nothing_back(tmp_path, monkeypatch):
    """A task that still runs when the driver has aborted the write fails, and leaves no folder."""
    monkeypatch.setattr(FI, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 1)))
    writer, row = FI.FilesWriter(str(tmp_path / "out"), ".bin"), SimpleNamespace(vol="v", content=b"x")
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([row]))
    assert list((tmp_path / "out").iterdir()) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    content = F.when(F.col("id") < 90, F.encode(F.lit("x"), "utf-8")).otherwise(F.raise_error(F.lit("planted")).cast("binary"))
    rows = spark.range(100, numPartitions=4).select(F.col("id").cast("string").alias("vol"), content.alias("content"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "3.bin").write_bytes(b"before")
    with pytest.raises(Exception, match="planted"):
        FI.save(rows, str(tmp_path / "out"), ".bin")
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "out").iterdir()] == [("3.bin", b"before")]
