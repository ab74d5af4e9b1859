"""Texts as media columns: stored losslessly as images, read back, and summed up."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.llm import webp

UNIT = 576


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text in UTF-8 (null: none), and these with bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: str | None = None) -> DataFrame:
    """For each row of docs its text as a lossless WebP image: sizes and hashes of what is read back, and its features.

    media: also return the stored bytes, in a column of this name. All figures but media_* are taken from the
    decoded samples. Null and empty texts are 576 bytes of 255. Equal texts have equal values; repeated rows are stored
    each; very long texts take several images end to end. Empty table: empty result.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *[media] * (media is not None)]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def row(text: str | None) -> tuple:
        n, payload = padded(text)
        kept = webp.store(payload)
        px = webp.load(kept)
        back = px.tobytes()
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(kept), hashlib.sha256(kept).hexdigest(), webp.features(px), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = [row(t.as_py())[: len(names)] for t in part.column(1)]
                cols = [pa.array([r[i] for r in rows], types[i]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", *names])

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (f", `{media}` binary" if media else "")
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
