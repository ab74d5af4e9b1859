"""Exact top-k inner products by multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.llm.common import spill

ROWS = 4096


def quantised(vec: Column, scale: float) -> Column:
    """floor(scale * x) of each component as double; null if the vector is null or holds a null or non-finite one."""
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vec.isNotNull() & sound, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def _packed(df: DataFrame, rows: int) -> DataFrame:
    """(dim, n, ids, data): blocks of at most `rows` vectors of one length, ids int64 and data float64, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            part = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([np.array([i for i, _ in part], np.int64).tobytes()], pa.binary()), pa.array([b"".join(v for _, v in part)], pa.binary())], names=["dim", "n", "ids", "data"])

        for b in batches:
            flat = b.column(1)
            ends, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
            for i, key in enumerate(b.column(0).to_pylist()):
                v = values[ends[i] : ends[i + 1]]
                held.setdefault(len(v), []).append((key, v.tobytes()))
                if len(held[len(v)]) == rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return df.select("id", "v").mapInArrow(run, "dim int, n int, ids binary, data binary")


def levels(dim: int) -> list[np.ndarray]:
    """Cuts of the components into segments, coarse to fine: 4, 8, 16, ... segments of two components or more."""
    return [np.linspace(0, dim, n + 1).astype(int) for n in (4 << i for i in range(dim.bit_length())) if 2 * n <= dim] or [np.array([0, dim])]


def statistics(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Each segment's mean and deviation, both times the root of its length.

    A segment's product of two vectors is at most the sum of the products of these: its squared distance is at least
    the squared differences of these.
    """
    n = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = total / n
    dev = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return np.concatenate([mean * np.sqrt(n), dev * np.sqrt(n)], axis=1)


def block_top(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, mark: np.ndarray | None = None, left: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of each query's k best rows of x by product, ties to the smaller id, its own id left out.

    mark: a product that each query's k-th best is known to reach; rows below it don't come. The segments' means and
    deviations give a lower bound of the squared distance |q|^2 + |x|^2 - 2 q.x, which is an upper bound of the product:
    the product of these statistics, whose squares sum to |q|^2 and |x|^2. At the coarsest level the eighth of
    the rows with the best bounds is computed, and its k-th product raises the mark. Pairs whose bound stays below it end; only
    the others have their bounds at the next level, and those left after the last one are computed exactly. left:
    a list that gets (pairs, pairs left after each level ...).
    """
    exact = _exact(q, x)
    mark = np.full(len(q), -np.inf) if mark is None else mark.astype(float)
    alive = qid[:, None] != xid[None, :]
    told = [int(alive.sum())]
    slack = 1e-9 * (1.0 + np.sqrt((q * q).sum(axis=1).max(initial=0) * (x * x).sum(axis=1).max(initial=0))) + 1e-6
    for step, cuts in enumerate(levels(q.shape[1])):
        sq, sx = statistics(q, cuts), statistics(x, cuts)
        r, c = np.nonzero(alive) if step else (None, None)
        if step and 8 * len(r) < alive.size:
            parts = range(0, len(r), 1 << 16)
            bound = np.concatenate([np.einsum("ij,ij->i", sq[r[a : a + (1 << 16)]], sx[c[a : a + (1 << 16)]]) for a in parts] or [np.zeros(0)])
            gone = bound + slack < mark[r]
            alive[r[gone], c[gone]] = False
        else:
            # while many are left, one matrix product costs less than picking them
            bound = sq @ sx.T + slack
            if step == 0 and len(x) > k:
                n = min(len(x), max(4 * k, len(x) // 8))
                first = np.argpartition(-np.where(alive, bound, -np.inf), n - 1, axis=1)[:, :n]
                rows = np.repeat(np.arange(len(q)), n)
                got = np.where(alive[rows, first.ravel()], exact(rows, first.ravel()), -np.inf).reshape(-1, n)
                mark = np.maximum(mark, np.partition(got, n - k, axis=1)[:, n - k])
            alive &= bound >= mark[:, None]
        told.append(int(alive.sum()))
    if left is not None:
        left.append(told)
    r, c = np.nonzero(alive)
    s = exact(r, c)
    order = np.lexsort((xid[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    best = rank < k
    return r[best], xid[c[best]], s[best]


def _exact(q: np.ndarray, x: np.ndarray):
    """Products of rows by index as integers: in doubles while these are exact, else in Python's integers."""
    most = (np.abs(q).max(initial=0)) * (np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return lambda r, c: np.concatenate([np.einsum("ij,ij->i", q[r[a : a + 65536]], x[c[a : a + 65536]]) for a in range(0, len(r), 65536)] or [np.zeros(0)]).astype(np.int64)
    qi, xi = [[int(v) for v in row] for row in q], [[int(v) for v in row] for row in x]
    return lambda r, c: np.array([max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(qi[i], xi[j], strict=True)))) for i, j in zip(r.tolist(), c.tolist(), strict=True)], np.int64)


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where `queries` holds, its k best among all others (all, if fewer).

    Components are floor(scale * x), scores integer inner products (kept within 64 bits), ties go to the smaller id.
    Vectors null or holding null or non-finite components take no part, nor do rows with a null id or empty vectors;
    vectors are compared with those of their own length. A query's own id is left out, however many rows share it; a
    repeated query row counts once. Extra columns, of whatever names, are not read. Empty table: empty result.

    Queries and rows are packed in blocks of at most `rows` vectors; each block of queries meets each block of rows
    once, and gives on k rows a query, of which a last window keeps the best. First all queries meet one block of rows of
    each length, whose k-th products are the marks with which they meet the others. No side is sent whole to a task.
    """
    v = quantised(F.col(vec_col), scale)
    x = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("q")).filter("id is not null and v is not null and size(v) > 0")
    x = spill(x, "vectors")
    c = spill(_packed(x, rows).withColumn("at", F.monotonically_increasing_id()), "rows")
    own = x.filter("q").dropDuplicates(["id"])
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    qs = spill(_packed(own.repartition(max(1, n // 8)), rows), "queries").select(*[F.col(a).alias(f"q_{a}") for a in ("dim", "n", "ids", "data")])
    qs = qs.withColumn("marks", F.lit(None).cast("binary"))

    def met(r: dict, whole: bool) -> Iterator[pa.RecordBatch]:
        """Each query's best rows of a block, or, if not whole, their k-th product alone as its mark."""
        xid, qid = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
        m, q = np.frombuffer(r["data"], np.float64).reshape(-1, r["dim"]), np.frombuffer(r["q_data"], np.float64).reshape(-1, r["dim"])
        mark = np.frombuffer(r["marks"], np.float64) if r["marks"] else np.full(len(q), -np.inf)
        marks = mark.copy()
        for at in range(0, len(q), 256):
            i, ids, s = block_top(q[at : at + 256], qid[at : at + 256], m, xid, k, mark[at : at + 256])
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(qid[at + i]), pa.array(np.ascontiguousarray(ids)), pa.array(s)], names=["query_id", "vec_id", "score"])
            else:
                full = np.bincount(i, minlength=len(q[at : at + 256])) >= k
                low = np.full(len(full), np.inf)
                np.minimum.at(low, i, s.astype(float))
                # a product of over 53 bits may be rounded up: its mark is set lower
                marks[at : at + len(full)] = np.where(full, low - np.abs(low) * 1e-12, -np.inf)
        if not whole:
            yield pa.RecordBatch.from_arrays([pa.array([r["q_dim"]], pa.int32()), pa.array([r["q_n"]], pa.int32()), *[pa.array([v], pa.binary()) for v in (r["q_ids"], r["q_data"], marks.tobytes())]], names=["q_dim", "q_n", "q_ids", "q_data", "marks"])

    def over(whole: bool):
        return lambda batches: (out for b in batches for r in b.to_pylist() for out in met(r, whole))

    one = c.groupBy("dim").agg(F.min("at").alias("at"))
    first = c.join(one.withColumnRenamed("dim", "d1"), (F.col("dim") == F.col("d1")) & (c["at"] == one["at"]), "left_semi")
    on = F.col("dim") == F.col("q_dim")
    # every query has a block of its length, its own
    qs = spill(first.drop("at").join(qs, on).mapInArrow(over(False), "q_dim int, q_n int, q_ids binary, q_data binary, marks binary"), "marked")
    pairs = c.drop("at").hint("shuffle_replicate_nl").join(qs, on)
    found = pairs.mapInArrow(over(True), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
