"""Decompositions of small matrices, whole Arrow batches at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _stack(m: pd.Series) -> np.ndarray:
    return np.array([np.array([list(r) for r in v], float) for v in m])


def pinv(m: Column) -> Column:
    """The pseudo-inverse of a matrix (array of rows); all matrices of a column have one shape; null for null."""

    @F.pandas_udf("array<array<double>>")
    def made(m: pd.Series) -> pd.Series:
        there = m.notna()
        made = iter(np.linalg.pinv(_stack(m[there])).tolist() if there.any() else ())
        return pd.Series([next(made) if t else None for t in there], dtype=object)

    return made(m)


def svd(m: Column) -> Column:
    """(u, s, vt) of a matrix, s from the largest: m = u diag(s) vt; null for null."""

    @F.pandas_udf("struct<u array<array<double>>, s array<double>, vt array<array<double>>>")
    def made(m: pd.Series) -> pd.DataFrame:
        there = m.notna()
        made = np.linalg.svd(_stack(m[there]), full_matrices=False) if there.any() else ((), (), ())
        parts = [iter(np.asarray(v).tolist()) for v in made]
        return pd.DataFrame({c: pd.Series([next(v) if t else None for t in there], dtype=object) for c, v in zip(("u", "s", "vt"), parts, strict=True)})

    return made(m)
