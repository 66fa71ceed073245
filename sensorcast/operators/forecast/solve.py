"""Least squares per key: Gram matrices by partial aggregates, solved where they lie.

A fit over the rows of a key is one grouped aggregate of products (map-side combined,
so a hot key is one row per task before the shuffle) and a Cholesky solution of the
small system of each key. The rows with the sums - one per key - are solved in batches
inside the tasks; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram_sums(features: list[Column], target: Column, weight: Column | None = None,
              push: Column | None = None) -> list[Column]:
    """Aggregates m_i_j = sum w x_i x_j (i <= j) and v_i = sum (w y + push) x_i."""
    w = F.lit(1.0) if weight is None else weight
    y = w * target if push is None else w * target + push
    k = len(features)
    return ([F.sum(w * features[i] * features[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]
            + [F.sum(y * features[i]).alias(f"v_{i}") for i in range(k)])


def cholesky_solve(m: np.ndarray, v: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Solutions of the symmetric systems m[n] x = v[n]; NaN where m[n] is not
    positive definite (too few or dependent rows). ``ridge`` is relative to the mean
    of a diagonal, or absolute where that is below 1."""
    k = m.shape[-1]
    out = np.full(v.shape, np.nan)
    if not len(m):
        return out
    m = m + ridge * np.maximum(1.0, np.trace(m, axis1=1, axis2=2) / k)[:, None, None] * np.eye(k)
    size = np.sqrt(np.maximum(np.einsum("nii->ni", m), 0))
    good = (size > 0).all(axis=1) & np.isfinite(m).all(axis=(1, 2)) & np.isfinite(v).all(axis=1)
    for n in np.flatnonzero(good):
        unit = m[n] / np.outer(size[n], size[n])          # a unit diagonal: pivots compare
        try:
            low = np.linalg.cholesky(unit)
        except np.linalg.LinAlgError:
            continue
        if low.diagonal().min() > 1e-6:
            out[n] = np.linalg.solve(low.T, np.linalg.solve(low, v[n] / size[n])) / size[n]
    return out


def solve_rows(sums: DataFrame, keep: list[str], k: int, ridge: float = 0.0) -> DataFrame:
    """(keep, c_0 .. c_{k-1}) of rows with the sums of ``gram_sums``; NULL
    coefficients where a system has no single solution."""
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def solve(batches):
        for b in batches:
            m, v = np.zeros((b.num_rows, k, k)), np.empty((b.num_rows, k))
            for i, j in upper:
                m[:, i, j] = m[:, j, i] = b.column(f"m_{i}_{j}").to_numpy(zero_copy_only=False)
            for i in range(k):
                v[:, i] = b.column(f"v_{i}").to_numpy(zero_copy_only=False)
            c = cholesky_solve(m, v, ridge)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in keep), *(pa.array(c[:, i], pa.float64(), from_pandas=True) for i in range(k))],
                names=[*keep, *(f"c_{i}" for i in range(k))])

    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in keep), *(f"c_{i} double" for i in range(k))])
    return sums.select(*keep, *[f"m_{i}_{j}" for i, j in upper], *[f"v_{i}" for i in range(k)]).mapInArrow(solve, schema)
