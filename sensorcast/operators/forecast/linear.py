"""Direct multi-step linear heads fitted by the normal equations.

X'X and X'Y over all training windows of all series: every task reduces its
Arrow batches to one Gram matrix, and a small aggregate sums these. The
(F+1) x (F+1) system is solved on the driver (a parameter-size result), and the
coefficients are applied as literals in a projection: no model state is shipped
to executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.timefn import add_steps
from .common import forecast_frame


def normal_equations(train: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Long form (i, j, value): sums of column i of [1, features] times column j
    of [1, features, targets], j >= i. Rows with a NULL in any of them are left out."""
    names = [*features, *targets]
    k = len(features) + 1

    def gram(batches):
        total = np.zeros((k, len(names) + 1))
        for b in batches:
            x = np.empty((b.num_rows, len(names) + 1))
            x[:, 0] = 1.0
            for i, c in enumerate(b.columns):
                x[:, i + 1] = c.to_numpy(zero_copy_only=False)
            total += x[:, :k].T @ x
        i, j = np.triu_indices(k, 0, len(names) + 1)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32),
                                          "value": total[i, j]})

    rows = train.select(*[F.col(c).cast("double") for c in names]).dropna()
    return (rows.mapInArrow(gram, "i int, j int, value double")
            .groupBy("i", "j").agg(F.sum("value").alias("value")))


def fit_head(train: DataFrame, features: list[str], targets: list[str],
             ridge: float = 1e-8) -> np.ndarray:
    """Least squares W ((1 + F) x H) for targets ~ [1, features]."""
    k = len(features) + 1
    m = np.zeros((k, k + len(targets)))
    for row in normal_equations(train, features, targets).collect():
        m[row.i, row.j] = row.value
        if row.j < k:
            m[row.j, row.i] = row.value
    xtx, xty = m[:, :k], m[:, k:]
    scale = max(1.0, float(np.trace(xtx)) / k)
    return np.linalg.solve(xtx + ridge * scale * np.eye(k), xty)


def coefficients(table: DataFrame, features: list[str]) -> np.ndarray:
    """W from a saved coefficient table."""
    rows = table.collect()
    terms = {t: i for i, t in enumerate(["intercept", *features])}
    w = np.zeros((len(terms), max((r.step for r in rows), default=0)))
    for r in rows:
        w[terms[r.term], r.step - 1] = r.coef
    return w


def coefficients_frame(spark, w: np.ndarray, features: list[str], model: str) -> DataFrame:
    """The fitted head as a table (model, step, term, coef) for persistence."""
    terms = ["intercept", *features]
    rows = [(model, h + 1, terms[i], float(w[i, h])) for h in range(w.shape[1])
            for i in range(w.shape[0])]
    return spark.createDataFrame(rows, "model string, step int, term string, coef double")


def predict_head(feat: DataFrame, w: np.ndarray, features: list[str], base_col: str,
                 freq: str, model: str) -> DataFrame:
    """Forecast rows for every origin in ``feat``: base + W' [1, features]."""
    preds = []
    for h in range(w.shape[1]):
        e = F.col(base_col) + F.lit(float(w[0, h]))
        for i, f in enumerate(features):
            e = e + F.lit(float(w[i + 1, h])) * F.col(f)
        preds.append(e)
    x = feat.select("series_id", "origin_ts", F.posexplode(F.array(*preds)).alias("_i", "predicted"))
    x = x.withColumn("step", F.col("_i") + 1).withColumn(
        "target_ts", add_steps("origin_ts", F.col("step"), freq))
    return forecast_frame(x, model, F.col("predicted"))
