"""Report precision shared by the registered queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .oracle import DIGITS, GRID


def rounded(df: DataFrame, digits: int = DIGITS, keep=("q",)) -> DataFrame:
    """Round every DOUBLE column to the magnitude-scaled binary grid of
    ``oracle.GRID`` with floor(x / g + 0.5) * g (float sums differ in the last
    bits by evaluation order). Exact constants
    such as quantile levels (``keep``) stay as they are."""
    grid = [(lim, g * 2.0 ** (DIGITS - digits)) for lim, g in GRID]

    def rnd(v):
        out = None
        for lim, g in grid:
            arm = F.floor(v / F.lit(g) + F.lit(0.5)).cast("double") * F.lit(g)
            out = (F.when(F.abs(v) < F.lit(lim), arm) if out is None
                   else out.when(F.abs(v) < F.lit(lim), arm))
        return out.otherwise(v)

    def one(c, t):
        if c in keep:
            return F.col(c)
        if t == "double":
            return rnd(F.col(c)).alias(c)
        if t == "array<double>":
            return F.transform(F.col(c), rnd).alias(c)
        return F.col(c)
    return df.select([one(c, t) for c, t in df.dtypes])
