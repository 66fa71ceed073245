"""Per-row error expressions shared by the metrics and loss operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The epsilon guarding the SMAPE and MAPE denominators.
EPS = 1e-8


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def error(actual="actual", predicted="predicted") -> Column:
    return _c(actual) - _c(predicted)


def abs_error(actual="actual", predicted="predicted") -> Column:
    return F.abs(error(actual, predicted))


def sq_error(actual="actual", predicted="predicted") -> Column:
    e = error(actual, predicted)
    return e * e


def smape_term(actual="actual", predicted="predicted") -> Column:
    a, p = _c(actual), _c(predicted)
    return F.lit(2.0) * F.abs(p - a) / (F.abs(a) + F.abs(p) + F.lit(EPS))


def mape_term(actual="actual", predicted="predicted") -> Column:
    a, p = _c(actual), _c(predicted)
    return F.abs((a - p) / (a + F.lit(EPS)))


def pinball_term(q: str | Column | float, actual="actual", predicted="predicted") -> Column:
    qc = F.lit(q) if isinstance(q, float) else _c(q)
    e = error(actual, predicted)
    return F.greatest(qc * e, (qc - F.lit(1.0)) * e)


def gaussian_nll_term(actual="actual", mean="predicted", sd="sd") -> Column:
    s = _c(sd)
    e = error(actual, mean)
    return F.lit(0.5 * math.log(2 * math.pi)) + F.log(s) + e * e / (F.lit(2.0) * s * s)


def is_valid_number(c: str | Column) -> Column:
    x = _c(c)
    return x.isNotNull() & ~F.isnan(x)
