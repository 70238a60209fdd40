"""Aggregate expressions built from native aggregates (no custom UDAF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def share(cond: Column) -> Column:
    """Share of rows where `cond` holds; NULL counts as false."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def n_true(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def pearson(x, y, min_pairs: int = 2) -> Column:
    """Pearson r over complete pairs; NULL for a constant column or too few pairs (`corr` would raise)."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(x) >= min_pairs, r)


def looks(v) -> Column:
    """Equivalent number of looks, (mean / std)^2."""
    v = _c(v)
    return F.pow(F.try_divide(F.avg(v), F.stddev_pop(v)), F.lit(2.0))


def variation(v) -> Column:
    v = _c(v)
    return F.try_divide(F.stddev_pop(v), F.avg(v))


def resultant(weight, angle2) -> Column:
    """Weighted length of the mean vector of doubled angles, in [0, 1]."""
    w, a = _c(weight), _c(angle2)
    return F.hypot(F.sum(w * F.cos(a)), F.sum(w * F.sin(a))) / (F.sum(w) + 1e-9)


def iou(tp, fp, fn, eps: float = 1e-6) -> Column:
    return (_c(tp) + eps) / (_c(tp) + _c(fp) + _c(fn) + eps)


def precision(tp, fp, eps: float = 1e-6) -> Column:
    return (_c(tp) + eps) / (_c(tp) + _c(fp) + eps)


def recall(tp, fn, eps: float = 1e-6) -> Column:
    return (_c(tp) + eps) / (_c(tp) + _c(fn) + eps)


def f1(prec, rec, eps: float = 1e-6) -> Column:
    p, r = _c(prec), _c(rec)
    return 2 * p * r / (p + r + eps)
