"""Ratios with the zero and null rules of the evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Zero, not null, where a denominator is zero."""
    p, r = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    return p, r, ratio_or_zero(2 * p * r, p + r)


def recall_or_null(found: Column, objects: Column) -> Column:
    return F.try_divide(found.cast("double"), objects.cast("double"))


def shown(x: Column, digits: int = 4) -> Column:
    """Rounded half to even, as reports show values."""
    return F.bround(x, digits)
