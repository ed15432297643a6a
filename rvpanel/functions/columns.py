"""Column expressions.  All of them stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Fixed value: trading days per year used to annualize a daily volatility.
TRADING_DAYS = 252


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def annualized(vol: Column, annualize: bool = True) -> Column:
    return vol * F.lit(math.sqrt(TRADING_DAYS)) if annualize else vol


def safe_name(symbol: Column | str) -> Column:
    """Symbol as a directory name: every ``^`` removed."""
    return F.regexp_replace(_col(symbol), r"\^", "")


def clean_double(c: Column | str) -> Column:
    """NaN and infinities become NULL, since Spark's aggregates propagate NaN."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def log_return(price: Column | str, previous: Column) -> Column:
    """``ln(p / p_prev)``; NULL where either is missing or the ratio is not positive."""
    return F.ln(F.try_divide(_col(price), previous))


def rolling_std(value: Column | str, rows: int, w: WindowSpec, first: int, last: int) -> Column:
    """Sample standard deviation over the frame ``[first, last]`` of ``rows`` rows.

    NULL unless the frame is full, that is, unless it holds ``rows`` values.
    """
    frame = w.rowsBetween(first, last)
    value = _col(value)
    return F.when(F.count(value).over(frame) == rows, F.stddev_samp(value).over(frame))


def rmse(actual: str, pred: str) -> Column:
    return F.expr(f"sqrt(avg(({actual} - {pred}) * ({actual} - {pred})))")


def mae(actual: str, pred: str) -> Column:
    return F.expr(f"avg(abs({actual} - {pred}))")


def bad_volatility(actual: str, pred: str) -> Column:
    """Aggregate: number of rows QLIKE is undefined for (a non-positive side)."""
    return F.expr(f"count_if({actual} <= 0 OR {pred} <= 0)")


def qlike(actual: str, pred: str, strict: bool = False) -> Column:
    """Aggregate ``avg(q - ln q - 1)`` with ``q = (actual / pred)^2``.

    One non-positive volatility makes the group's QLIKE NULL, or an error with
    ``strict``.  Without this guard such rows would vanish, as ``ln(0)`` is NULL.
    """
    q = f"pow(try_divide({actual}, {pred}), 2)"
    bad = f"count_if({actual} <= 0 OR {pred} <= 0) > 0"
    fault = "double(raise_error('QLIKE of a volatility that is not strictly positive'))" if strict else "NULL"
    return F.expr(f"CASE WHEN {bad} THEN {fault} ELSE avg({q} - ln({q}) - 1D) END")
