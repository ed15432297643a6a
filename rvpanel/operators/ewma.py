"""Exponentially weighted volatility as a blocked scan.

With weights ``d^(t-k)`` on every earlier value the variance at row t needs four sums
over the whole past.  Each block of rows computes them for its own values with running
window sums of ``x_k * d^-k``; what earlier blocks add is a constant per block times
``d^(offset+1)``.  The block is short enough for ``d^-k`` to stay finite.

The constants are carried in two levels, so that no task takes all blocks of a symbol: a block is an
affine step (decay what came before, add its own sums); the steps of a super-block, about a
million rows, are composed in ``(symbol, super-block)``, and only super-blocks are
carried along a symbol.  On both levels the look-back ends where ``d^rows`` underflows
to zero, so nothing representable is left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.functions import TRADING_DAYS
from rvpanel.operators.layout import (
    BLOCK_ROWS,
    block_table,
    blocks,
    join_blocks,
    number,
    own_rows,
    public,
)

# Rows of a super-block, whatever the block length.
SUPER_ROWS = 1 << 20

_SUMS = ["s1", "s2", "w1", "w2"]
# -ln of the smallest positive double, and ln of the largest weight allowed in a block.
_UNDERFLOW = 745.0
_MAX_LOG_WEIGHT = 115.0
_EPSILON = 1e-15


def decay(span: float) -> float:
    if span < 1:
        raise ValueError(f"span must be at least 1, got {span}")
    return 1.0 - 2.0 / (span + 1.0)


def block_rows(span: float) -> int:
    """Rows per block for this span: a power of two, at most ``BLOCK_ROWS``."""
    d = decay(span)
    limit = 1 if d == 0 else int(min(BLOCK_ROWS, _MAX_LOG_WEIGHT / -math.log(d)))
    return 1 << max(limit.bit_length() - 1, 0)


def _decays(d: float, rows: int) -> dict[str, float]:
    """What each sum loses over so many rows."""
    return {k: d ** (2 * rows if k == "w2" else rows) for k in _SUMS}


def _state_before(d: float, rows: int, keys: str, order: str) -> tuple[str, str]:
    """SQL: the sums and the count that the steps before a step leave, each step ``rows`` rows long."""
    look_back = math.ceil(_UNDERFLOW / -math.log(d) / rows) + 1
    step = _decays(d, rows)
    zero = ", ".join(f"0D AS {k}" for k in _SUMS)
    fold = ", ".join(f"acc.{k} * {step[k]!r}D + b.{k} AS {k}" for k in _SUMS)
    over = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN"
    sums = f"""aggregate(collect_list(struct({", ".join(_SUMS)})) {over} {look_back} PRECEDING AND 1 PRECEDING),
        struct({zero}), (acc, b) -> struct({fold}))"""
    return sums, f"coalesce(sum(seen) {over} UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"


def _carried(ends: DataFrame, d: float, size: int) -> DataFrame:
    """(symbol, _block, _carry, _seen_before): what all earlier blocks add to a block."""
    wide = max(SUPER_ROWS // size, 2)
    sums, seen = _state_before(d, size, "symbol, _super", "_block")
    # Composed inside super-blocks ...
    inner = ends.selectExpr("*", f"_block div {wide}L AS _super").selectExpr(
        "symbol", "_super", "_block", f"{sums} AS _local", f"{seen} AS _seen_local", *_SUMS, "seen"
    )
    # ... whose whole steps are carried along the symbol.
    step = _decays(d, size)
    last = ", ".join(f"_local.{k} * {step[k]!r}D + {k} AS {k}" for k in _SUMS)
    whole = inner.groupBy("symbol", "_super").agg(
        F.expr(f"max_by(struct({last}), _block)").alias("_whole"), F.sum("seen").alias("seen")
    )
    sums, seen = _state_before(d, wide * size, "symbol", "_super")
    starts = whole.selectExpr("symbol", "_super", "_whole.*", "seen").selectExpr(
        "symbol", "_super", f"{sums} AS _start", f"{seen} AS _seen_start"
    )
    rows = f"(_block - _super * {wide}L) * {size}L"
    aged = {k: f"pow({d!r}D, {rows}{' * 2' if k == 'w2' else ''})" for k in _SUMS}
    carry = ", ".join(f"'{k}', _local.{k} + _start.{k} * {aged[k]}" for k in _SUMS)
    both = inner.join(starts, ["symbol", "_super"])
    return both.selectExpr(
        "symbol", "_block", f"named_struct({carry}) AS _carry", "_seen_local + _seen_start AS _seen_before"
    ).where("_block IS NOT NULL")


def with_ewma(
    laid: DataFrame,
    value: str,
    span: float,
    size: int,
    alias: str,
    annualize: bool = True,
    per_symbol: DataFrame | None = None,
) -> DataFrame:
    """Add the exponentially weighted volatility of ``value`` to rows laid out in blocks
    of ``size``.  A missing value ages the weights and repeats the last result.

    ``per_symbol`` (one row per symbol) may ride along on the same block join.
    """
    d = decay(span)
    if d == 0:
        raise ValueError("span 1 weighs a single row: it has no variance")
    offset = f"(i - _block * {size}L)"
    x = f"CASE WHEN _own = _block THEN {value} END"
    terms = {"s1": "{x} * {w}", "s2": "{x} * {x} * {w}", "w1": "CASE WHEN {x} IS NOT NULL THEN {w} END"}
    terms["w2"] = terms["w1"].replace("{w}", "{w} * {w}")

    def weighted(name: str, weight: str, tail: str = "") -> str:
        return f"coalesce(sum({terms[name].format(x=f'({x})', w=weight)}){tail}, 0D)"

    # State at each block's last row, then the fold of all blocks before a block.
    at_end = f"pow({d!r}D, {size - 1} - {offset})"
    ends = block_table(
        laid, *[F.expr(weighted(k, at_end)).alias(k) for k in _SUMS], F.expr(f"count({x})").alias("seen")
    )
    carry = _carried(ends, d, size)
    if per_symbol is not None:
        carry = carry.join(per_symbol, "symbol", "left")

    so_far = " OVER (PARTITION BY symbol, _block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    growing = f"pow({d!r}D, -{offset})"
    local = laid.selectExpr(
        "*", *[f"{weighted(k, growing, so_far)} AS _{k}" for k in _SUMS], f"count({x}){so_far} AS _seen"
    )
    age, aged = f"pow({d!r}D, {offset})", f"pow({d!r}D, {offset} + 1)"
    kept = [*laid.columns, *([c for c in per_symbol.columns if c != "symbol"] if per_symbol is not None else [])]
    sums = join_blocks(local, carry).selectExpr(
        *kept,
        *[f"_{k} * {age} + _carry.{k} * {aged} AS _t_{k}" for k in ("s1", "s2", "w1")],
        f"_w2 * {age} * {age} + _carry.w2 * {aged} * {aged} AS _t_w2",
        "_seen + _seen_before AS _seen",
    )
    # Where one weight outweighs all others by more than a double can tell, there is no
    # second value and the volatility is missing.
    variance = """greatest(_t_s2 / _t_w1 - (_t_s1 / _t_w1) * (_t_s1 / _t_w1), 0D)
        * (_t_w1 * _t_w1) / (_t_w1 * _t_w1 - _t_w2)"""
    usable = f"_seen >= 2 AND _t_w1 * _t_w1 - _t_w2 > _t_w1 * _t_w1 * {_EPSILON}D"
    scale = f" * {math.sqrt(TRADING_DAYS)!r}D" if annualize else ""
    return sums.selectExpr(*kept, f"CASE WHEN {usable} THEN sqrt({variance}){scale} END AS {alias}")


def ewma_forecast(returns: DataFrame, span: float = 32.0, annualize: bool = True) -> DataFrame:
    """``pred`` per row from all returns up to it; missing on the first row."""
    if decay(span) == 0:
        return public(returns).withColumn("pred", F.lit(None).cast("double"))
    size = block_rows(span)
    laid = blocks(number(returns), size=size)
    return public(own_rows(with_ewma(laid, "r", span, size, "pred", annualize))).drop("i", "n")
