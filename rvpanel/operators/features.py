"""Returns, realized volatility, targets and sequence windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.functions import annualized, log_return, rolling_std
from rvpanel.operators.layout import (
    block_window,
    blocks,
    keyed,
    number,
    number_changes,
    own_rows,
    public,
    renumber,
    with_previous,
)
from rvpanel.schema import FEATURES, TARGET


def returns_rows(panel: DataFrame, strict: bool = False) -> DataFrame:
    """``log_returns`` with the working columns kept, for operators that go on."""
    rows = with_previous(keyed(panel.select("symbol", "date", "px"), strict), "px", "_prev")
    return rows.withColumn("r", log_return("px", F.col("_prev"))).drop("_prev")


def log_returns(panel: DataFrame, strict: bool = False) -> DataFrame:
    """``r = ln(px_t / px_(t-1))`` per symbol; the first row has none and is kept.  Rows without symbol or
    date are left out (``layout.missing_keys`` counts them), or an error with ``strict``."""
    return public(returns_rows(panel, strict))


def numbered_returns(panel: DataFrame, strict: bool = False) -> DataFrame:
    """The returns a symbol has, numbered: (symbol, date, px, r, i, n).  What evaluation
    starts from."""
    return number_changes(
        keyed(panel.select("symbol", "date", "px"), strict), "px", lambda p, q: f"ln(try_divide({p}, {q}))", "r"
    )


def realized_vol(returns: DataFrame, window: int, annualize: bool = True, alias: str = "rv") -> DataFrame:
    """Standard deviation of the last ``window`` returns, current row included."""
    laid = blocks(number(returns), before=window - 1)
    vol = rolling_std("r", window, block_window(), -(window - 1), 0)
    return _finish(laid.withColumn(alias, annualized(vol, annualize)))


def realized_vol_target(
    returns: DataFrame, horizon: int, annualize: bool = True, alias: str = TARGET
) -> DataFrame:
    """Standard deviation of the next ``horizon`` returns, current row excluded."""
    laid = blocks(number(returns), after=horizon)
    vol = rolling_std("r", horizon, block_window(), 1, horizon)
    return _finish(laid.withColumn(alias, annualized(vol, annualize)))


def naive_forecast(returns: DataFrame, horizon: int, annualize: bool = True) -> DataFrame:
    """The last ``horizon`` rows' volatility as the forecast for the next ones."""
    return realized_vol(returns, horizon, annualize, alias="pred")


def shift(df: DataFrame, column: str, **rows: int) -> DataFrame:
    """Values of ``column`` from other rows of the symbol: ``back=1`` adds a column ``back``
    from one row earlier, ``ahead=-5`` one from five rows later."""
    laid = blocks(number(df), before=max(0, *rows.values()), after=max(0, *(-k for k in rows.values())))
    return _finish(laid.withColumns({alias: F.lag(column, k).over(block_window()) for alias, k in rows.items()}))


def feature_blocks(panel: DataFrame, horizon: int, windows: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """Rows of the feature frame in the blocks they were computed in, and the names of its columns."""
    # The oldest return in a frame needs the price one row before it.
    laid = blocks(number(panel.select("symbol", "date", "px")), before=max(windows), after=horizon)
    w = block_window()
    laid = laid.withColumn("log_returns", log_return("px", F.lag("px").over(w)))
    rolled = {
        f"rv_{n}d": annualized(rolling_std("log_returns", n, w, -(n - 1), 0)) for n in windows
    }
    target = annualized(rolling_std("log_returns", horizon, w, 1, horizon))
    columns = ["log_returns", *rolled, TARGET]
    frame = own_rows(laid.withColumns({**rolled, TARGET: target}))
    return frame.dropna("any", subset=columns), columns


def build_features(panel: DataFrame, horizon: int = 5, windows: Sequence[int] = (5, 20, 60)) -> DataFrame:
    """Return, rolling volatilities and target per row; rows lacking any are dropped."""
    frame, columns = feature_blocks(panel, horizon, windows)
    return frame.select("symbol", "date", *columns)


def feature_rows(panel: DataFrame, horizon: int = 5, windows: Sequence[int] = (5, 20, 60)) -> DataFrame:
    """The same rows, numbered (``i`` of ``n``) and still in the blocks they were computed in, for operators
    that go on: sequence windows and scaling do not lay them out again."""
    frame, columns = feature_blocks(panel, horizon, windows)
    return renumber(frame.select("symbol", "date", *columns, "i", "_block"))


def sequence_windows(
    frame: DataFrame,
    seq_len: int,
    feature_cols: Sequence[str] = FEATURES,
    target_col: str = TARGET,
) -> DataFrame:
    """The last ``seq_len`` rows of features as a float matrix ``x``, one row per full
    window, keyed by the window's last date; ``y`` is the target of that last row.

    ``frame`` is a feature frame, or the stored blocks of :func:`rvpanel.operators.packed.pack`, which are cut
    into windows where they lie.
    """
    if "_lead" in frame.columns:
        return _cut_windows(frame, seq_len, len(feature_cols))
    laid = blocks(number(frame), before=seq_len - 1)
    step = F.array(*[F.col(c).cast("float") for c in feature_cols])
    x = F.collect_list(step).over(block_window().rowsBetween(-(seq_len - 1), 0))
    rows = own_rows(laid.withColumn("x", x)).where(F.col("i") >= seq_len - 1)
    return rows.select("symbol", "date", "x", F.col(target_col).cast("float").alias("y"))


def _cut_windows(packed: DataFrame, seq_len: int, width: int) -> DataFrame:
    """Slices of the packed rows; a block's leading rows are those before it."""
    step = f"slice(g, (_lead + k - {seq_len - 1} + j) * {width} + 1, {width})"
    window = f"struct(get(date, k) AS date, transform(sequence(0, {seq_len - 1}), j -> {step}) AS x, float(get(y, k)) AS y)"
    whole = f"filter(sequence(0, size(date) - 1), k -> _lead + k >= {seq_len - 1})"
    # The array is cast once, as the argument of a function, not once a window.
    cut = f"get(transform(array(CAST(f AS array<float>)), g -> transform({whole}, k -> {window})), 0)"
    return packed.selectExpr("symbol", f"inline({cut})")


def _finish(laid: DataFrame) -> DataFrame:
    return public(own_rows(laid)).drop("i", "n")
