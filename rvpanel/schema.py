"""Declared schemas of every table the package reads or writes.

A *panel* is a long table keyed by ``(symbol, date)``.  ``date`` is a DATE for
daily bars or a TIMESTAMP for intraday bars; it is the only row order there is,
so every window names it.  Missing values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_STR, _DBL, _LONG, _INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()

BARS = _table(
    ("symbol", _STR),
    ("date", T.DateType()),
    ("open", _DBL),
    ("high", _DBL),
    ("low", _DBL),
    ("close", _DBL),
    ("adj_close", _DBL),
    ("volume", _LONG),
)
BASKET = _table(("symbol", _STR), ("is_target", T.BooleanType()))
RUN_PARAMS = _table(("run_id", _STR), ("key", _STR), ("value", _STR))
RUN_METRICS = _table(("run_id", _STR), ("metric", _STR), ("value", _DBL))
RUN_MODELS = _table(("run_id", _STR), ("name", _STR), ("path", _STR))
GARCH_PARAMS = _table(
    ("symbol", _STR),
    ("fold", _INT),
    ("n_obs", _LONG),
    ("mu", _DBL),
    ("omega", _DBL),
    ("alpha", _DBL),
    ("beta", _DBL),
    ("last_resid_sq", _DBL),
    ("last_variance", _DBL),
    ("log_likelihood", _DBL),
    ("start_log_likelihood", _DBL),
    ("converged", T.BooleanType()),
    ("rounds", _INT),
)

# Names of the feature columns and of the target.
FEATURES = ["log_returns", "rv_5d", "rv_20d", "rv_60d"]
TARGET = "rv_target"
