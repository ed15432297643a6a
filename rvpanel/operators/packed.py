"""Sequence windows without copies: feature rows packed by block, cut into windows where they are used.

A packed row holds a (symbol, block): dates, targets and positions of its feature rows, their features in one flat array,
and in front of them the ``_lead`` feature rows before the block that its first windows reach into.
They are few, may come from several blocks where prices are missing, and are looked up by position.  So a
window is a slice (or a strided view in numpy) of an array that is stored once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rvpanel.operators.features import feature_blocks
from rvpanel.operators.folds import CALENDAR
from rvpanel.operators.layout import block_starts, number
from rvpanel.schema import FEATURES, TARGET
from rvpanel.sources.store import materialize, release

_BLOCK = ["symbol", "_block"]


def pack(
    panel: DataFrame,
    window: int,
    horizon: int = 5,
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    mode: str = "rows",
) -> DataFrame:
    """Packed feature rows of a price panel, stored: ``symbol, _block, _lead, date, y, p, f, m``.

    ``p`` is the position of each row for the folds, out of ``m``: among the symbol's own rows (``mode='rows'``) or
    the panel's dates (``'calendar'``).  ``p`` and ``f`` begin with the ``_lead`` rows, ``date`` and ``y`` do not.
    """
    rows, _ = feature_blocks(panel, horizon, (5, 20, 60))
    item = F.struct("i", "date", F.array(*features).alias("f"), F.col(target).alias("y"))
    grouped = rows.groupBy(*_BLOCK).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    plain = materialize(
        grouped.selectExpr(
            *_BLOCK,
            "CAST(size(rows) AS BIGINT) AS _count",
            "transform(rows, r -> r.date) AS date",
            "flatten(transform(rows, r -> r.f)) AS f",
            "transform(rows, r -> r.y) AS y",
        )
    )
    packed = materialize(_with_lead(_placed(plain, mode), window - 1, len(features)))
    release(plain)
    return packed


def _placed(plain: DataFrame, mode: str) -> DataFrame:
    placed = plain.join(block_starts(plain.select(*_BLOCK, "_count")), _BLOCK)
    own = "sequence(_start, _start + _count - 1)"
    if mode == "rows":
        return placed.selectExpr("*", f"{own} AS p", "n AS m")
    # Only dates are spread to rows.
    each = plain.selectExpr(*_BLOCK, "posexplode(date) AS (_k, date)")
    calendar = number(each.select("date").distinct().withColumn("symbol", F.lit(CALENDAR)))
    found = each.join(calendar.select("date", "i", F.col("n").alias("m")), "date")
    positions = found.groupBy(*_BLOCK).agg(
        F.expr("transform(sort_array(collect_list(struct(_k, i))), x -> x.i) AS p"), F.max("m").alias("m")
    )
    return placed.join(positions, _BLOCK)


def _with_lead(placed: DataFrame, reach: int, width: int) -> DataFrame:
    """The last ``reach`` rows before each block in front of its own."""
    kept = placed.select(*_BLOCK, "_start", "date", "y", "p", "f", "m")
    if not reach:
        return kept.selectExpr(*_BLOCK, "0 AS _lead", "date", "y", "p", "f", "m")
    ends = placed.selectExpr("symbol", "_start", "p", "f", f"explode(sequence(greatest(_count - {reach}, 0L), _count - 1)) AS _k")
    held = ends.selectExpr(
        "symbol",
        "_start + _k AS _at",
        f"(_start + _k) div {reach}L AS _cell",
        "get(p, int(_k)) AS _p",
        f"slice(f, int(_k) * {width} + 1, {width}) AS _f",
    )
    asked = placed.where("_start > 0").selectExpr(
        *_BLOCK, "_start", f"explode(array_distinct(array(greatest(_start - {reach}L, 0L) div {reach}L, (_start - 1L) div {reach}L))) AS _cell"
    )
    near = asked.join(held, ["symbol", "_cell"]).where(f"_at >= _start - {reach}L AND _at < _start")
    lead = near.groupBy(*_BLOCK).agg(F.sort_array(F.collect_list(F.struct("_at", "_p", "_f"))).alias("_rows"))
    return kept.join(lead, _BLOCK, "left").selectExpr(
        *_BLOCK,
        "coalesce(size(_rows), 0) AS _lead",
        "date",
        "y",
        "CASE WHEN _rows IS NULL THEN p ELSE concat(transform(_rows, r -> r._p), p) END AS p",
        "CASE WHEN _rows IS NULL THEN f ELSE concat(flatten(transform(_rows, r -> r._f)), f) END AS f",
        "m",
    )


def on_blocks(packed: DataFrame, per_symbol: DataFrame) -> DataFrame:
    """Join a table of one row per symbol.  It goes to the (symbol, block) keys first, so that a hot symbol's
    packed rows are not gathered."""
    return packed.join(packed.select(*_BLOCK).join(per_symbol, "symbol"), _BLOCK)


@dataclass
class Block:
    """A packed row in numpy.  Own rows are those from ``lead`` on."""

    symbol: str
    date: pa.Array
    y: np.ndarray
    p: np.ndarray
    f: np.ndarray
    m: int
    lead: int
    row: dict

    def ends(self, window: int, low: int, high: int) -> np.ndarray:
        """Own rows in which a window of positions in [low, high) ends, as places in ``f``."""
        at = np.arange(max(self.lead, window - 1), len(self.p))
        return at[(self.p[at - window + 1] >= low) & (self.p[at] < high)]


def read_blocks(batches: Iterator[pa.RecordBatch], width: int, others: Sequence[str] = ()) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            value = {c: batch.column(batch.schema.get_field_index(c))[i] for c in ("symbol", "date", "y", "p", "f", "m", "_lead", *others)}
            yield Block(
                value["symbol"].as_py(),
                value["date"].values,
                value["y"].values.to_numpy(),
                value["p"].values.to_numpy(),
                value["f"].values.to_numpy().reshape(-1, width),
                value["m"].as_py(),
                value["_lead"].as_py(),
                {c: value[c].as_py() for c in others},
            )


def windows_at(scaled: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Flat windows that end in the given rows, from a strided view."""
    view = np.lib.stride_tricks.sliding_window_view(scaled, (window, scaled.shape[1]))[:, 0]
    return view[ends - window + 1].reshape(len(ends), -1).astype(np.float64)
