"""GARCH(1,1) with constant mean and normal errors, fitted by maximum likelihood.

``v_t = omega + alpha * e_(t-1)^2 + beta * v_(t-1)`` on returns in percent.  The sum over
time is all that needs data; it splits over blocks of rows, because a block's variances
are ``own_t + beta^(t+1) * v_before``.  Two ways use the same search:

* ``fit``: panels with a DATE column.  Dates are unique, so one symbol's returns are a few
  thousand numbers (a DATE cannot hold more than 3.7 million) and one task fits one fold of
  a symbol.
* ``fit_by_rounds``: panels with timestamps, whatever their size.  Every search round is a
  Spark job over (symbol, block); a row per block, fold and round is shuffled.

The borders alpha = 0 and beta = 0 are ordinary points of the search's coordinates, so
fits that end there end.  ``converged`` and ``rounds`` report how a search ended; a fit that did
not converge gives no forecast.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rvpanel.functions import annualized
from rvpanel.operators.folds import bounds_of_counts
from rvpanel.operators.layout import BLOCK_ROWS, blocks
from rvpanel.schema import GARCH_PARAMS
from rvpanel.sources.store import materialize, release

# The functions below travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The pre-sample variance is a weighted mean of the first squared residuals.
BACKCAST_ROWS = 75
BACKCAST_DECAY = 0.94

_PERCENT = 100.0
_STEP = 1e-3
# Smallest gain worth a round, relative to the log-likelihood; a line search that fails
# where more than _STUCK was expected is no convergence.
_TOLERANCE = 1e-9
_STUCK = 1e-3
# Beyond it a search is reported as not converged.
MAX_ROUNDS = 200
_LOWER = np.array([-5.0, -25.0, -10.0, -10.0])
_UPPER = np.array([5.0, 5.0, 10.0, 10.0])
# Largest alpha + beta.
_PERSISTENCE = 0.99999
# Blocks whose variances one task chains.
_SUPER = 256
_LINE = np.array([2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.003, 0.001, 1e-4, 1e-5])


# --- likelihood of one block of rows, for many candidates at once ---------------------


def _scan(u: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """``y_t = beta * y_(t-1) + u_t`` from zero, by doubling the span of the sum."""
    y = u.copy()
    factor, reach = beta[:, None].copy(), 1
    while reach < y.shape[1] and factor.max() > 1e-300:
        shifted = y[:, :-reach] * factor
        y[:, reach:] += shifted
        factor, reach = factor * factor, reach * 2
    return y


def block_variances(
    theta: np.ndarray, r: np.ndarray, r_before: float | None, backcast: float, v_before: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Squared residuals and variances, candidates x rows; ``theta`` rows are
    (mu, omega, alpha, beta).  ``r_before`` is None at the start of the series."""
    mu, omega, alpha, beta = (theta[:, [k]] for k in range(4))
    squared = (r[None, :] - mu) ** 2
    first = np.full_like(mu, backcast) if r_before is None else (r_before - mu) ** 2
    lagged = np.hstack([first, squared[:, :-1]])
    v = _scan(omega + alpha * lagged, theta[:, 3])
    v += beta ** np.arange(1, r.size + 1)[None, :] * v_before[:, None]
    return squared, v


def _log_likelihood(squared: np.ndarray, v: np.ndarray) -> np.ndarray:
    return -0.5 * (math.log(2 * math.pi) * v.shape[1] + (np.log(v) + squared / v).sum(axis=1))


def series_log_likelihood(theta: np.ndarray, r: np.ndarray, backcast: float):
    """Total log-likelihood per candidate, last squared residual and last variance."""
    v_before = np.full(len(theta), backcast)
    total, r_before = np.zeros(len(theta)), None
    for at in range(0, r.size, BLOCK_ROWS):
        part = r[at : at + BLOCK_ROWS]
        squared, v = block_variances(theta, part, r_before, backcast, v_before)
        total += _log_likelihood(squared, v)
        v_before, r_before = v[:, -1], part[-1]
    return total, squared[:, -1], v_before


def backcast_variance(first_rows: np.ndarray, mean: float) -> float:
    e = (first_rows[:BACKCAST_ROWS] - mean) ** 2
    weight = BACKCAST_DECAY ** np.arange(e.size)
    return float((e * weight).sum() / weight.sum())


# --- search: Newton steps on unconstrained coordinates --------------------------------
# Coordinates: mean (in standard deviations from the sample mean), log of the long-run over the
# sample variance (omega / (1 - alpha - beta) / variance), and angles u, t with alpha + beta = _PERSISTENCE * sin(u)^2, alpha / (alpha + beta) = sin(t)^2.
# At a border an angle's slope is zero, so a maximum there is a stationary point like any other.


def to_theta(phi: np.ndarray, mean: float, variance: float) -> np.ndarray:
    persistence = _PERSISTENCE * np.sin(phi[:, 2]) ** 2
    share = np.sin(phi[:, 3]) ** 2
    return np.column_stack(
        [
            mean + phi[:, 0] * math.sqrt(variance),
            variance * np.exp(phi[:, 1]) * (1 - persistence),
            persistence * share,
            persistence * (1 - share),
        ]
    )


def _starts() -> np.ndarray:
    rows = []
    for persistence in (0.3, 0.6, 0.8, 0.9, 0.97, 0.99):
        for share in (0.03, 0.08, 0.2, 0.5):
            rows.append([0.0, 0.0, *_angles(persistence, share)])
    return np.array(rows)


def _angles(persistence: float, share: float) -> tuple[float, float]:
    return math.asin(math.sqrt(persistence / _PERSISTENCE)), math.asin(math.sqrt(share))


_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def _stencil(centre: np.ndarray) -> np.ndarray:
    eye = np.eye(4) * _STEP
    points = [centre]
    for a in range(4):
        points += [centre + eye[a], centre - eye[a]]
    for a, b in _PAIRS:
        points += [centre + eye[a] + eye[b], centre + eye[a] - eye[b]]
        points += [centre - eye[a] + eye[b], centre - eye[a] - eye[b]]
    return np.array(points)


def _newton_direction(ll: np.ndarray) -> tuple[np.ndarray, float]:
    gradient = (ll[1:9:2] - ll[2:9:2]) / (2 * _STEP)
    hessian = np.diag((ll[1:9:2] - 2 * ll[0] + ll[2:9:2]) / _STEP**2)
    for k, (a, b) in enumerate(_PAIRS):
        pp, pm, mp, mm = ll[9 + 4 * k : 13 + 4 * k]
        hessian[a, b] = hessian[b, a] = (pp - pm - mp + mm) / (4 * _STEP**2)
    values, vectors = np.linalg.eigh(hessian)
    slope = vectors.T @ gradient
    # Climb along every axis, whatever its curvature; flat axes are damped.
    step = slope / np.maximum(np.abs(values), max(1e-7 * np.abs(values).max(), 0.02))
    gain = 0.5 * float((slope * step).sum())
    direction = vectors @ step
    length = np.linalg.norm(direction)
    return (direction * (1.5 / length) if length > 1.5 else direction), gain


def new_search() -> dict:
    zero = [0.0] * 4
    return {
        "phase": "start", "phi": zero, "direction": zero, "ll": -math.inf, "start_ll": -math.inf, "gain": 0.0, "rounds": 0,
    }


def is_open(state: dict) -> bool:
    return state["phase"] in ("start", "stencil", "line") and state["rounds"] < MAX_ROUNDS


def candidates(state: dict) -> np.ndarray:
    phi = np.array(state["phi"], dtype=float)
    if state["phase"] == "start":
        return _starts()
    if state["phase"] == "stencil":
        return _stencil(phi)
    if state["phase"] == "line":
        return np.clip(phi + _LINE[:, None] * np.array(state["direction"]), _LOWER, _UPPER)
    return phi[None, :]


def advance(state: dict, ll: np.ndarray) -> dict:
    """Next search state from the log-likelihoods of ``candidates(state)``."""
    ll = np.where(np.isfinite(ll), ll, -1e300)
    tried, best = candidates(state), int(np.argmax(ll))
    phase, state = state["phase"], {**state, "rounds": state["rounds"] + 1}
    if phase == "start":
        return {**state, "phase": "stencil", "phi": tried[best].tolist(), "ll": ll[best], "start_ll": ll[best]}
    if phase == "stencil":
        direction, gain = _newton_direction(ll)
        following = "line" if gain > _TOLERANCE * max(1.0, abs(ll[0])) else "done"
        return {**state, "phase": following, "direction": direction.tolist(), "ll": ll[0], "gain": gain}
    if phase == "line":
        if ll[best] <= state["ll"] + _TOLERANCE * max(1.0, abs(state["ll"])):
            return {**state, "phase": "done" if state["gain"] < _STUCK else "stuck"}
        return {**state, "phase": "stencil", "phi": tried[best].tolist(), "ll": ll[best]}
    return state


def fit_series(r: np.ndarray) -> dict | None:
    """Fit one return series (in percent); None if it has no variance."""
    mean, variance = float(r.mean()), float(r.var())
    if r.size < 2 or not variance > 0:
        return None
    backcast = backcast_variance(r, mean)
    state = new_search()
    while is_open(state):
        theta = to_theta(candidates(state), mean, variance)
        state = advance(state, series_log_likelihood(theta, r, backcast)[0])
    theta = to_theta(np.array([state["phi"]]), mean, variance)
    ll, squared, v = series_log_likelihood(theta, r, backcast)
    mu, omega, alpha, beta = theta[0]
    return {
        "mu": mu,
        "omega": omega,
        "alpha": alpha,
        "beta": beta,
        "last_resid_sq": squared[0],
        "last_variance": v[0],
        "log_likelihood": ll[0],
        "start_log_likelihood": state["start_ll"],
        "converged": state["phase"] == "done",
        "rounds": state["rounds"],
    }


# --- Spark ------------------------------------------------------------------------------


def packed_blocks(numbered: DataFrame, before: int = 0) -> DataFrame:
    """One row per (symbol, block) with its returns in percent, in row order."""
    pairs = F.sort_array(F.collect_list(F.struct("i", (F.col("r") * _PERCENT).alias("r"))))
    laid = blocks(numbered.select("symbol", "r", "i", "n"), before=before, size=BLOCK_ROWS)
    packed = laid.groupBy("symbol", "_block").agg(
        pairs.alias("_pairs"), F.max("n").alias("n"), F.min("i").alias("_first")
    )
    return packed.select(
        "symbol", F.col("_block").alias("block"), "n", F.col("_first").alias("first"), F.col("_pairs.r").alias("rs")
    )


def is_daily(df: DataFrame) -> bool:
    return isinstance(df.schema["date"].dataType, T.DateType)


def garch_params(
    numbered: DataFrame, n_splits: int = 5, horizon: int = 5, min_train_size: int = 252
) -> DataFrame:
    """Fitted parameters per symbol and fold, from numbered returns (symbol, date, r, i, n).

    Panels with a DATE column are fitted lazily, one task a fold; panels with timestamps by
    rounds over blocks.
    """
    way = fit if is_daily(numbered) else fit_by_rounds
    return way(numbered, n_splits, horizon, min_train_size)


def fit(numbered: DataFrame, n_splits: int, horizon: int, min_train_size: int) -> DataFrame:
    columns = GARCH_PARAMS.names

    def fit_fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        train_end = int(pdf["train_end"].iloc[0])
        found = fit_series(np.concatenate(pdf["rs"].to_list())[:train_end])
        rows = [{"symbol": key[0], "fold": key[1], "n_obs": train_end, **found}] if found else []
        return pd.DataFrame(rows, columns=columns)

    size = f"(n div {n_splits + 1}L)"
    per_fold = (
        packed_blocks(numbered)
        .where(f"{size} > 0 AND n - {horizon}L - {n_splits}L * {size} > 0")
        .selectExpr("*", f"explode(sequence(0, {n_splits - 1})) AS fold")
        .selectExpr("symbol", "fold", "block", "rs", f"n - ({n_splits}L - fold) * {size} - {horizon}L AS train_end")
        .where(f"train_end >= {min_train_size}L AND block * {BLOCK_ROWS}L < train_end")
    )
    # A fit costs far more time than its bytes suggest, so the number of tasks is given and
    # adaptive execution does not merge them.
    tasks = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = per_fold.repartition(tasks, "symbol", "fold")
    return spread.groupBy("symbol", "fold").applyInPandas(fit_fold, GARCH_PARAMS)


_STATE = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("train_end", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("variance", T.DoubleType()),
        T.StructField("backcast", T.DoubleType()),
        T.StructField("phase", T.StringType()),
        T.StructField("phi", T.ArrayType(T.DoubleType())),
        T.StructField("direction", T.ArrayType(T.DoubleType())),
        T.StructField("ll", T.DoubleType()),
        T.StructField("start_ll", T.DoubleType()),
        T.StructField("gain", T.DoubleType()),
        T.StructField("rounds", T.IntegerType()),
    ]
)
_ENDS = "symbol string, fold int, block long, ends array<double>, factors array<double>, backcast double"
_CARRIED = "symbol string, fold int, block long, v_before array<double>"
_PARTS = "symbol string, fold int, ll array<double>, last_sq double, last_v double"


def _block_inputs(row) -> tuple[np.ndarray, float | None, dict, np.ndarray]:
    """Returns of the block that belong to the fold, the return before it, and thetas."""
    rs = np.asarray(row.rs, dtype=float)
    start = row.block * BLOCK_ROWS
    r_before = rs[0] if row.first < start else None
    own = rs[start - row.first :][: max(row.train_end - start, 0)]
    state = {"phase": row.phase, "phi": row.phi, "direction": row.direction}
    return own, r_before, state, to_theta(candidates(state), row.mean, row.variance)


def _block_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples():
            r, r_before, _, theta = _block_inputs(row)
            _, v = block_variances(theta, r, r_before, row.backcast, np.zeros(len(theta)))
            factors = theta[:, 3] ** r.size
            out.append((row.symbol, row.fold, row.block, v[:, -1].tolist(), factors.tolist(), row.backcast))
        yield pd.DataFrame(out, columns=["symbol", "fold", "block", "ends", "factors", "backcast"])


def _block_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples():
            r, r_before, _, theta = _block_inputs(row)
            v_before = np.asarray(row.v_before, dtype=float)
            squared, v = block_variances(theta, r, r_before, row.backcast, v_before)
            ll = _log_likelihood(squared, v).tolist()
            is_last = row.block == (row.train_end - 1) // BLOCK_ROWS
            last = (squared[0, -1], v[0, -1]) if is_last else (None, None)
            out.append((row.symbol, row.fold, ll, *last))
        yield pd.DataFrame(out, columns=["symbol", "fold", "ll", "last_sq", "last_v"])


def _chained(pdf: pd.DataFrame, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Variance before each block and after the last, from the variance before the first."""
    v, before = start, []
    for ends, factors in zip(pdf["ends"], pdf["factors"]):
        before.append(v)
        v = np.asarray(factors) * v + np.asarray(ends)
    return before, v


def _composed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks of a super-block as one affine step: a block's step is ``factors * v + ends``."""
    pdf = pdf.sort_values("block")
    _, ends = _chained(pdf, np.zeros(len(pdf["ends"].iloc[0])))
    factors = np.prod(np.array(pdf["factors"].to_list()), axis=0)
    row = [key[0], key[1], key[2], ends.tolist(), factors.tolist(), pdf["backcast"].iloc[0]]
    return pd.DataFrame([row], columns=["symbol", "fold", "block", "ends", "factors", "backcast"])


def _from_backcast(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Variance before each super-block of a fold: one short vector per 256 blocks."""
    pdf = pdf.sort_values("block")
    before, _ = _chained(pdf, np.full(len(pdf["ends"].iloc[0]), pdf["backcast"].iloc[0]))
    return pd.DataFrame({"symbol": key[0], "fold": key[1], "super": pdf["block"].to_numpy(), "start": [b.tolist() for b in before]})


def _from_start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    before, _ = _chained(pdf, np.asarray(pdf["start"].iloc[0], dtype=float))
    return pd.DataFrame({"symbol": key[0], "fold": key[1], "block": pdf["block"].to_numpy(), "v_before": [b.tolist() for b in before]})


def _carried(ends: DataFrame) -> DataFrame:
    """Variance before each block, in two levels, so that no task takes all blocks of a series."""
    laid = ends.withColumn("super", F.expr(f"block div {_SUPER}L"))
    steps = laid.groupBy("symbol", "fold", "super").applyInPandas(_composed, _ENDS)
    starts = steps.groupBy("symbol", "fold").applyInPandas(_from_backcast, "symbol string, fold int, super long, start array<double>")
    return laid.join(starts, ["symbol", "fold", "super"]).groupBy("symbol", "fold", "super").applyInPandas(_from_start, _CARRIED)


def _on_blocks(packed: DataFrame, per_fold: DataFrame) -> DataFrame:
    """Blocks that hold train rows of a fold, with the fold's row.  The small table goes
    to (symbol, block) first, so a hot symbol's blocks are not gathered."""
    keys = packed.select("symbol", "block").join(per_fold, "symbol")
    return packed.join(keys.where(F.col("block") * BLOCK_ROWS < F.col("train_end")), ["symbol", "block"])


def _likelihoods(packed: DataFrame, states: DataFrame) -> DataFrame:
    """Log-likelihood of each state's candidates, added up over the symbol's blocks."""
    work = _on_blocks(packed, states).select("symbol", "fold", "block", "first", "rs", *_STATE.names[2:])
    ends = work.mapInPandas(_block_ends, _ENDS)
    parts = work.join(_carried(ends), ["symbol", "fold", "block"]).mapInPandas(_block_parts, _PARTS)
    per_candidate = parts.select("symbol", "fold", "last_sq", "last_v", F.posexplode("ll").alias("_at", "_ll"))
    summed = per_candidate.groupBy("symbol", "fold", "_at").agg(
        F.sum("_ll").alias("_ll"), F.max("last_sq").alias("last_sq"), F.max("last_v").alias("last_v")
    )
    return summed.groupBy("symbol", "fold").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "_ll"))), lambda p: p["_ll"]).alias("lls"),
        F.max("last_sq").alias("last_sq"),
        F.max("last_v").alias("last_v"),
    )


def _advance_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            out.append({**row, **advance(row, np.asarray(row["lls"], dtype=float))})
        yield pd.DataFrame(out, columns=_STATE.names)


def _states(packed: DataFrame, bounds: DataFrame, phase: str, phi: list[float]) -> DataFrame:
    """Search state of each (symbol, fold, train_end): moments and backcast of the train
    rows, added up from blocks, and a starting point."""
    offset = f"int(greatest(block * {BLOCK_ROWS}L - first, 0L)) + 1"
    length = f"int(least({BLOCK_ROWS}L, train_end - block * {BLOCK_ROWS}L))"
    own = f"slice(rs, {offset}, {length})"
    total = "aggregate(rs, 0D, (a, x) -> a + x)"
    train = _on_blocks(packed, bounds).selectExpr("symbol", "fold", "train_end", f"{own} AS rs")
    means = train.groupBy("symbol", "fold", "train_end").agg(F.expr(f"sum({total}) / train_end").alias("mean"))

    weight = f"pow({BACKCAST_DECAY}D, k)"
    squares = f"transform({own}, x -> (x - mean) * (x - mean))"
    head = f"slice(sq, 1, {BACKCAST_ROWS})"
    backcast = f"""aggregate(transform({head}, (x, k) -> x * {weight}), 0D, (a, x) -> a + x)
        / aggregate(transform({head}, (x, k) -> {weight}), 0D, (a, x) -> a + x)"""
    second = _on_blocks(packed, means).selectExpr("symbol", "fold", "train_end", "mean", "block", f"{squares} AS sq")
    fresh = new_search()
    zero = F.array(*[F.lit(0.0)] * 4)
    return (
        second.groupBy("symbol", "fold", "train_end", "mean")
        .agg(
            F.expr("sum(aggregate(sq, 0D, (a, x) -> a + x)) / train_end").alias("variance"),
            F.expr(f"max(CASE WHEN block = 0 THEN {backcast} END)").alias("backcast"),
        )
        .where("variance > 0")
        .withColumns(
            {
                "phase": F.lit(phase),
                "phi": F.array(*[F.lit(float(x)) for x in phi]),
                "direction": zero,
                "ll": F.lit(fresh["ll"]),
                "start_ll": F.lit(fresh["start_ll"]),
                "gain": F.lit(0.0),
                "rounds": F.lit(0),
            }
        )
        .select(*_STATE.names)
    )


def _fitted(states: DataFrame, packed: DataFrame) -> DataFrame:
    """Parameters, last residual and variance, and likelihood at each state's point."""
    final = states.withColumns({"converged": F.col("phase") == "done", "phase": F.lit("done")})
    persistence, share = f"({_PERSISTENCE}D * pow(sin(phi[2]), 2))", "pow(sin(phi[3]), 2)"
    return final.join(_likelihoods(packed, final), ["symbol", "fold"]).selectExpr(
        "symbol",
        "fold",
        "train_end AS n_obs",
        "mean + phi[0] * sqrt(variance) AS mu",
        f"variance * exp(phi[1]) * (1D - {persistence}) AS omega",
        f"{persistence} * {share} AS alpha",
        f"{persistence} * (1D - {share}) AS beta",
        "last_sq AS last_resid_sq",
        "last_v AS last_variance",
        "lls[0] AS log_likelihood",
        "start_ll AS start_log_likelihood",
        "converged",
        "rounds",
    )


def fit_by_rounds(numbered: DataFrame, n_splits: int, horizon: int, min_train_size: int) -> DataFrame:
    """Fit series of any length.  Runs jobs: one per search round, each reading the packed
    blocks from the shared folder, until every search has ended."""
    packed = materialize(packed_blocks(numbered, before=1))
    counts = packed.groupBy("symbol").agg(F.max("n").alias("n"))
    bounds = bounds_of_counts(counts, n_splits, horizon, min_train_size).select("symbol", "fold", "train_end")
    fresh = new_search()
    states = materialize(_states(packed, bounds, fresh["phase"], fresh["phi"]))
    searching = F.col("phase").isin("start", "stencil", "line") & (F.col("rounds") < MAX_ROUNDS)
    while not states.where(searching).isEmpty():
        open_ones = states.where(searching)
        scored = open_ones.join(_likelihoods(packed, open_ones), ["symbol", "fold"])
        moved = scored.select(*_STATE.names, "lls").mapInPandas(_advance_states, _STATE)
        before, states = states, materialize(states.where(~searching).unionByName(moved))
        release(before)
    return _fitted(states, packed)


def garch_likelihood(numbered: DataFrame, alpha: float, beta: float, omega_share: float) -> DataFrame:
    """Log-likelihood of each symbol's whole series at its mean, ``alpha``, ``beta`` and
    ``omega = omega_share * variance``; evaluated block by block, for any length."""
    packed = materialize(packed_blocks(numbered, before=1))
    whole = packed.groupBy("symbol").agg(F.max("n").alias("train_end")).withColumn("fold", F.lit(0))
    point = [0.0, math.log(omega_share / (1 - alpha - beta)), *_angles(alpha + beta, alpha / (alpha + beta))]
    states = _states(packed, whole, "done", point)
    return _fitted(states, packed).select("symbol", "n_obs", "log_likelihood", "last_variance")


def horizon_volatility(horizon: int, annualize: bool = True) -> Column:
    """Forecast volatility from a parameter row: root of the mean of the next ``horizon``
    variance forecasts, back from percent."""
    first = F.col("omega") + F.col("alpha") * F.col("last_resid_sq") + F.col("beta") * F.col("last_variance")
    begin = F.struct(first.alias("v"), first.alias("total"))

    def step(acc: Column, _: Column) -> Column:
        v = F.col("omega") + (F.col("alpha") + F.col("beta")) * acc["v"]
        return F.struct(v.alias("v"), (acc["total"] + v).alias("total"))

    later = F.array_repeat(F.lit(0), horizon - 1)
    total = F.aggregate(later, begin, step)["total"]
    return annualized(F.sqrt(total / F.lit(float(horizon)) / F.lit(_PERCENT**2)), annualize)


def garch_forecast(params: DataFrame, horizon: int = 5, annualize: bool = True) -> DataFrame:
    """One forecast per symbol and fold; it holds for all test dates of the fold.  NULL where the fit
    did not converge."""
    pred = horizon_volatility(horizon, annualize)
    if "converged" in params.columns:
        pred = F.when(F.col("converged"), pred)
    return params.select("symbol", "fold", pred.alias("pred"))
