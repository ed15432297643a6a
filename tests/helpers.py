import numpy as np
import pandas as pd

PANEL = "symbol string, date date, px double"
RETURNS = "symbol string, date date, r double"


def business_days(n, start="2018-01-01"):
    return pd.bdate_range(start, periods=n).date


def frame(spark, pdf, schema, shuffle=True):
    """NaN as NULL; rows in random order over several partitions."""

    def plain(v):
        return None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v

    rows = [tuple(plain(v) for v in row) for row in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, schema)
    return df.repartition(5) if shuffle else df


def random_prices(n, symbol="AAA", seed=0, start="2018-01-01"):
    rng = np.random.default_rng(seed)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return pd.DataFrame({"symbol": symbol, "date": business_days(n, start), "px": px})


def random_returns(n, symbol="AAA", seed=0, start="2018-01-01"):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"symbol": symbol, "date": business_days(n, start), "r": rng.normal(0, 0.01, n)})


def series(df, column, symbol=None):
    """One symbol's column as a float Series in date order."""
    pdf = df.toPandas()
    if symbol is not None:
        pdf = pdf[pdf.symbol == symbol]
    pdf = pdf.sort_values("date").set_index("date")
    return pdf[column].astype(float)


def clustered_returns(n, seed=0, mu=0.05, omega=0.04, alpha=0.08, beta=0.9):
    """Simulated GARCH(1,1) returns in percent."""
    rng = np.random.default_rng(seed)
    v, e, out = omega / (1 - alpha - beta), 0.0, []
    for _ in range(n + 300):
        v = omega + alpha * e * e + beta * v
        e = np.sqrt(v) * rng.standard_normal()
        out.append(mu + e)
    return np.array(out[300:])
