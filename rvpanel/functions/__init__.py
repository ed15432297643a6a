from rvpanel.functions.columns import (  # noqa: F401
    TRADING_DAYS,
    annualized,
    bad_volatility,
    clean_double,
    log_return,
    mae,
    qlike,
    rmse,
    rolling_std,
    safe_name,
)
