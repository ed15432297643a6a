import pytest

from rvpanel.config import Settings, settings_from


def test_defaults():
    s = Settings()
    assert (s.horizon, s.folds, s.least_train, s.validation_share) == (5, 5, 252, 0.2)
    assert (s.window, s.rounds, s.patience, s.seed) == (30, 50, 10, 42)


def test_given_values_keep_other_defaults():
    s = settings_from({"folds": 3, "features": ["rv_5d"]})
    assert s.folds == 3 and s.least_train == 252 and s.features == ("rv_5d",)


def test_unknown_names_are_errors():
    with pytest.raises(TypeError):
        settings_from({"n_folds": 3})


def test_recorded():
    kept = settings_from({"horizon": 7}).recorded()
    assert kept["horizon"] == "7" and kept["seed"] == "42" and kept["features"] == "log_returns,rv_5d,rv_20d,rv_60d"
