"""Settings of a run: one flat record that the driver holds."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any

from rvpanel.schema import FEATURES, TARGET


@dataclass(frozen=True)
class Settings:
    """``folds`` test blocks of the calendar, each behind at least ``least_train`` rows; the learned model sees
    ``window`` rows of ``features`` and predicts ``target``, ``horizon`` rows ahead.

    ``learner`` is ``gbt`` (boosted trees) or ``linear``.  Boosting makes ``rounds`` trees and keeps as many as had
    the least validation error before ``patience`` rounds brought no gain.  ``side_by_side`` folds are fitted at a time.
    """

    # Defaults that results are compared under.
    horizon: int = 5
    folds: int = 5
    least_train: int = 252
    validation_share: float = 0.2
    window: int = 30
    rounds: int = 50
    patience: int = 10
    seed: int = 42
    # Own choices.
    learner: str = "gbt"
    depth: int = 3
    step_size: float = 0.1
    side_by_side: int = 5
    features: tuple[str, ...] = tuple(FEATURES)
    target: str = TARGET

    def recorded(self) -> dict[str, str]:
        """Names and values as text, as they are kept with a run."""
        values = {f.name: getattr(self, f.name) for f in fields(self)}
        return {name: ",".join(v) if isinstance(v, tuple) else str(v) for name, v in values.items()}


def settings_from(values: Mapping[str, Any]) -> Settings:
    """Settings with some values given; an unknown name is a TypeError."""
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
