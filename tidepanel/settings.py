"""Tunable thresholds of the monitoring and retraining policy."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults of the policy.
    min_train_rows: int = 150
    min_train_dates: int = 20
    min_valid_rows: int = 30
    train_fraction: float = 0.80
    error_window: int = 200
    alert_window: int = 50
    retrain_mae_multiplier: float = 1.25
    rollback_mae_multiplier: float = 1.15
    retrain_mape_threshold: float = 0.20
    psi_threshold: float = 0.20
    psi_severe_threshold: float = 0.30
    retrain_streak: int = 3
    rollback_streak: int = 2
    retrain_min_new_rows: int = 100
    retrain_schedule_days: int = 14
    retrain_schedule_min_rows: int = 150
    retrain_cooldown_days: int = 3
    accept_ratio: float = 0.98
    unset_baseline_mae: float = 999999.0
    expected_entities: int = 7


DEFAULTS = Settings()
