"""Model registry transitions: train a candidate, accept or reject it, roll back."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from tidepanel.operators.features import event_vocabulary, training_frame
from tidepanel.operators.normalize import normalize_events
from tidepanel.operators.policy import acceptance, rollback
from tidepanel.plans.model import Learner, TrainedModel, load, train
from tidepanel.settings import DEFAULTS, Settings
from tidepanel.sources import schemas as S
from tidepanel.sources.state import StateStore


def _job(store: StateStore, batch: int, reason: str, old: str | None, new: str | None, status: str, details: dict) -> None:
    row = [(reason, old, new, status, json.dumps(details))]
    frame = store.spark.createDataFrame(
        row, "trigger_reason STRING, old_version STRING, new_version STRING, status STRING, details_json STRING"
    )
    store.jobs.append(frame.withColumn("created_at", F.current_timestamp()), batch)


def active_entry(store: StateStore, upto: int | None = None):
    """The active registry row (one at most) as of a batch, or None."""
    rows = store.registry.current(upto).filter(F.col("status") == "active").limit(1).collect()
    return rows[0] if rows else None


def active_model(store: StateStore) -> TrainedModel | None:
    entry = active_entry(store)
    return load(store.spark, entry["artifact_path"]) if entry else None


def retrain(
    store: StateStore,
    history: DataFrame,
    batch: int,
    reason: str = "manual",
    events: DataFrame | None = None,
    regimes: DataFrame | None = None,
    features: Sequence[str] = S.FEATURE_CONTRACT,
    learner: Learner = Learner(),
    settings: Settings = DEFAULTS,
    version: str | None = None,
    commit: bool = True,
) -> dict:
    """One candidate through training and the champion gate; registry, job and result are recorded.

    The champion is the one before the batch, and the version is named after the batch, so that a
    second run of a batch leaves what the first left. With ``commit`` an accepted candidate becomes
    the active model of the state as well.
    """
    version = version or f"gbt_demand_{batch}"
    kinds = event_vocabulary(normalize_events(events)) if events is not None else []
    frame = training_frame(history, events, regimes, features, kinds=kinds or None)
    path = f"{store.root}/models/{version}"
    model, code = train(frame, features, version, path, learner, settings, kinds)
    if model is None:
        return {"accepted": False, "reason": code}
    champion = active_entry(store, batch - 1)
    accepted = bool(
        store.spark.range(1).select(
            acceptance(F.lit(model.mae), F.lit(champion["mae"] if champion else None).cast("double"), settings).alias("ok")
        ).first()["ok"]
    )
    now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    rows = [(version, "active" if accepted else "archived", path, model.mae, model.rmse, list(features), now)]
    if accepted and champion:
        rows.append((champion["version"], "archived", champion["artifact_path"], champion["mae"],
                     champion["rmse"], champion["feature_columns"], champion["created_at"]))
    store.registry.append(store.spark.createDataFrame(rows, S.REGISTRY), batch)
    old = champion["version"] if champion else None
    _job(store, batch, reason, old, version, "accepted" if accepted else "rejected",
         {"mae": model.mae, "rmse": model.rmse})
    result = {
        "accepted": accepted, "version": version, "mae": model.mae, "rmse": model.rmse, "old_version": old,
        "reason": "activated" if accepted else "candidate_rejected", "model": model,
    }
    if accepted and commit:
        store.set_state(accepted_state(result, int(store.state_values(batch - 1)["sim_day"])), batch)
    return result


def accepted_state(result: dict, sim_day: int) -> dict[str, str]:
    """State written when a candidate becomes active; without a predecessor it is its own fallback."""
    return {
        "active_model_version": result["version"],
        "active_baseline_mae": str(result["mae"]),
        "last_stable_version": result["old_version"] or result["version"],
        "last_retrain_sim_day": str(sim_day),
        "rows_since_last_retrain": "0",
        "consecutive_perf_drift": "0",
        "consecutive_rollback_drift": "0",
    }


def rollback_to_stable(store: StateStore, batch: int) -> dict:
    """Reactivate the last stable version as of the batch before; the reason says why not where that is impossible."""
    stable = store.state_values(batch - 1).get("last_stable_version") or None
    registry = store.registry.current(batch - 1).withColumn("last_stable_version", F.lit(stable).cast("string"))
    moved = rollback(registry)
    facts = moved.select("rolled_back", "reason").limit(1).collect()
    if not facts or not facts[0]["rolled_back"]:
        return {"rolled_back": False, "reason": facts[0]["reason"] if facts else "no_stable_version"}
    before = active_entry(store, batch - 1)
    changed = moved.filter(F.col("status").isin("active", "rolled_back")).select(*S.names(S.REGISTRY)).collect()
    store.registry.append(store.spark.createDataFrame([tuple(r) for r in changed], S.REGISTRY), batch)
    mae = next(r["mae"] for r in changed if r["version"] == stable)
    _job(store, batch, "rollback", before["version"] if before else None, stable, "rolled_back", {})
    return {
        "rolled_back": True, "active_version": stable,
        "state": {
            "active_model_version": stable, "active_baseline_mae": str(mae), "consecutive_rollback_drift": "0",
        },
    }
