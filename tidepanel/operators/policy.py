"""Streaks, retrain and rollback decisions, champion selection.

All of it runs per segment. A segment holds at most one row per day (or one per candidate
model), so folding its history in order inside one task is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.settings import DEFAULTS, Settings


def streaks(df: DataFrame, hit: str, segment: Sequence[str], order: Sequence[str], name: str = "streak") -> DataFrame:
    """Number of consecutive hits up to and including each row; a miss resets to 0."""
    in_order = Window.partitionBy(*segment).orderBy(*order)
    run = F.count_if(~F.col(hit)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    island = df.withColumn("_run", run)
    within = Window.partitionBy(*segment, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn(name, F.count_if(F.col(hit)).over(within)).drop("_run")


def performance_drift(mae: Column, mape: Column, baseline_mae: Column, settings: Settings = DEFAULTS) -> Column:
    return F.coalesce(
        (mae > baseline_mae * settings.retrain_mae_multiplier) | (mape > settings.retrain_mape_threshold), F.lit(False)
    )


def rollback_drift(mae: Column, baseline_mae: Column, settings: Settings = DEFAULTS) -> Column:
    return F.coalesce(mae > baseline_mae * settings.rollback_mae_multiplier, F.lit(False))


def decide(
    perf_now: Column, perf_streak: Column, rollback_streak: Column, max_psi: Column,
    days_since_retrain: Column, rows_since_retrain: Column, settings: Settings = DEFAULTS,
) -> tuple[Column, Column]:
    """(should_retrain, rollback_flag) from the counters of one day."""
    enough = rows_since_retrain >= settings.retrain_min_new_rows
    severe = max_psi > settings.psi_severe_threshold
    scheduled = (days_since_retrain >= settings.retrain_schedule_days) & (
        rows_since_retrain >= settings.retrain_schedule_min_rows
    )
    retrain = (days_since_retrain >= settings.retrain_cooldown_days) & (
        (perf_now & (perf_streak >= settings.retrain_streak) & enough) | (severe & enough) | scheduled
    )
    return F.coalesce(retrain, F.lit(False)), rollback_streak >= settings.rollback_streak


def action(should_retrain: Column, rollback_flag: Column) -> Column:
    """Rollback comes before retraining."""
    return F.when(rollback_flag, "rollback").when(should_retrain, "retrain").otherwise("none")


def policy_replay(
    daily: DataFrame, segment: Sequence[str], settings: Settings = DEFAULTS, order: str = "date",
    start: dict[str, int] | None = None, feedback: bool = True,
) -> DataFrame:
    """Decision of every day, with feedback: a retrain resets its counters, a rollback its streak.

    ``daily`` has one row per segment and day: mae, mape, max_feature_psi, baseline_mae, n_new. ``start`` gives the
    counters before the first day (0 each: sim_day, last_retrain, rows, perf, roll). Without ``feedback`` decisions
    are only recorded, as where nobody acts on them.
    """
    before = {"sim_day": 0, "last_retrain": 0, "rows": 0, "perf": 0, "roll": 0, **(start or {})}
    day = F.struct(order, "mae", "mape", "max_feature_psi", "baseline_mae", "n_new")
    opening = F.struct(
        *[F.lit(v).cast("bigint" if n == "rows" else "int").alias(n) for n, v in before.items()]
    )
    entry = (
        "struct<%s:date,sim_day:int,rows_since_retrain:bigint,perf_streak:int,rollback_streak:int,"
        "performance_drift:boolean,severe_feature_drift:boolean,action:string>" % order
    )
    init = F.struct(opening.alias("state"), F.array().cast(f"array<{entry}>").alias("log"))

    def step(acc: Column, d: Column) -> Column:
        # A day without errors to judge keeps the counters as they are.
        judged = d["mae"].isNotNull()
        sim_day = acc["state"]["sim_day"] + 1
        rows = acc["state"]["rows"] + d["n_new"]
        perf_now = performance_drift(d["mae"], d["mape"], d["baseline_mae"], settings)
        roll_now = rollback_drift(d["mae"], d["baseline_mae"], settings)
        perf = F.when(~judged, acc["state"]["perf"]).when(perf_now, acc["state"]["perf"] + 1).otherwise(0)
        roll = F.when(~judged, acc["state"]["roll"]).when(roll_now, acc["state"]["roll"] + 1).otherwise(0)
        psi = F.when(judged, d["max_feature_psi"])
        retrain, rollback = decide(
            perf_now, perf, roll, psi, sim_day - acc["state"]["last_retrain"],
            F.when(judged, rows), settings,
        )
        act = action(retrain, judged & rollback)
        done, acted = (act == "retrain", act != "none") if feedback else (F.lit(False), F.lit(False))
        state = F.struct(
            sim_day.alias("sim_day"),
            F.when(done, sim_day).otherwise(acc["state"]["last_retrain"]).alias("last_retrain"),
            F.when(done, F.lit(0).cast("bigint")).otherwise(rows).alias("rows"),
            F.when(done, 0).otherwise(perf).alias("perf"),
            F.when(acted, 0).otherwise(roll).alias("roll"),
        )
        line = F.struct(
            d[order].alias(order), sim_day.alias("sim_day"), rows.alias("rows_since_retrain"),
            perf.alias("perf_streak"), roll.alias("rollback_streak"),
            perf_now.alias("performance_drift"),
            F.coalesce(psi > settings.psi_severe_threshold, F.lit(False)).alias("severe_feature_drift"),
            act.alias("action"),
        ).cast(entry)
        return F.struct(state.alias("state"), F.concat(acc["log"], F.array(line)).alias("log"))

    history = daily.groupBy(*segment).agg(F.array_sort(F.collect_list(day)).alias("_days"))
    folded = history.withColumn("_log", F.aggregate("_days", init, step, lambda a: a["log"]))
    return folded.select(*segment, F.inline("_log"))


def acceptance(mae: Column, champion_mae: Column, settings: Settings = DEFAULTS) -> Column:
    """A challenger needs no champion, or an error at most 0.98 of the champion's."""
    return champion_mae.isNull() | (mae <= champion_mae * settings.accept_ratio)


def registry_replay(
    candidates: DataFrame, segment: Sequence[str], order: Sequence[str], settings: Settings = DEFAULTS
) -> DataFrame:
    """Outcome of each candidate in order, and the champion and last stable version after it.

    ``candidates`` has version and mae per row; a segment has one row per training run.
    """
    run = F.struct(*order, "version", "mae")
    init = F.struct(
        F.lit(None).cast("string").alias("active"), F.lit(None).cast("double").alias("active_mae"),
        F.lit(None).cast("string").alias("stable"),
        F.array().cast(
            "array<struct<version:string,mae:double,status:string,active_version:string,last_stable_version:string>>"
        ).alias("log"),
    )

    def step(acc: Column, c: Column) -> Column:
        ok = acceptance(c["mae"], acc["active_mae"], settings)
        active = F.when(ok, c["version"]).otherwise(acc["active"])
        stable = F.when(ok, F.coalesce(acc["active"], c["version"])).otherwise(acc["stable"])
        line = F.struct(
            c["version"].alias("version"), c["mae"].alias("mae"),
            F.when(ok, "accepted").otherwise("rejected").alias("status"),
            active.alias("active_version"), stable.alias("last_stable_version"),
        )
        return F.struct(
            active.alias("active"), F.when(ok, c["mae"]).otherwise(acc["active_mae"]).alias("active_mae"),
            stable.alias("stable"), F.concat(acc["log"], F.array(line)).alias("log"),
        )

    runs = candidates.groupBy(*segment).agg(F.array_sort(F.collect_list(run)).alias("_runs"))
    folded = runs.withColumn("_log", F.aggregate("_runs", init, step, lambda a: a["log"]))
    return folded.select(*segment, F.posexplode("_log").alias("run_no", "_l")).select(*segment, "run_no", "_l.*")


def rollback(registry: DataFrame, segment: Sequence[str] = ()) -> DataFrame:
    """Put the last stable version back, per segment; ``reason`` tells where that is impossible.

    ``registry`` carries version, status, last_stable_version (same on every row of a segment).
    """
    whole = Window.partitionBy(*segment)
    stable = F.max("last_stable_version").over(whole)
    active = F.max(F.when(F.col("status") == "active", F.col("version"))).over(whole)
    known = F.max((F.col("version") == F.col("last_stable_version")).cast("int")).over(whole)
    facts = registry.withColumn("_stable", stable).withColumn("_active", active).withColumn("_known", known)
    reason = (
        F.when(F.col("_stable").isNull(), "no_stable_version")
        .when(F.col("_stable") == F.col("_active"), "already_on_stable")
        .when(F.coalesce(F.col("_known"), F.lit(0)) == 0, "stable_artifact_missing")
    )
    facts = facts.withColumn("reason", reason)
    status = (
        F.when(F.col("reason").isNotNull(), F.col("status"))
        .when(F.col("version") == F.col("_stable"), "active")
        .when(F.col("version") == F.col("_active"), "rolled_back")
        .otherwise(F.col("status"))
    )
    return facts.withColumn("status", status).withColumn("rolled_back", F.col("reason").isNull()).drop(
        "_stable", "_active", "_known"
    )
