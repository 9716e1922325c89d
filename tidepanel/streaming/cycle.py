"""The daily cycle on Structured Streaming: ingest, compare, measure, alert, decide, forecast.

Each date is one step whose work grows with the day's rows and not with history: the features
need the last rows of each entity (``tail``) and the metrics the errors of the newest dates
(``error_window``); both are carried from date to date as small tables. Every table is written
once per date into that date's partition and the runtime state last, so a step that is replayed
after a failure overwrites itself, and a date at or before the watermark is ignored.

Several dates that wait are replayed as sets (``_catch_up``): one job per table for all of them, with errors by range
frames over the dates' totals and the policy as a fold, and what they leave is what one step after another leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date as Date

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.functions.columns import lenient_double
from tidepanel.operators.dashboard import daily_summary
from tidepanel.operators.dedup import keep_last, union_keep_last
from tidepanel.operators.drift import (
    alerts_from_errors, align_forecasts, drift_snapshot, drift_snapshots, error_metrics_by_date, feature_psi,
    newest_dates,
)
from tidepanel.operators.features import FEATURE_LOOKBACK, feature_frame
from tidepanel.operators.normalize import finalize_features, normalize_feed
from tidepanel.operators.policy import decide, performance_drift, policy_replay, rollback_drift
from tidepanel.plans.forecast import ModelScorer, NaiveScorer, forecast_rows
from tidepanel.plans.lifecycle import accepted_state, active_entry, active_model, retrain, rollback_to_stable
from tidepanel.plans.model import Learner, load
from tidepanel.session import scratch_dir, wide_plans
from tidepanel.settings import DEFAULTS, Settings
from tidepanel.sources import schemas as S
from tidepanel.sources.files import stream_feed
from tidepanel.sources.state import StateStore

_EPOCH = Date(1970, 1, 1).toordinal()


def ordinal(day: Date) -> int:
    return day.toordinal() - _EPOCH


# ---- gates -----------------------------------------------------------------------------------------


def completeness(feed: DataFrame, expected: int) -> DataFrame:
    """Distinct entities per date and whether the date is complete."""
    return feed.groupBy("date").agg(F.countDistinct("entity_id").alias("n_entities")).withColumn(
        "complete", F.col("n_entities") == expected
    )


def next_date(feed: DataFrame, watermark: str | None) -> DataFrame:
    """One row: the smallest feed date after the watermark (NULL when the feed is used up)."""
    ahead = feed if not watermark else feed.filter(F.col("date") > F.lit(watermark).cast("date"))
    return ahead.agg(F.min("date").alias("next_date"))


def split_late(feed: DataFrame, watermark: str | None) -> DataFrame:
    """Flag rows at or before the watermark; they are never ingested."""
    late = F.lit(False) if not watermark else F.col("date") <= F.lit(watermark).cast("date")
    return feed.withColumn("is_late", late)


def trailing_rows(rows: DataFrame, n: int = FEATURE_LOOKBACK) -> DataFrame:
    newest_first = Window.partitionBy("entity_id").orderBy(F.desc("date"))
    return rows.withColumn("_n", F.row_number().over(newest_first)).filter(F.col("_n") <= n).drop("_n")


# Rows of these refusals come back with the next delivery.
_PENDING = ("incomplete", "waiting")


def _settled(spark, rows: DataFrame, label: str = "refused") -> DataFrame:
    """The rows written apart: read often, or about to be replaced where they were read from."""
    path = scratch_dir(spark, label)
    with wide_plans(spark):
        rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class DailyCycle:
    def __init__(
        self,
        store: StateStore,
        settings: Settings = DEFAULTS,
        scorer: NaiveScorer | ModelScorer | None = None,
        profile: DataFrame | None = None,
        events: DataFrame | None = None,
        regimes: DataFrame | None = None,
        learner: Learner | None = None,
        forecasts: bool = True,
        skip_incomplete: bool = False,
        prepare: Callable[[DataFrame], DataFrame] | None = None,
        compact_after: int | None = None,
    ):
        """``learner`` turns policy decisions into training runs; without it they are only recorded.

        Without a scorer the store's active model takes up its work again, with its profile and its
        error as baseline; a store without one starts with the naive scorer. Dates wait behind an
        incomplete one until it is complete, unless ``skip_incomplete``. ``prepare`` shapes the features that are
        measured for drift, as those of the profile were shaped. With ``compact_after`` the state is compacted up to the
        date before the newest one when more batches than that lie in the panel's log.
        """
        self.store, self.spark, self.settings = store, store.spark, settings
        self._registered = {}
        if scorer is None:
            entry = active_entry(store)
            if entry:
                scorer = ModelScorer(load(self.spark, entry["artifact_path"]))
                self._registered = {"active_model_version": entry["version"], "active_baseline_mae": str(entry["mae"])}
        self.scorer = scorer or NaiveScorer()
        self.profile = profile if profile is not None else self.scorer.profile
        self.events, self.regimes, self.learner, self.forecasts = events, regimes, learner, forecasts
        self.skip_incomplete = skip_incomplete
        self.prepare = prepare or (lambda frame: frame)
        self.compact_after = compact_after

    def seed(self, history: DataFrame) -> None:
        """Load the panel that exists before the first feed date."""
        rows = keep_last(normalize_feed(history, S.PANEL_SIGNALS), ["date", "entity_id"])
        last = rows.agg(F.max("date")).first()[0]
        day = ordinal(last)
        self.store.panel.append(rows, day)
        self.store.tail.append(trailing_rows(self.store.panel.log(only=day)), day)
        self.store.set_state({"seed_date": last.isoformat()}, day)

    # ---- one date ------------------------------------------------------------------------------

    def process(self, batch: DataFrame, _batch_id: int | None = None) -> list[dict]:
        """``foreachBatch`` target: the dates of the micro-batch and those that waited, oldest first."""
        keys = ["date", "entity_id"]
        arrived = normalize_feed(batch, S.PANEL_SIGNALS).withColumn("_fresh", F.lit(True))
        both = union_keep_last([self._pending().withColumn("_fresh", F.lit(False)), arrived], keys)
        path = scratch_dir(self.spark, "backlog")
        both.write.partitionBy("date").parquet(path)  # parsed once, then read date by date
        feed = self.spark.read.schema(both.schema).parquet(path)
        fresh = feed.groupBy("date").agg(F.max("_fresh").alias("fresh"))
        days = completeness(feed, self.settings.expected_entities).join(fresh, "date").orderBy("date").collect()
        if not any(d["fresh"] for d in days):
            return []
        feed = feed.drop("_fresh")
        ready = self._ready(days)
        # With a learner a decision may change the model that the next date is forecast with.
        together = self.learner is None and len(ready) > 1
        results, blocked = [], False
        for d in days:
            if together and d["date"] in ready:
                continue
            done = self.step(feed.filter(F.col("date") == F.lit(d["date"])), d["date"], d, blocked)
            blocked |= done["status"] in _PENDING and not self.skip_incomplete
            if d["fresh"] or done["status"] == "ingested":
                results.append(done)
        if together:
            rows = feed.filter(F.col("date").isin(*ready))
            results += self._catch_up(rows, {d["date"]: int(d["n_entities"]) for d in days if d["date"] in ready})
        if self.compact_after is not None and self.store.panel.batches() > self.compact_after:
            done = self.store.state_values()["last_ingested_date"]
            if done:
                self.store.compact(ordinal(Date.fromisoformat(done)) - 1)  # a step reads nothing older one by one
        return sorted(results, key=lambda r: r["date"])

    def _ready(self, days) -> list[Date]:
        """The dates that no gate holds back, oldest first."""
        watermark, ready = self.store.state_values()["last_ingested_date"], []
        for d in days:
            if not d["complete"]:
                if not self.skip_incomplete:
                    break
            elif not watermark or d["date"].isoformat() > watermark:
                ready.append(d["date"])
        return ready

    def _state(self) -> dict[str, str]:
        """The state; a store whose state names no model yet has the registry's active one."""
        state = self.store.state_values()
        return state if state["active_model_version"] else {**state, **self._registered}

    def _pending(self) -> DataFrame:
        """Rows kept of dates after the watermark that were not complete, or waited behind such a date."""
        watermark = self.store.state_values()["last_ingested_date"]
        rows = self.store.refused.log().filter(F.col("reason").isin(*_PENDING))
        if watermark:
            rows = rows.filter(F.col("_batch") > ordinal(Date.fromisoformat(watermark)))
        return keep_last(rows.drop("_batch", "reason"), ["date", "entity_id"], [])

    def step(self, rows: DataFrame, day: Date, gate, blocked: bool = False) -> dict:
        state, key = self._state(), ordinal(day)
        watermark = state["last_ingested_date"]
        refused = None
        if not gate["complete"]:
            refused = "incomplete"
        elif watermark and day.isoformat() <= watermark:
            refused = "late"
        elif blocked:
            refused = "waiting"
        if refused:
            held = self.store.refused.log(only=key).filter(F.col("reason") == refused).drop("_batch", "reason")
            kept = union_keep_last([held, rows], ["date", "entity_id"], [])
            self.store.refused.append(_settled(self.spark, kept).withColumn("reason", F.lit(refused)), key)
            return {"date": day, "status": refused, "rows": 0}
        return self._ingest(rows, day, int(gate["n_entities"]), state)

    def _ingest(self, rows: DataFrame, day: Date, n_rows: int, state: dict[str, str]) -> dict:
        store, key = self.store, ordinal(day)
        before = state["last_ingested_date"] or state.get("seed_date") or ""
        previous = ordinal(Date.fromisoformat(before)) if before else key - 1

        store.panel.append(rows, key)
        batch = store.panel.log(only=key).drop("_batch")
        tail = store.tail.log(only=previous).drop("_batch")

        # Independent small jobs: the scheduler runs them side by side.
        with ThreadPoolExecutor() as pool:
            jobs = [
                pool.submit(store.actuals.append, batch.withColumn("created_at", F.current_timestamp()), key),
                pool.submit(store.summary.append, daily_summary(batch), key),
                pool.submit(self._keep_tail, tail, batch, key),
                pool.submit(self._compare, batch, key, previous),
            ]
            for job in jobs:
                job.result()
            errors = store.error_window.log(only=key).drop("_batch")
            # All of the date's misses raise alerts, however many there are.
            today = store.fva.log(only=key).withColumnRenamed("_batch", "first_seq")
            alerts = pool.submit(store.alerts.append, alerts_from_errors(today, None), key)
            # Without a learner no decision can change the scorer, so forecasting need not wait.
            ahead = pool.submit(self._forecast, tail, batch, key) if self.learner is None else None
            metrics = self._measure(errors, tail, batch, state, n_rows, key)
            alerts.result()
            if ahead:
                ahead.result()

        changes = {
            "last_ingested_date": day.isoformat(),
            "sim_day": str(int(state["sim_day"]) + 1),
            "rows_since_last_retrain": str(int(state["rows_since_last_retrain"]) + n_rows),
            "consecutive_perf_drift": str(metrics["perf_streak"]),
            "consecutive_rollback_drift": str(metrics["roll_streak"]),
            "active_model_version": state["active_model_version"] or self.scorer.version,
        }
        changes |= self._act(metrics["action"], key, changes)
        if self.learner is not None:
            self._forecast(tail, batch, key)
        store.set_state(changes, key)
        return {
            "date": day, "status": "ingested", "rows": n_rows, "action": metrics["action"],
            "perf_streak": metrics["perf_streak"], "roll_streak": metrics["roll_streak"],
            **{m: metrics[m] for m in ("mae", "mape", "rmse", "max_feature_psi", "drift_status")},
        }

    # ---- many dates ----------------------------------------------------------------------------

    def _catch_up(self, rows: DataFrame, days: dict[Date, int]) -> list[dict]:
        """All dates of ``days`` (their entities by date) in one plan per table; the state is written last."""
        store, state = self.store, self._state()
        dates = sorted(days)
        keys = [ordinal(d) for d in dates]
        before = state["last_ingested_date"] or state.get("seed_date") or ""
        previous, last = ordinal(Date.fromisoformat(before)) if before else keys[0] - 1, keys[-1]
        of_date = F.unix_date("date")

        store.panel.append(rows, of_date)
        batch = store.panel.log(among=keys).drop("_batch")
        tail = store.tail.log(only=previous).drop("_batch")
        said = live = batch  # forecast from, and measured for drift
        if self.profile is not None or (self.forecasts and self.scorer.needs_features):
            live = self._live(tail, batch, keys)
        if self.forecasts and self.scorer.needs_features:
            said = live = _settled(self.spark, live, "live")  # read twice

        with ThreadPoolExecutor() as pool:
            jobs = [
                pool.submit(store.actuals.append, batch.withColumn("created_at", F.current_timestamp()), of_date),
                pool.submit(store.summary.append, daily_summary(batch), of_date),
                pool.submit(self._keep_tail, tail, batch, last),
            ]
            if self.forecasts:
                # What is said on one date is compared on the next.
                ahead = forecast_rows(said, batch, self.scorer, dated=True)
                store.predictions.append(ahead, F.unix_date("target_date") - 1)
            made = store.predictions.log(among=[k - 1 for k in keys])
            store.fva.append(align_forecasts(batch, made).withColumn("created_at", F.current_timestamp()), of_date)
            fresh = store.fva.log(among=keys).withColumnRenamed("_batch", "first_seq")
            errors = store.error_window.log(only=previous).drop("_batch").unionByName(fresh)
            jobs += [
                pool.submit(store.alerts.append, alerts_from_errors(fresh, None), of_date),
                pool.submit(store.error_window.append, newest_dates(errors, self.settings.error_window), last),
            ]
            judged = self._judge(errors, live, days, state)
            for job in jobs:
                job.result()

        names = ("mae", "mape", "rmse", "max_feature_psi", "drift_status", "payload_json")
        kept = self.spark.createDataFrame(
            [(r["date"], *(r[n] for n in names)) for r in judged],
            "date DATE, mae DOUBLE, mape DOUBLE, rmse DOUBLE, max_feature_psi DOUBLE, drift_status STRING, payload_json STRING",
        )
        store.drift.append(
            kept.select("*", F.current_timestamp().alias("drift_ts"), F.lit(self.scorer.version).alias("model_version")),
            of_date,
        )
        end = judged[-1]
        store.set_state({
            "last_ingested_date": dates[-1].isoformat(),
            "sim_day": str(end["sim_day"]),
            "rows_since_last_retrain": str(end["rows_since_retrain"]),
            "consecutive_perf_drift": str(end["perf_streak"]),
            "consecutive_rollback_drift": str(end["rollback_streak"]),
            "active_model_version": state["active_model_version"] or self.scorer.version,
        }, last)
        return [
            {
                "date": r["date"], "status": "ingested", "rows": days[r["date"]], "action": r["action"],
                "perf_streak": r["perf_streak"], "roll_streak": r["rollback_streak"], **{n: r[n] for n in names[:-1]},
            }
            for r in judged
        ]

    def _judge(self, errors: DataFrame, live: DataFrame, days: dict[Date, int], state: dict[str, str]) -> list:
        """Per date: errors of its newest dates, feature drift, status, counters and decision."""
        dated = self.spark.createDataFrame(sorted(days.items()), "date DATE, n_new BIGINT")
        metrics = error_metrics_by_date(errors, dated, self.settings.error_window).join(F.broadcast(dated), "date")
        if self.profile is not None:
            inputs = self.scorer.features
            psi = feature_psi(self.prepare(finalize_features(live, inputs)), self.profile, inputs, segment=["date"])
        else:
            psi = self.spark.createDataFrame([], "date DATE, feature STRING, psi DOUBLE")
        baseline = F.lit(float(state["active_baseline_mae"]))
        daily = drift_snapshots(metrics, psi, baseline, self.settings).withColumns(
            {"baseline_mae": baseline, "segment": F.lit(0)}
        )
        start = {
            "sim_day": state["sim_day"], "last_retrain": state["last_retrain_sim_day"],
            "rows": state["rows_since_last_retrain"], "perf": state["consecutive_perf_drift"],
            "roll": state["consecutive_rollback_drift"],
        }
        daily = _settled(self.spark, daily, "daily")
        decisions = policy_replay(
            daily, ["segment"], self.settings, start={n: int(v) for n, v in start.items()}, feedback=False
        )
        # One row per date.
        return daily.drop("n_new", "segment").join(decisions, "date").orderBy("date").collect()

    def _keep_tail(self, tail: DataFrame, batch: DataFrame, key: int) -> None:
        """Each entity's last rows; the batch is newer than all of them."""
        self.store.tail.append(trailing_rows(tail.unionByName(batch)), key)

    def _compare(self, batch: DataFrame, key: int, previous: int) -> None:
        """Errors of the date, and those of the newest dates that hold ``error_window`` rows, each date whole."""
        store = self.store
        made = store.predictions.log(only=key - 1)  # forecasts for a date are made the day before
        store.fva.append(align_forecasts(batch, made).withColumn("created_at", F.current_timestamp()), key)
        fresh = store.fva.log(only=key).withColumnRenamed("_batch", "first_seq")
        held = store.error_window.log(only=previous).drop("_batch")
        store.error_window.append(newest_dates(held.unionByName(fresh), self.settings.error_window), key)

    def _forecast(self, tail: DataFrame, batch: DataFrame, key: int) -> None:
        if self.forecasts:
            live = self._live(tail, batch, [key]) if self.scorer.needs_features else batch
            self.store.predictions.append(forecast_rows(live, batch, self.scorer), key)

    def _live(self, tail: DataFrame, batch: DataFrame, keys: list[int]) -> DataFrame:
        """Features of the dates; the tail is all the history they can reach."""
        scorer = self.scorer
        frame = feature_frame(
            tail.unionByName(batch), self.events, self.regimes, scorer.event_kinds, scorer.features
        )
        return frame.filter(F.unix_date("date").isin(*keys))

    def _measure(self, errors, tail, batch, state, n_rows: int, key: int):
        """Drift snapshot and policy decision of the date, as one row."""
        if self.profile is not None:
            inputs = self.scorer.features
            live = finalize_features(self._live(tail, batch, [key]), inputs)
            psi = feature_psi(self.prepare(live), self.profile, inputs)
        else:
            psi = self.spark.createDataFrame([], "feature STRING, psi DOUBLE")
        baseline = float(state["active_baseline_mae"])
        snapshot = drift_snapshot(errors, psi, baseline, self.settings, whole=True)
        base = F.lit(baseline)
        perf_now = performance_drift(F.col("mae"), F.col("mape"), base, self.settings)
        roll_now = rollback_drift(F.col("mae"), base, self.settings)
        judged = F.col("mae").isNotNull()

        def streak(key_name: str, hit):
            held = int(state[key_name])
            return F.when(~judged, held).when(hit, held + 1).otherwise(0)

        counted = snapshot.withColumns({
            "perf_streak": streak("consecutive_perf_drift", perf_now),
            "roll_streak": streak("consecutive_rollback_drift", roll_now),
        })
        since = int(state["sim_day"]) + 1 - int(state["last_retrain_sim_day"])
        new_rows = int(state["rows_since_last_retrain"]) + n_rows
        should, back = decide(
            perf_now, F.col("perf_streak"), F.col("roll_streak"), F.col("max_feature_psi"),
            F.lit(since), F.lit(new_rows), self.settings,
        )
        act = F.when(~judged, "none").when(back, "rollback").when(should, "retrain").otherwise("none")
        row = counted.withColumn("action", act).first()
        kept = self.spark.createDataFrame(
            [tuple(row[c] for c in ("mae", "mape", "rmse", "max_feature_psi", "drift_status", "payload_json"))],
            "mae DOUBLE, mape DOUBLE, rmse DOUBLE, max_feature_psi DOUBLE, drift_status STRING, payload_json STRING",
        )
        self.store.drift.append(
            kept.select("*", F.current_timestamp().alias("drift_ts"), F.lit(self.scorer.version).alias("model_version")),
            key,
        )
        return row

    def _act(self, action: str, key: int, changes: dict[str, str]) -> dict[str, str]:
        if action == "none" or self.learner is None:
            return {}
        if action == "rollback":
            result = rollback_to_stable(self.store, key)
            if result["rolled_back"]:
                self.scorer = ModelScorer(active_model(self.store))  # as this batch left it
                self.profile = self.scorer.profile
            return result.get("state", {})
        result = retrain(
            self.store, self.store.history(), key, "policy", self.events, self.regimes,
            learner=self.learner, settings=self.settings, version=f"gbt_demand_{key}", commit=False,
        )
        if not result["accepted"]:
            return {}
        self.scorer = ModelScorer(result["model"])
        self.profile = self.scorer.profile
        return accepted_state(result, int(changes["sim_day"]))

    # ---- entry points --------------------------------------------------------------------------

    def run_stream(self, feed_path: str, checkpoint: str, files_per_batch: int | None = None) -> list[dict]:
        """Consume every waiting feed file, then stop; run it after each delivery."""
        results: list[dict] = []

        def handle(batch: DataFrame, batch_id: int) -> None:
            results.extend(self.process(batch, batch_id))

        query = (
            stream_feed(self.spark, feed_path, files_per_batch).writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return results

    def run_date(self, feed: DataFrame, day: str | None = None) -> dict:
        """Batch form: the named date, or the next one after the watermark."""
        if day is None:
            found = next_date(normalize_feed(feed), self.store.state_values()["last_ingested_date"]).first()[0]
            if found is None:
                return {"status": "no_new_data", "rows": 0}
            day = found.isoformat()
        done = self.process(normalize_feed(feed, S.PANEL_SIGNALS).filter(F.col("date") == F.lit(day).cast("date")))
        return done[0] if done else {"status": "no_new_data", "rows": 0}


def stream_daily_summary(feed: DataFrame, delay: str = "1 day") -> DataFrame:
    """The daily summary as a watermarked one-day window over a stream of feed rows, written in append mode.

    Rows are first summed by date and entity, so that the distinct entities of a date are counted exactly from one state
    row each, however often an entity reports; late rows count until the watermark passes their date. ``entities`` is a
    sketch of the same entities, which other spans of dates are counted from by :func:`distinct_over`.
    """
    stamped = feed.withColumn("_ts", F.col("date").cast("timestamp")).withWatermark("_ts", delay)
    kind = F.coalesce(F.col("event_type"), F.lit("organic")) if "event_type" in feed.columns else F.lit("organic")
    day, means = F.window("_ts", "1 day"), S.FEED_MEASURES
    by_entity = stamped.withColumns({f"_{m}": lenient_double(F.col(m)) for m in means}).groupBy(day, "entity_id").agg(
        *[F.sum(f"_{m}").alias(f"_sum_{m}") for m in means], *[F.count(f"_{m}").alias(f"_n_{m}") for m in means],
        F.count_if(kind != "organic").alias("_events"), F.count("*").alias("_rows"),
    )
    again = by_entity.withColumn("_end", F.window_time("window")).groupBy(F.window("_end", "1 day")).agg(
        *[(F.sum(f"_sum_{m}") / F.nullif(F.sum(f"_n_{m}"), F.lit(0))).alias(f"avg_{m}") for m in means],
        F.count("entity_id").alias("product_count"), F.sum("_events").alias("event_count"),
        F.sum("_rows").alias("n_rows"), F.hll_sketch_agg("entity_id").alias("entities"),
    )
    return again.select(F.col("window.start").cast("date").alias("date"), *again.columns[1:])


def distinct_over(summary: DataFrame, unit: str = "week") -> DataFrame:
    """Distinct entities of each week (or another unit) from the sketches of its dates: an estimate, within a few per cent."""
    return summary.groupBy(F.date_trunc(unit, F.col("date")).cast("date").alias("start")).agg(
        F.hll_sketch_estimate(F.hll_union_agg("entities")).alias("product_count")
    )
