"""Registered queries: state tables, the daily cycle, policy and models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.functions.columns import week_start
from tidepanel.operators import attribution as A, dashboard as D, dedup, drift, features as X, policy as P
from tidepanel.operators.normalize import finalize_features, normalize_feed
from tidepanel.plans import model as M, queries_features  # noqa: F401  (queries that share their SQL)
from tidepanel.plans.contributions import SHARES, shares_text, with_shares
from tidepanel.plans.forecast import NaiveScorer, forecast_next_day, latest_context
from tidepanel.plans.lifecycle import retrain
from tidepanel.plans.queries_reports import _METRICS, _daily_metrics, _reason_sql
from tidepanel.plans.registry import Inputs, QUERIES, grid_sql, on_grid, query
from tidepanel.plans.shared_sql import base_sql, feature_sql, finalized_sql, proximity_sql, regime_sql, with_tables
from tidepanel.settings import DEFAULTS
from tidepanel.sources import schemas as S, state
from tidepanel.sources.state import LogTable, StateStore
from tidepanel.streaming import cycle as C, keyed as K

_LATE = "(SELECT max(date) - 9 FROM activity)"


def _log(i: Inputs, ddl: str, keys: list[str], **options) -> LogTable:
    return LogTable(i.spark, i.scratch("log"), ddl, keys, **options)


# ---- G. state tables -----------------------------------------------------------------------------------


@query(
    "g1_upsert_actuals", "date d, entity_id s, demand_index f, price_index f, event_type s, first_seq i",
    f"SELECT date, entity_id, demand_index + CASE WHEN date >= {_LATE} THEN 1 ELSE 0 END AS demand_index, "
    "price_index, 'organic' AS event_type, 1 AS first_seq FROM activity",
)
def g1_upsert_actuals(i: Inputs) -> DataFrame:
    """All rows, then corrections of the last ten dates."""
    table = _log(i, S.ACTUALS, ["date", "entity_id"], keep_from_first=["created_at"], measures_to_zero=S.FEED_MEASURES)
    rows = i.activity.withColumn("event_type", F.lit("organic"))
    table.append(rows, 1)
    table.append(
        rows.filter(F.col("date") >= i.first_live_date).withColumn("demand_index", F.col("demand_index") + 1), 2
    )
    return table.current()


@query(
    "g2_two_models_a_day", "target_date d, entity_id s, model_version s, pred_demand f, pred_price f",
    "SELECT target_date, entity_id, model_version, coalesce(pred_demand, 0.0) AS pred_demand, "
    "coalesce(pred_price, 0.0) AS pred_price FROM forecasts",
)
def g2_two_models_a_day(i: Inputs) -> DataFrame:
    """The models of one batch write one after another, the first of them twice."""
    store = StateStore(i.spark, i.scratch("state"))
    versions = [r["model_version"] for r in i.forecasts.select("model_version").distinct().orderBy("model_version").collect()]
    for version in [*versions, versions[0]]:
        store.predictions.append(i.forecasts.filter(F.col("model_version") == version), 1)
    return store.predictions.current()


@query(
    "g2_upsert_predictions", "target_date d, entity_id s, model_version s, pred_demand f, pred_price f, explanation_text s, first_seq i",
    f"SELECT target_date, entity_id, model_version, coalesce(pred_demand, 0.0) + CASE WHEN target_date >= {_LATE} "
    "AND model_version = 'mean_7' THEN 1 ELSE 0 END AS pred_demand, coalesce(pred_price, 0.0) AS pred_price, "
    "NULL AS explanation_text, 1 AS first_seq FROM forecasts",
)
def g2_upsert_predictions(i: Inputs) -> DataFrame:
    """Forecasts without text columns, then a revised model for the last ten dates."""
    table = _log(
        i, S.PREDICTIONS, ["target_date", "entity_id", "model_version"], measures_to_zero=["pred_demand", "pred_price"]
    )
    table.append(i.forecasts, 1)
    revised = i.forecasts.filter((F.col("target_date") >= i.first_live_date) & (F.col("model_version") == "mean_7"))
    table.append(revised.withColumn("pred_demand", F.coalesce("pred_demand", F.lit(0.0)) + 1), 2)
    return table.current()


@query(
    "g3_upsert_fva", "date d, entity_id s, model_version s, actual_demand f, demand_error f, first_seq i",
    f"SELECT date, entity_id, model_version, actual_demand + CASE WHEN date >= {_LATE} - 5 THEN 3 ELSE 0 END AS "
    "actual_demand, demand_error + CASE WHEN date >= "
    f"{_LATE} - 5 THEN 3 ELSE 0 END AS demand_error, CASE WHEN date < {_LATE} THEN 1 ELSE 2 END AS first_seq FROM errors",
)
def g3_upsert_fva(i: Inputs) -> DataFrame:
    """Two batches that overlap by five dates: values from the second, sequence from the first."""
    table = _log(i, S.FORECAST_VS_ACTUAL, ["date", "entity_id", "model_version"])
    table.append(i.errors.filter(F.col("date") < i.first_live_date), 1)
    later = i.errors.filter(F.col("date") >= F.date_sub(i.first_live_date, 5)).withColumns({
        "actual_demand": F.col("actual_demand") + 3, "demand_error": F.col("demand_error") + 3,
    })
    table.append(later, 2)
    return table.current()


@query(
    "g4_append_log", "payload s, mae f, rmse f, first_seq i",
    f"SELECT strftime(date, '%Y-%m-%d') || ' ' || model_version AS payload, mae, rmse, CASE WHEN date < {_LATE} "
    f"THEN 1 ELSE 2 END AS first_seq FROM (SELECT date, model_version, {_METRICS} FROM errors GROUP BY 1, 2) AS x",
)
def g4_append_log(i: Inputs) -> DataFrame:
    """A drift snapshot per date and model, appended in two batches, the second one twice."""
    table = _log(i, S.DRIFT, [])
    daily = _daily_metrics(i.errors, ["date", "model_version"]).withColumn(
        "payload_json", F.concat_ws(" ", F.col("date").cast("string"), "model_version")
    )
    table.append(daily.filter(F.col("date") < i.first_live_date), 1)
    for _ in range(2):
        table.append(daily.filter(F.col("date") >= i.first_live_date), 2)
    return table.current().withColumnRenamed("payload_json", "payload")


@query(
    "g5_runtime_state", "state_key s, state_value s",
    f"""SELECT 'rows_' || category AS state_key, CAST(count(*) AS VARCHAR) AS state_value FROM activity GROUP BY category
      UNION ALL SELECT 'last_ingested_date', strftime(max(date), '%Y-%m-%d') FROM activity""",
)
def g5_runtime_state(i: Inputs) -> DataFrame:
    """Counters set from the first dates, then set again from all of them."""
    table = _log(i, S.RUNTIME_STATE, ["state_key"])

    def values(panel: DataFrame) -> DataFrame:
        counts = panel.groupBy(F.concat(F.lit("rows_"), "category").alias("state_key")).agg(
            F.count("*").cast("string").alias("state_value")
        )
        last = panel.agg(F.max("date").cast("string").alias("state_value")).select(
            F.lit("last_ingested_date").alias("state_key"), "state_value"
        )
        return counts.unionByName(last)

    table.append(values(i.activity.filter(F.col("date") < i.first_live_date)), 1)
    table.append(values(i.activity), 2)
    return table.current()


@query(
    "g6_next_date", "next_date d",
    "SELECT min(date) AS next_date FROM activity WHERE date > DATE '2024-01-15'",
)
def g6_next_date(i: Inputs) -> DataFrame:
    return C.next_date(i.activity, "2024-01-15")


@query(
    "g7_completeness", "date d, n_entities i, complete i",
    "SELECT date, count(DISTINCT entity_id) AS n_entities, CASE WHEN count(DISTINCT entity_id) = 27 THEN 1 ELSE 0 "
    "END AS complete FROM retail GROUP BY date",
)
def g7_completeness(i: Inputs) -> DataFrame:
    return C.completeness(i.retail, 27)


@query(
    "g8_late_rows", "date d, entity_id s, is_late i",
    "SELECT date, entity_id, CASE WHEN date <= DATE '2024-01-15' THEN 1 ELSE 0 END AS is_late FROM activity",
)
def g8_late_rows(i: Inputs) -> DataFrame:
    return C.split_late(i.activity, "2024-01-15")


@query(
    "g9_alerts", "date d, entity_id s, abs_demand_error f, severity s, alert_type s, message s",
    """SELECT date, entity_id, abs_demand_error, CASE WHEN abs_demand_error > 10 THEN 'high' ELSE 'medium' END AS severity,
      'forecast_miss' AS alert_type, 'Demand deviated by ' || printf('%.2f', abs_demand_error) || ' for entity '
      || entity_id AS message
    FROM (SELECT *, row_number() OVER (PARTITION BY date, entity_id ORDER BY model_version) AS n FROM (
      SELECT date, entity_id, model_version, abs_demand_error * 4 AS abs_demand_error FROM errors
      ORDER BY date DESC, entity_id DESC, model_version DESC LIMIT 50) AS x WHERE abs_demand_error > 5) AS y WHERE n = 1""",
)
def g9_alerts(i: Inputs) -> DataFrame:
    return drift.alerts_from_errors(i.errors.withColumn("abs_demand_error", F.col("abs_demand_error") * 4))


@query(
    "g10_append_master", "date d, entity_id s, brand s, demand_index f, event_type s",
    "SELECT date, entity_id, brand, CASE WHEN date > (SELECT max(date) - 30 FROM retail) THEN demand_index * 2 "
    "ELSE demand_index END AS demand_index, event_type FROM retail "
    "UNION ALL SELECT max(date) + 1, 'new', 'fresh', sum(demand_index), 'organic' FROM retail",
)
def g10_append_master(i: Inputs) -> DataFrame:
    """A batch that corrects the last 30 days and brings one new row."""
    last = i.retail.agg(F.max("date")).scalar()
    fixed = i.retail.filter(F.col("date") > F.date_sub(last, 30)).withColumn("demand_index", F.col("demand_index") * 2)
    fresh = i.retail.agg(F.date_add(F.max("date"), 1).alias("date"), F.sum("demand_index").alias("demand_index")).select(
        "date", F.lit("new").alias("entity_id"), F.lit("fresh").alias("brand"), "demand_index",
        F.lit("organic").alias("event_type"),
    )
    batch = fixed.unionByName(fresh, allowMissingColumns=True)
    return dedup.upsert(i.retail, batch, ["date", "entity_id"], keep_from_first=())


@query(
    "g11_append_summary", "date d, avg_demand_index f, product_count i, event_count i, total_events i",
    """SELECT date, avg(demand_index) * CASE WHEN date > (SELECT max(date) - 5 FROM retail) THEN 3 ELSE 1 END AS
      avg_demand_index, count(DISTINCT entity_id) AS product_count,
      count(*) FILTER (event_type <> 'organic') AS event_count,
      CASE WHEN date > (SELECT max(date) - 5 FROM retail) THEN NULL ELSE 0 END AS total_events
    FROM retail GROUP BY date""",
)
def g11_append_summary(i: Inputs) -> DataFrame:
    """Stored rows carry a column that new rows lack; new dates replace old ones whole."""
    stored = D.daily_summary(i.retail).withColumn("total_events", F.lit(0))
    last = i.retail.agg(F.max("date")).scalar()
    batch = i.retail.filter(F.col("date") > F.date_sub(last, 5)).withColumn("demand_index", F.col("demand_index") * 3)
    return dedup.upsert(stored, D.daily_summary(batch), ["date"], keep_from_first=())


# ---- the daily cycle over a feed ---------------------------------------------------------------------------

# The first date is history, all later ones come through a feed in which every entity reports every day. The third of
# them misses one entity.
_FEED_START = "(SELECT min(date) + 1 FROM activity)"
_FEED_SQL = f"""
SELECT d.date, n.entity_id, coalesce(a.demand_index, 0.0) AS demand_index, coalesce(a.price_index, 0.0) AS price_index,
  coalesce(a.search_index, 0.0) AS search_index, coalesce(a.sentiment_index, 0.0) AS sentiment_index,
  coalesce(a.ad_index, 0.0) AS ad_index
FROM (SELECT DISTINCT entity_id FROM activity) AS n
CROSS JOIN (SELECT DISTINCT date FROM activity WHERE date >= {_FEED_START} AND date <> {_FEED_START} + 2) AS d
LEFT JOIN activity AS a ON a.entity_id = n.entity_id AND a.date = d.date"""
# Tomorrow equals today, where today was ingested.
_CYCLE_SQL = f"""
SELECT t.date, t.entity_id, y.demand_index AS pred_demand, t.demand_index AS actual_demand,
  t.demand_index - y.demand_index AS demand_error, y.price_index AS pred_price, t.price_index AS actual_price,
  'naive_lag1' AS model_version
FROM ({_FEED_SQL}) AS t JOIN ({_FEED_SQL}) AS y ON y.entity_id = t.entity_id AND y.date = t.date - 1"""


def _feed(i: Inputs) -> tuple[DataFrame, int, DataFrame]:
    """(deliveries, number of entities, history before them)."""
    panel = i.activity = i.stored(i.activity, "panel")
    first = F.date_add(panel.agg(F.min("date")).scalar(), 1)
    names = panel.select("entity_id", "brand", "category").distinct()
    dates = panel.filter(F.col("date") >= first).select("date").distinct()  # a calendar
    measures = panel.filter(F.col("date") >= first).drop("brand", "category")
    filled = names.join(F.broadcast(dates)).join(measures, ["entity_id", "date"], "left")
    feed = filled.selectExpr(*[
        f"CAST({c if c in filled.columns else 'NULL'} AS {t}) AS {c}" for c, t in S.columns(S.FEED)
    ])
    return i.stored(feed, "deliveries"), names.count(), panel.filter(F.col("date") < first)


# The files of the feed: other spellings and another order than declared, and no text but the category.
_FEED_FILE = {
    "product_id": "entity_id", "price_new": "price_index", "date": "date", "category": "category",
    "sentiment_mean": "sentiment_index", "demand_index": "demand_index", "ad_index": "ad_index",
    "search_interest": "search_index",
}


def _run_daily(i: Inputs, cycle: C.DailyCycle, feed: DataFrame, history: DataFrame, halves: bool = False) -> list[dict]:
    """Deliver the feed into its folder and run the stream after each delivery: the first dates one after another, then
    all that are left, in one delivery.

    The third date misses an entity, or with ``halves`` comes in two deliveries with the fourth between them.
    """
    cycle.seed(history)
    folder, checkpoint = i.scratch("feed"), i.scratch("checkpoint")
    lowest = feed.agg(F.min("entity_id")).scalar()
    dates = [r["date"] for r in feed.select("date").distinct().orderBy("date").collect()]
    when, low = F.col("date"), F.col("entity_id") == lowest
    if halves:
        parts = [when <= dates[1], (when == dates[2]) & ~low, when == dates[3], ((when == dates[2]) & low) | (when > dates[3])]
    else:
        parts = [when == dates[0], (when > dates[0]) & ((when != dates[2]) | ~low)]
    results = []
    for part in parts:
        named = feed.filter(part).select(*[F.col(c).alias(n) for n, c in _FEED_FILE.items()])
        named.write.mode("append").option("header", True).csv(folder)
        results += cycle.run_stream(folder, checkpoint)
    return results


@query(
    "g12_ingest_step",
    "date d, entity_id s, pred_demand f, actual_demand f, demand_error f, pred_price f, actual_price f, model_version s",
    _CYCLE_SQL,
)
def g12_ingest_step(i: Inputs) -> DataFrame:
    """Forecasts against actuals after the stream has consumed the feed, date by date."""
    feed, entities, history = _feed(i)
    store = StateStore(i.spark, i.scratch("state"))
    cycle = C.DailyCycle(store, replace(DEFAULTS, expected_entities=entities), skip_incomplete=True)
    _run_daily(i, cycle, feed, history)
    return store.fva.current()


_WHOLE_FEED_SQL = _FEED_SQL.replace(f" AND date <> {_FEED_START} + 2", "")


@query(
    "g7_split_date",
    "date d, entity_id s, pred_demand f, actual_demand f, demand_error f, pred_price f, actual_price f, model_version s",
    _CYCLE_SQL.replace(_FEED_SQL, _WHOLE_FEED_SQL),
)
def g7_split_date(i: Inputs) -> DataFrame:
    """A date that comes in two deliveries is put together, and the complete date between them waits for it."""
    feed, entities, history = _feed(i)
    store = StateStore(i.spark, i.scratch("state"))
    _run_daily(i, C.DailyCycle(store, replace(DEFAULTS, expected_entities=entities)), feed, history, halves=True)
    return store.fva.current()


# The cycle of g13: all 88 features of the panel as it was fed, drift by date against the profile of the whole of it.
_FED = f"""
SELECT date, entity_id, demand_index, price_index, search_index, sentiment_index, ad_index FROM activity
WHERE date < {_FEED_START} UNION ALL
SELECT date, entity_id, demand_index, price_index, search_index, sentiment_index, ad_index FROM ({_FEED_SQL}) AS f"""
_UNPIVOTED = "UNPIVOT (SELECT COLUMNS(* EXCLUDE (entity_id)) FROM fed_gridded) ON COLUMNS(* EXCLUDE (date)) INTO NAME feature VALUE value"
_CYCLE_BASELINE = 1.5
_CYCLE_TABLES = {
    "fed": _FED,
    "fed_base": base_sql("fed"),
    "fed_near": proximity_sql("fed_base"),
    "fed_regimes": regime_sql("fed_base"),
    "fed_features": feature_sql("fed_base", "fed_near", "fed_regimes"),
    "fed_gridded": finalized_sql("fed_features"),
    "fed_cells": _UNPIVOTED,
    "fed_edges": f"""SELECT feature, list_sort(list_distinct([min(value), {grid_sql('quantile_cont(value, 0.1)')},
      {grid_sql('quantile_cont(value, 0.5)')}, {grid_sql('quantile_cont(value, 0.9)')}, max(value)])) AS e
      FROM fed_cells GROUP BY feature""",
    "fed_hits": f"""SELECT c.date, c.feature, CASE WHEN value = e[len(e)] THEN len(e) - 1
        ELSE len(list_filter(e, lambda x: x <= value)) END AS bin, count(*) AS n
      FROM fed_cells AS c JOIN fed_edges AS d ON d.feature = c.feature
      WHERE c.date >= {_FEED_START} AND value BETWEEN e[1] AND e[len(e)] GROUP BY ALL""",
    "fed_shares": """SELECT b.date, b.feature, b.size, b.bin, coalesce(h.n, 0)
        / greatest(sum(coalesce(h.n, 0)) OVER (PARTITION BY b.date, b.feature), 1) AS share
      FROM (SELECT date, feature, len(e) AS size, unnest(range(1, greatest(len(e), 2))) AS bin
        FROM fed_edges, (SELECT DISTINCT date FROM fed_hits) AS t) AS b
      LEFT JOIN fed_hits AS h ON h.date = b.date AND h.feature = b.feature AND h.bin = b.bin""",
    "fed_psi": """SELECT date, feature, CASE WHEN max(size) < 3 THEN 0.0
        ELSE sum((greatest(share, 1e-6) - x) * ln(greatest(share, 1e-6) / x)) END AS psi
      FROM (SELECT *, [0.1, 0.4, 0.4, 0.1][bin] AS x FROM fed_shares) AS s GROUP BY date, feature""",
    "fed_totals": f"""SELECT d.date, d.n_new, count(v.entity_id) AS n, coalesce(sum(abs(actual_demand - pred_demand)), 0) AS a,
        coalesce(sum(abs(actual_demand - pred_demand) / greatest(abs(actual_demand), 1e-6)), 0) AS p,
        coalesce(sum((actual_demand - pred_demand) * (actual_demand - pred_demand)), 0) AS s
      FROM (SELECT date, count(*) AS n_new FROM ({_FEED_SQL}) AS f GROUP BY date) AS d
      LEFT JOIN ({_CYCLE_SQL}) AS v ON v.date = d.date GROUP BY d.date, d.n_new""",
    # Whole dates, the newest that together hold at least 200 rows.
    "fed_metrics": """SELECT date, n_new, sum(a) / nullif(sum(n), 0) AS mae, sum(p) / nullif(sum(n), 0) AS mape,
        sqrt(sum(s) / nullif(sum(n), 0)) AS rmse
      FROM (SELECT d.date, d.n_new, t.a, t.p, t.s, t.n,
          sum(t.n) OVER (PARTITION BY d.date ORDER BY t.date DESC) - t.n AS newer
        FROM fed_totals AS d JOIN fed_totals AS t ON t.date <= d.date) AS w
      WHERE newer < 200 GROUP BY date, n_new""",
    "fed_days": f"""SELECT m.date, CAST(row_number() OVER (ORDER BY m.date) AS INTEGER) AS n, m.n_new, m.mae, m.mape, m.rmse,
        CASE WHEN mae IS NULL THEN 0.0 ELSE p.worst END AS worst, CASE WHEN mae IS NULL THEN '' ELSE p.psi_map END AS psi_map,
        coalesce(mae > {_CYCLE_BASELINE} * 1.25 OR mape > 0.2, false) AS perf, coalesce(mae > {_CYCLE_BASELINE} * 1.15, false) AS roll
      FROM fed_metrics AS m JOIN (SELECT date, max(psi) AS worst,
          string_agg(feature || '=' || CAST(floor(psi * 1e6 + 0.501) AS BIGINT), ' ' ORDER BY feature) AS psi_map
        FROM fed_psi GROUP BY date) AS p ON p.date = m.date""",
    "fed_walk": """SELECT 0 AS n, CAST(0 AS BIGINT) AS rows, 0 AS ps, 0 AS rs
      UNION ALL SELECT d.n, w.rows + d.n_new, CASE WHEN d.mae IS NULL THEN w.ps WHEN d.perf THEN w.ps + 1 ELSE 0 END,
        CASE WHEN d.mae IS NULL THEN w.rs WHEN d.roll THEN w.rs + 1 ELSE 0 END
      FROM fed_walk AS w JOIN fed_days AS d ON d.n = w.n + 1""",
}


@query(
    "g13_run_cycle",
    "date d, mae f, mape f, rmse f, max_feature_psi f, drift_status s, psi_map s, perf_streak i, roll_streak i, action s",
    with_tables(f"""SELECT d.date, d.mae, d.mape, d.rmse, d.worst AS max_feature_psi,
      CASE WHEN d.mae IS NULL THEN 'insufficient_data' WHEN d.worst > 0.3 THEN 'severe_feature_drift'
        WHEN d.worst > 0.2 THEN 'feature_drift' WHEN d.mae > {_CYCLE_BASELINE} * 1.25 THEN 'performance_drift' ELSE 'stable' END AS drift_status,
      d.psi_map, w.ps AS perf_streak, w.rs AS roll_streak,
      CASE WHEN d.mae IS NULL THEN 'none' WHEN w.rs >= 2 THEN 'rollback'
        WHEN d.n >= 3 AND ((d.perf AND w.ps >= 3 AND w.rows >= 100) OR (d.worst > 0.3 AND w.rows >= 100)
          OR (d.n >= 14 AND w.rows >= 150)) THEN 'retrain' ELSE 'none' END AS action
    FROM fed_days AS d JOIN fed_walk AS w ON w.n = d.n""", _CYCLE_TABLES),
)
def g13_run_cycle(i: Inputs) -> DataFrame:
    """Every date of the cycle: errors, drift of all features against the profile, status, streaks and decision."""
    feed, entities, history = _feed(i)
    names = list(S.FEATURE_CONTRACT)
    i.events, i.regimes = i.stored(i.events, "events"), i.stored(i.regimes, "regimes")
    third = F.date_add(feed.agg(F.min("date")).scalar(), 2)
    whole = history.unionByName(feed.filter(F.col("date") != third), allowMissingColumns=True)
    frame = i.stored(on_grid(finalize_features(X.feature_frame(normalize_feed(whole), i.events, i.regimes), names), names), "fed-features")
    store = StateStore(i.spark, i.scratch("state"))
    cycle = C.DailyCycle(
        store, replace(DEFAULTS, expected_entities=entities), NaiveScorer(), events=i.events, regimes=i.regimes,
        profile=i.stored(on_grid(drift.baseline_profile(frame, names), ["q10", "q50", "q90"]), "profile"),
        skip_incomplete=True, prepare=lambda live: on_grid(live, names),
    )
    day_before = history.agg(F.max(F.unix_date("date"))).first()[0]
    store.set_state({"active_baseline_mae": str(_CYCLE_BASELINE)}, day_before)
    done = _run_daily(i, cycle, feed, normalize_feed(history))
    told = i.spark.createDataFrame(
        [(r["date"], r["perf_streak"], r["roll_streak"], r["action"]) for r in done if r["status"] == "ingested"],
        "date DATE, perf_streak BIGINT, roll_streak BIGINT, action STRING",
    )
    logged = store.drift.log().withColumn("date", F.date_from_unix_date(F.col("_batch").cast("int")))
    units = F.transform(
        F.array_sort(F.map_entries(F.from_json("payload_json", "map<string,double>"))),
        lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] * 1e6 + 0.501).cast("string")),
    )
    return logged.withColumn("psi_map", F.array_join(units, " ")).join(told, "date")


# ---- policy -------------------------------------------------------------------------------------------------


def _category_errors(i: Inputs) -> DataFrame:
    return i.errors.join(i.activity.select("entity_id", "date", "category"), ["entity_id", "date"])


def _category_days(i: Inputs, version: str = "naive_lag1") -> DataFrame:
    return _daily_metrics(_category_errors(i).filter(F.col("model_version") == version), ["category", "date"])


_CATEGORY_DAYS = f"""SELECT category, date, {_METRICS}, count(*) AS n_rows FROM category_errors
  WHERE model_version = 'naive_lag1' GROUP BY category, date"""


@query(
    "c20_streaks", "category s, date d, streak i",
    f"""WITH days AS ({_CATEGORY_DAYS}),
      hits AS (SELECT category, date, CASE WHEN mae > 1.5 THEN 1 ELSE 0 END AS hit FROM days),
      runs AS (SELECT *, sum(1 - hit) OVER (PARTITION BY category ORDER BY date) AS run FROM hits)
    SELECT category, date, sum(hit) OVER (PARTITION BY category, run ORDER BY date) AS streak FROM runs""",
)
def c20_streaks(i: Inputs) -> DataFrame:
    days = _category_days(i).withColumn("hit", F.col("mae") > 1.5)
    return P.streaks(days, "hit", ["category"], ["date"])


def _deliveries(i: Inputs, rows: DataFrame, run) -> None:
    """The rows as files of a stream in two deliveries of dates, ``run`` on the folder after each; the second run goes on
    from the state that the first one left."""
    rows = i.stored(rows, "rows")
    days = rows.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    middle = F.date_add(F.lit(days["a"]), (days["b"] - days["a"]).days // 2) if days["a"] else F.lit(None).cast("date")
    folder = i.scratch("stream")
    for part in (F.col("date") <= middle, F.col("date") > middle):
        rows.filter(part).write.mode("append").parquet(folder)
        run(i.spark.readStream.schema(rows.schema).parquet(folder))


@query("c20_streaks_streamed", "category s, date d, streak i", QUERIES["c20_streaks"].sql)
def c20_streaks_streamed(i: Inputs) -> DataFrame:
    """The streaks of c20 from keyed state, over a restart."""
    days = _category_days(i).select("category", "date", (F.col("mae") > 1.5).alias("hit"))
    out, checkpoint = i.scratch("streaks"), i.scratch("checkpoint")
    _deliveries(i, days, lambda s: K.run_keyed(K.stream_streaks(s, "category", "hit"), out, checkpoint))
    return i.spark.read.parquet(out)


@query("c15_features_streamed", QUERIES["c15_feature_frame"].spec, QUERIES["c15_feature_frame"].sql)
def c15_features_streamed(i: Inputs) -> DataFrame:
    """The features of c15, each entity's last rows kept in keyed state, over a restart."""
    events, regimes = i.stored(i.events, "events"), i.stored(i.regimes, "regimes")
    out, checkpoint = i.scratch("features"), i.scratch("checkpoint")
    _deliveries(i, i.activity, lambda s: K.stream_features(s, out, checkpoint, events, regimes))
    return i.spark.read.parquet(out)


@query("e1_summary_streamed", QUERIES["e1_daily_summary"].spec, QUERIES["e1_daily_summary"].sql)
def e1_summary_streamed(i: Inputs) -> DataFrame:
    """The daily summary of e1 by watermarked windows, over a restart; a last row without entity closes the last dates."""
    out, checkpoint = i.scratch("summary"), i.scratch("checkpoint")
    rows = i.retail.select("date", "entity_id", *S.FEED_MEASURES, "event_type")

    def run(stream: DataFrame) -> None:
        stream = C.stream_daily_summary(stream, "1 day").drop("entities")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
            "append").trigger(availableNow=True).start().awaitTermination()

    end = rows.agg(F.date_add(F.max("date"), 9).alias("date"))
    _deliveries(i, rows.unionByName(end.filter("date IS NOT NULL"), allowMissingColumns=True), run)
    return i.spark.read.schema("date DATE, product_count BIGINT, event_count BIGINT, "
                               + ", ".join(f"avg_{m} DOUBLE" for m in S.FEED_MEASURES)).parquet(out)


# Drift of all 88 features by category and day, against the profile of the panel before its last ten dates. A day
# holds one value of each calendar feature, far from any profile, so the policy of h9 asks for more than the default.
_SEVERE = 13.0
_CATEGORY_PSI = {
    "category_cells": """SELECT a.category, g.date, g.feature, g.value
      FROM (UNPIVOT (SELECT * FROM gridded) ON COLUMNS(* EXCLUDE (entity_id, date)) INTO NAME feature VALUE value) AS g
      JOIN activity AS a ON a.entity_id = g.entity_id AND a.date = g.date""",
    "category_edges": "SELECT feature, list_sort(list_distinct([min, q10, q50, q90, max])) AS e FROM profile",
    "category_hits": """SELECT category, date, c.feature, CASE WHEN value = e[len(e)] THEN len(e) - 1
        ELSE len(list_filter(e, lambda x: x <= value)) END AS bin, count(*) AS n
      FROM category_cells AS c JOIN category_edges AS d ON d.feature = c.feature
      WHERE value BETWEEN e[1] AND e[len(e)] GROUP BY ALL""",
    "category_shares": """SELECT b.*, coalesce(h.n, 0)
        / greatest(sum(coalesce(h.n, 0)) OVER (PARTITION BY b.category, b.date, b.feature), 1) AS share
      FROM (SELECT category, date, feature, len(e) AS size, unnest(range(1, greatest(len(e), 2))) AS bin
        FROM category_edges, (SELECT DISTINCT category, date FROM category_cells) AS t) AS b
      LEFT JOIN category_hits AS h ON h.category = b.category AND h.date = b.date AND h.feature = b.feature AND h.bin = b.bin""",
    "category_psi": """SELECT category, date, max(psi) AS psi FROM (
        SELECT category, date, feature, CASE WHEN max(size) < 3 THEN 0.0
          ELSE sum((greatest(share, 1e-6) - x) * ln(greatest(share, 1e-6) / x)) END AS psi
        FROM (SELECT *, [0.1, 0.4, 0.4, 0.1][bin] AS x FROM category_shares) AS s GROUP BY category, date, feature) AS f
      GROUP BY category, date""",
}
_POLICY = replace(
    DEFAULTS, retrain_mape_threshold=0.75, retrain_min_new_rows=20, retrain_schedule_min_rows=30, psi_severe_threshold=_SEVERE,
)


@query(
    "h9_policy",
    "category s, date d, sim_day i, rows_since_retrain i, perf_streak i, rollback_streak i, performance_drift i, "
    "max_feature_psi f, severe_feature_drift i, action s",
    with_tables(f"""SELECT * FROM (WITH RECURSIVE days AS ({_CATEGORY_DAYS}),
      base AS (SELECT category, avg(mae) AS baseline FROM days GROUP BY category),
      seq AS (SELECT d.*, b.baseline, p.psi,
          CASE WHEN d.mae > b.baseline * 1.25 OR d.mape > 0.75 THEN 1 ELSE 0 END AS perf,
          CASE WHEN d.mae > b.baseline * 1.15 THEN 1 ELSE 0 END AS roll,
          row_number() OVER (PARTITION BY d.category ORDER BY d.date) AS n
        FROM days AS d JOIN base AS b ON b.category = d.category
        JOIN category_psi AS p ON p.category = d.category AND p.date = d.date),
      walk AS (
        SELECT category, 0 AS n, CAST(NULL AS DATE) AS date, 0 AS last, CAST(0 AS BIGINT) AS rows, 0 AS ps, 0 AS rs,
          0 AS perf, 0 AS severe, CAST(0 AS BIGINT) AS show_rows, 0 AS show_ps, 0 AS show_rs, 'none' AS action FROM base
        UNION ALL
        SELECT category, n, date,
          CASE WHEN action = 'retrain' THEN n ELSE last END,
          CASE WHEN action = 'retrain' THEN 0 ELSE rows END,
          CASE WHEN action = 'retrain' THEN 0 ELSE ps END,
          CASE WHEN action <> 'none' THEN 0 ELSE rs END,
          perf, severe, rows, ps, rs, action
        FROM (SELECT *, CASE WHEN rs >= 2 THEN 'rollback' WHEN n - last >= 3 AND ((perf = 1 AND ps >= 3 AND rows >= 20)
              OR (psi > {_SEVERE} AND rows >= 20) OR (n - last >= 14 AND rows >= 30)) THEN 'retrain' ELSE 'none' END AS action,
              CASE WHEN psi > {_SEVERE} THEN 1 ELSE 0 END AS severe
          FROM (SELECT s.category, CAST(s.n AS INTEGER) AS n, s.date, w.last, w.rows + s.n_rows AS rows,
              CASE WHEN s.perf = 1 THEN w.ps + 1 ELSE 0 END AS ps, CASE WHEN s.roll = 1 THEN w.rs + 1 ELSE 0 END AS rs,
              s.perf, s.psi
            FROM walk AS w JOIN seq AS s ON s.category = w.category AND s.n = w.n + 1) AS stepped) AS decided)
    SELECT w.category, w.date, n AS sim_day, show_rows AS rows_since_retrain, show_ps AS perf_streak,
      show_rs AS rollback_streak, perf AS performance_drift, p.psi AS max_feature_psi,
      severe AS severe_feature_drift, action
    FROM walk AS w JOIN category_psi AS p ON p.category = w.category AND p.date = w.date WHERE n > 0) AS h""", _CATEGORY_PSI),
)
def h9_policy(i: Inputs) -> DataFrame:
    """Decisions of every day per category; the category's mean error is its baseline."""
    names = list(S.FEATURE_CONTRACT)
    i.activity = i.stored(i.activity, "panel")
    frame = i.stored(on_grid(finalize_features(i.feature_rows, names).select("date", "category", *names), names), "features")
    marks = ["q10", "q50", "q90", "mean", "std"]
    profile = i.stored(on_grid(drift.baseline_profile(frame.filter(F.col("date") < i.first_live_date), names), marks), "profile")
    psi = drift.feature_psi(frame, profile, names, "quantile", ["category", "date"])
    worst = i.stored(psi.groupBy("category", "date").agg(F.max("psi").alias("max_feature_psi")), "psi")
    days = i.stored(_category_days(i), "days")
    base = days.groupBy("category").agg(F.avg("mae").alias("baseline_mae"))
    daily = days.join(base, "category").join(worst, ["category", "date"]).select(
        "category", "date", "mae", "mape", "baseline_mae", F.col("n_rows").alias("n_new"), "max_feature_psi",
    )
    return P.policy_replay(daily, ["category"], _POLICY).join(worst, ["category", "date"])


@query(
    "h5_accept", "category s, champion f, challenger f, accepted i",
    """SELECT category, champion, challenger, CASE WHEN challenger <= champion * 0.98 THEN 1 ELSE 0 END AS accepted
    FROM (SELECT category, avg(abs_demand_error) FILTER (model_version = 'naive_lag1') AS champion,
      avg(abs_demand_error) FILTER (model_version = 'mean_7') AS challenger FROM category_errors GROUP BY category) AS x""",
)
def h5_accept(i: Inputs) -> DataFrame:
    error, version = F.col("abs_demand_error"), F.col("model_version")
    sides = _category_errors(i).groupBy("category").agg(
        F.avg(F.when(version == "naive_lag1", error)).alias("champion"),
        F.avg(F.when(version == "mean_7", error)).alias("challenger"),
    )
    return sides.withColumn("accepted", P.acceptance(F.col("challenger"), F.col("champion")))


def _replayed(i: Inputs) -> DataFrame:
    label = F.concat_ws(" ", week_start(F.col("date")).cast("string"), "model_version")
    runs = _category_errors(i).groupBy("category", label.alias("version")).agg(F.avg("abs_demand_error").alias("mae"))
    return P.registry_replay(runs.withColumn("trained", F.col("version")), ["category"], ["trained"])


@query(
    "h6_registry_replay", "category s, run_no i, version s, mae f, status s, active_version s, last_stable_version s",
    "SELECT category, run_no, version, mae, status, active_version, last_stable_version FROM replay",
)
def h6_registry_replay(i: Inputs) -> DataFrame:
    return _replayed(i).withColumn("run_no", F.col("run_no") + 1)


@query(
    "h7_rollback", "category s, version s, status s, reason s, rolled_back i",
    """WITH done AS (SELECT category, active_version, last_stable_version FROM replay
        QUALIFY row_number() OVER (PARTITION BY category ORDER BY run_no DESC) = 1)
    SELECT c.category, c.version, CASE
        WHEN d.active_version = d.last_stable_version THEN
          CASE WHEN c.version = d.active_version THEN 'active' ELSE 'archived' END
        WHEN c.version = d.last_stable_version THEN 'active' WHEN c.version = d.active_version THEN 'rolled_back'
        ELSE 'archived' END AS status,
      CASE WHEN d.active_version = d.last_stable_version THEN 'already_on_stable' END AS reason,
      CASE WHEN d.active_version = d.last_stable_version THEN 0 ELSE 1 END AS rolled_back
    FROM candidates AS c JOIN done AS d ON d.category = c.category""",
)
def h7_rollback(i: Inputs) -> DataFrame:
    runs = i.stored(_replayed(i), "runs")
    final = runs.groupBy("category").agg(
        F.max_by("active_version", "run_no").alias("active"), F.max_by("last_stable_version", "run_no").alias("stable")
    )
    registry = runs.select("category", "version").join(final, "category").select(
        "category", "version", F.when(F.col("version") == F.col("active"), "active").otherwise("archived").alias("status"),
        F.col("stable").alias("last_stable_version"),
    )
    return P.rollback(registry, ["category"])


@query(
    "f4_retrain_jobs", "trigger_reason s, segment s, old_version s, new_version s, status s",
    """SELECT 'policy' AS trigger_reason, category AS segment, old_version, version AS new_version, status FROM (
      SELECT *, lag(active_version) OVER (PARTITION BY category ORDER BY run_no) AS old_version FROM replay) AS x
    ORDER BY run_no DESC, category DESC LIMIT 20""",
)
def f4_retrain_jobs(i: Inputs) -> DataFrame:
    ordered = Window.partitionBy("category").orderBy("run_no")
    jobs = _replayed(i).select(
        F.lit("policy").alias("trigger_reason"), F.col("category").alias("segment"), "run_no",
        F.lag("active_version").over(ordered).alias("old_version"), F.col("version").alias("new_version"), "status",
    )
    return state.newest_rows(jobs, ["run_no", "segment"], 20)


@query(
    "f8_status",
    "sim_day i, latest_date s, active_model_version s, rows_since_last_retrain i, drift_status s, mae f, mape f, "
    "rmse f, max_feature_psi f, registry_version s",
    f"""SELECT (SELECT count(DISTINCT date) FROM activity) AS sim_day,
      (SELECT strftime(max(date), '%Y-%m-%d') FROM activity) AS latest_date, 'mean_7' AS active_model_version,
      (SELECT count(*) FROM activity) AS rows_since_last_retrain, 'stable' AS drift_status, m.mae, m.mape, m.rmse,
      0.0 AS max_feature_psi, 'mean_7' AS registry_version
    FROM (SELECT {_METRICS} FROM errors WHERE model_version = 'mean_7' GROUP BY date ORDER BY date DESC LIMIT 1) AS m""",
)
def f8_status(i: Inputs) -> DataFrame:
    facts = i.activity.agg(
        F.countDistinct("date").cast("string").alias("sim_day"),
        F.max("date").cast("string").alias("last_ingested_date"),
        F.lit("mean_7").alias("active_model_version"),
        F.count("*").cast("string").alias("rows_since_last_retrain"),
    )
    keys = facts.unpivot([], facts.columns, "state_key", "state_value")
    daily = _daily_metrics(i.errors.filter("model_version = 'mean_7'"), ["date"])
    snapshots = daily.withColumn("max_feature_psi", F.lit(0.0)).withColumn(
        "drift_status", drift.drift_status(F.col("mae"), F.col("max_feature_psi"), F.lit(DEFAULTS.unset_baseline_mae))
    )
    registry = i.forecasts.groupBy(F.col("model_version").alias("version")).agg(F.count("*").alias("n")).withColumn(
        "status", F.when(F.col("version") == "mean_7", "active").otherwise("archived")
    )
    return state.engine_status(keys, snapshots, registry, ["date"])


# ---- H. models ------------------------------------------------------------------------------------------------

_GUARD = replace(DEFAULTS, min_train_rows=200, min_valid_rows=40)


@query(
    "h1_train_guards", "brand s, n_rows i, n_dates i, n_train i, n_valid i, reason s",
    """WITH frame AS (SELECT brand, date, lead(demand_index) OVER (PARTITION BY entity_id ORDER BY date) AS target
        FROM activity),
      days AS (SELECT brand, date, count(*) AS n, count(target) AS t,
          row_number() OVER (PARTITION BY brand ORDER BY date) AS k, count(*) OVER (PARTITION BY brand) AS n_dates
        FROM frame GROUP BY brand, date),
      counts AS (SELECT brand, sum(n) AS n_rows, max(n_dates) AS n_dates,
          coalesce(sum(t) FILTER (k <= floor(n_dates * 0.8)), 0) AS n_train,
          coalesce(sum(t) FILTER (k > floor(n_dates * 0.8)), 0) AS n_valid FROM days GROUP BY brand)
    SELECT *, CASE WHEN n_rows < 200 THEN 'insufficient_rows:' || CAST(n_rows AS BIGINT) WHEN n_dates < 20 THEN
      'insufficient_unique_dates' WHEN floor(n_dates * 0.8) <= 0 OR floor(n_dates * 0.8) >= n_dates THEN
      'invalid_train_valid_split' WHEN n_train = 0 THEN 'empty_train_partition' WHEN n_valid < 40 THEN
      'insufficient_validation_rows' ELSE 'ok' END AS reason FROM counts""",
)
def h1_train_guards(i: Inputs) -> DataFrame:
    """Guards per brand, on the panel with its next-row target (the last row has none)."""
    ahead = F.lead("demand_index").over(Window.partitionBy("entity_id").orderBy("date"))
    frame = i.activity.withColumn("target", ahead)
    return M.training_guards(frame, ["demand_index"], settings=_GUARD, segment=["brand"])


@query(
    "h2_date_split", "is_train i, n_rows i, n_dates i, first_date d, last_date d",
    """SELECT CASE WHEN k <= floor(total * 0.8) THEN 1 ELSE 0 END AS is_train, sum(n) AS n_rows, count(*) AS n_dates,
      min(date) AS first_date, max(date) AS last_date FROM (SELECT date, count(*) AS n, row_number() OVER (ORDER BY date)
        AS k, count(*) OVER () AS total FROM retail GROUP BY date) AS x GROUP BY 1""",
)
def h2_date_split(i: Inputs) -> DataFrame:
    return M.split_by_date(i.retail).groupBy("is_train").agg(
        F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


_SMALL = M.Learner(trees=4, depth=4, rate=0.3)
_INPUTS = list(S.FEATURE_CONTRACT)


def _trained(i: Inputs, rows: DataFrame | None = None, learner: M.Learner = _SMALL) -> M.TrainedModel | None:
    """``rows``: the features of all rows, where they are stored."""
    frame = X.training_frame(i.activity, i.events, i.regimes, _INPUTS) if rows is None else X.training_rows(rows, _INPUTS)
    return M.train(frame, _INPUTS, "gbt", i.scratch("model"), learner)[0]


@query("h3_gbt_train", "feature s, min f, q50 f, max f, mae f, rmse f")
def h3_gbt_train(i: Inputs) -> DataFrame:
    """The demand model with all its trees: its profile and validation errors."""
    model = _trained(i, learner=M.Learner())
    if model is None:
        return i.spark.createDataFrame([], "feature STRING, min DOUBLE, q50 DOUBLE, max DOUBLE, mae DOUBLE, rmse DOUBLE")
    return model.profile.withColumn("mae", F.lit(model.mae)).withColumn("rmse", F.lit(model.rmse))


@query("h4_predict", "entity_id s, date d, pred_demand f")
def h4_predict(i: Inputs) -> DataFrame:
    """Stored model applied to the features of every panel row."""
    rows = i.stored(i.feature_rows, "feature-rows")
    model = _trained(i, rows)
    if model is None:
        return i.spark.createDataFrame([], "entity_id STRING, date DATE, pred_demand DOUBLE")
    return M.score(model.pipeline, rows, model.features)


@query(
    "h11_forecast", "target_date d, entity_id s, pred_demand f, pred_price f, model_version s, explanation_text s",
    "SELECT date + 1 AS target_date, entity_id, demand_index AS pred_demand, price_index AS pred_price, "
    "'naive_lag1' AS model_version, "
    + _reason_sql("search_index", "sentiment_index", "ad_index", "'organic'", "price_index")
    + " AS explanation_text FROM activity WHERE date = (SELECT max(date) FROM activity)",
)
def h11_forecast(i: Inputs) -> DataFrame:
    """From the newest actuals; the history ends before them."""
    known = i.activity.agg(F.max("date")).scalar()
    history = i.activity.filter(F.col("date") < known)
    return forecast_next_day(history, None, NaiveScorer(), actuals=i.activity.filter(F.col("date") >= i.first_live_date))


@query(
    "h15_context_batch", "source s, entity_id s, date d, demand_index f, price_index f",
    f"""SELECT CASE WHEN x.newer THEN 'actuals' ELSE 'history' END AS source, entity_id, date, demand_index, price_index
    FROM activity JOIN (SELECT max(date) AS last, TRUE AS newer FROM activity
      UNION ALL SELECT max(date), FALSE FROM activity WHERE date < {_LATE}) AS x ON date = x.last""",
)
def h15_context_batch(i: Inputs) -> DataFrame:
    """The rows that a forecast without a batch starts from: with newer actuals, and from history alone."""
    history = i.activity.filter(F.col("date") < i.first_live_date)
    newer = i.activity.filter(F.col("date") >= i.first_live_date)
    legs = {"actuals": latest_context(history, newer), "history": latest_context(history, newer.filter(F.lit(False)))}
    named = [rows.withColumn("source", F.lit(name)) for name, rows in legs.items()]
    return named[0].unionByName(named[1])


@query(
    "h12_reason_text", "entity_id s, date d, explanation_text s",
    "SELECT entity_id, date, "
    + _reason_sql("demand_index", "sentiment_index", "ad_index", "event_type", "price_index / 30")
    + " AS explanation_text FROM retail",
)
def h12_reason_text(i: Inputs) -> DataFrame:
    text = A.reason_text(
        F.col("demand_index"), F.col("sentiment_index"), F.col("ad_index"), F.col("event_type"), F.col("price_index") / 30
    )
    return i.retail.withColumn("explanation_text", text)


@query("h13_contributions", "entity_id s, date d, pred_demand f, explained f, shap_explanation s")
def h13_contributions(i: Inputs) -> DataFrame:
    """The three inputs that move each row's next-day demand most in the trees; ``explained`` is the mean and all shares."""
    rows = i.stored(i.feature_rows, "feature-rows")
    model = _trained(i, rows)
    if model is None:
        return i.spark.createDataFrame(
            [], "entity_id STRING, date DATE, pred_demand DOUBLE, explained DOUBLE, shap_explanation STRING")
    scored = M.score(model.pipeline, rows, model.features)
    told = with_shares(scored, model.leaves, model.features)
    total = F.aggregate(SHARES, F.lit(model.leaves.mean), lambda a, x: a + x)
    return told.withColumn("explained", total).withColumn("shap_explanation", shares_text(model.features))


@query("h14_retrain", "version s, status s, mae f, rmse f")
def h14_retrain(i: Inputs) -> DataFrame:
    """Two training runs through the champion gate."""
    store = StateStore(i.spark, i.scratch("state"))
    store.panel.append(i.activity, 1)
    history = store.history()
    for batch, learner in ((1, _SMALL), (2, M.Learner(trees=8, depth=4, rate=0.3))):
        retrain(store, history, batch, features=_INPUTS, learner=learner, version=f"run_{batch}")
    return store.registry.current()
