"""Registered queries: sources, cleaning, features, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.columns import lenient_date, lenient_double, safe_double
from tidepanel.operators import dedup, features as X, normalize as N
from tidepanel.operators.drift import baseline_profile
from tidepanel.operators.series import latest_two_dates
from tidepanel.plans.registry import Inputs, query
from tidepanel.plans.shared_sql import SIX, row_features
from tidepanel.sources import files, schemas as S, state

_ROW = row_features()


def _select_rows(names: list[str], base: str) -> str:
    shown = ", ".join(f"{_ROW[n]} AS {n}" for n in names)
    return f"SELECT entity_id, date, {shown} FROM {base}"


def _spec(names: list[str]) -> str:
    return "entity_id s, date d, " + ", ".join(f"{n} f" for n in names)


# ---- A. sources ---------------------------------------------------------------------------------------


@query(
    "a1_csv_scan", "date d, entity_id s, brand s, demand_index f, price_index f, event_type s, new_reviews f",
    "SELECT date, entity_id, brand, demand_index, price_index, NULL AS event_type, new_reviews FROM activity",
)
def a1_csv_scan(i: Inputs) -> DataFrame:
    path = i.scratch("panel-csv")
    files.replace_table(i.activity, path, "csv")
    return files.scan_csv(i.spark, path, S.FEED)


_RAW = ["demand_index", "price_index", "search_index", "ad_index", "sentiment_index", "new_reviews"]


@query(
    "a2_contract_scan", "feature s, min f, q10 f, q50 f, q90 f, max f, mean f, std f",
    "SELECT feature, min(value) AS min, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, "
    "quantile_cont(value, 0.9) AS q90, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std "
    f"FROM (UNPIVOT (SELECT {', '.join(_RAW)} FROM activity) ON COLUMNS(*) INTO NAME feature VALUE value) AS u "
    "GROUP BY feature",
)
def a2_contract_scan(i: Inputs) -> DataFrame:
    path = i.scratch("profile-json")
    files.profile_document(baseline_profile(i.activity, _RAW)).coalesce(1).write.text(path)
    return files.scan_profile_json(i.spark, path)


@query(
    "a4_state_sql", "entity_id s, n_days i, demand f",
    "SELECT entity_id, count(*) AS n_days, sum(demand_index) AS demand FROM activity "
    "WHERE date >= DATE '2024-01-15' AND sentiment_index >= 0.4 GROUP BY entity_id",
)
def a4_state_sql(i: Inputs) -> DataFrame:
    return state.read_sql(
        i.spark,
        "SELECT entity_id, count(*) AS n_days, sum(demand_index) AS demand FROM {actuals} "
        "WHERE date >= to_date(:since) AND sentiment_index >= :mood GROUP BY entity_id",
        {"actuals": i.activity}, since="2024-01-15", mood=0.4,
    )


@query(
    "a5_feed_source",
    "date d, entity_id s, brand s, category s, demand_index f, price_index f, sentiment_index f, "
    "search_index f, ad_index f, event_type s, impact_direction s, priority s, event_effect_hint s",
    "SELECT date, entity_id, brand, category, demand_index, price_index, sentiment_index, search_index, "
    "ad_index, 'organic' AS event_type, 'neutral' AS impact_direction, 'medium' AS priority, "
    "'organic_continuation' AS event_effect_hint FROM activity",
)
def a5_feed_source(i: Inputs) -> DataFrame:
    path = i.scratch("feed")
    # A feed file that lacks the text columns altogether.
    i.activity.drop("new_reviews").write.option("header", True).csv(path)
    raw = i.spark.read.option("header", True).csv(path)
    return dedup.keep_last(N.normalize_feed(raw), ["date", "entity_id"])


@query(
    "a6_payload_json", "entity_id s, n_types i, purchases f, top_type s",
    """SELECT CAST(user_id AS VARCHAR) AS entity_id, count(DISTINCT event_type) AS n_types,
      sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS purchases,
      (SELECT x.event_type FROM (SELECT e2.user_id, e2.event_type, sum(e2.value) AS v FROM events AS e2
        GROUP BY 1, 2) AS x WHERE x.user_id = e.user_id ORDER BY x.v DESC, x.event_type LIMIT 1) AS top_type
    FROM events AS e GROUP BY user_id""",
)
def a6_payload_json(i: Inputs) -> DataFrame:
    """Encode each entity's totals by type as JSON, then read them back out of the text."""
    by_type = i.table("events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    entry = F.struct("event_type", "v")
    encoded = by_type.groupBy(F.col("user_id").cast("string").alias("entity_id")).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("payload")
    )
    decoded = encoded.withColumn("m", F.from_json("payload", "MAP<STRING, DOUBLE>"))
    entries = F.map_entries("m")
    largest = F.array_max(F.transform(entries, lambda e: e["value"]))
    return decoded.select(
        "entity_id", F.size(entries).alias("n_types"),
        F.coalesce(F.col("m")["purchase"], F.lit(0.0)).alias("purchases"),
        F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == largest), lambda e: e["key"])).alias("top_type"),
    )


# ---- B. cleaning ----------------------------------------------------------------------------------------


@query(
    "b1_normalize_feed", "date d, entity_id s, brand s, product_name s, demand_index f, price_index f, event_type s",
    "SELECT date, entity_id, brand, '' AS product_name, CASE WHEN ad_index = 0 THEN 0.0 ELSE demand_index END "
    "AS demand_index, CASE WHEN search_index = 0 THEN 0.0 ELSE price_index END AS price_index, "
    "'organic' AS event_type FROM activity WHERE demand_index < 6",
)
def b1_normalize_feed(i: Inputs) -> DataFrame:
    messy = i.activity.select(
        F.col("entity_id").alias("product_id"), "brand",
        F.when(F.col("demand_index") >= 6, "n/a").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(F.col("ad_index") == 0, float("nan")).otherwise(F.col("demand_index")).alias("demand_index"),
        F.when(F.col("search_index") == 0, "bad").otherwise(F.col("price_index").cast("string")).alias("price_new"),
    )
    return N.normalize_feed(messy)


@query(
    "b2_normalize_panel",
    "entity_id s, date d, demand_index f, price_new f, search_interest f, avg_rating f, stock_status_score f, "
    "discount_pct f, event_type s",
    "SELECT entity_id, date, demand_index + CASE WHEN event_type = 'promotion' THEN 1 ELSE 0 END AS demand_index, "
    "price_index AS price_new, search_index AS search_interest, 4.0 AS avg_rating, 1.0 AS stock_status_score, "
    "discount_pct, event_type FROM retail",
)
def b2_normalize_panel(i: Inputs) -> DataFrame:
    """Every row once, promotion rows again with corrected demand: the correction wins."""
    panel = i.retail.withColumn("_seq", F.lit(1))
    fixed = i.retail.filter("event_type = 'promotion'").withColumn(
        "demand_index", F.col("demand_index") + 1
    ).withColumn("_seq", F.lit(2))
    return N.normalize_panel(panel.unionByName(fixed))


@query(
    "b3_normalize_events", "entity_id s, date d, event_type s, event_intensity_score f",
    "SELECT * FROM events_by_type",
)
def b3_normalize_events(i: Inputs) -> DataFrame:
    return N.normalize_events(i.events)


@query(
    "b4_normalize_regime", "entity_id s, date d, recent_change_point_flag f, regime_shift_strength f",
    "SELECT entity_id, date, change_point AS recent_change_point_flag, shift_strength AS regime_shift_strength FROM regimes",
)
def b4_normalize_regime(i: Inputs) -> DataFrame:
    return N.normalize_regimes(i.regimes.withColumnRenamed("change_point", "rule_change_point"))


_LINE = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"


@query(
    "b5_dedup_keep_last", "l_partkey i, date d, l_orderkey i, l_linenumber i, l_suppkey i, l_quantity f, l_extendedprice f",
    f"""SELECT * FROM (SELECT l_partkey, CAST(l_shipdate AS DATE) AS date, {_LINE}, row_number() OVER (
      PARTITION BY l_partkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC,
      l_quantity DESC, l_extendedprice DESC) AS n FROM lineitem) AS x WHERE n = 1""",
)
def b5_dedup_keep_last(i: Inputs) -> DataFrame:
    rows = i.table("lineitem").select(
        "l_partkey", F.col("l_shipdate").cast("date").alias("date"), *_LINE.split(", ")
    )
    return dedup.keep_last(rows, ["l_partkey", "date"], ["l_orderkey", "l_linenumber"])


@query(
    "b7_lenient_cast", "event_type s, n_rows i, n_number i, n_date i, total f, safe_total f",
    """SELECT event_type, count(*) AS n_rows,
      count(*) FILTER (event_type NOT IN ('view', 'click')) AS n_number,
      count(*) FILTER (event_type <> 'error') AS n_date,
      CASE WHEN event_type NOT IN ('view', 'click') THEN sum(value) END AS total,
      CASE WHEN event_type NOT IN ('view', 'click') THEN sum(value) ELSE count(*) * 2.5 END AS safe_total
    FROM events GROUP BY event_type""",
)
def b7_lenient_cast(i: Inputs) -> DataFrame:
    """Views carry bad numbers, clicks NaN, errors bad dates; nothing throws and nothing leaks into sums."""
    kind = F.col("event_type")
    dirty = i.table("events").select(
        "event_type",
        F.when(kind == "view", "bad").when(kind == "click", "NaN").otherwise(F.col("value").cast("string")).alias("v"),
        F.when(kind == "error", "yesterday").otherwise(F.col("ts").cast("string")).alias("d"),
    )
    return dirty.groupBy("event_type").agg(
        F.count("*").alias("n_rows"),
        F.count(lenient_double(F.col("v"))).alias("n_number"),
        F.count(lenient_date(F.col("d"))).alias("n_date"),
        F.sum(lenient_double(F.col("v"))).alias("total"),
        F.sum(safe_double(F.col("v"), 2.5)).alias("safe_total"),
    )


@query(
    "b10_finalize", "entity_id s, date d, demand_lag_1 f, ratio f, not_there f",
    "SELECT entity_id, date, coalesce(lag(demand_index) OVER (PARTITION BY entity_id ORDER BY date), 0.0) AS "
    "demand_lag_1, CASE WHEN discount_pct = 0 THEN 0.0 ELSE demand_index / discount_pct END AS ratio, "
    "0.0 AS not_there FROM retail",
)
def b10_finalize(i: Inputs) -> DataFrame:
    lagged = X.add_demand_lags(i.retail)
    ratio = F.when(F.col("discount_pct") == 0, float("inf")).otherwise(F.col("demand_index") / F.col("discount_pct"))
    return N.finalize_features(lagged.withColumn("ratio", ratio), ["demand_lag_1", "ratio", "not_there"])


@query(
    "b11_category_filter", "entity_id s, date d, category s, demand_index f",
    "SELECT entity_id, date, category, demand_index FROM retail WHERE lower(category) = 'economy'",
)
def b11_category_filter(i: Inputs) -> DataFrame:
    return N.filter_category(i.retail, "Economy")


@query(
    "b15_contract_audit", "feature s, present i, n_rows i, n_null i, n_nan i, n_inf i, n_zero i",
    "SELECT 'unknown_feature' AS feature, 0 AS present, count(*) AS n_rows, count(*) AS n_null, 0 AS n_nan, "
    "0 AS n_inf, 0 AS n_zero FROM feature_rows UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{f}', 1, count(*), count(*) - count({f}), 0, 0, count(*) FILTER ({f} = 0) FROM feature_rows"
        for f in S.FEATURE_CONTRACT
    ),
)
def b15_contract_audit(i: Inputs) -> DataFrame:
    return N.contract_audit(i.feature_rows, [*S.FEATURE_CONTRACT, "unknown_feature"])


# ---- C. features ------------------------------------------------------------------------------------------

_LAGS = [f"demand_lag_{k}" for k in (1, 2, 3, 7)]
_ROLLING = ["demand_3d_mean", "demand_7d_mean", "demand_7d_std", "demand_volatility_7d", "demand_range_7d"]
_CHANGES = ["demand_change_1", "demand_change_3", "demand_momentum_7", "trend_strength_7d"]
_SIGNAL_ROLLING = [
    "reviews_7d_sum", "search_7d_avg", "sentiment_7d_avg", "price_7d_avg", "new_reviews_7d_sum",
    "price_new_7d_std", *[f"{s}_7d_mean" for s in SIX],
]
_SIGNAL_LAGS = [f"{s}_lag_{k}" for s in SIX for k in (1, 7)]
_SIGNAL_DIFFS = [f"{s}_{d}" for s in SIX for d in ("change", "momentum")]
_INTERACTIONS = [
    "price_x_search", "search_x_sentiment", "ad_x_search", "discount_x_demand_lag_1", "buzz_x_search",
    "rating_x_reviews",
]
_CALENDAR = [
    "day_of_week_num", "month_num", "is_weekend", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
]
_EVENTS = list(X._EVENT_DEFAULTS)
_REGIME = list(X._REGIME_DEFAULTS)


@query("c1_demand_lags", _spec(_LAGS), _select_rows(_LAGS, "retail"))
def c1_demand_lags(i: Inputs) -> DataFrame:
    return X.add_demand_lags(i.retail)


@query("c2_demand_rolling", _spec(_ROLLING), _select_rows(_ROLLING, "retail"))
def c2_demand_rolling(i: Inputs) -> DataFrame:
    return X.add_demand_rolling(i.retail)


@query("c3_demand_changes", _spec(_CHANGES), _select_rows(_CHANGES, "retail"))
def c3_demand_changes(i: Inputs) -> DataFrame:
    return X.add_demand_changes(i.retail)


@query("c4_signal_rolling", _spec(_SIGNAL_ROLLING), _select_rows(_SIGNAL_ROLLING, "base"))
def c4_signal_rolling(i: Inputs) -> DataFrame:
    return X.add_signal_rolling(N.normalize_panel(i.activity))


@query("c5_signal_lags", _spec(_SIGNAL_LAGS), _select_rows(_SIGNAL_LAGS, "base"))
def c5_signal_lags(i: Inputs) -> DataFrame:
    return X.add_signal_lags(N.normalize_panel(i.activity))


@query("c6_signal_diffs", _spec(_SIGNAL_DIFFS), _select_rows(_SIGNAL_DIFFS, "base"))
def c6_signal_diffs(i: Inputs) -> DataFrame:
    return X.add_signal_diffs(N.normalize_panel(i.activity))


@query(
    "c7_lead_target", "entity_id s, date d, demand_index f, target f",
    "SELECT * FROM (SELECT entity_id, date, demand_index, lead(demand_index, 2) OVER (PARTITION BY entity_id "
    "ORDER BY date) AS target FROM retail) AS x WHERE target IS NOT NULL",
)
def c7_lead_target(i: Inputs) -> DataFrame:
    return X.add_lead_target(i.retail, horizon=2)


@query("c8_health_index", "entity_id s, date d, health_index f", _select_rows(["health_index"], "retail_base"))
def c8_health_index(i: Inputs) -> DataFrame:
    return X.add_health_index(N.normalize_panel(i.retail))


@query("c9_event_proximity", _spec(_EVENTS), "SELECT * FROM proximity")
def c9_event_proximity(i: Inputs) -> DataFrame:
    return X.add_event_proximity(i.activity, i.events)


@query(
    "c10_event_type_code", "event_type s, event_type_encoded i",
    "SELECT event_type, code AS event_type_encoded FROM event_codes",
)
def c10_event_type_code(i: Inputs) -> DataFrame:
    return X.event_type_codes(i.events)


@query(
    "c11_regime_join", _spec(_REGIME[:2]),
    "SELECT entity_id, date, recent_change_point_flag, regime_shift_strength FROM regime_marks",
)
def c11_regime_join(i: Inputs) -> DataFrame:
    return X.add_regime_features(i.activity, i.regimes)


@query(
    "c12_regime_recent", _spec(_REGIME[2:]), "SELECT entity_id, date, regime_flag_recent FROM regime_marks",
)
def c12_regime_recent(i: Inputs) -> DataFrame:
    return X.add_regime_features(i.activity, i.regimes)


@query("c13_interactions", _spec(_INTERACTIONS), _select_rows(_INTERACTIONS, "retail_base"))
def c13_interactions(i: Inputs) -> DataFrame:
    return X.add_interactions(N.normalize_panel(i.retail))


@query("c14_calendar", _spec(_CALENDAR), _select_rows(_CALENDAR, "retail"))
def c14_calendar(i: Inputs) -> DataFrame:
    return X.add_calendar(i.retail)


_ALL = S.FEATURE_CONTRACT


@query("c15_feature_frame", _spec(_ALL), "SELECT * FROM feature_rows")
def c15_feature_frame(i: Inputs) -> DataFrame:
    return i.feature_rows


_FILLED = ", ".join(f"coalesce({n}, 0.0) AS {n}" for n in _ALL)


@query(
    "c16_training_frame", _spec([*_ALL, "target"]),
    f"SELECT entity_id, date, {_FILLED}, target FROM (SELECT *, lead(demand_index) OVER (PARTITION BY entity_id "
    "ORDER BY date) AS target FROM feature_rows) AS x WHERE target IS NOT NULL",
)
def c16_training_frame(i: Inputs) -> DataFrame:
    return X.training_frame(i.activity, i.events, i.regimes)


def _live_batch(i: Inputs) -> DataFrame:
    """The last date again with corrected demand, prices and searches, as a batch that follows the history."""
    last = i.activity.agg(F.max("date")).scalar()
    return i.activity.filter(F.col("date") == last).withColumns({
        "demand_index": F.col("demand_index") + 1, "price_index": F.col("price_index") * 1.5 + 1,
        "search_index": F.col("search_index") + 2,
    })


@query(
    "c17_live_frame", _spec(_ALL),
    # Prices and searches of the batch are in its features; its demand is not, as those end at the previous row.
    f"SELECT entity_id, date, {_FILLED} FROM live_rows WHERE date = (SELECT max(date) FROM activity)",
)
def c17_live_frame(i: Inputs) -> DataFrame:
    return X.live_frame(i.activity, _live_batch(i), i.events, i.regimes)


_MEANS = ", ".join(f"avg({n}) AS {n}" for n in _ALL)
_MEANS_FILLED = ", ".join(f"avg(coalesce({n}, 0.0)) AS {n}" for n in _ALL)


@query(
    "c18_audit_frames", "frame s, n_rows i, " + ", ".join(f"{n} f" for n in _ALL),
    f"SELECT 'full_training_frame' AS frame, count(*) AS n_rows, {_MEANS} FROM feature_rows "
    f"UNION ALL SELECT 'full_live_frame', count(*), {_MEANS} FROM live_rows "
    f"UNION ALL SELECT 'final_training_frame', count(*), {_MEANS_FILLED} FROM (SELECT *, lead(demand_index) OVER "
    "(PARTITION BY entity_id ORDER BY date) AS t FROM feature_rows) AS x WHERE t IS NOT NULL "
    f"UNION ALL SELECT 'final_live_frame', count(*), {_MEANS_FILLED} FROM live_rows "
    "WHERE date = (SELECT max(date) FROM activity)",
)
def c18_audit_frames(i: Inputs) -> DataFrame:
    """Rows and the mean of every feature of the four frames."""
    out = None
    for name, frame in X.audit_frames(i.activity, _live_batch(i), i.events, i.regimes).items():
        line = frame.agg(F.count("*").alias("n_rows"), *[F.avg(c).alias(c) for c in _ALL]).withColumn("frame", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


@query(
    "c19_latest_two_dates", "latest d, previous d",
    "SELECT max(date) AS latest, (SELECT max(date) FROM retail WHERE date < (SELECT max(date) FROM retail)) "
    "AS previous FROM retail",
)
def c19_latest_two_dates(i: Inputs) -> DataFrame:
    return latest_two_dates(i.retail)
