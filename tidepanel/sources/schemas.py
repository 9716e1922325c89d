"""Declared table shapes, aliases and defaults."""

from __future__ import annotations

# Accepted spellings and the defaults for absent or unreadable fields.
ENTITY_ALIASES = ["entity_id", "product_id", "sku", "asin"]
EVENT_DATE_ALIASES = ["date", "event_date", "start_date"]
INTENSITY_COLUMNS = ["event_intensity_score", "event_intensity", "impact_score", "weight"]
CHANGE_FLAG_COLUMNS = ["change_point", "rule_change_point", "is_change_point"]
SHIFT_STRENGTH_COLUMNS = ["shift_strength", "regime_shift_strength"]
REGIME_TYPE_COLUMNS = ["regime_type", "shift_type", "type"]
GENERIC_EVENT_TYPE = "generic_event"
EVERY_ENTITY = "ALL"

FEED_TEXT_DEFAULTS = {
    "brand": "",
    "product_name": "",
    "category": "",
    "event_type": "organic",
    "event_title": "",
    "event_description": "",
    "impact_direction": "neutral",
    "signal_story": "",
    "priority": "medium",
    "event_effect_hint": "organic_continuation",
}
FEED_MEASURES = ["demand_index", "price_index", "sentiment_index", "search_index", "ad_index"]
FEED_ALIASES = {
    "price_index": "price_new",
    "search_index": "search_interest",
    "sentiment_index": "sentiment_mean",
}
FEED_COLUMNS = [
    "date", "entity_id", "brand", "product_name", "category",
    "demand_index", "price_index", "sentiment_index", "search_index", "ad_index",
    "event_type", "event_title", "event_description", "impact_direction",
    "signal_story", "priority", "event_effect_hint",
]

PANEL_ALIASES = {
    "price_new": "price_index",
    "search_interest": "search_index",
    "sentiment_mean": "sentiment_index",
}
PANEL_MEASURE_DEFAULTS = {
    "new_reviews": 0.0,
    "avg_rating": 4.0,
    "sentiment_mean": 0.0,
    "search_interest": 0.0,
    "buzz_score": 0.0,
    "stock_status_score": 1.0,
    "listing_change_score": 0.0,
    "discount_pct": 0.0,
    "rank_proxy": 0.0,
    "bsr_category_rank": 0.0,
    "price_competitiveness_index": 0.0,
    "competitor_count": 0.0,
    "price_new": 0.0,
    "ad_index": 0.0,
    "search_index": 0.0,
    "sentiment_index": 0.0,
    "health_index": 0.0,
}
PANEL_TEXT_DEFAULTS = {"event_type": "", "event_effect_hint": ""}

# Signals of a panel beyond the feed's columns; a table keeps all of them.
PANEL_SIGNALS = [n for n in PANEL_MEASURE_DEFAULTS if n not in FEED_COLUMNS]

# The ordered list of model inputs.
FEATURE_CONTRACT = """
new_reviews avg_rating sentiment_mean search_interest buzz_score stock_status_score
listing_change_score discount_pct rank_proxy bsr_category_rank price_competitiveness_index
competitor_count
reviews_7d_sum search_7d_avg sentiment_7d_avg price_7d_avg
new_reviews_lag_1 new_reviews_lag_7 search_interest_lag_1 search_interest_lag_7
sentiment_mean_lag_1 sentiment_mean_lag_7 price_new_lag_1 price_new_lag_7
avg_rating_lag_1 avg_rating_lag_7 buzz_score_lag_1 buzz_score_lag_7
new_reviews_7d_sum new_reviews_7d_mean search_interest_7d_mean sentiment_mean_7d_mean
price_new_7d_mean price_new_7d_std buzz_score_7d_mean avg_rating_7d_mean
new_reviews_change new_reviews_momentum search_interest_change search_interest_momentum
sentiment_mean_change sentiment_mean_momentum price_new_change price_new_momentum
avg_rating_change avg_rating_momentum buzz_score_change buzz_score_momentum
day_of_week_num month_num health_index ad_index search_index sentiment_index
demand_lag_1 demand_lag_2 demand_lag_3 demand_lag_7 demand_3d_mean demand_7d_mean
demand_7d_std demand_change_1 demand_change_3 demand_momentum_7 demand_volatility_7d
demand_range_7d trend_strength_7d
event_flag_today event_flag_recent_3d event_flag_next_3d days_since_last_event
days_to_next_event event_intensity_score event_type_encoded
price_x_search search_x_sentiment ad_x_search discount_x_demand_lag_1 buzz_x_search
rating_x_reviews is_weekend day_of_week_sin day_of_week_cos month_sin month_cos
recent_change_point_flag regime_shift_strength regime_flag_recent
""".split()
TARGET = "demand_index"


def names(ddl: str) -> list[str]:
    """Column names of a DDL string."""
    return [part.split()[0] for part in ddl.split(", ")]


def columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a DDL string."""
    return [tuple(part.split(None, 1)) for part in ddl.split(", ")]


# Names and types of the tables.
FEED = (
    "date DATE, entity_id STRING, brand STRING, product_name STRING, category STRING, "
    "demand_index DOUBLE, price_index DOUBLE, sentiment_index DOUBLE, search_index DOUBLE, "
    "ad_index DOUBLE, event_type STRING, event_title STRING, event_description STRING, "
    "impact_direction STRING, signal_story STRING, priority STRING, event_effect_hint STRING"
)
PANEL = ", ".join([FEED, *(f"{n} DOUBLE" for n in PANEL_SIGNALS)])
EVENTS = (
    "event_id STRING, date DATE, entity_id STRING, event_type STRING, event_title STRING, "
    "event_description STRING, event_scope STRING, signal_target STRING, event_strength DOUBLE, "
    "event_intensity_score DOUBLE, impact_direction STRING, signal_story STRING, "
    "priority STRING, notes STRING"
)
REGIMES = (
    "entity_id STRING, date DATE, change_point DOUBLE, shift_strength DOUBLE, regime_type STRING"
)
DAILY_SUMMARY = (
    "date DATE, avg_demand_index DOUBLE, avg_price_index DOUBLE, avg_sentiment_index DOUBLE, "
    "avg_search_index DOUBLE, avg_ad_index DOUBLE, product_count BIGINT, event_count BIGINT"
)
ALERTS = (
    "date DATE, entity_id STRING, abs_demand_error DOUBLE, severity STRING, event_type STRING, "
    "alert_type STRING, message STRING"
)
ACTUALS = (
    "date DATE, entity_id STRING, demand_index DOUBLE, price_index DOUBLE, sentiment_index DOUBLE, "
    "search_index DOUBLE, ad_index DOUBLE, event_type STRING, event_effect_hint STRING, "
    "created_at TIMESTAMP"
)
PREDICTIONS = (
    "prediction_ts TIMESTAMP, target_date DATE, entity_id STRING, pred_demand DOUBLE, "
    "pred_price DOUBLE, model_version STRING, event_type STRING, event_effect_hint STRING, "
    "explanation_text STRING, shap_explanation STRING"
)
FORECAST_VS_ACTUAL = (
    "date DATE, entity_id STRING, pred_demand DOUBLE, actual_demand DOUBLE, demand_error DOUBLE, "
    "abs_demand_error DOUBLE, pred_price DOUBLE, actual_price DOUBLE, price_error DOUBLE, "
    "abs_price_error DOUBLE, event_type STRING, event_effect_hint STRING, model_version STRING, "
    "created_at TIMESTAMP"
)
DRIFT = (
    "drift_ts TIMESTAMP, model_version STRING, mae DOUBLE, mape DOUBLE, rmse DOUBLE, "
    "max_feature_psi DOUBLE, drift_status STRING, payload_json STRING"
)
RETRAIN_JOBS = (
    "trigger_reason STRING, old_version STRING, new_version STRING, status STRING, "
    "details_json STRING, created_at TIMESTAMP"
)
RUNTIME_STATE = ("state_key STRING, state_value STRING, updated_at TIMESTAMP")
REGISTRY = (
    "version STRING, status STRING, artifact_path STRING, mae DOUBLE, rmse DOUBLE, "
    "feature_columns ARRAY<STRING>, created_at TIMESTAMP"
)

# Runtime state before the first cycle.
STATE_DEFAULTS = {
    "sim_day": "0",
    "last_retrain_sim_day": "0",
    "rows_since_last_retrain": "0",
    "consecutive_perf_drift": "0",
    "consecutive_rollback_drift": "0",
    "active_baseline_mae": "999999",
    "active_model_version": "",
    "last_ingested_date": "",
}
