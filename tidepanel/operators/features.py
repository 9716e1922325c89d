"""Time-series features of the panel.

Frames count rows per entity, never calendar days, except event proximity, which counts days.
Every window is partitioned by entity and ordered by day. The panel has one row per entity and
day, so a partition holds at most as many rows as the calendar has days, however hot the entity
was in the raw input; the blocks below share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.columns import day_number
from tidepanel.operators.dedup import stack, union_keep_last
from tidepanel.operators.normalize import (
    canonical_panel, finalize_features, normalize_events, normalize_panel, normalize_regimes,
)
from tidepanel.sources import schemas as S

# Lags, frame lengths, reach of events and the health weights.
DEMAND_LAGS = (1, 2, 3, 7)
WEEK = 7
EVENT_REACH = 3
NO_EVENT_DAYS = 999.0
REGIME_LOOKBACK = 7
FEATURE_LOOKBACK = 8
HEALTH_PARTS = [
    ("sentiment_index", 0.30, 0.0), ("search_index", 0.25, 0.0), ("ad_index", 0.20, 0.0), ("avg_rating", 0.15, 4.0),
]
DISCOUNT_WEIGHT = 0.10
SIGNALS = ["new_reviews", "search_interest", "sentiment_mean", "price_new", "avg_rating", "buzz_score"]

_DAY = "_day"
_ORDER = f"PARTITION BY entity_id ORDER BY {_DAY}"


def _with_day(df: DataFrame) -> DataFrame:
    return df if _DAY in df.columns else df.withColumn(_DAY, day_number(F.col("date")))


def _rows(first: int, last: int) -> str:
    """A frame of rows relative to the current one."""
    def edge(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{abs(k)} PRECEDING" if k < 0 else f"{k} FOLLOWING"

    return f"OVER ({_ORDER} ROWS BETWEEN {edge(first)} AND {edge(last)})"


def _days(first: int, last: int) -> str:
    """A frame of calendar days around the current one."""
    return _rows(first, last).replace("ROWS BETWEEN", "RANGE BETWEEN")


def _lag(name: str, k: int) -> str:
    return f"lag({name}, {k}) OVER ({_ORDER})"


def _add(df: DataFrame, new: dict[str, str]) -> DataFrame:
    """All new columns in one select, replacing columns of the same name."""
    kept = [f"`{c}`" for c in df.columns if c not in new]
    return df.selectExpr(*kept, *[f"{text} AS `{name}`" for name, text in new.items()])


# ---- row-frame columns, as SQL text: the whole block is one select over one window order ---------------


def demand_lag_columns(target: str = S.TARGET) -> dict[str, str]:
    return {f"demand_lag_{k}": _lag(target, k) for k in DEMAND_LAGS}


def demand_rolling_columns(target: str = S.TARGET) -> dict[str, str]:
    """Frames that end at the previous row."""
    past = _rows(-WEEK, -1)
    deviation = f"stddev_samp({target}) {past}"
    return {
        "demand_3d_mean": f"avg({target}) {_rows(-3, -1)}",
        "demand_7d_mean": f"avg({target}) {past}",
        "demand_7d_std": deviation,
        "demand_volatility_7d": deviation,
        # A single value has no range.
        "demand_range_7d": f"if(count({target}) {past} >= 2, max({target}) {past} - min({target}) {past}, NULL)",
    }


def demand_change_columns(target: str = S.TARGET) -> dict[str, str]:
    """Differences of the lag and rolling columns; equal window expressions are computed once."""
    lag, mean = demand_lag_columns(target), demand_rolling_columns(target)["demand_7d_mean"]
    last = lag["demand_lag_1"]
    return {
        "demand_change_1": f"{last} - {lag['demand_lag_2']}",
        "demand_change_3": f"{last} - {lag['demand_lag_3']}",
        "demand_momentum_7": f"{last} - {lag['demand_lag_7']}",
        "trend_strength_7d": f"{last} - {mean}",
    }


def signal_rolling_columns() -> dict[str, str]:
    """Frames that include today."""
    week = _rows(1 - WEEK, 0)
    reviews = f"sum(new_reviews) {week}"
    return {
        "reviews_7d_sum": reviews,
        "search_7d_avg": f"avg(search_interest) {week}",
        "sentiment_7d_avg": f"avg(sentiment_mean) {week}",
        "price_7d_avg": f"avg(price_new) {week}",
        "new_reviews_7d_sum": reviews,
        **{f"{s}_7d_mean": f"avg({s}) {week}" for s in SIGNALS},
        "price_new_7d_std": f"stddev_samp(price_new) {week}",
    }


def signal_lag_columns() -> dict[str, str]:
    return {f"{s}_lag_{k}": _lag(s, k) for s in SIGNALS for k in (1, WEEK)}


def signal_diff_columns() -> dict[str, str]:
    steps = {"change": 1, "momentum": 3}
    return {f"{s}_{name}": f"{s} - {_lag(s, k)}" for s in SIGNALS for name, k in steps.items()}


def health_column() -> dict[str, str]:
    """Composite index where none was supplied."""
    parts = [f"{w}D * coalesce({name}, {default}D)" for name, w, default in HEALTH_PARTS]
    blend = " + ".join(parts) + f" + {DISCOUNT_WEIGHT}D * (1.0D - coalesce(discount_pct, 0.0D))"
    return {"health_index": f"if(health_index IS NULL OR health_index = 0, {blend}, health_index)"}


def interaction_columns() -> dict[str, str]:
    return {
        "price_x_search": "price_new * search_interest",
        "search_x_sentiment": "search_interest * sentiment_mean",
        "ad_x_search": "ad_index * search_interest",
        "discount_x_demand_lag_1": f"discount_pct * coalesce({_lag(S.TARGET, 1)}, 0.0D)",
        "buzz_x_search": "buzz_score * search_interest",
        "rating_x_reviews": "avg_rating * new_reviews",
    }


def calendar_columns() -> dict[str, str]:
    def circle(part: str, period: int) -> dict[str, str]:
        angle = f"2 * pi() * {part} / {period}.0D"
        return {"sin": f"sin({angle})", "cos": f"cos({angle})"}

    week, year = circle("weekday(date)", 7), circle("month(date)", 12)
    return {
        "day_of_week_num": "weekday(date)",
        "month_num": "month(date)",
        "is_weekend": "if(weekday(date) >= 5, 1.0D, 0.0D)",
        "day_of_week_sin": week["sin"],
        "day_of_week_cos": week["cos"],
        "month_sin": year["sin"],
        "month_cos": year["cos"],
    }


def add_demand_lags(panel: DataFrame) -> DataFrame:
    return _add(_with_day(panel), demand_lag_columns()).drop(_DAY)


def add_demand_rolling(panel: DataFrame) -> DataFrame:
    return _add(_with_day(panel), demand_rolling_columns()).drop(_DAY)


def add_demand_changes(panel: DataFrame) -> DataFrame:
    return _add(_with_day(panel), demand_change_columns()).drop(_DAY)


def add_signal_rolling(panel: DataFrame) -> DataFrame:
    return _add(_with_day(panel), signal_rolling_columns()).drop(_DAY)


def add_signal_lags(panel: DataFrame) -> DataFrame:
    return _add(_with_day(panel), signal_lag_columns()).drop(_DAY)


def add_signal_diffs(panel: DataFrame) -> DataFrame:
    return _add(_with_day(panel), signal_diff_columns()).drop(_DAY)


def add_health_index(panel: DataFrame) -> DataFrame:
    return _add(panel, health_column())


def add_calendar(panel: DataFrame) -> DataFrame:
    return _add(panel, calendar_columns())


def add_interactions(panel: DataFrame) -> DataFrame:
    return _add(_with_day(panel), interaction_columns()).drop(_DAY)


def add_lead_target(panel: DataFrame, target: str = S.TARGET, horizon: int = 1) -> DataFrame:
    """The target ``horizon`` rows ahead; rows without one are dropped."""
    led = _add(_with_day(panel), {"target": f"lead({target}, {horizon}) OVER ({_ORDER})"})
    return led.filter(F.col("target").isNotNull()).drop(_DAY)


# ---- events and regimes on the entity's timeline -------------------------------------------------


def event_types(events: DataFrame) -> Column:
    """Sorted distinct event types as one array; the vocabulary of types is small by nature."""
    kinds = F.array_sort(F.collect_set(F.col("event_type").cast("string")))
    return events.agg(kinds.alias("kinds")).scalar()


def event_vocabulary(events: DataFrame) -> list[str]:
    """The same list as values, to be stored with a trained model."""
    return list(events.select("event_type").agg(
        F.array_sort(F.collect_set(F.col("event_type").cast("string"))).alias("k")
    ).first()["k"])


def event_type_codes(events: DataFrame) -> DataFrame:
    """Each distinct event type with its 1-based rank."""
    kinds = events.agg(F.array_sort(F.collect_set(F.col("event_type").cast("string"))).alias("k"))
    return kinds.select(F.posexplode("k").alias("_i", "event_type")).select(
        "event_type", (F.col("_i") + 1).alias("event_type_encoded")
    )


def encode_event_type(events: DataFrame, kinds: Column | Sequence[str] | None = None) -> DataFrame:
    """Attach the code; pass the trained model's list of types to keep its codes at scoring."""
    if kinds is None:
        kinds = event_types(events)
    elif not isinstance(kinds, Column):
        kinds = F.array(*[F.lit(k) for k in kinds]) if kinds else F.array().cast("array<string>")
    code = F.array_position(kinds, F.col("event_type").cast("string")).cast("double")
    return events.withColumn("event_type_encoded", F.coalesce(code, F.lit(0.0)))


_MARKS = ("_panel", "_intensity", "_code", "_flag", "_strength")


def _event_marks(events: DataFrame, kinds=None) -> DataFrame:
    coded = encode_event_type(normalize_events(events), kinds)
    return coded.select(
        "entity_id", "date", F.lit(False).alias("_panel"),
        F.col("event_intensity_score").alias("_intensity"),
        F.col("event_type_encoded").alias("_code"),
    )


def _regime_marks(regimes: DataFrame) -> DataFrame:
    return normalize_regimes(regimes).select(
        "entity_id", "date", F.lit(False).alias("_panel"),
        F.col("recent_change_point_flag").alias("_flag"),
        F.col("regime_shift_strength").alias("_strength"),
    )


def _timeline(panel: DataFrame, marks: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """One row per (entity, day): the panel row kept last, plus that day's event and regime marks.

    Deduplication and both joins are one aggregation with map-side combine; days with only a
    mark stay as rows with ``_panel`` false until the day frames have been read.
    """
    carried = [c for c in panel.columns if c not in ("entity_id", "date", *order)]
    packed = ", ".join(f"`{c}`" for c in [*order, *carried])
    rows = panel.selectExpr("entity_id", "date", "true AS _panel", f"struct({packed}) AS _row")
    for mark in marks:
        rows = rows.unionByName(mark, allowMissingColumns=True)
    attached = [c for c in _MARKS if c in rows.columns]
    merged = rows.groupBy("entity_id", "date").agg(
        F.max("_row").alias("_row"), *[F.max(c).alias(c) for c in attached]
    )
    return merged.selectExpr(
        "entity_id", "date", f"unix_date(date) AS {_DAY}",
        *[f"_row.`{c}` AS `{c}`" for c in carried], *attached,
    )


def _event_columns() -> dict[str, str]:
    hit_day = f"if(_code IS NULL, NULL, {_DAY})"

    def flag(first: int, last: int) -> str:
        return f"if(count(_code) {_days(first, last)} > 0, 1.0D, 0.0D)"

    def days_or_none(gap: str) -> str:
        return f"coalesce(CAST({gap} AS DOUBLE), {NO_EVENT_DAYS}D)"

    reach = _days(-EVENT_REACH, EVENT_REACH)
    so_far = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    last_hit = f"max({hit_day}) OVER ({_ORDER} {so_far})"
    # Read backwards so the frame grows row by row; one that shrinks would be recomputed per row.
    next_hit = f"min({hit_day}) OVER ({_ORDER} DESC {so_far})"
    return {
        "event_flag_today": "if(_code IS NULL, 0.0D, 1.0D)",
        "event_flag_recent_3d": flag(-EVENT_REACH, 0),
        "event_flag_next_3d": flag(0, EVENT_REACH),
        "days_since_last_event": days_or_none(f"{_DAY} - {last_hit}"),
        "days_to_next_event": days_or_none(f"{next_hit} - {_DAY}"),
        "event_intensity_score": f"coalesce(max(_intensity) {reach}, 0.0D)",
        "event_type_encoded": f"coalesce(max(_code) {reach}, 0.0D)",
    }


def _regime_columns() -> dict[str, str]:
    return {
        "recent_change_point_flag": "coalesce(_flag, 0.0D)",
        "regime_shift_strength": "coalesce(_strength, 0.0D)",
    }


def _regime_recency() -> dict[str, str]:
    past = _rows(-REGIME_LOOKBACK, -1)
    return {"regime_flag_recent": f"coalesce(max(recent_change_point_flag) {past}, 0.0D)"}


_EVENT_DEFAULTS = {
    "event_flag_today": 0.0, "event_flag_recent_3d": 0.0, "event_flag_next_3d": 0.0,
    "days_since_last_event": NO_EVENT_DAYS, "days_to_next_event": NO_EVENT_DAYS,
    "event_intensity_score": 0.0, "event_type_encoded": 0.0,
}
_REGIME_DEFAULTS = {"recent_change_point_flag": 0.0, "regime_shift_strength": 0.0, "regime_flag_recent": 0.0}


def _literals(defaults: dict[str, float]) -> dict[str, str]:
    return {n: f"{v}D" for n, v in defaults.items()}


def _enrich(panel: DataFrame, events, regimes, kinds=None, order: Sequence[str] = ()) -> DataFrame:
    """Timeline with event, regime and same-day columns; keeps the day column for later windows."""
    marks = []
    if events is not None:
        marks.append(_event_marks(events, kinds))
    if regimes is not None:
        marks.append(_regime_marks(regimes))
    line = _timeline(panel, marks, order)
    line = _add(line, _event_columns() if events is not None else _literals(_EVENT_DEFAULTS))
    line = line.filter("_panel")
    if regimes is not None:
        return _add(line, _regime_columns()).drop(*_MARKS)
    return _add(line, _literals(_REGIME_DEFAULTS)).drop(*_MARKS)


def add_event_proximity(panel: DataFrame, events: DataFrame | None, kinds=None) -> DataFrame:
    """Flags, distances and strongest event around each panel day, for the entity's own events."""
    return _enrich(panel, events, None, kinds).drop(_DAY, *_REGIME_DEFAULTS)


def add_regime_features(panel: DataFrame, regimes: DataFrame | None) -> DataFrame:
    """Change point of the day, its strength, and whether one fell in the seven rows before."""
    line = _enrich(panel, None, regimes).drop(*_EVENT_DEFAULTS)
    return (_add(line, _regime_recency()) if regimes is not None else line).drop(_DAY)


# ---- frames ------------------------------------------------------------------------------------


def feature_frame(
    panel: DataFrame,
    events: DataFrame | None = None,
    regimes: DataFrame | None = None,
    kinds=None,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Every feature of every panel row, or only those named.

    Two exchanges in all: one by (entity, date) that deduplicates and attaches events and
    regimes, one by entity that serves all windows.
    """
    order = [c for c in ("_rank", "_seq") if c in panel.columns]
    line = _enrich(canonical_panel(panel), events, regimes, kinds, order)
    computed = {
        **demand_lag_columns(), **demand_rolling_columns(), **demand_change_columns(),
        **signal_rolling_columns(), **signal_lag_columns(), **signal_diff_columns(),
        **health_column(), **interaction_columns(), **calendar_columns(),
    }
    if regimes is not None:
        computed |= _regime_recency()
    if features is not None:
        computed = {n: text for n, text in computed.items() if n in features}
    return _add(line, computed).drop(_DAY)


def training_frame(
    panel: DataFrame,
    events: DataFrame | None = None,
    regimes: DataFrame | None = None,
    features: Sequence[str] = S.FEATURE_CONTRACT,
    target: str = S.TARGET,
    horizon: int = 1,
    kinds=None,
) -> DataFrame:
    """Keys, model inputs and the target ``horizon`` rows ahead (column ``target``)."""
    return training_rows(feature_frame(panel, events, regimes, kinds, features), features, target, horizon)


def training_rows(
    frame: DataFrame, features: Sequence[str] = S.FEATURE_CONTRACT, target: str = S.TARGET, horizon: int = 1
) -> DataFrame:
    """:func:`training_frame` from a frame that has its features."""
    # Only what is kept is moved and sorted for the target.
    kept = [c for c in dict.fromkeys(["entity_id", "date", *features, target]) if c in frame.columns]
    full = add_lead_target(frame.select(*[F.col(f"`{c}`") for c in kept]), target, horizon)
    return finalize_features(full, features).select("entity_id", "date", *features, "target")


def trailing_history(history: DataFrame, batch_dates: DataFrame, rows: int = FEATURE_LOOKBACK) -> DataFrame:
    """History the live features can reach: rows from the first batch date on, and each entity's
    last ``rows`` dates before it. Dates are ranked, not rows, so duplicates may still be there.
    Spark cuts the ranking per entity before the shuffle.
    """
    first = batch_dates.agg(F.min("date")).scalar()
    before = Window.partitionBy("entity_id").orderBy(F.desc("date"))
    earlier = (
        history.filter(F.col("date") < first)
        .withColumn("_n", F.dense_rank().over(before))
        .filter(F.col("_n") <= rows)
        .drop("_n")
    )
    return earlier.unionByName(history.filter(F.col("date") >= first))


def live_frame(
    history: DataFrame,
    batch: DataFrame,
    events: DataFrame | None = None,
    regimes: DataFrame | None = None,
    features: Sequence[str] = S.FEATURE_CONTRACT,
    kinds=None,
) -> DataFrame:
    """Model inputs for every entity seen on the batch's dates, in history or batch."""
    full = live_feature_frame(history, batch, events, regimes, kinds, features)
    return finalize_features(full, features).select("entity_id", "date", *features)


def live_feature_frame(history, batch, events=None, regimes=None, kinds=None, features=None) -> DataFrame:
    """History and batch as one panel, all features, limited to the batch's dates."""
    dates = canonical_panel(batch).select("date").distinct()
    # The feature frame drops duplicates; the batch's rows come after the history's.
    panel = stack(trailing_history(canonical_panel(history), dates), canonical_panel(batch))
    return feature_frame(panel, events, regimes, kinds, features).join(dates, "date", "left_semi")


def audit_frames(
    history: DataFrame,
    batch: DataFrame | None = None,
    events: DataFrame | None = None,
    regimes: DataFrame | None = None,
    horizon: int = 1,
    features: Sequence[str] = S.FEATURE_CONTRACT,
) -> dict[str, DataFrame]:
    """Full and final frames side by side, for training and for a live batch."""
    frames = {
        "full_training_frame": feature_frame(history, events, regimes),
        "final_training_frame": training_frame(history, events, regimes, features, horizon=horizon),
    }
    if batch is not None:
        everything = union_keep_last([normalize_panel(history), normalize_panel(batch)])
        frames["full_live_frame"] = feature_frame(everything, events, regimes)
        frames["final_live_frame"] = live_frame(history, batch, events, regimes, features)
    return frames
