"""Window and proximity features against plain loops, over gaps, NULLs, single rows and ties."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidepanel.operators import features as X

DAY0 = dt.date(2024, 1, 1)

panel_rows = st.lists(
    st.tuples(
        st.sampled_from("abc"), st.integers(0, 25),
        st.one_of(st.none(), st.integers(0, 9).map(float)), st.integers(1, 50).map(float),
    ),
    min_size=1, max_size=45, unique_by=lambda r: (r[0], r[1]),
)
event_rows = st.lists(
    st.tuples(st.sampled_from(["a", "b", "ALL"]), st.integers(-4, 30), st.sampled_from(["ad", "sale", "outage"]),
              st.integers(1, 9).map(float)),
    max_size=12,
)
quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def _frame(spark, rows):
    data = [(e, DAY0 + dt.timedelta(days=d), y, p) for e, d, y, p in rows]
    return spark.createDataFrame(data, "entity_id STRING, date DATE, demand_index DOUBLE, price_index DOUBLE")


def _same(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    return b is not None and abs(a - b) < 1e-9


@quick
@given(rows=panel_rows)
def test_row_windows_equal_pandas(spark, rows):
    got = {(r["entity_id"], r["date"]): r for r in X.feature_frame(_frame(spark, rows)).collect()}
    pdf = pd.DataFrame(
        [(e, DAY0 + dt.timedelta(days=d), np.nan if y is None else y, p) for e, d, y, p in rows],
        columns=["e", "d", "y", "p"],
    ).sort_values(["e", "d"])
    for entity, part in pdf.groupby("e"):
        past, price = part["y"].shift(1), part["p"]
        week = price.rolling(7, min_periods=1)
        want = {
            "demand_lag_1": past, "demand_lag_7": part["y"].shift(7),
            "demand_3d_mean": past.rolling(3, min_periods=1).mean(),
            "demand_7d_mean": past.rolling(7, min_periods=1).mean(),
            "demand_7d_std": past.rolling(7, min_periods=2).std(),
            "demand_range_7d": past.rolling(7, min_periods=2).max() - past.rolling(7, min_periods=2).min(),
            "demand_momentum_7": past - part["y"].shift(7),
            "price_7d_avg": week.mean(), "price_new_7d_std": price.rolling(7, min_periods=2).std(),
            "price_new_change": price.diff(), "price_new_momentum": price.diff(3),
            "price_new_lag_7": price.shift(7),
        }
        for k, day in enumerate(part["d"]):
            for name, series in want.items():
                assert _same(float(series.iloc[k]), got[(entity, day)][name]), (entity, day, name)


@quick
@given(rows=panel_rows, events=event_rows)
def test_event_proximity_equals_loops(spark, rows, events):
    marks = spark.createDataFrame(
        [(e, DAY0 + dt.timedelta(days=d), t, w, k) for k, (e, d, t, w) in enumerate(events)],
        "entity_id STRING, date DATE, event_type STRING, weight DOUBLE, _seq INT",
    )
    got = {(r["entity_id"], r["date"]): r for r in X.add_event_proximity(_frame(spark, rows), marks).collect()}
    codes = {t: k + 1 for k, t in enumerate(sorted({t for _, _, t, _ in events}))}
    kept = {(e, d, t): w for e, d, t, w in events}  # the last of each key
    for e, d, _, _ in rows:
        near = [(x - d, w, codes[t]) for (n, x, t), w in kept.items() if n == e]
        row = got[(e, DAY0 + dt.timedelta(days=d))]
        past, ahead = [g for g, _, _ in near if g <= 0], [g for g, _, _ in near if g >= 0]
        local = [(w, c) for g, w, c in near if -3 <= g <= 3]
        assert row["event_flag_today"] == float(any(g == 0 for g, _, _ in near))
        assert row["event_flag_recent_3d"] == float(any(-3 <= g <= 0 for g, _, _ in near))
        assert row["event_flag_next_3d"] == float(any(0 <= g <= 3 for g, _, _ in near))
        assert row["days_since_last_event"] == (float(-max(past)) if past else 999.0)
        assert row["days_to_next_event"] == (float(min(ahead)) if ahead else 999.0)
        assert row["event_intensity_score"] == max((w for w, _ in local), default=0.0)
        assert row["event_type_encoded"] == max((float(c) for _, c in local), default=0.0)


def test_events_at_three_and_four_days(spark):
    panel = _frame(spark, [("a", 10, 1.0, 1.0), ("b", 10, 1.0, 1.0)])
    marks = spark.createDataFrame(
        [("a", DAY0 + dt.timedelta(days=7), "ad"), ("b", DAY0 + dt.timedelta(days=14), "ad"),
         ("ALL", DAY0 + dt.timedelta(days=10), "ad")],
        "entity_id STRING, date DATE, event_type STRING",
    )
    rows = {r["entity_id"]: r for r in X.add_event_proximity(panel, marks).collect()}
    assert rows["a"]["event_flag_recent_3d"] == 1.0 and rows["a"]["days_since_last_event"] == 3.0
    assert rows["b"]["event_flag_next_3d"] == 0.0 and rows["b"]["days_to_next_event"] == 4.0
    assert rows["a"]["event_flag_today"] == 0.0  # events for every entity stay out of proximity


def test_unknown_event_type_keeps_trained_codes(spark):
    panel = _frame(spark, [("a", 1, 1.0, 1.0)])
    marks = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=1), "zebra"), ("a", DAY0 + dt.timedelta(days=1), "ad")],
                                  "entity_id STRING, date DATE, event_type STRING")
    fresh = X.add_event_proximity(panel, marks).first()["event_type_encoded"]
    trained = X.add_event_proximity(panel, marks, ["ad", "sale"]).first()["event_type_encoded"]
    assert (fresh, trained) == (2.0, 1.0)


def test_duplicates_in_the_frame_keep_the_last_by_sequence(spark):
    data = [("a", DAY0, 1.0, 2), ("a", DAY0, 5.0, 1), ("a", DAY0 + dt.timedelta(days=1), 3.0, 1)]
    panel = spark.createDataFrame(data, "entity_id STRING, date DATE, demand_index DOUBLE, _seq INT")
    rows = X.feature_frame(panel).orderBy("date").collect()
    assert [(r["demand_index"], r["demand_lag_1"]) for r in rows] == [(1.0, None), (3.0, 1.0)]


def test_regime_recency_looks_at_seven_rows_before(spark):
    panel = _frame(spark, [("a", d, 1.0, 1.0) for d in range(0, 20, 2)])
    shifts = spark.createDataFrame([("a", DAY0 + dt.timedelta(days=2), 1.0, 0.7)],
                                   "entity_id STRING, date DATE, is_change_point DOUBLE, shift_strength DOUBLE")
    rows = X.add_regime_features(panel, shifts).orderBy("date").collect()
    assert [r["regime_flag_recent"] for r in rows] == [0, 0, 1, 1, 1, 1, 1, 1, 1, 0]
    assert [r["regime_shift_strength"] for r in rows][:3] == [0.0, 0.7, 0.0]


def test_live_frame_equals_full_frame_on_batch_dates(spark):
    rows = [(e, d, float((d * 7 + ord(e)) % 11), float(d % 5 + 1)) for e in "abc" for d in range(0, 24, 1 + ord(e) % 3)]
    panel = _frame(spark, rows)
    last = DAY0 + dt.timedelta(days=20)
    history, batch = panel.filter(F.col("date") < last), panel.filter(F.col("date") == last)
    live = X.live_frame(history, batch).orderBy("entity_id").collect()
    full = X.live_frame(panel, batch).orderBy("entity_id").collect()
    assert live and live == full


@pytest.mark.parametrize("horizon", [1, 3])
def test_training_target_is_rows_ahead(spark, horizon):
    panel = _frame(spark, [("a", d, float(d), 1.0) for d in (0, 1, 5, 9, 10)])
    rows = X.training_frame(panel, features=["demand_lag_1"], horizon=horizon).orderBy("date").collect()
    assert [r["target"] for r in rows] == [1.0, 5.0, 9.0, 10.0][horizon - 1:]
