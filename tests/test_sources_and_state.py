import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import dedup, normalize as N
from tidepanel.operators.dashboard import competitors, kpis, next_days
from tidepanel.session import scratch_dir
from tidepanel.sources import files, schemas as S, state
from tidepanel.sources.state import LogTable, StateStore

D = dt.date(2025, 4, 3)


def test_feed_aliases_defaults_and_bad_values(spark):
    rows = [("7", None, "2025-04-03", "1e2", "x"), (None, "8", "2025-04-03 10:00:00", "NaN", None), (None, None, "2025-04-03", "1", "y"),
            ("9", None, "soon", "1", "y")]
    df = spark.createDataFrame(rows, "sku STRING, asin STRING, date STRING, price_new STRING, brand STRING")
    got = {r["entity_id"]: r for r in N.normalize_feed(df).collect()}
    assert set(got) == {"7", "8"}
    assert (got["7"]["price_index"], got["8"]["price_index"], got["8"]["demand_index"]) == (100.0, 0.0, 0.0)
    assert got["7"]["event_type"] == "organic" and got["7"]["date"] == D
    assert N.normalize_feed(df).columns == S.FEED_COLUMNS


def test_required_columns(spark):
    with pytest.raises(ValueError, match="entity_id"):
        N.normalize_feed(spark.createDataFrame([("2025-01-01",)], "date STRING"))
    with pytest.raises(ValueError, match="date"):
        N.normalize_panel(spark.createDataFrame([("1",)], "entity_id STRING"))
    assert N.normalize_events(spark.createDataFrame([("1",)], "note STRING")).count() == 0


def test_finalize_and_contract(spark):
    df = spark.createDataFrame([(1, float("inf"), None), (2, float("nan"), 3.0)], "k INT, a DOUBLE, b DOUBLE")
    got = N.finalize_features(df, ["a", "b", "c"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 0.0, 0.0), (2, 0.0, 3.0, 0.0)]
    audit = {r["feature"]: r for r in N.contract_audit(df, ["a", "b", "c"]).collect()}
    assert (audit["a"]["n_inf"], audit["a"]["n_nan"], audit["b"]["n_null"], audit["c"]["present"]) == (1, 1, 1, False)


def test_keep_last_breaks_ties_by_sequence(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "only")], "k STRING, _seq INT, v STRING")
    assert {r["k"]: r["v"] for r in dedup.keep_last(df, ["k"]).collect()} == {"a": "new", "b": "only"}
    assert {r["k"]: r["v"] for r in dedup.keep_first(df, ["k"]).collect()} == {"a": "old", "b": "only"}


def test_csv_scan(spark, tmp_path):
    assert files.scan_csv(spark, str(tmp_path / "absent"), S.EVENTS).count() == 0
    (tmp_path / "e.csv").write_text("entity_id,date,event_strength,color\n1,2025-04-03,0.5,red\n2,never,much,blue\n")
    rows = files.scan_csv(spark, str(tmp_path / "e.csv"), S.EVENTS).orderBy("entity_id").collect()
    assert rows[0]["date"] == D and rows[0]["color"] == "red"
    assert rows[1]["date"] is None and rows[1]["event_strength"] is None and rows[1]["priority"] is None


def test_profile_json_round_trip(spark, tmp_path):
    profile = spark.createDataFrame([("f", 0.0, 1.0, 2.0, 3.0, 4.0, 2.0, 1.5)],
                                    "feature STRING, min DOUBLE, q10 DOUBLE, q50 DOUBLE, q90 DOUBLE, max DOUBLE, mean DOUBLE, std DOUBLE")
    files.profile_document(profile).coalesce(1).write.text(str(tmp_path / "p"))
    assert files.scan_profile_json(spark, str(tmp_path / "p")).collect() == profile.collect()


def test_log_table_upsert_replay_and_first_seq(spark):
    table = LogTable(spark, scratch_dir(spark, "log"), "k STRING, v DOUBLE, born STRING", ["k"],
                     keep_from_first=["born"], measures_to_zero=["v"])
    assert table.current().count() == 0
    one = spark.createDataFrame([("a", 1.0, "x"), ("b", None, "x")], "k STRING, v DOUBLE, born STRING")
    two = spark.createDataFrame([("a", 2.0, "y"), ("c", 3.0, "y")], "k STRING, v DOUBLE, born STRING")
    table.append(one, 1)
    for _ in range(3):  # a replayed batch replaces itself
        table.append(two, 2)
    got = {r["k"]: (r["v"], r["born"], r["first_seq"]) for r in table.current().collect()}
    assert got == {"a": (2.0, "x", 1), "b": (0.0, "x", 1), "c": (3.0, "y", 2)}
    assert table.log().count() == 4 and table.current(upto=1).count() == 2


def test_runtime_state_defaults_and_snapshot(spark):
    store = StateStore(spark, scratch_dir(spark, "state"))
    assert store.state_values()["active_baseline_mae"] == "999999"
    store.set_state({"sim_day": 3}, 1)
    store.set_state({"sim_day": 4, "last_ingested_date": "2025-04-03"}, 2)
    assert store.state_values()["sim_day"] == "4" and store.state_values(upto=1)["sim_day"] == "3"
    snapshot = state.state_snapshot(store.state.current()).first()["state"]
    assert snapshot["last_ingested_date"]["value"] == "2025-04-03"


def _panel(spark, days):
    rows = [(D - dt.timedelta(days=d), str(e), f"b{e % 2}", "p", "cat_a", float(10 * e + d), 5.0, 0.5, 1.0, 1.0)
            for d in range(days) for e in range(3)]
    return spark.createDataFrame(
        rows, "date DATE, entity_id STRING, brand STRING, product_name STRING, category STRING, demand_index DOUBLE, "
        "price_index DOUBLE, sentiment_index DOUBLE, search_index DOUBLE, ad_index DOUBLE"
    )


def test_single_date_and_flat_series(spark):
    row = kpis(_panel(spark, 1)).first()
    assert (row["demand_chg"], row["price_chg"], row["sent_chg"], row["total_rows"]) == (0.0, 0.0, 0.0, 3)
    best = competitors(_panel(spark, 3)).orderBy(F.desc("score")).first()
    # Demand leads with 35; the four flat signals sit at 50 and the price at 100 - 50.
    assert best["entity_id"] == "2" and best["score"] == pytest.approx(35 + 0.65 * 50)
    assert best["price_history"] == [5.0, 5.0, 5.0] and best["cat"] == "Cat A"


def test_next_days_falls_back_to_forecasts(spark):
    fva = spark.createDataFrame([], "date DATE, actual_demand DOUBLE, pred_demand DOUBLE")
    ahead = spark.createDataFrame([(D, 2.0), (D, 4.0)], "target_date DATE, pred_demand DOUBLE")
    row = next_days(fva, ahead).first()
    assert (row["label"], row["actual"], row["predicted"]) == ("Apr 3", None, 3.0)


def test_weeks_start_on_monday(spark):
    from tidepanel.functions.columns import week_start

    row = spark.createDataFrame([(dt.date(2025, 1, 5),)], "d DATE").select(week_start(F.col("d")).alias("w"), F.weekday("d").alias("n")).first()
    assert row["w"] == dt.date(2024, 12, 30) and row["n"] == 6


def test_shown_numbers_keep_their_values(spark):
    from tidepanel.plans.registry import on_grid, present
    values = [float("nan"), float("inf"), float("-inf"), 3e13, -2.5, 1.23456749, None]
    frame = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    want = ["nan", "inf", "-inf", "30000000000000.0", "-2.5", "1.234567", "None"]
    assert [str(r[0]) for r in present(frame, "x f").collect()] == want
    assert [str(r[0]) for r in on_grid(frame, ["x"]).collect()] == want
