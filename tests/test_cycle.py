"""The streamed daily cycle: gates, idempotence, and equality with the batch form."""

import datetime as dt
import json
from dataclasses import replace

import pytest

from tidepanel.operators.normalize import normalize_feed
from tidepanel.plans.forecast import forecast_next_day
from tidepanel.plans.lifecycle import active_model, retrain, rollback_to_stable, accepted_state
from tidepanel.plans.model import Learner
from tidepanel.session import scratch_dir
from tidepanel.settings import DEFAULTS
from tidepanel.sources import schemas as S
from tidepanel.sources.state import StateStore
from tidepanel.streaming.cycle import DailyCycle, ordinal, stream_daily_summary
from tidepanel.sources.files import read_feed, stream_feed

D = dt.date(2025, 4, 1)
THREE = replace(DEFAULTS, expected_entities=3)


def _day(k, entities="abc", bump=0.0):
    return [(D + dt.timedelta(days=k), e, float(ord(e) + k) + bump, 60.0 + k) for e in entities]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "date DATE, entity_id STRING, demand_index DOUBLE, price_index DOUBLE")


def _write_feed(spark, days):
    folder = scratch_dir(spark, "feed")
    for rows in days:
        df = _frame(spark, rows)
        shaped = df.selectExpr(*[f"{c if c in df.columns else 'CAST(NULL AS ' + t + ')'} AS {c}" for c, t in S.columns(S.FEED)])
        shaped.coalesce(1).write.mode("append").option("header", True).csv(folder)
    return folder


def _fva(store):
    return {(r["date"], r["entity_id"]): (r["pred_demand"], r["actual_demand"]) for r in store.fva.current().collect()}


@pytest.fixture(scope="module")
def streamed(spark):
    # Day 2 comes first incomplete, then whole; day 1 comes again late; day 3 is skipped.
    days = [_day(0), _day(1), _day(2, "ab"), _day(2), _day(1, bump=50.0), _day(4)]
    folder = _write_feed(spark, days)
    store = StateStore(spark, scratch_dir(spark, "state"))
    cycle = DailyCycle(store, THREE)
    cycle.seed(_frame(spark, [r for k in range(-5, 0) for r in _day(k)]))
    checkpoint = scratch_dir(spark, "checkpoint")
    return cycle, store, folder, checkpoint, cycle.run_stream(folder, checkpoint, 1)


def test_gates(streamed):
    _, store, _, _, results = streamed
    assert [r["status"] for r in results] == ["ingested", "ingested", "incomplete", "ingested", "late", "ingested"]
    values = store.state_values()
    assert (values["last_ingested_date"], values["sim_day"], values["rows_since_last_retrain"]) == ("2025-04-05", "4", "12")
    refused = sorted((r["date"], r["entity_id"], r["reason"]) for r in store.refused.log().collect())
    late = [(D + dt.timedelta(days=1), e, "late") for e in "abc"]
    assert refused == late + [(D + dt.timedelta(days=2), e, "incomplete") for e in "ab"]


def test_comparisons_and_forecasts(streamed):
    _, store, _, _, _ = streamed
    got = _fva(store)
    # Yesterday as forecast; nothing was forecast for the day after the gap.
    assert got == {
        (D + dt.timedelta(days=k), e): (float(ord(e) + k - 1), float(ord(e) + k)) for k in (1, 2) for e in "abc"
    }
    ahead = store.predictions.log(only=ordinal(D + dt.timedelta(days=4))).collect()
    assert {r["target_date"] for r in ahead} == {D + dt.timedelta(days=5)} and len(ahead) == 3
    assert all("Competitive pricing" in r["explanation_text"] for r in ahead)


def test_nothing_twice_after_restart(streamed, spark):
    cycle, store, folder, checkpoint, _ = streamed
    before = _fva(store)
    assert cycle.run_stream(folder, checkpoint, 1) == []  # the checkpoint knows the files
    again = DailyCycle(store, THREE).run_stream(folder, scratch_dir(spark, "checkpoint"), 1)
    assert {r["status"] for r in again} == {"late", "incomplete"}  # the watermark knows the dates
    assert _fva(store) == before and store.summary.current().count() == 4


def test_replayed_date_overwrites_itself(streamed):
    _, store, _, _, _ = streamed
    tail = store.tail.log(only=ordinal(D + dt.timedelta(days=4)))
    # Eight rows of each entity at most; the seed holds five dates, the feed four.
    assert {r["count"] for r in tail.groupBy("entity_id").count().collect()} == {8}


def test_batch_form_equals_stream(streamed, spark):
    _, store, _, _, _ = streamed
    whole = _frame(spark, [r for k in (0, 1, 2, 4) for r in _day(k)])
    other = StateStore(spark, scratch_dir(spark, "state"))
    cycle = DailyCycle(other, THREE)
    cycle.seed(_frame(spark, [r for k in range(-5, 0) for r in _day(k)]))
    for _ in range(4):
        assert cycle.run_date(whole)["status"] == "ingested"
    assert cycle.run_date(whole)["status"] == "no_new_data"
    assert _fva(other) == _fva(store)
    names = ["date", "avg_demand_index", "product_count", "event_count"]
    assert sorted(other.summary.current().select(*names).collect()) == sorted(store.summary.current().select(*names).collect())


def test_date_in_two_deliveries_holds_the_next_one(spark):
    store = StateStore(spark, scratch_dir(spark, "state"))
    cycle = DailyCycle(store, THREE)
    cycle.seed(_frame(spark, [r for k in range(-5, 0) for r in _day(k)]))
    statuses = [[r["status"] for r in cycle.process(_frame(spark, rows))] for rows in (
        _day(0, "a"), _day(1), _day(0, "b"), _day(0, "c"), _day(2))]
    assert statuses == [["incomplete"], ["waiting"], ["incomplete"], ["ingested", "ingested"], ["ingested"]]
    assert sorted(_fva(store)) == [(D + dt.timedelta(days=k), e) for k in (1, 2) for e in "abc"]
    assert store.state_values()["last_ingested_date"] == "2025-04-03"


def test_stream_reads_any_header_as_the_batch_does(spark):
    folder = scratch_dir(spark, "feed")
    rows = _frame(spark, _day(0)).selectExpr("price_index AS price_new", "entity_id AS product_id", "demand_index", "date")
    rows.coalesce(1).write.option("header", True).csv(folder)
    batch = read_feed(spark, folder)
    seen = []
    stream_feed(spark, folder).writeStream.foreachBatch(lambda b, _: seen.extend(normalize_feed(b).collect())).option(
        "checkpointLocation", scratch_dir(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 3 and sorted(seen) == sorted(batch.collect())
    assert {r["price_index"] for r in seen} == {60.0} and {r["entity_id"] for r in seen} == set("abc")


def test_panel_keeps_its_signals(spark):
    store = StateStore(spark, scratch_dir(spark, "state"))
    panel = _frame(spark, [r for k in range(-5, 1) for r in _day(k)]).selectExpr("*", "7.0D AS new_reviews", "0.5D AS discount_pct")
    cycle = DailyCycle(store, THREE)
    cycle.seed(panel.filter("date < DATE'2025-04-01'"))
    cycle.process(panel.filter("date = DATE'2025-04-01'"))
    kept = store.history().agg({"new_reviews": "sum", "discount_pct": "sum", "demand_index": "count"}).first()
    assert sorted(kept) == [9.0, 18, 126.0]


def test_streaming_summary_equals_batch(spark):
    folder = _write_feed(spark, [_day(k) for k in range(4)])
    query = (
        stream_daily_summary(stream_feed(spark, folder, 1)).writeStream.format("memory").queryName("daily")
        .outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", scratch_dir(spark, "checkpoint")).start()
    )
    query.awaitTermination()
    got = {r["date"]: r["avg_demand_index"] for r in spark.table("daily").collect()}
    want = {r["date"]: r["m"] for r in read_feed(spark, folder).groupBy("date").agg({"demand_index": "avg"}).withColumnRenamed("avg(demand_index)", "m").collect()}
    assert got and all(want[d] == m for d, m in got.items())
    assert D in got  # closed by the watermark


def test_train_gate_and_rollback(spark):
    store = StateStore(spark, scratch_dir(spark, "state"))
    rows = [r for k in range(40) for r in _day(k, "abcdef", bump=float((k * 7) % 5))]
    store.panel.append(_frame(spark, rows), 1)
    features = ["demand_lag_1", "demand_lag_7", "day_of_week_num", "demand_7d_mean"]
    small = Learner(trees=2, depth=3, rate=0.3)
    assert rollback_to_stable(store, 1) == {"rolled_back": False, "reason": "no_stable_version"}
    first = retrain(store, store.history(), 1, features=features, learner=small, version="one")
    assert first["accepted"] and first["old_version"] is None
    store.set_state(accepted_state(first, 1), 1)
    better = retrain(store, store.history(), 2, features=features, learner=Learner(trees=20, depth=4, rate=0.3), version="two")
    assert better["mae"] < first["mae"] * 0.98 and better["accepted"]
    store.set_state(accepted_state(better, 2), 2)
    again = retrain(store, store.history(), 2, features=features, learner=Learner(trees=20, depth=4, rate=0.3), version="two")
    assert again["accepted"] and again["old_version"] == "one"
    assert store.state_values()["last_stable_version"] == "one"
    worse = retrain(store, store.history(), 3, features=features, learner=small, version="three")
    assert worse["reason"] == "candidate_rejected"
    assert active_model(store).version == "two" and store.state_values()["active_baseline_mae"] == str(better["mae"])
    fresh = DailyCycle(store, THREE)  # takes up the active model
    assert fresh.scorer.version == "two" and fresh.profile.count() == len(features) and set(fresh.scorer.weights) == set(features)
    live = forecast_next_day(store.history(), store.history().filter("date = DATE'2025-05-10'"), fresh.scorer).collect()
    assert len(live) == 6 and all(r["model_version"] == "two" and " contributed to " in r["shap_explanation"] for r in live)
    assert rollback_to_stable(store, 4)["active_version"] == "one"
    back = rollback_to_stable(store, 4)  # a second run of the step does the same
    assert back["rolled_back"] and back["active_version"] == "one"
    states = {r["version"]: r["status"] for r in store.registry.current().collect()}
    assert states == {"one": "active", "two": "rolled_back", "three": "archived"}
    assert [r["status"] for r in store.jobs.log().orderBy("_batch").collect()] == ["accepted", "accepted", "rejected", "rolled_back"]


def test_errors_of_whole_dates_are_measured(spark):
    """The window ends at a date, not within one: 6 rows asked for, 4 of a date."""
    store = StateStore(spark, scratch_dir(spark, "state"))
    cycle = DailyCycle(store, replace(DEFAULTS, expected_entities=4, error_window=6))
    cycle.seed(_frame(spark, _day(-1, "abcd")))
    cycle.process(_frame(spark, [r for k in range(5) for r in _day(k, "abcd", bump=float(k * k))]))
    rows = store.fva.current().filter("date >= DATE'2025-04-04'").collect()  # the newest two dates
    last = store.drift.log(only=ordinal(D + dt.timedelta(days=4))).first()
    assert len(rows) == 8 and last["mae"] == pytest.approx(sum(r["abs_demand_error"] for r in rows) / 8)
    cycle.settings = replace(cycle.settings, error_window=3)  # less than one date
    cycle.process(_frame(spark, [(d, e, v * (ord(e) - 96), p) for d, e, v, p in _day(5, "abcd")]))
    key = ordinal(D + dt.timedelta(days=5))
    made = [r["abs_demand_error"] for r in store.fva.log(only=key).collect()]
    assert len(made) == 4 and store.drift.log(only=key).first()["mae"] == pytest.approx(sum(made) / 4)


def _catch_up_case(spark):
    """Two stores fed the same dates: one date by date, one all at once; gaps, a late and an incomplete date among them."""
    from tidepanel.operators.drift import baseline_profile
    from tidepanel.operators.features import feature_frame
    from tidepanel.operators.normalize import finalize_features
    from tidepanel.plans.forecast import NaiveScorer

    days = [_day(k, bump=float((k * 7) % 5) * (9 if k > 7 else 1)) for k in range(12) if k not in (4, 5)]
    days[6] = days[6][:2]  # one entity is missing
    seed = _frame(spark, [r for k in range(-9, 0) for r in _day(k, bump=float(k % 3))])
    names = ["demand_lag_1", "demand_lag_7", "demand_7d_mean", "demand_7d_std", "price_7d_avg", "day_of_week_num"]
    profile = baseline_profile(finalize_features(feature_frame(seed), names), names)
    settings = replace(THREE, error_window=7, retrain_min_new_rows=6, retrain_mape_threshold=0.02)
    out = []
    for together in (False, True):
        store = StateStore(spark, scratch_dir(spark, "state"))
        scorer = NaiveScorer()
        scorer.features = names
        cycle = DailyCycle(store, settings, scorer, profile=profile, skip_incomplete=True)
        cycle.seed(seed)
        store.set_state({**store.state_values(), "active_baseline_mae": "3.0"}, ordinal(D) - 1)
        chunks = [days[:1], [r for d in days[1:7] for r in d], [r for d in days[7:] for r in d]] if together else days
        results = []
        for chunk in chunks:
            rows = [r for d in chunk for r in d] if chunk and isinstance(chunk[0], list) else chunk
            results += cycle.process(_frame(spark, rows))
        out.append((store, results))
    return out


def _table(df, drop=("created_at", "prediction_ts", "drift_ts", "payload_json")):
    kept = sorted(c for c in df.columns if c not in drop)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*kept).collect()), key=repr)


def test_catching_up_leaves_what_single_steps_leave(spark):
    (one, one_by_one), (many, together) = _catch_up_case(spark)
    for name in ("panel", "actuals", "summary", "predictions", "fva", "alerts", "refused"):
        assert _table(getattr(one, name).log()) == _table(getattr(many, name).log()), name
    assert _table(one.drift.log()) == _table(many.drift.log()) and one.drift.log().count() == 9
    last = ordinal(D + dt.timedelta(days=11))
    for name in ("tail", "error_window"):
        assert _table(getattr(one, name).log(only=last)) == _table(getattr(many, name).log(only=last)), name
    assert one.state_values() == many.state_values()
    shown = [[{k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for r in x] for x in (one_by_one, together)]
    assert shown[0] == shown[1] and {r["action"] for r in together if r["status"] == "ingested"} >= {"none", "rollback"}
    maps = [{r["_batch"]: json.loads(r["payload_json"]) for r in s.drift.log().collect()} for s in (one, many)]
    assert maps[0].keys() == maps[1].keys() and all(maps[0][k] == pytest.approx(maps[1][k]) for k in maps[0])
    assert max(r["max_feature_psi"] for r in together if r["status"] == "ingested") > 0


def test_a_replayed_catch_up_overwrites_itself(spark):
    store = StateStore(spark, scratch_dir(spark, "state"))
    cycle = DailyCycle(store, THREE)
    cycle.seed(_frame(spark, [r for k in range(-5, 0) for r in _day(k)]))
    rows = _frame(spark, [r for k in range(5) for r in _day(k)])
    commit, store.set_state = store.set_state, lambda *a: (_ for _ in ()).throw(RuntimeError("lost before the commit"))
    with pytest.raises(RuntimeError):
        cycle.process(rows)
    assert store.state_values()["last_ingested_date"] == ""
    store.set_state = commit
    assert [r["status"] for r in cycle.process(rows)] == ["ingested"] * 5
    assert store.panel.current().count() == store.panel.log().count() == 30
    assert store.fva.log().count() == 12 and store.state_values()["sim_day"] == "5"


def test_a_compacted_cycle_goes_on_as_before(spark):
    stores = [StateStore(spark, scratch_dir(spark, "state")) for _ in range(2)]
    for store, after in zip(stores, (None, 2)):
        cycle = DailyCycle(store, THREE, compact_after=after)
        cycle.seed(_frame(spark, [r for k in range(-5, 0) for r in _day(k)]))
        for chunk in (range(0, 4), range(4, 5), range(5, 8)):
            cycle.process(_frame(spark, [r for k in chunk for r in _day(k, bump=float(k * k))]))
    plain, folded = stores
    assert plain.panel.batches() == 9 and folded.panel.batches() == folded.tail.batches() == 1
    for name in ("panel", "actuals", "summary", "predictions", "fva", "alerts", "drift"):
        assert _table(getattr(plain, name).current()) == _table(getattr(folded, name).current()), name
    assert plain.state_values() == folded.state_values()
    assert _table(plain.history()) == _table(folded.history())
