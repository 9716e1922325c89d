import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.quantiles import column_quantiles, exact_quantiles
from tidepanel.operators import drift

DAY = dt.date(2025, 4, 3)


def _psi(spark, values, profile, method="auto"):
    live = spark.createDataFrame([(float(v),) for v in values], "f DOUBLE")
    table = spark.createDataFrame([("f", *map(float, profile))], "feature STRING, min DOUBLE, q10 DOUBLE, q50 DOUBLE, q90 DOUBLE, max DOUBLE")
    return drift.feature_psi(live, table, ["f"], method).first()["psi"]


@pytest.mark.parametrize("values, profile, psi", [
    ([99, 100], (0, 1, 2, 3, 4), 12.62191212957556),
    ([0.5, 0.5], (0, 1, 2, 3, 4), 13.542957679698645),
    ([1.5], (0, 1, 2, 3, 4), 8.012011537483833),
    ([1.0], (1, 1, 2, 3, 4), 12.391676646127086),
    ([9.0], (1, 1, 2, 3, 4), 11.470631096004002),
    ([1.0], (0.45, 1, 1, 1, 1), 0.0),
])
def test_psi_golden_values(spark, values, profile, psi):
    assert _psi(spark, values, profile) == pytest.approx(psi, abs=1e-12)


def test_psi_equals_numpy_histogram(spark):
    rng = np.random.default_rng(7)
    for _ in range(4):
        edges = np.sort(rng.integers(0, 6, 5).astype(float))
        values = rng.integers(-1, 8, 60).astype(float)
        bins = np.unique(edges)
        got = _psi(spark, values, edges)
        if len(bins) < 3:
            assert got == 0.0
            continue
        hits = np.histogram(values, bins)[0]
        a = np.clip(hits / max(hits.sum(), 1), 1e-6, None)
        e = np.clip(np.array([0.1, 0.4, 0.4, 0.1])[: len(a)], 1e-6, None)
        assert got == pytest.approx(float(np.sum((a - e) * np.log(a / e))), abs=1e-9)


def _index(values, edges):
    """PSI of one column against distinct edges, bin by bin; None is no value."""
    e = sorted(set(edges))
    given = [v for v in values if v is not None]
    if len(e) < 3 or not given:
        return 0.0
    hits = [sum(a <= v < b or (v == b == e[-1]) for v in given) for a, b in zip(e, e[1:])]
    shares = [max(h / max(sum(hits), 1), 1e-6) for h in hits]
    return sum((a - x) * math.log(a / x) for a, x in zip(shares, (0.1, 0.4, 0.4, 0.1)))


def test_psi_by_segment_equals_counting(spark):
    rng = np.random.default_rng(5)
    names = [f"f{k}" for k in range(6)]
    odd = [None, math.nan, math.inf, -0.0, 0.0]
    rows = [(DAY + dt.timedelta(days=int(rng.integers(3))), [None, "a", "b"][rng.integers(3)],
             *[odd[rng.integers(5)] if rng.random() < 0.3 else float(rng.integers(-1, 7)) for _ in names[1:]], None) for _ in range(400)]
    live = spark.createDataFrame(rows, "date DATE, kind STRING, " + ", ".join(f"{n} DOUBLE" for n in names)).repartition(3)
    profiles = {"f0": (0, 1, 2, 3, 6), "f1": (0, 0, 0, 3, 3), "f2": (1, 1, 1, 1, 1), "f3": (-1, 0, 0, 2, math.inf), "f5": (0, 1, 2, 3, 4)}
    table = spark.createDataFrame([(n, *map(float, p)) for n, p in profiles.items()], "feature STRING, min DOUBLE, q10 DOUBLE, q50 DOUBLE, q90 DOUBLE, max DOUBLE")
    got = {(r["date"], r["kind"], r["feature"]): r["psi"] for r in drift.feature_psi(live, table, names, segment=["date", "kind"]).collect()}
    want = {}
    for day, kind in {r[:2] for r in rows}:
        for n, edges in profiles.items():  # no profile, no index
            values = [r[2 + names.index(n)] for r in rows if r[:2] == (day, kind)]
            want[day, kind, n] = _index(values, map(float, edges))
    assert got == pytest.approx(want, abs=1e-12)
    assert drift.feature_psi(live.filter("false"), table, names).collect() == []


def test_counts_of_many_segments_go_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(drift, "SEGMENTS_HELD", 2)
    batches = [pa.RecordBatch.from_pydict({"s": s, "f": v}) for s, v in (
        (["a", "b", "c"], [0.5, 1.5, 9.0]), (["a", "d"], [2.0, None]), (["a"], [0.0]))]
    parts = list(drift._binned([[0.0, 1.0, 2.0], None], 1)(iter(batches)))
    assert [p.num_rows for p in parts] == [6, 4, 2]
    hits = {(r["s"], r["_f"], p): (r["_h0"], r["_h1"], r["_h2"], r["n_values"]) for p, b in enumerate(parts) for r in b.to_pylist()}
    assert hits["a", 0, 0] == (1, 0, 0, 1) and hits["b", 0, 0] == (0, 1, 0, 1) and hits["c", 0, 0] == (0, 0, 0, 1)
    assert hits["a", 0, 1] == (0, 1, 0, 1) and hits["d", 0, 1] == (0, 0, 0, 0) and hits["a", 0, 2] == (1, 0, 0, 1)


def test_psi_reads_a_wide_frame_once(spark, tmp_path):
    names = [f"f{k}" for k in range(40)]
    spark.range(10).select(*[F.col("id").cast("double").alias(n) for n in names]).write.parquet(str(tmp_path / "live"))
    table = spark.createDataFrame([(n, 0.0, 1.0, 4.0, 8.0, 9.0) for n in names], "feature STRING, min DOUBLE, q10 DOUBLE, q50 DOUBLE, q90 DOUBLE, max DOUBLE")
    psi = drift.feature_psi(spark.read.parquet(str(tmp_path / "live")), table, names)
    assert psi._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


@pytest.mark.parametrize("kind", ["random", "hot", "tiny", "large"])
def test_exact_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    groups = {
        "random": {"a": rng.normal(size=501), "b": rng.integers(0, 4, 200).astype(float)},
        # A third and more of all rows hold one value.
        "hot": {"a": np.concatenate([np.zeros(4000), rng.normal(size=3000)]), "b": np.full(10, 2.0)},
        "tiny": {"a": np.array([3.0]), "b": np.array([1.0, 2.0])},
        "large": {"a": rng.exponential(size=60000)},
    }[kind]
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE")
    probs = {"p0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "p100": 1.0}
    # A coarse sketch: the brackets, not the sketch, must carry the exactness.
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, accuracy=200).collect()}
    for g, values in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(float(np.quantile(values, p)), abs=1e-12)


def test_alignment_golden_row(spark):
    actual = spark.createDataFrame([(DAY, "101", 42.8, 63.12, "ad_campaign")],
                                   "date DATE, entity_id STRING, demand_index DOUBLE, price_index DOUBLE, event_type STRING")
    made = spark.createDataFrame([(DAY, "101", 28.834814071655273, 63.12, "m"), (DAY, "101", None, 63.12, "n")],
                                 "target_date DATE, entity_id STRING, pred_demand DOUBLE, pred_price DOUBLE, model_version STRING")
    rows = drift.align_forecasts(actual, made).collect()
    assert len(rows) == 1 and rows[0]["demand_error"] == pytest.approx(13.965185928344724)
    fva = drift.align_forecasts(actual, made).withColumn("first_seq", F.lit(1))
    alert = drift.alerts_from_errors(fva).first()
    assert alert["severity"] == "high" and alert["message"] == "Demand deviated by 13.97 for entity 101"


def test_mape_floor_and_window(spark):
    rows = [(k, "e", "m", 0.0 if k == 3 else 2.0, 1.0) for k in range(4)]
    fva = spark.createDataFrame(rows, "first_seq INT, entity_id STRING, model_version STRING, actual_demand DOUBLE, pred_demand DOUBLE")
    got = drift.error_metrics(fva, 2).first()
    assert got["n_rows"] == 2 and got["mape"] == pytest.approx((1 / 1e-6 + 0.5) / 2)
    empty = drift.error_metrics(fva.limit(0)).first()
    assert empty["mae"] is None


@pytest.mark.parametrize("mae, psi, status", [
    (None, 0.9, "insufficient_data"), (9.0, 0.31, "severe_feature_drift"), (9.0, 0.25, "feature_drift"),
    (1.26, 0.2, "performance_drift"), (1.25, 0.2, "stable"),
])
def test_status_order(spark, mae, psi, status):
    row = spark.createDataFrame([(mae, psi)], "mae DOUBLE, psi DOUBLE")
    assert row.select(drift.drift_status(F.col("mae"), F.col("psi"), F.lit(1.0)).alias("s")).first()["s"] == status


def test_profile_moments(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    got = drift.baseline_profile(spark.createDataFrame([(v,) for v in values], "x DOUBLE"), ["x"]).first()
    assert (got["min"], got["max"], got["mean"]) == (1.0, 8.0, 3.75)
    assert got["std"] == pytest.approx(np.std(values, ddof=1)) and not math.isnan(got["q50"])


@pytest.mark.parametrize("buffer, parts", [(1 << 16, 3), (5000, 7)])
def test_column_quantiles_equal_numpy(spark, buffer, parts):
    rng = np.random.default_rng(5)
    n = 30011
    table = {
        "a": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.7, 0.0, rng.normal(size=n)), "flat": np.full(n, -2.5),
        "whole": rng.integers(-3, 4, n).astype(float), "sorted": np.arange(n) / 7.0,
    }
    gaps = rng.random(n) < 0.3
    rows = [(*(float(c[k]) for c in table.values()), None if gaps[k] else float(table["a"][k]), None) for k in range(n)]
    names = [*table, "gaps", "void"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} DOUBLE" for c in names)).repartition(parts)
    probs = {"p0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "p100": 1.0}
    got = {r["feature"]: r for r in column_quantiles(df, names, probs, buffer).collect()}
    table["gaps"] = table["a"][~gaps]
    assert set(got) == set(table)
    for name, values in table.items():
        for p, q in probs.items():
            assert got[name][p] == pytest.approx(float(np.quantile(values, q)), abs=1e-12)
        assert (got[name]["min"], got[name]["max"]) == (values.min(), values.max())
        assert got[name]["mean"] == pytest.approx(values.mean(), abs=1e-12)
        assert got[name]["std"] == pytest.approx(values.std(ddof=1), abs=1e-12)


def test_column_quantiles_with_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, float("-inf")), (-0.0, None), (0.0, None)], "x DOUBLE, y DOUBLE")
    got = {r["feature"]: r for r in column_quantiles(df, ["x", "y"], {"q50": 0.5, "p100": 1.0}).collect()}
    assert (got["x"]["min"], got["x"]["q50"]) == (0.0, 1.0) and math.isnan(got["x"]["max"]) and math.isnan(got["x"]["p100"])
    assert got["y"]["min"] == float("-inf") and got["y"]["p100"] == 1.0


def test_a_profile_reads_its_frame_twice_however_wide(spark):
    """One pass for the sketches and one for the counts, not one for every few columns."""
    tasks = spark.sparkContext.accumulator(0)
    width = 40

    def touched(batches):
        tasks.add(1)
        yield from batches

    df = spark.range(100).coalesce(1).selectExpr(*[f"CAST(id + {k} AS DOUBLE) AS x{k}" for k in range(width)])
    profile = drift.baseline_profile(df.mapInArrow(touched, df.schema), [f"x{k}" for k in range(width)])
    assert profile.count() == width and tasks.value == 2
