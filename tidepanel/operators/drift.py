"""Forecast errors, baseline profiles and population stability."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidepanel.functions.columns import lenient_double, severity
from tidepanel.functions.quantiles import column_quantiles, ordered_keys
from tidepanel.operators.dedup import keep_first
from tidepanel.settings import DEFAULTS, Settings

# Expected share of each bin, and the floor that keeps the logarithm finite.
QUANTILE_SHARES = (0.10, 0.40, 0.40, 0.10)
MEAN_STD_SHARES = (0.16, 0.34, 0.34, 0.16)
MAX_EDGES = 5
UNPIVOT_COLUMNS = 16
SEGMENTS_HELD = 1 << 12  # counted by a task before their counts go on
SHARE_FLOOR = 1e-6
ACTUAL_FLOOR = 1e-6
INSERTION_ORDER = ("first_seq", "entity_id", "model_version")


# ---- forecast versus actual ---------------------------------------------------------------------


def align_forecasts(actuals: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each actual beside every prediction made for its entity and date, with signed and absolute errors."""
    a, p = actuals.alias("a"), predictions.alias("p")
    joined = a.join(
        p, (F.col("a.date") == F.col("p.target_date")) & (F.col("a.entity_id") == F.col("p.entity_id"))
    )
    carried = [
        (F.col(f"a.{c}") if c in actuals.columns else F.lit(None).cast("string")).alias(c)
        for c in ("event_type", "event_effect_hint")
    ]
    paired = joined.select(
        F.col("a.date").alias("date"), F.col("a.entity_id").alias("entity_id"),
        lenient_double(F.col("p.pred_demand")).alias("pred_demand"),
        lenient_double(F.col("a.demand_index")).alias("actual_demand"),
        lenient_double(F.col("p.pred_price")).alias("pred_price"),
        lenient_double(F.col("a.price_index")).alias("actual_price"),
        *carried, F.col("p.model_version").alias("model_version"),
    ).na.drop(subset=["pred_demand", "actual_demand", "pred_price", "actual_price"])
    demand, price = F.col("actual_demand") - F.col("pred_demand"), F.col("actual_price") - F.col("pred_price")
    return paired.select(
        "date", "entity_id", "pred_demand", "actual_demand",
        demand.alias("demand_error"), F.abs(demand).alias("abs_demand_error"),
        "pred_price", "actual_price", price.alias("price_error"), F.abs(price).alias("abs_price_error"),
        "event_type", "event_effect_hint", "model_version",
    )


def error_aggregates(actual: Column, predicted: Column) -> dict[str, Column]:
    gap = actual - predicted
    return {
        "mae": F.avg(F.abs(gap)),
        "mape": F.avg(F.abs(gap / F.greatest(F.abs(actual), F.lit(ACTUAL_FLOOR)))),
        "rmse": F.sqrt(F.avg(gap * gap)),
    }


def newest(fva: DataFrame, limit: int, order: Sequence[str] = INSERTION_ORDER) -> DataFrame:
    """The ``limit`` most recently first-inserted rows (a top-k, not a full sort)."""
    return fva.orderBy(*[F.desc(c) for c in order if c in fva.columns]).limit(limit)


def newest_dates(fva: DataFrame, least: int) -> DataFrame:
    """All rows of the newest dates that together hold at least ``least`` rows."""
    days = fva.groupBy("date").agg(F.count("*").alias("_rows"))  # one row per date
    newer = F.sum("_rows").over(Window.orderBy(F.desc("date"))) - F.col("_rows")
    kept = days.withColumn("_newer", newer).filter(F.col("_newer") < least).select("date")
    return fva.join(F.broadcast(kept), "date", "left_semi")


def error_metrics(
    fva: DataFrame, window: int | None = DEFAULTS.error_window, model_version: str | None = None
) -> DataFrame:
    """MAE, MAPE and RMSE of the newest rows (all without a window), across versions unless one is named."""
    if model_version is not None:
        fva = fva.filter(F.col("model_version") == model_version)
    measures = error_aggregates(F.col("actual_demand"), F.col("pred_demand"))
    return (fva if window is None else newest(fva, window)).agg(
        *[c.alias(n) for n, c in measures.items()], F.count("*").alias("n_rows")
    )


def error_metrics_by_date(fva: DataFrame, dates: DataFrame, least: int) -> DataFrame:
    """MAE, MAPE and RMSE at each of ``dates``: over all rows of the newest dates up to it that together hold at least
    ``least`` rows (as :func:`newest_dates` takes them).

    Rows become totals per date; a date's window is a range frame over the running number of rows.
    """
    gap = F.col("actual_demand") - F.col("pred_demand")
    totals = fva.groupBy("date").agg(
        F.count("*").alias("_n"), F.sum(F.abs(gap)).alias("_abs"),
        F.sum(F.abs(gap / F.greatest(F.abs("actual_demand"), F.lit(ACTUAL_FLOOR)))).alias("_share"),
        F.sum(gap * gap).alias("_square"),
    )
    placed = totals.join(dates.select("date"), "date", "full_outer").withColumn("_n", F.coalesce("_n", F.lit(0)))
    # One row per date from here on.
    running = placed.withColumn("_so_far", F.sum("_n").over(Window.orderBy("date")))
    recent = Window.orderBy("_so_far").rangeBetween(1 - least, 0)
    n = F.sum("_n").over(recent)
    means = {m: F.try_divide(F.sum(c).over(recent), n) for m, c in (("mae", "_abs"), ("mape", "_share"), ("_mean_square", "_square"))}
    measured = running.select("date", *[c.alias(m) for m, c in means.items()], n.alias("n_rows"))
    asked = measured.join(dates.select("date"), "date", "left_semi")
    return asked.select("date", "mae", "mape", F.sqrt("_mean_square").alias("rmse"), "n_rows")


def regression_scores(scored: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and R² of ``pred`` against ``actual``."""
    gap = F.col("actual") - F.col("pred")
    return scored.filter(F.col("actual").isNotNull() & F.col("pred").isNotNull()).groupBy(*group).agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        (1 - F.try_divide(F.sum(gap * gap), F.var_pop("actual") * F.count("*"))).alias("r2"),
        F.count("*").alias("n_rows"),
    )


# ---- baseline profile -----------------------------------------------------------------------------


def long_form(frame: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows.

    Wide frames are unpivoted a few columns at a time: one pass over 88 columns generates a method
    too long for the JVM to compile, and each part reads only its own columns of a stored frame.
    """
    parts = []
    for start in range(0, len(features), UNPIVOT_COLUMNS):
        names = list(features[start:start + UNPIVOT_COLUMNS])
        texts = [f"CAST(`{n}` AS DOUBLE) AS `{n}`" for n in names]
        parts.append(frame.selectExpr(*keys, *texts).unpivot(list(keys), names, "feature", "value"))
    return reduce(DataFrame.unionByName, parts)


def baseline_profile(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: min, q10, q50, q90, max, mean and std of the training period."""
    profile = column_quantiles(frame, features, {"q10": 0.10, "q50": 0.50, "q90": 0.90})
    return profile.select("feature", "min", "q10", "q50", "q90", "max", "mean", "std")


# ---- population stability index ---------------------------------------------------------------------


def _quantile_edges() -> Column:
    return F.array_sort(F.array_distinct(F.array("min", "q10", "q50", "q90", "max")))


def _mean_std_edges() -> Column:
    spread = F.greatest(F.col("std"), F.lit(1e-6))
    edges = F.array("min", F.col("mean") - spread, F.col("mean"), F.col("mean") + spread, "max")
    return F.array_sort(F.array_distinct(edges))


def bin_edges(profile: DataFrame, method: str = "auto") -> DataFrame:
    """Sorted distinct edges and expected shares per feature.

    ``auto`` uses the quantiles where the profile has them and mean and deviation elsewhere.
    """
    missing = [c for c in ("q10", "q50", "q90", "mean", "std") if c not in profile.columns]
    for name in missing:
        profile = profile.withColumn(name, F.lit(None).cast("double"))

    def complete(*names: str) -> Column:
        return ~F.array_contains(F.array(*[F.col(n).isNull() for n in names]), True)

    by_quantile, by_moment = complete("min", "q10", "q50", "q90", "max"), complete("min", "mean", "std", "max")
    if method == "quantile":
        by_moment = F.lit(False)
    elif method == "mean_std":
        by_quantile = F.lit(False)
    return profile.select(
        "feature",
        F.when(by_quantile, _quantile_edges()).when(by_moment, _mean_std_edges()).alias("edges"),
        F.when(by_quantile, F.array(*map(F.lit, QUANTILE_SHARES)))
        .when(by_moment, F.array(*map(F.lit, MEAN_STD_SHARES))).alias("expected"),
    )


def _binned(edges: Sequence[Sequence[float] | None], keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, segment (the first ``keys`` columns) and feature: how many values lie in each bin, and how many there are.

    Half-open bins, the last one closed; values outside the edges belong to none. Features beyond the columns given
    get their rows, with nothing counted.
    """
    # Doubles as integers of the same order: the last edge is closed by the integer after it.
    marks = [np.array([], np.int64) if e is None else ordered_keys(pa.array(e, pa.float64())) + ([0] * (len(e) - 1) + [1]) for e in edges]
    places = MAX_EDGES + 1  # below, the bins, above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[tuple, int] = {}
        found: list[pa.RecordBatch] = []
        totals = np.zeros((1, len(marks), places), np.int64)

        def flush() -> pa.RecordBatch:
            n = len(slots)
            counts, at = totals[:n].reshape(n * len(marks), places), np.repeat(np.arange(n), len(marks))
            size = np.tile([max(len(m), 1) for m in marks], n)
            hits = [np.where(k + 1 < size, counts[:, k + 1], 0) for k in range(MAX_EDGES - 1)]
            columns = [c.combine_chunks() for c in pa.Table.from_batches(found).take(pa.array(at)).columns] if keys else []
            facts = [np.tile(np.arange(len(marks), dtype=np.int32), n), *hits, counts.sum(axis=1)]
            names = [*(found[0].schema.names if keys else []), "_f", *[f"_h{k}" for k in range(MAX_EDGES - 1)], "n_values"]
            return pa.RecordBatch.from_arrays([*columns, *map(pa.array, facts)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.zeros(batch.num_rows, np.int64)
            for column in batch.columns[:keys]:
                coded = column.dictionary_encode(null_encoding="encode")
                of = np.unique(of * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            first = np.unique(of, return_index=True)[1]
            mine = pa.RecordBatch.from_arrays(batch.columns[:keys], names=batch.schema.names[:keys]).take(pa.array(first)) if keys else None
            rows = [tuple(r.values()) for r in mine.to_pylist()] if keys else [()]
            new = [k for k, r in enumerate(rows) if r not in slots]
            slots.update({rows[k]: len(slots) + j for j, k in enumerate(new)})
            if keys and new:
                found.append(mine.take(pa.array(new)))
            if len(slots) > len(totals):
                totals = np.concatenate([totals, np.zeros((len(slots), len(marks), places), np.int64)])
            here = [slots[r] for r in rows]
            for f, column in enumerate(batch.columns[keys:]):
                segments = of[column.is_valid().to_numpy(zero_copy_only=False)] if column.null_count else of
                cells = segments * places + np.searchsorted(marks[f], ordered_keys(column), side="right")
                totals[here, f] += np.bincount(cells, minlength=len(rows) * places).reshape(-1, places)
            if len(slots) >= SEGMENTS_HELD:
                yield flush()
                slots, found, totals = {}, [], np.zeros((1, len(marks), places), np.int64)
        if slots:
            yield flush()

    return run


def feature_psi(
    live: DataFrame, profile: DataFrame, features: Sequence[str], method: str = "auto",
    segment: Sequence[str] = (),
) -> DataFrame:
    """PSI of each feature of the live frame against its profile.

    One pass over Arrow batches bins all features at once and sends on a row per task, segment and feature. The driver
    reads the edges, one row per feature column. A feature with fewer than two bins has PSI 0 whatever its values, so
    these are not read.
    """
    held = {r["feature"]: r for r in bin_edges(profile, method).collect()}
    known = [n for n in features if n in held]
    read = [n for n in known if len(held[n]["edges"] or ()) >= 3] or known[:1]
    names = [*read, *[n for n in known if n not in read]]
    edges = live.sparkSession.createDataFrame(
        [(f, n, held[n]["edges"], held[n]["expected"]) for f, n in enumerate(names)],
        "_f INT, feature STRING, edges ARRAY<DOUBLE>, expected ARRAY<DOUBLE>",
    )
    wide = live.select(*segment, *[F.col(f"`{n}`").cast("double").alias(f"_c{f}") for f, n in enumerate(read)])
    counts = [f"_h{k}" for k in range(MAX_EDGES - 1)]
    shape = T.StructType([*wide.schema.fields[:len(segment)], T.StructField("_f", T.IntegerType()),
                          *[T.StructField(c, T.LongType()) for c in [*counts, "n_values"]]])
    binned = wide.mapInArrow(_binned([held[n]["edges"] for n in names], len(segment)), shape)
    counted = binned.groupBy(*segment, "_f").agg(*[F.sum(c).alias(c) for c in [*counts, "n_values"]])
    ready = counted.join(F.broadcast(edges), "_f").withColumn("hits", F.array(*counts))
    return ready.select(*segment, "feature", _psi_of("hits", "edges", "expected", "n_values").alias("psi"))


def _psi_of(hits: str, edges: str, expected: str, n_values: str) -> Column:
    n_bins = F.size(edges) - 1
    used = F.slice(F.col(hits), 1, F.greatest(n_bins, F.lit(1)))
    total = F.greatest(F.aggregate(used, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(1).cast("bigint"))
    shares = F.zip_with(
        used, F.slice(F.col(expected), 1, F.greatest(n_bins, F.lit(1))),
        lambda h, e: F.struct(
            F.greatest(h / total, F.lit(SHARE_FLOOR)).alias("a"),
            F.greatest(e, F.lit(SHARE_FLOOR)).alias("e"),
        ),
    )
    index = F.aggregate(
        shares, F.lit(0.0), lambda acc, s: acc + (s["a"] - s["e"]) * F.ln(s["a"] / s["e"])
    )
    scorable = F.col(edges).isNotNull() & (F.size(edges) >= 3) & (F.col(n_values) > 0)
    return F.when(scorable, index).otherwise(F.lit(0.0))


# ---- drift status ---------------------------------------------------------------------------------


def drift_status(
    mae: Column, max_psi: Column, baseline_mae: Column, settings: Settings = DEFAULTS
) -> Column:
    """Feature drift outranks performance drift; no error rows means nothing to judge."""
    return (
        F.when(mae.isNull(), "insufficient_data")
        .when(max_psi > settings.psi_severe_threshold, "severe_feature_drift")
        .when(max_psi > settings.psi_threshold, "feature_drift")
        .when(mae > baseline_mae * settings.retrain_mae_multiplier, "performance_drift")
        .otherwise("stable")
    )


def drift_snapshot(
    fva: DataFrame, psi: DataFrame, baseline_mae: float | Column, settings: Settings = DEFAULTS,
    whole: bool = False,
) -> DataFrame:
    """One row: error metrics, largest PSI, status and the PSI map as JSON.

    The metrics rest on the newest ``error_window`` rows, or with ``whole`` on all rows given.
    """
    errors = error_metrics(fva, None if whole else settings.error_window)
    # One entry per feature column of the contract.
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi"))))
    stability = psi.agg(
        F.struct(
            F.coalesce(F.max("psi"), F.lit(0.0)).alias("worst"), F.to_json(entries).alias("by_feature")
        ).alias("s")
    ).scalar()
    base = baseline_mae if isinstance(baseline_mae, Column) else F.lit(float(baseline_mae))
    row = errors.select(
        "mae", "mape", "rmse", "n_rows",
        F.when(F.col("mae").isNull(), 0.0).otherwise(stability["worst"]).alias("max_feature_psi"),
        F.when(F.col("mae").isNull(), "{}").otherwise(stability["by_feature"]).alias("payload_json"),
    )
    return row.withColumn(
        "drift_status", drift_status(F.col("mae"), F.col("max_feature_psi"), base, settings)
    )


def drift_snapshots(
    metrics: DataFrame, psi: DataFrame, baseline_mae: Column, settings: Settings = DEFAULTS
) -> DataFrame:
    """:func:`drift_snapshot` of many dates: ``metrics`` has a row per date, ``psi`` one per date and feature."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "psi"))))
    stability = psi.groupBy("date").agg(F.max("psi").alias("_worst"), F.to_json(entries).alias("_by_feature"))
    judged = F.col("mae").isNotNull()
    rows = metrics.join(stability, "date", "left").withColumns({
        "max_feature_psi": F.when(judged, F.coalesce("_worst", F.lit(0.0))).otherwise(0.0),
        "payload_json": F.when(judged, F.coalesce("_by_feature", F.lit("{}"))).otherwise("{}"),
    })
    status = drift_status(F.col("mae"), F.col("max_feature_psi"), baseline_mae, settings)
    return rows.drop("_worst", "_by_feature").withColumn("drift_status", status)


# ---- alerts ----------------------------------------------------------------------------------------


def alerts_from_errors(fva: DataFrame, limit: int | None = DEFAULTS.alert_window) -> DataFrame:
    """Alerts for the large misses among the newest rows (all without a limit), one per entity and date.

    Among versions that missed on the same day the earliest inserted one speaks.
    """
    recent = (fva if limit is None else newest(fva, limit)).withColumn("severity", severity(F.col("abs_demand_error")))
    loud = recent.filter(F.col("severity").isin("high", "medium")).select(
        "date", "entity_id", "first_seq", "model_version", "abs_demand_error", "severity", "event_type",
        F.lit("forecast_miss").alias("alert_type"),
        F.format_string("Demand deviated by %.2f for entity %s", "abs_demand_error", "entity_id").alias("message"),
    )
    one = keep_first(loud, ["date", "entity_id", "alert_type"], ["first_seq", "model_version"])
    return one.drop("first_seq", "model_version")
