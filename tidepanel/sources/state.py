"""State tables as append-only logs with a keep-last view.

A batch writes only its own ``_batch`` partition, replacing it when the batch is replayed, so a
lost executor or a restarted stream never leaves rows twice or half-updated. Tables with several
writers in a batch (models, versions, reasons) split the batch by writer in ``_part``, so that one
never replaces another's rows. Readers fold the log to one row per key: the newest values, and the
batch of first insertion as ``first_seq``. They can read the log as it was after any batch, which
is what makes a step that depends on its own tables repeatable.

Old batches can be compacted: they are folded into segments, segments of one tier into one of the next, and a manifest
names the segments that are live and the last batch in them. A manifest is a new file that appears by a rename, so a reader
sees the view before or after, and of two compactions at a time one fails. Reads open segments and newer batches only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.functions.columns import safe_sql
from tidepanel.operators.series import beside
from tidepanel.sources import schemas as S

BATCH = "_batch"
PART = "_part"
FIRST = "_first"  # the batch of first insertion, and before a column's name its value then
FAN_IN = 4


class LogTable:
    """One keyed table; without keys every row of every batch is kept."""

    def __init__(
        self, spark: SparkSession, path: str, ddl: str, keys: Sequence[str] = (),
        keep_from_first: Sequence[str] = (), order: Sequence[str] = (), measures_to_zero: Sequence[str] = (),
        writers: Sequence[str] = (), only_newest: bool = False,
    ):
        """``only_newest`` is for working sets of which nobody reads but the newest batch."""
        self.only_newest = only_newest
        self.spark, self.path, self.ddl = spark, path, ddl
        self.keys, self.kept, self.order = list(keys), list(keep_from_first), list(order)
        self.zeroed = set(measures_to_zero)
        self.writers = list(writers)
        self._ddl = f"{ddl}, {BATCH} BIGINT, {PART} STRING"

    def append(self, df: DataFrame, batch: int | Column) -> None:
        """Write the batch's partition; absent columns are NULL, unreadable measures 0.

        A column as ``batch`` deals the rows to their batches, all of them in one job.
        """
        if not isinstance(batch, Column) and batch <= self._manifest()["upto"]:
            raise ValueError(f"batch {batch} of {self.path} is compacted")
        present = set(df.columns)

        def shaped(name: str, kind: str) -> str:
            if name not in present:
                return f"CAST(NULL AS {kind}) AS `{name}`"
            return safe_sql(name, name) if name in self.zeroed else f"CAST(`{name}` AS {kind}) AS `{name}`"

        number = batch if isinstance(batch, Column) else F.lit(batch)
        rows = df.select(*[F.expr(shaped(n, k)) for n, k in S.columns(self.ddl)], number.cast("bigint").alias(BATCH))
        writer = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.writers]
        rows = rows.withColumn(PART, F.concat(F.lit("of "), *writer) if writer else F.lit("all"))
        even = rows.hint("rebalance", F.col(BATCH)) if isinstance(batch, Column) else rows.hint("rebalance")
        even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            BATCH, PART
        ).parquet(self.path)

    def log(self, upto: int | None = None, only: int | None = None, among: Sequence[int] | None = None) -> DataFrame:
        """Raw rows; all limits prune partitions."""
        names = [*S.names(self.ddl), BATCH]
        rows = reduce(DataFrame.unionByName, [f.select(*names) for f in self._live()])
        if upto is not None:
            rows = rows.filter(F.col(BATCH) <= upto)
        if only is not None:
            rows = rows.filter(F.col(BATCH) == only)
        if among is not None:
            rows = rows.filter(F.col(BATCH).isin(*among))
        return rows

    def current(self, upto: int | None = None) -> DataFrame:
        """One row per key: latest values, ``first_seq`` and the columns kept from first insertion."""
        if not self.keys:
            return self.log(upto).withColumnRenamed(BATCH, "first_seq")
        rows = reduce(DataFrame.unionByName, self._live())
        if upto is not None:
            rows = rows.filter(F.col(BATCH) <= upto)
        first = [f"{FIRST}_{c} AS {c}" if c in self.kept else c for c in S.names(self.ddl)]
        return self._folded(rows).selectExpr(*first, f"{FIRST} AS first_seq")

    def _folded(self, rows: DataFrame) -> DataFrame:
        """One row per key with the newest values, their batch, and what is kept of the first ones."""
        names = S.names(self.ddl)
        rest = [n for n in names if n not in self.keys and n not in self.kept]
        lead = [c for c in self.order if c in rest]
        newest = ", ".join([BATCH, *lead, *[c for c in rest if c not in lead]])
        kept = [FIRST, *[f"{FIRST}_{c}" for c in self.kept]]
        folded = rows.groupBy(*self.keys).agg(
            F.expr(f"max(struct({newest})) AS _new"), F.expr(f"min(struct({', '.join(kept)})) AS _old")
        )
        values = [n if n in self.keys else f"_old.{FIRST}_{n} AS {n}" if n in self.kept else f"_new.{n} AS {n}" for n in names]
        return folded.selectExpr(*values, f"_new.{BATCH} AS {BATCH}", *[f"_old.{c} AS {c}" for c in kept])

    # ---- compaction ----------------------------------------------------------------------------

    def _live(self) -> list[DataFrame]:
        """Rows of the segments and of the batches after them, with what is kept of first insertion."""
        manifest = self._manifest()
        try:
            raw = self.spark.read.schema(self._ddl).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            raw = self.spark.createDataFrame([], self._ddl)  # nothing was written yet
        raw = raw.filter(F.col(BATCH) > manifest["upto"]) if manifest["segments"] else raw
        frames = [raw.drop(PART).selectExpr("*", f"{BATCH} AS {FIRST}", *[f"{c} AS {FIRST}_{c}" for c in self.kept])]
        if manifest["segments"]:
            paths = [x["path"] for x in manifest["segments"]]
            frames.append(self.spark.read.schema(frames[0].schema).parquet(*paths))
        return frames

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _listed(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _manifest(self) -> dict[str, Any]:
        held = [n for n in self._listed(f"{self.path}_manifests") if n.endswith(".json")]
        if not held:
            return {"number": 0, "upto": -1 << 62, "segments": []}
        text = self.spark.read.text(f"{self.path}_manifests/{held[-1]}", wholetext=True).first()[0]
        return json.loads(text)

    def _swap(self, manifest: dict[str, Any]) -> None:
        """Make a manifest the newest; fails if there is one of its number."""
        folder = f"{self.path}_manifests"
        fs, draft = self._fs(f"{folder}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._fs(f"{folder}/{manifest['number']:012d}.json")[1]
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: another compaction came first")

    def _segment(self, rows: DataFrame, tier: int) -> dict[str, Any]:
        path = f"{self.path}_segments/{uuid.uuid4().hex}"
        (self._folded(rows) if self.keys else rows).write.parquet(path)
        return {"path": path, "tier": tier}

    def batches(self) -> int:
        """How many batches lie in the log, compacted ones left out."""
        return sum(n.startswith(f"{BATCH}=") for n in self._listed(self.path))

    def compact(self, upto: int) -> bool:
        """Fold the batches up to ``upto`` into the segments; ``FAN_IN`` segments of a tier become one of the next.

        Of keyed tables the newest row of each key stays and what is kept of its first; reads as of a folded batch
        are over. Files that are no longer live are removed after the swap.
        """
        batches = [int(n.split("=")[1]) for n in self._listed(self.path) if n.startswith(f"{BATCH}=")]
        old = self._manifest()
        folded = sorted(b for b in batches if b <= upto)
        fresh = [b for b in folded if b > old["upto"]]
        if not fresh or (self.only_newest and len(batches) == len(folded) == 1):
            return False
        dropped: list[str] = []
        if self.only_newest:
            folded = [b for b in folded if b != max(batches)]
        else:
            rows = self._live()[0].filter(F.col(BATCH) <= upto)
            segments, tier = [*old["segments"], self._segment(rows, 0)], 0
            while len(same := [x for x in segments if x["tier"] == tier]) >= FAN_IN:
                merged = self.spark.read.schema(rows.schema).parquet(*[x["path"] for x in same])
                segments = [x for x in segments if x["tier"] != tier] + [self._segment(merged, tier + 1)]
                dropped += [x["path"] for x in same]
                tier += 1
            self._swap({"number": old["number"] + 1, "upto": upto, "segments": segments})
        for path in [*dropped, *[f"{self.path}/{BATCH}={b}" for b in folded]]:
            fs, at = self._fs(path)
            fs.delete(at, True)
        return True


_FORECAST_KEYS = ["entity_id", "model_version"]
_FVA_MEASURES = [
    "pred_demand", "actual_demand", "demand_error", "abs_demand_error",
    "pred_price", "actual_price", "price_error", "abs_price_error",
]


class StateStore:
    """All tables of one engine below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

        def log(name: str, ddl: str, keys: Sequence[str] = (), **options) -> LogTable:
            return LogTable(spark, f"{self.root}/{name}", ddl, keys, **options)

        self.panel = log("panel", S.PANEL, ["date", "entity_id"])
        self.actuals = log(
            "actuals", S.ACTUALS, ["date", "entity_id"], keep_from_first=["created_at"],
            measures_to_zero=S.FEED_MEASURES,
        )
        self.predictions = log(
            "predictions", S.PREDICTIONS, ["target_date", *_FORECAST_KEYS],
            measures_to_zero=["pred_demand", "pred_price"], writers=["model_version"],
        )
        self.fva = log(
            "forecast_vs_actual", S.FORECAST_VS_ACTUAL, ["date", *_FORECAST_KEYS], measures_to_zero=_FVA_MEASURES,
            writers=["model_version"],
        )
        self.summary = log("daily_summary", S.DAILY_SUMMARY, ["date"])
        self.alerts = log("alerts", S.ALERTS, ["date", "entity_id", "alert_type"])
        self.drift = log("drift", S.DRIFT)
        self.jobs = log("retrain_jobs", S.RETRAIN_JOBS, writers=["trigger_reason", "new_version"])
        self.registry = log("registry", S.REGISTRY, ["version"], writers=["version"])
        self.state = log("runtime_state", S.RUNTIME_STATE, ["state_key"])
        # Working sets of the daily cycle: trailing rows per entity and the newest errors.
        self.tail = log("tail", S.PANEL, only_newest=True)
        self.error_window = log("error_window", f"{S.FORECAST_VS_ACTUAL}, first_seq BIGINT", only_newest=True)
        self.refused = log("refused", f"{S.PANEL}, reason STRING", writers=["reason"])

    # ---- runtime state -------------------------------------------------------------------------

    def state_values(self, upto: int | None = None) -> dict[str, str]:
        """All keys; a handful by design, so they are read to the driver."""
        stored = {r["state_key"]: r["state_value"] for r in self.state.current(upto).collect()}
        return {**S.STATE_DEFAULTS, **stored}

    def set_state(self, values: dict[str, Any], batch: int) -> None:
        """Write values of a batch beside those it has; the last write of a cycle is its commit mark."""
        held = {r["state_key"]: r["state_value"] for r in self.state.log(only=batch).collect()}
        rows = [(k, str(v)) for k, v in {**held, **values}.items()]
        frame = self.spark.createDataFrame(rows, "state_key STRING, state_value STRING")
        self.state.append(frame.withColumn("updated_at", F.current_timestamp()), batch)

    def compact(self, upto: int) -> list[str]:
        """Compact all tables but the refused rows, to which late dates are still added; names those that changed."""
        tables = {n: t for n, t in vars(self).items() if isinstance(t, LogTable) and t is not self.refused}
        return [n for n, t in tables.items() if t.compact(upto)]

    # ---- history -------------------------------------------------------------------------------

    def history(self) -> DataFrame:
        """Panel and actuals as one panel; actuals win where they say something, other signals stay."""
        panel = self.panel.current().drop("first_seq")
        actuals = self.actuals.current().drop("first_seq", "created_at")
        newer = {c: f"_{c}" for c in actuals.columns if c not in ("date", "entity_id")}
        both = panel.join(actuals.withColumnsRenamed(newer), ["date", "entity_id"], "full_outer")
        return both.select(*[
            F.coalesce(newer[c], c).alias(c) if c in newer else F.col(c) for c in panel.columns
        ])


def state_snapshot(state: DataFrame) -> DataFrame:
    """The keyed state as one map column of (value, updated_at)."""
    entry = F.struct("state_key", F.struct(F.col("state_value").alias("value"), "updated_at").alias("v"))
    return state.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("state"))


def read_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    """Parameterised SQL: ``{name}`` is a table, ``:name`` a value."""
    return spark.sql(query, args=params, **tables)


# ---- readers ---------------------------------------------------------------------------------------


def latest_forecast(predictions: DataFrame, limit: int = 500) -> DataFrame:
    last = predictions.agg(F.max("target_date")).scalar()
    return predictions.filter(F.col("target_date") == last).orderBy("entity_id", "model_version").limit(limit)


def latest_row(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """The newest row of a log."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(1)


def newest_rows(log: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    return log.orderBy(*[F.desc(c) for c in order]).limit(limit)


def sorted_tail(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The last ``limit`` rows of the sorted table, ascending."""
    return newest_rows(df, order, limit).orderBy(*order)


def actuals_for_date(actuals: DataFrame, date: str | None = None) -> DataFrame:
    """One date's actuals by entity; the latest date unless one is given."""
    wanted = F.lit(date).cast("date") if date else actuals.agg(F.max("date")).scalar()
    return actuals.filter(F.col("date") == wanted).orderBy("entity_id")


def engine_status(state: DataFrame, drift: DataFrame, registry: DataFrame, drift_order: Sequence[str]) -> DataFrame:
    """One row: state keys, newest drift snapshot and the active model."""
    def value(key: str):
        return F.max(F.when(F.col("state_key") == key, F.col("state_value")))

    keys = state.agg(
        value("sim_day").cast("int").alias("sim_day"),
        value("last_ingested_date").alias("latest_date"),
        value("active_model_version").alias("active_model_version"),
        value("rows_since_last_retrain").cast("bigint").alias("rows_since_last_retrain"),
    )
    newest = latest_row(drift, drift_order).agg(
        *[F.max(c).alias(c) for c in ("drift_status", "mae", "mape", "rmse", "max_feature_psi")]
    )
    active = registry.filter(F.col("status") == "active").agg(F.max("version").alias("registry_version"))
    return beside(keys, newest, active)
