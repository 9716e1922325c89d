"""Training, scoring and explaining the demand model with Spark ML."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.operators.drift import baseline_profile, regression_scores
from tidepanel.operators.normalize import contract_columns, finalize_features
from tidepanel.plans.contributions import Leaves, largest_text, read_leaves
from tidepanel.session import checkpoints, wide_plans
from tidepanel.settings import DEFAULTS, Settings

PROFILE, PIPELINE, METADATA = "profile", "pipeline", "metadata"


# ---- guards and split ---------------------------------------------------------------------------------


def split_by_date(
    frame: DataFrame, fraction: float = DEFAULTS.train_fraction, segment: Sequence[str] = ()
) -> DataFrame:
    """Flag ``is_train``: the first ``fraction`` of the distinct dates trains, the rest validates.

    Only the distinct dates are ranked; they come back as a calendar-sized broadcast.
    """
    dates = frame.select(*segment, "date").distinct()
    ranked = Window.partitionBy(*segment).orderBy("date")
    whole = Window.partitionBy(*segment)
    cut = F.floor(F.count("*").over(whole) * fraction)
    flagged = dates.withColumn("is_train", F.row_number().over(ranked) <= cut)
    side = flagged if segment else F.broadcast(flagged)
    return frame.join(side, [*segment, "date"])


def training_guards(
    frame: DataFrame, features: Sequence[str], target: str = "target", settings: Settings = DEFAULTS,
    segment: Sequence[str] = (),
) -> DataFrame:
    """Reason code per segment (``ok`` when the frame can train a model) and the counts behind it."""
    missing = contract_columns(frame, features)["missing"]
    per_date = frame.groupBy(*segment, "date").agg(F.count("*").alias("n"), F.count(target).alias("n_target"))
    ranked = Window.partitionBy(*segment).orderBy("date")
    whole = Window.partitionBy(*segment)
    placed = per_date.withColumn("_n_dates", F.count("*").over(whole)).withColumn(
        "_train", F.row_number().over(ranked) <= F.floor(F.col("_n_dates") * settings.train_fraction)
    )
    counts = placed.groupBy(*segment).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_dates"),
        F.coalesce(F.sum(F.when(F.col("_train"), F.col("n_target"))), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum(F.when(~F.col("_train"), F.col("n_target"))), F.lit(0)).alias("n_valid"),
    )
    split = F.floor(F.col("n_dates") * settings.train_fraction)
    reason = (
        F.when(F.col("n_rows") == 0, "empty_training_data")
        .when(F.col("n_rows") < settings.min_train_rows, F.concat(F.lit("insufficient_rows:"), F.col("n_rows")))
        .when(F.col("n_dates") < settings.min_train_dates, "insufficient_unique_dates")
        .when((split <= 0) | (split >= F.col("n_dates")), "invalid_train_valid_split")
        .when(F.lit(bool(missing)), f"missing_feature_columns:{','.join(missing[:5])}")
        .when(F.col("n_train") == 0, "empty_train_partition")
        .when(F.col("n_valid") < settings.min_valid_rows, "insufficient_validation_rows")
        .otherwise("ok")
    )
    return counts.withColumn("reason", reason)


# ---- fit and score --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Learner:
    """Boosted trees; ``trees`` is a parameter because boosting rounds run one after another."""

    # Depth, rate, sampling and seed of the demand model.
    trees: int = 700
    depth: int = 6
    rate: float = 0.03
    sample: float = 0.9
    seed: int = 42

    def pipeline(self, features: Sequence[str], label: str = "target") -> Pipeline:
        trees = GBTRegressor(
            featuresCol="features", labelCol=label, predictionCol="prediction", maxIter=self.trees,
            maxDepth=self.depth, stepSize=self.rate, subsamplingRate=self.sample,
            featureSubsetStrategy=str(self.sample), seed=self.seed,
        )
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), trees])


def score(model: PipelineModel, frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """``pred_demand`` for each row; absent inputs are 0, extra columns are carried."""
    ready = finalize_features(frame, features)
    scored = model.transform(ready).withColumnRenamed("prediction", "pred_demand")
    return scored.drop("features")


@dataclass
class TrainedModel:
    version: str
    features: list[str]
    pipeline: PipelineModel
    profile: DataFrame
    mae: float
    rmse: float
    event_kinds: list[str]
    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    leaves: Leaves | None = None


_META = (
    "version STRING, features ARRAY<STRING>, event_kinds ARRAY<STRING>, mae DOUBLE, rmse DOUBLE, "
    "weights MAP<STRING, STRUCT<coefficient: DOUBLE, mean: DOUBLE>>"
)


def train(
    frame: DataFrame, features: Sequence[str], version: str, path: str,
    learner: Learner = Learner(), settings: Settings = DEFAULTS, event_kinds: Sequence[str] = (),
) -> tuple[TrainedModel | None, str]:
    """Guard, split, fit, validate and store one model; returns it with its reason code.

    The frame is read by the fit, the validation and the profile, so it is written once to the
    artifact folder and read back from there.
    """
    with wide_plans(frame.sparkSession):
        return _train(frame, features, version, path, learner, settings, event_kinds)


def _train(
    frame: DataFrame, features: Sequence[str], version: str, path: str, learner: Learner, settings: Settings,
    event_kinds: Sequence[str],
) -> tuple[TrainedModel | None, str]:
    frame.write.mode("overwrite").parquet(f"{path}/frame")
    stored = frame.sparkSession.read.parquet(f"{path}/frame")
    reason = [r["reason"] for r in training_guards(stored, features, settings=settings).collect()]
    if not reason:
        return None, "empty_training_data"
    if reason[0] != "ok":
        return None, reason[0]
    parts = split_by_date(stored, settings.train_fraction).filter(F.col("target").isNotNull())
    train_part, valid_part = parts.filter("is_train"), parts.filter("NOT is_train")
    with checkpoints(frame.sparkSession):
        fitted = learner.pipeline(features).fit(train_part)
    scored = score(fitted, valid_part, features)
    metrics = regression_scores(
        scored.select(F.col("target").alias("actual"), F.col("pred_demand").alias("pred"))
    ).collect()[0]
    fitted.write().overwrite().save(f"{path}/{PIPELINE}")
    baseline_profile(train_part, features).write.mode("overwrite").parquet(f"{path}/{PROFILE}")
    spark = frame.sparkSession
    spark.createDataFrame(
        [(version, list(features), list(event_kinds), float(metrics["mae"]), float(metrics["rmse"]),
          linear_surrogate(train_part, features))],
        _META,
    ).coalesce(1).write.mode("overwrite").json(f"{path}/{METADATA}")
    return load(spark, path), "ok"


def load(spark: SparkSession, path: str) -> TrainedModel:
    meta = spark.read.schema(_META).json(f"{path}/{METADATA}").first()
    return TrainedModel(
        version=meta["version"], features=list(meta["features"]),
        pipeline=PipelineModel.load(f"{path}/{PIPELINE}"),
        profile=spark.read.parquet(f"{path}/{PROFILE}"),
        mae=meta["mae"], rmse=meta["rmse"], event_kinds=list(meta["event_kinds"] or []),
        weights={k: (v["coefficient"], v["mean"]) for k, v in (meta["weights"] or {}).items()},
        leaves=read_leaves(spark, f"{path}/{PIPELINE}"),
    )


# ---- contributions ----------------------------------------------------------------------------------------


RIDGE = 1e-3


def linear_surrogate(
    frame: DataFrame, features: Sequence[str], label: str = "target", ridge: float = RIDGE
) -> dict[str, tuple[float, float]]:
    """Coefficient and mean of each feature from a ridge fit of ``label`` on standardised inputs.

    ``ridge`` counts in standard deviations of the label, so the weights do not depend on units; it settles how
    collinear inputs share a weight. Inputs that are constant but for rounding get none. The normal equations are
    summed in one pass, centred, by NumPy over Arrow batches.
    Raises ValueError where they have no solution.
    """
    ready = finalize_features(frame, features).filter(F.col(label).isNotNull())
    n, mean, cross = _moments(ready.select(*features, label))
    means = {f: float(m) for f, m in zip(features, mean)}
    spread = np.sqrt(cross.diagonal() / max(n, 1))
    # The root of the mean square stands for the size of an input.
    size = np.sqrt(spread ** 2 + mean ** 2)
    used = [k for k in range(len(features)) if spread[k] > 1e-9 * max(1.0, size[k])]
    weights: dict[str, float] = {}
    if spread[-1] and used:  # else no rows, or nothing to explain
        scale = spread[used]
        shared = cross[np.ix_(used, used)] / n / np.outer(scale, scale)
        with_label = cross[used, -1] / n / scale / spread[-1]
        found = np.full(len(used), np.nan)
        if np.isfinite(shared).all() and np.isfinite(with_label).all():
            found = np.linalg.solve(shared + ridge * np.eye(len(used)), with_label) * spread[-1] / scale
        if not np.isfinite(found).all():
            raise ValueError("the normal equations of the surrogate have no solution")
        weights = {features[k]: float(w) for k, w in zip(used, found)}
    return {f: (weights.get(f, 0.0), m) for f, m in means.items()}


_PARTIAL = "n DOUBLE, mean ARRAY<DOUBLE>, cross ARRAY<DOUBLE>"
_MERGERS = 8


def _merged(parts: Iterable[tuple[float, np.ndarray, np.ndarray]], width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and centred cross-products of all rows from those of parts."""
    n, mean, cross = 0.0, np.zeros(width), np.zeros((width, width))
    for n_part, mean_part, cross_part in parts:
        if n_part:
            gap, total = mean_part - mean, n + n_part
            cross += cross_part + np.outer(gap, gap) * (n * n_part / total)
            mean, n = mean + gap * (n_part / total), total
    return n, mean, cross


def _moments(rows: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and centred cross-products of all columns in one pass; a task sends one matrix, the driver reads
    ``_MERGERS`` of them."""
    width = len(rows.columns)

    def shaped(found: tuple[float, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        n, mean, cross = found
        arrays = [pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())),
                  pa.array([cross.ravel().tolist()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["n", "mean", "cross"])

    def of_rows(batch: pa.RecordBatch) -> tuple[float, np.ndarray, np.ndarray]:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        mean = x.mean(axis=0) if len(x) else np.zeros(width)
        x -= mean
        return float(len(x)), mean, x.T @ x

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for batch in batches:
            for n, mean, cross in zip(*batch.columns, strict=True):
                yield n.as_py(), mean.values.to_numpy(), cross.values.to_numpy().reshape(width, width)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield shaped(_merged(map(of_rows, batches), width))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield shaped(_merged(of_parts(batches), width))

    doubles = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(rows.columns)])
    parts = doubles.mapInArrow(gather, _PARTIAL).repartition(_MERGERS).mapInArrow(merge, _PARTIAL)
    return _merged(((r["n"], np.array(r["mean"]), np.array(r["cross"]).reshape(width, width)) for r in parts.collect()), width)


def contribution_text(weights: dict[str, tuple[float, float]], top: int = 3) -> Column:
    """The ``top`` features that moved a prediction most by linear weights, largest first."""
    return largest_text(F.array(*[
        F.struct(
            ((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - mean) * coef).alias("v"), F.lit(f).alias("f")
        )
        for f, (coef, mean) in weights.items()
    ]), top)
