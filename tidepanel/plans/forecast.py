"""Next-day forecasts from the latest batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.operators.attribution import attach_context, with_reasons
from tidepanel.operators.dedup import union_keep_last
from tidepanel.operators.features import live_feature_frame
from tidepanel.operators.normalize import finalize_features
from tidepanel.plans.contributions import shares_text, with_shares
from tidepanel.plans.model import TrainedModel, contribution_text, score
from tidepanel.sources import schemas as S


class NaiveScorer:
    """Tomorrow equals today; needs no features."""

    needs_features = False
    version = "naive_lag1"
    profile = None
    features: list[str] = list(S.FEATURE_CONTRACT)
    event_kinds: list[str] | None = None

    def predict(self, live: DataFrame) -> DataFrame:
        return live.withColumn("pred_demand", F.col("demand_index"))

    def explain(self) -> Column:
        return F.lit(None).cast("string")


class ModelScorer:
    """A stored model, explained by the shares of its trees, or by linear ``weights`` where these are given."""

    needs_features = True

    def __init__(self, model: TrainedModel, weights: dict[str, tuple[float, float]] | None = None):
        self.model, self.weights = model, weights or model.weights
        self.by_trees = not weights and model.leaves is not None
        self.version, self.profile = model.version, model.profile
        self.features, self.event_kinds = model.features, model.event_kinds or None

    def predict(self, live: DataFrame) -> DataFrame:
        scored = score(self.model.pipeline, live, self.features)
        return with_shares(scored, self.model.leaves, self.features) if self.by_trees else scored

    def explain(self) -> Column:
        if self.by_trees:
            return shares_text(self.features)
        return contribution_text(self.weights) if self.weights else F.lit(None).cast("string")


def latest_context(history: DataFrame, actuals: DataFrame | None = None) -> DataFrame:
    """Rows of the newest actuals; without any, rows of the newest history date."""
    fallback = history.filter(F.col("date") == history.agg(F.max("date")).scalar())
    if actuals is None:
        return fallback
    newest = actuals.filter(F.col("date") == actuals.agg(F.max("date")).scalar())
    nothing = actuals.agg(F.count("*") == 0).scalar()
    return newest.unionByName(fallback.filter(nothing), allowMissingColumns=True)


def forecast_next_day(
    history: DataFrame,
    batch: DataFrame | None,
    scorer: NaiveScorer | ModelScorer,
    events: DataFrame | None = None,
    regimes: DataFrame | None = None,
    actuals: DataFrame | None = None,
) -> DataFrame:
    """Predictions for the day after the batch, with price, signals, event and reasons carried over.

    Without a batch the context is the newest actuals, or the newest history without those.
    """
    if batch is None:
        batch = latest_context(history, actuals)
    if scorer.needs_features:
        live = live_feature_frame(history, batch, events, regimes, scorer.event_kinds, scorer.features)
    else:
        dates = batch.select("date").distinct()
        live = union_keep_last([history, batch], ["entity_id", "date"], []).join(dates, "date", "left_semi")
    return forecast_rows(live, batch, scorer)


def forecast_rows(
    live: DataFrame, batch: DataFrame, scorer: NaiveScorer | ModelScorer, dated: bool = False
) -> DataFrame:
    """Forecasts from rows of the batch's dates that already carry the scorer's features.

    ``dated`` forecasts the day after each date of the batch, from that date's rows.
    """
    ready = finalize_features(live, scorer.features) if scorer.needs_features else live
    scored = scorer.predict(ready).select(
        "entity_id", F.date_add("date", 1).alias("target_date"), "pred_demand",
        scorer.explain().alias("shap_explanation"),
    )
    placed = with_reasons(attach_context(scored, batch, dated))
    labels = [c for c in ("brand", "product_name", "category") if c in placed.columns]
    return placed.select(
        F.current_timestamp().alias("prediction_ts"), "target_date", "entity_id", "pred_demand", "pred_price",
        F.lit(scorer.version).alias("model_version"), "search_index", "sentiment_index", "ad_index",
        "event_type", "event_effect_hint", "explanation_text", "shap_explanation", *labels,
    )
