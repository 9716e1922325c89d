"""Which event most likely explains a date, and why a forecast looks as it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.columns import day_number, first_present, lenient_date, lenient_double, safe_double
from tidepanel.operators.dedup import keep_first
from tidepanel.sources import schemas as S

# Reach, default strength and the limits of the reason rules.
LOOKBACK_DAYS = 5
DEFAULT_STRENGTH = 0.5
REASON_SEPARATOR = " | "
HIGH_SEARCH = 45
GOOD_SENTIMENT = 0.6
WEAK_SENTIMENT = 0.5
STRONG_ADS = 5
LOW_PRICE = 80
_BEST = ("_preferred", "_strength", "_date", "_id")


def _event_record(events: DataFrame) -> list[Column]:
    def text(*names: str) -> Column:
        found = next((n for n in names if n in events.columns), None)
        return F.col(found).cast("string") if found else F.lit(None).cast("string")

    return [
        text("event_id").alias("event_id"),
        F.col("_date").alias("event_date"),
        text("event_type").alias("event_type"),
        text("event_title", "event_name").alias("event_title"),
        text("event_description", "notes").alias("event_description"),
        text("event_scope").alias("event_scope"),
        text("signal_target").alias("signal_target"),
        F.col("_strength").alias("event_strength"),
        text("impact_direction").alias("impact_direction"),
        text("signal_story").alias("signal_story"),
        text("priority").alias("priority"),
        text("notes").alias("notes"),
    ]


def _best_per_day(events: DataFrame, signal_target: str | None) -> DataFrame:
    """The strongest event of each (entity, day), preferring the wanted signal.

    ``_best`` compares as (matches signal, strength, date, id), so its maximum over any span is
    the winner of that span and the span can be reduced in any order.
    """
    preferred = F.lit(False)
    if signal_target and "signal_target" in events.columns:
        preferred = F.coalesce(F.col("signal_target") == signal_target, F.lit(False))
    strength = (
        F.coalesce(lenient_double(F.col("event_strength")), F.lit(DEFAULT_STRENGTH))
        if "event_strength" in events.columns else F.lit(DEFAULT_STRENGTH)
    )
    entity = first_present(events, S.ENTITY_ALIASES)
    date = lenient_date(first_present(events, S.EVENT_DATE_ALIASES))
    ready = events.select(
        "*", entity.cast("string").alias("_entity"), date.alias("_date"),
        preferred.alias("_preferred"), strength.alias("_strength"),
        (F.col("event_id").cast("string") if "event_id" in events.columns else F.lit(None).cast("string")).alias("_id"),
    ).filter(F.col("_entity").isNotNull() & F.col("_date").isNotNull())
    best = F.struct(*_BEST, F.struct(*_event_record(ready)).alias("event"))
    return ready.groupBy("_entity", "_date").agg(F.max(best).alias("_best"))


def attribute_events(
    requests: DataFrame,
    events: DataFrame,
    signal_target: str | None = None,
    lookback_days: int = LOOKBACK_DAYS,
    date: str = "target_date",
) -> DataFrame:
    """``likely_event`` for every request row: the best event of the entity, or of all entities,
    in the ``lookback_days`` up to the date.

    Events shrink to one per (entity, day) and meet the requests in a day-range frame, so no pair
    of request and event is ever formed. Events for every entity shrink to one row per calendar
    day, which is what bounds their broadcast.
    """
    per_day = _best_per_day(events, signal_target)
    asked = requests.select(
        F.col("entity_id").alias("_entity"), F.col(date).alias("_date"),
        F.struct(*requests.columns).alias("_request"),
    )
    own = per_day.filter(F.col("_entity") != S.EVERY_ENTITY)
    line = asked.unionByName(own, allowMissingColumns=True).withColumn("_day", day_number(F.col("_date")))
    reach = Window.partitionBy("_entity").orderBy("_day").rangeBetween(-lookback_days, 0)
    answered = line.withColumn("_own", F.max("_best").over(reach)).filter(F.col("_request").isNotNull())
    shared = (
        per_day.filter(F.col("_entity") == S.EVERY_ENTITY)
        .select(
            F.explode(F.transform(
                F.sequence(F.lit(0), F.lit(lookback_days)), lambda k: F.date_add("_date", k)
            )).alias("_date"),
            "_best",
        )
        .groupBy("_date").agg(F.max("_best").alias("_shared"))
    )
    both = answered.join(F.broadcast(shared), "_date", "left")
    winner = F.greatest(F.col("_own"), F.col("_shared"))
    return both.select("_request.*", winner["event"].alias("likely_event"))


def explain_forecasts(
    predictions: DataFrame,
    events: DataFrame,
    entity_id: str | None = None,
    target_date: str | None = None,
    signal_target: str = S.TARGET,
    lookback_days: int = LOOKBACK_DAYS,
) -> DataFrame:
    """Forecasts of the latest target date with the likely event of each."""
    last = predictions.agg(F.max("target_date")).scalar()
    rows = predictions.filter(F.col("target_date") == last)
    if entity_id is not None:
        rows = rows.filter(F.col("entity_id") == entity_id)
    if target_date is not None:
        rows = rows.filter(F.col("target_date") == F.lit(target_date).cast("date"))
    wanted = ["entity_id", "target_date", "pred_demand", "pred_price", "model_version",
              "explanation_text", "shap_explanation"]
    shown = rows.select(*[
        F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in wanted
    ])
    return attribute_events(shown, events, signal_target, lookback_days)


def reason_text(
    search: Column, sentiment: Column, ads: Column, event_type: Column, price: Column
) -> Column:
    """Rule-based reasons joined with a bar; ``concat_ws`` skips rules that do not fire."""
    kind = F.coalesce(event_type, F.lit("organic"))
    reasons = F.concat_ws(
        REASON_SEPARATOR,
        F.when(search > HIGH_SEARCH, F.format_string("High search interest (%.1f)", search.cast("double"))),
        F.when(sentiment > GOOD_SENTIMENT, "Positive sentiment trend").when(
            sentiment < WEAK_SENTIMENT, "Weak sentiment affecting demand"
        ),
        F.when(ads > STRONG_ADS, "Strong ad campaign influence"),
        F.when((kind != "organic") & (kind != ""), F.concat(F.lit("Event impact: "), kind)),
        F.when(price < LOW_PRICE, "Competitive pricing boosting demand"),
    )
    return F.when(reasons == "", "Stable organic demand").otherwise(reasons)


def attach_context(forecasts: DataFrame, batch: DataFrame, dated: bool = False) -> DataFrame:
    """Carry the batch's price (as predicted price), signals, event and labels onto forecasts.

    ``dated`` takes a batch of several dates: a forecast gets the rows of the day before its target.
    """
    texts = ["event_type", "event_effect_hint"]
    labels = [c for c in ("brand", "product_name", "category") if c in batch.columns]
    order = [c for c in ("date", "_seq") if c in batch.columns]
    context = keep_first(
        batch.select(
            "entity_id", *order, F.col("price_index").alias("pred_price"),
            "search_index", "sentiment_index", "ad_index",
            *[(F.col(t) if t in batch.columns else F.lit(None).cast("string")).alias(t) for t in texts], *labels,
        ),
        ["entity_id", "date"] if dated else ["entity_id"], order,
    )
    keys = ["entity_id"]
    if dated:
        keys, context = [*keys, "target_date"], context.withColumn("target_date", F.date_add("date", 1))
    joined = forecasts.drop("pred_price", *labels).join(context.drop("date", "_seq"), keys, "left")
    return joined.select(
        *[c for c in joined.columns if c not in ("pred_price", "pred_demand")],
        safe_double(F.col("pred_price")).alias("pred_price"),
        safe_double(F.col("pred_demand")).alias("pred_demand"),
    )


def with_reasons(forecasts: DataFrame) -> DataFrame:
    return forecasts.withColumn(
        "explanation_text",
        reason_text(
            F.col("search_index"), F.col("sentiment_index"), F.col("ad_index"),
            F.col("event_type"), F.col("pred_price"),
        ),
    )
