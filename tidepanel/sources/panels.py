"""Adapters from the retail and activity tables to the panel data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def retail_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part and ship date.

    Line items collapse to part-days before the part attributes are attached, so the join
    carries the small side of the aggregation.
    """
    days = (
        table(spark, folder, "lineitem")
        .groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.sum("l_quantity").alias("demand_index"),
            F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_index"),
            F.avg("l_discount").alias("discount_pct"),
            (100 * F.avg("l_tax")).alias("ad_index"),
            F.count("*").cast("double").alias("search_index"),
            F.avg(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0)).alias("sentiment_index"),
            F.when(F.max("l_discount") >= 0.09, "promotion").otherwise("organic").alias("event_type"),
        )
    )
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return days.join(part, days.l_partkey == part.p_partkey).select(
        "date",
        F.col("l_partkey").cast("string").alias("entity_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        "demand_index", "price_index", "discount_pct", "ad_index",
        "search_index", "sentiment_index", "event_type",
    )


def activity_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user and day of the event stream."""
    events = table(spark, folder, "events")
    kind = F.col("event_type")
    mood = F.when(kind == "purchase", 1.0).when(kind == "error", 0.0).otherwise(0.5)
    days = events.groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(
        F.count("*").cast("double").alias("demand_index"),
        F.avg("value").alias("price_index"),
        F.count_if(kind == "view").cast("double").alias("search_index"),
        F.count_if(kind == "click").cast("double").alias("ad_index"),
        F.avg(mood).alias("sentiment_index"),
        F.count_if(kind == "signup").cast("double").alias("new_reviews"),
    )
    return days.select(
        "date",
        F.col("user_id").cast("string").alias("entity_id"),
        F.concat(F.lit("g"), F.col("user_id") % 25).alias("brand"),
        F.concat(F.lit("c"), F.col("user_id") % 6).alias("category"),
        "demand_index", "price_index", "search_index", "ad_index", "sentiment_index", "new_reviews",
    )


def interventions(spark: SparkSession, folder: str) -> DataFrame:
    """Dated interventions: errors and signups of high value, some of them for every entity."""
    events = table(spark, folder, "events").filter(
        F.col("event_type").isin("error", "signup") & (F.col("value") > 100)
    )
    user = F.col("user_id")
    every = F.col("event_id") % 50 == 0
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_id").alias("_seq"),
        F.col("ts").cast("date").alias("date"),
        F.when(every, "ALL").otherwise(user.cast("string")).alias("entity_id"),
        "event_type",
        F.concat(F.lit("g"), user % 25).alias("brand"),
        F.concat(F.lit("c"), user % 6).alias("category"),
        F.concat(F.col("event_type"), F.lit(" #"), F.col("event_id")).alias("event_title"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("story of "), F.col("event_type"))
        ).alias("signal_story"),
        F.concat(F.lit("event "), F.col("event_id")).alias("event_description"),
        F.when(every, "global").otherwise("entity").alias("event_scope"),
        F.when(F.col("event_id") % 2 == 0, "demand_index").otherwise("price_index").alias("signal_target"),
        (F.col("value") / 500).alias("event_strength"),
        (F.col("value") / 500).alias("event_intensity_score"),
        F.when(F.col("event_type") == "error", "negative").otherwise("positive").alias("impact_direction"),
    )


def regime_shifts(panel: DataFrame) -> DataFrame:
    """Days at or above twice the entity's mean demand."""
    mean = F.avg("demand_index").over(Window.partitionBy("entity_id"))
    return (
        panel.select("entity_id", "date", "demand_index", mean.alias("_mean"))
        .filter(F.col("demand_index") >= 2 * F.col("_mean"))
        .select(
            "entity_id", "date",
            F.lit(1.0).alias("change_point"),
            (F.col("demand_index") / F.col("_mean")).alias("shift_strength"),
            F.when(F.col("demand_index") >= 3 * F.col("_mean"), "spike").alias("regime_type"),
        )
    )


def reference_forecasts(panel: DataFrame) -> DataFrame:
    """Two exact forecasters, both priced at the previous row: last demand and mean of seven rows."""
    by_day = Window.partitionBy("entity_id").orderBy("date")
    scored = panel.select(
        "entity_id", F.col("date").alias("target_date"),
        F.lag("demand_index").over(by_day).alias("naive_lag1"),
        F.avg("demand_index").over(by_day.rowsBetween(-7, -1)).alias("mean_7"),
        F.lag("price_index").over(by_day).alias("pred_price"),
    )
    return scored.unpivot(
        ["entity_id", "target_date", "pred_price"], ["naive_lag1", "mean_7"], "model_version", "pred_demand"
    )
