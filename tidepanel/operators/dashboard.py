"""Dashboard aggregates. Each function is one plan that ends in a bounded result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.columns import fold_case, pct_change, safe_double, scale_100, steady_round, title_case
from tidepanel.operators.dedup import latest_dimension
from tidepanel.operators.normalize import filter_category
from tidepanel.operators.series import (
    as_list, beside, daily_series, latest_date, latest_two_dates, of_top_categories, on_latest_date,
    top_categories, weekly_series, weekly_series_by_category,
)
from tidepanel.sources import schemas as S

# Weights of the composite score and the sizes of the panels.
SCORE_WEIGHTS = {"demand": 0.35, "sentiment": 0.25, "search": 0.20, "ad": 0.10, "price": 0.10}
SCATTER_BRANDS = 14
RADAR_BRANDS = 3
TREND_BRANDS = 3
TREND_DAYS = 13
COMPETITORS = 12
COMPETITOR_DAYS = 12
BUZZ_DAYS = 56
SPARKLINE_DAYS = 24
LATEST_EVENTS = 6
LATEST_REGIMES = 12
PRICE_CHANGE_DAYS = 30
LABEL_FORMAT = "MMM d"


def _mean(name: str, where: Column | None = None) -> Column:
    return F.avg(F.col(name) if where is None else F.when(where, F.col(name)))


# ---- daily summary --------------------------------------------------------------------------------


def daily_summary(batch: DataFrame) -> DataFrame:
    """Per date: means of the five signals, distinct entities, rows with a non-organic event."""
    kind = F.coalesce(F.col("event_type"), F.lit("organic")) if "event_type" in batch.columns else F.lit("organic")
    return batch.groupBy("date").agg(
        *[F.avg(m).alias(f"avg_{m}") for m in S.FEED_MEASURES],
        F.countDistinct("entity_id").alias("product_count"),
        F.count_if(kind != "organic").alias("event_count"),
    )


# ---- headline numbers -------------------------------------------------------------------------------


def _totals(panel: DataFrame, alerts: DataFrame | None) -> DataFrame:
    totals = panel.agg(
        F.countDistinct("brand").alias("total_brands"),
        F.countDistinct("entity_id").alias("total_entities"),
        F.count("*").alias("total_rows"),
    )
    if alerts is None:
        return totals.withColumn("total_alerts", F.lit(0).cast("bigint"))
    return beside(totals, alerts.agg(F.count("*").alias("total_alerts")))


def kpis(panel: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Latest-date means and their change against the previous date, with panel-wide counts."""
    dates = latest_two_dates(panel)
    span = dates.select(F.struct("latest", "previous").alias("d")).scalar()
    today = F.col("date") == span["latest"]
    before = F.col("date") == span["previous"]
    means = panel.filter(today | before).agg(
        *[_mean(f"{m}_index", today).alias(m) for m in ("demand", "price", "sentiment")],
        *[_mean(f"{m}_index", before).alias(f"prev_{m}") for m in ("demand", "price", "sentiment")],
    )
    shown = means.select(
        steady_round(safe_double(F.col("demand")), 1).alias("demand"),
        steady_round(safe_double(F.col("price")), 2).alias("price"),
        steady_round(safe_double(F.col("sentiment")) * 100.0, 1).alias("sentiment"),
        "prev_demand", "prev_price", "prev_sentiment",
    )
    prev_sent = F.coalesce(F.col("prev_sentiment") * 100.0, F.col("sentiment"))
    changes = shown.select(
        "demand", pct_change(F.col("demand"), F.col("prev_demand")).alias("demand_chg"),
        "price", pct_change(F.col("price"), F.col("prev_price")).alias("price_chg"),
        "sentiment", steady_round(F.col("sentiment") - prev_sent, 1).alias("sent_chg"),
    )
    return beside(changes, _totals(panel, alerts)).withColumnsRenamed(
        {"total_brands": "active_brands", "total_entities": "active_entities"}
    )


def kpis_by_category(panel: DataFrame) -> DataFrame:
    return on_latest_date(panel).groupBy("category").agg(
        steady_round(safe_double(_mean("demand_index")), 1).alias("demand"),
        steady_round(safe_double(_mean("price_index")), 1).alias("price"),
        steady_round(safe_double(_mean("sentiment_index")) * 100.0, 1).alias("sentiment"),
        F.countDistinct("entity_id").alias("count"),
    )


# ---- rankings --------------------------------------------------------------------------------------


def _ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """Best ``k`` rows per group; Spark trims each task's input to ``k`` before shuffling."""
    spec = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(spec)).filter(F.col(name) <= k)


def scatter(panel: DataFrame, n_categories: int = 3, brands: int = SCATTER_BRANDS) -> DataFrame:
    """Mean price and demand of the leading brands, overall and per top category, in one pass."""
    latest = on_latest_date(panel).withColumn("key", fold_case(F.col("category")))
    means = latest.groupingSets([["brand"], ["key", "brand"]], "key", "brand").agg(
        F.grouping("key").alias("overall"),
        F.avg("price_index").alias("x"), F.avg("demand_index").alias("y"),
    )
    top = top_categories(panel, n_categories).select("key", F.col("category").alias("grp"))
    groups = F.broadcast(top.unionByName(panel.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("key"), F.lit("all").alias("grp")
    )).withColumn("overall", F.col("key").isNull().cast("tinyint")))
    grouped = means.alias("m").join(
        groups.alias("g"), (F.col("m.overall") == F.col("g.overall")) & F.col("m.key").eqNullSafe(F.col("g.key"))
    ).select("grp", "brand", "x", "y")
    best = _ranked(grouped, ["grp"], [F.desc_nulls_last("y"), F.asc("brand")], brands, "pos")
    return best.select(
        "grp", "pos", F.col("brand").alias("label"),
        steady_round(safe_double(F.col("x")), 1).alias("x"), steady_round(safe_double(F.col("y")), 1).alias("y"),
    )


_SCORE_SOURCES = {
    "demand": "demand_index", "sentiment": "sentiment_index", "search": "search_index",
    "ad": "ad_index", "price": "price_index",
}


def _scored(means: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Composite score from five means scaled to 0..100 within the group, low price counting as high."""
    bounds = means.groupBy(*group).agg(
        *[F.min(m).alias(f"{m}_lo") for m in SCORE_WEIGHTS], *[F.max(m).alias(f"{m}_hi") for m in SCORE_WEIGHTS]
    )
    # One row per group; callers group by nothing or by a few top categories.
    ranged = means.join(F.broadcast(bounds), list(group)) if group else beside(means, bounds)
    scaled = {m: scale_100(F.col(m), F.col(f"{m}_lo"), F.col(f"{m}_hi")) for m in SCORE_WEIGHTS}
    scaled["price"] = 100.0 - scaled["price"]
    out = ranged.select(*means.columns, *[c.alias(f"{m}_n") for m, c in scaled.items()])
    parts = [F.col(f"{m}_n") * w for m, w in SCORE_WEIGHTS.items()]
    return out.withColumn("score", parts[0] + parts[1] + parts[2] + parts[3] + parts[4])


def _radar_of(rows: DataFrame, k: int) -> DataFrame:
    means = rows.groupBy("grp", "brand").agg(*[F.avg(c).alias(m) for m, c in _SCORE_SOURCES.items()])
    best = _ranked(_scored(means, ["grp"]), ["grp"], [F.desc_nulls_last("score"), F.asc("brand")], k, "pos")
    return best.select(
        "grp", "pos", "brand", *[steady_round(safe_double(F.col(f"{m}_n")), 1).alias(f"{m}_n") for m in SCORE_WEIGHTS]
    )


def radar(panel: DataFrame, category: str = "all", k: int = RADAR_BRANDS) -> DataFrame:
    """Top brands by composite score on the latest date, with their five scaled means."""
    rows = on_latest_date(filter_category(panel, category))
    means = rows.groupBy("brand").agg(*[F.avg(c).alias(m) for m, c in _SCORE_SOURCES.items()])
    shown = [steady_round(safe_double(F.col(f"{m}_n")), 1).alias(f"{m}_n") for m in SCORE_WEIGHTS]
    best = (
        _scored(means).orderBy(F.desc_nulls_last("score"), "brand").limit(k)
        .select((-F.col("score")).alias("_order"), "brand", *shown)
    )
    placed = best.agg(F.array_sort(F.collect_list(F.struct(*best.columns))).alias("_best"))
    return placed.select(F.posexplode("_best").alias("_i", "_row")).select(
        F.lit(category).alias("grp"), (F.col("_i") + 1).alias("pos"), "_row.brand",
        *[f"_row.{m}_n" for m in SCORE_WEIGHTS],
    )


def _own_latest(panel: DataFrame, n_categories: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the top categories, and those on each category's own latest date."""
    rows = of_top_categories(panel, top_categories(panel, n_categories))
    last = rows.groupBy("grp").agg(F.max("date").alias("date"))
    return rows, rows.join(F.broadcast(last), ["grp", "date"])


def radar_by_category(panel: DataFrame, n_categories: int = 3, k: int = RADAR_BRANDS) -> DataFrame:
    return _radar_of(_own_latest(panel, n_categories)[1], k)


def trends(
    panel: DataFrame, n_categories: int = 3, brands: int = TREND_BRANDS, days: int = TREND_DAYS
) -> DataFrame:
    """Per top category, the leading brands by latest demand and the daily means of each."""
    rows, latest = _own_latest(panel, n_categories)
    means = latest.groupBy("grp", "brand").agg(F.avg("demand_index").alias("mean_value"))
    best = _ranked(means, ["grp"], [F.desc_nulls_last("mean_value"), F.asc("brand")], brands, "pos")
    chosen = F.broadcast(best.select("grp", "brand", "pos"))
    return daily_series(rows.join(chosen, ["grp", "brand"]), "demand_index", days, ["grp", "pos", "brand"])


def competitors(panel: DataFrame, k: int = COMPETITORS, days: int = COMPETITOR_DAYS) -> DataFrame:
    """Leading entities by composite score, each with its recent daily price and sentiment."""
    ids = ["entity_id", "brand", "product_name", "category"]
    means = on_latest_date(panel).groupBy(*ids).agg(*[F.avg(c).alias(m) for m, c in _SCORE_SOURCES.items()])
    scored = _scored(means).withColumn("score", steady_round(F.col("score"), 1))
    top = scored.orderBy(F.desc_nulls_last("score"), "entity_id").limit(k).select(
        "entity_id", F.col("brand").alias("name"), F.col("product_name").alias("product"),
        title_case(F.col("category")).alias("cat"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        steady_round(safe_double(F.col("price")), 1).alias("price"),
        steady_round(safe_double(F.col("sentiment")) * 100.0, 1).alias("sent"),
        steady_round(safe_double(F.col("demand")), 1).alias("demand"),
    )
    daily = (
        panel.join(F.broadcast(top.select("entity_id")), "entity_id")
        .groupBy("entity_id", "date")
        .agg(F.avg("price_index").alias("p"), F.avg("sentiment_index").alias("s"))
    )
    recent = _ranked(daily, ["entity_id"], [F.desc("date")], days, "_n")
    point = F.struct(
        "date", steady_round(safe_double(F.col("p")), 2).alias("p"), steady_round(safe_double(F.col("s") * 100.0), 1).alias("s")
    )
    history = recent.groupBy("entity_id").agg(F.array_sort(F.collect_list(point)).alias("h")).select(
        "entity_id",
        F.transform("h", lambda r: r["p"]).alias("price_history"),
        F.transform("h", lambda r: r["s"]).alias("sent_history"),
    )
    return top.join(F.broadcast(history), "entity_id", "left")


# ---- forecasts, events, regimes ---------------------------------------------------------------------


def next_days(
    fva: DataFrame, forecast: DataFrame | None = None, days: int = 7, category: str = "all"
) -> DataFrame:
    """Mean actual and predicted demand of the last days; forecasts alone where nothing was compared."""
    compared = filter_category(fva, category).groupBy("date").agg(
        F.avg("actual_demand").alias("actual"), F.avg("pred_demand").alias("predicted")
    )
    tail = compared.orderBy(F.desc("date")).limit(days).select(
        "date", steady_round(safe_double(F.col("actual")), 2).alias("actual"),
        steady_round(safe_double(F.col("predicted")), 2).alias("predicted"),
    )
    if forecast is not None:
        ahead = filter_category(forecast, category).groupBy(F.col("target_date").alias("date")).agg(
            F.avg("pred_demand").alias("predicted")
        )
        none_compared = tail.agg(F.count("*") == 0).scalar()
        only = ahead.orderBy(F.desc("date")).limit(days).filter(none_compared).select(
            "date", F.lit(None).cast("double").alias("actual"),
            steady_round(safe_double(F.col("predicted")), 2).alias("predicted"),
        )
        tail = tail.unionByName(only)
    return tail.select("date", F.date_format("date", LABEL_FORMAT).alias("label"), "actual", "predicted")


def with_category(fva: DataFrame, panel: DataFrame) -> DataFrame:
    """Latest brand, product and category of each entity beside its rows."""
    labels = latest_dimension(panel, ["brand", "product_name", "category"])
    return fva.join(labels, "entity_id", "left")


def buzz(panel: DataFrame, category: str = "all", days: int = BUZZ_DAYS) -> DataFrame:
    """Daily buzz score; without any score, search plus eight times ads, scaled to 0..100."""
    rows = filter_category(panel, category)

    def given(name: str) -> Column:
        return safe_double(F.col(name)) if name in rows.columns else F.lit(0.0)

    proxied = rows.withColumn("_proxy", given("search_index") + 8.0 * given("ad_index"))
    span = proxied.agg(F.struct(F.min("_proxy").alias("lo"), F.max("_proxy").alias("hi")).alias("s")).scalar()
    proxy = scale_100(F.col("_proxy"), span["lo"], span["hi"])
    if "buzz_score" not in rows.columns:
        return daily_series(proxied, proxy, days)
    scored = rows.agg(F.count("buzz_score") > 0).scalar()
    return daily_series(proxied, F.when(scored, F.col("buzz_score")).otherwise(proxy), days)


def category_sparkline(panel: DataFrame, category: str, days: int = SPARKLINE_DAYS) -> DataFrame:
    return daily_series(filter_category(panel, category), "demand_index", days)


def latest_events(events: DataFrame, category: str = "all", n: int = LATEST_EVENTS) -> DataFrame:
    """Newest events with the story, or the description where no story column exists."""
    rows = filter_category(events, category)
    story = F.col("signal_story") if "signal_story" in rows.columns else None
    text = F.col("event_description") if "event_description" in rows.columns else F.lit("")
    ties = [F.desc(c) for c in ("_seq", "event_id") if c in rows.columns]
    brand = F.col("brand") if "brand" in rows.columns else F.lit("")
    cat = fold_case(F.col("category")) if "category" in rows.columns else F.lit("")
    return rows.orderBy(F.desc_nulls_last("date"), *ties).limit(n).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), brand.alias("brand"), cat.alias("cat"),
        (F.coalesce(story, text) if story is not None else text).alias("explanation"),
    )


def latest_regimes(
    regimes: DataFrame, n: int = LATEST_REGIMES, order: Sequence[str] = ("date", "entity_id")
) -> DataFrame:
    """The last regimes in stored order (``_seq``, else ``order``) with the first type column that says something."""
    kinds = [F.nullif(F.col(c), F.lit("")) for c in S.REGIME_TYPE_COLUMNS if c in regimes.columns]
    stored = ["_seq", *order] if "_seq" in regimes.columns else order
    return regimes.orderBy(*[F.desc_nulls_last(c) for c in stored]).limit(n).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        *[c for c in order if c != "date"],
        F.coalesce(*kinds, F.lit("neutral")).alias("regime_type"),
    )


def filter_values(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Selectable values as (field, value) rows: ids, categories, event types, first and last date."""
    def distinct(df: DataFrame, column: str, field: str) -> DataFrame:
        return (
            df.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull())
            .distinct().select(F.lit(field).alias("field"), "value")
        )

    span = panel.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    dates = span.select(
        F.date_format("date_min", "yyyy-MM-dd").alias("date_min"),
        F.date_format("date_max", "yyyy-MM-dd").alias("date_max"),
    ).unpivot([], ["date_min", "date_max"], "field", "value")
    return (
        distinct(panel, "entity_id", "entity_id")
        .unionByName(distinct(panel, "category", "category"))
        .unionByName(distinct(events, "event_type", "event_type"))
        .unionByName(dates)
    )


# ---- report and bundle -----------------------------------------------------------------------------


def report(
    panel: DataFrame, alerts: DataFrame | None = None, spotlight: str = "headphones"
) -> DataFrame:
    """One-row summary. ``best_brand_health`` is the highest demand score among the leading brands."""
    cats = on_latest_date(panel).groupBy("category").agg(
        F.avg("demand_index").alias("d"), F.avg("sentiment_index").alias("s")
    )
    lead = cats.orderBy(F.desc_nulls_last("d"), "category").limit(1).agg(
        F.max(title_case(F.col("category"))).alias("top_cat"),
        steady_round(safe_double(F.max("d")), 1).alias("top_cat_demand"),
        steady_round(safe_double(F.max("s")) * 100.0, 1).alias("top_cat_sent"),
    )
    best = radar(panel).agg(
        F.max(F.when(F.col("pos") == 1, F.col("brand"))).alias("best_brand"),
        steady_round(F.coalesce(F.max("demand_n"), F.lit(0.0)), 1).alias("best_brand_health"),
    )
    cut = F.date_sub(latest_date(panel), PRICE_CHANGE_DAYS - 1)
    daily = panel.filter(F.col("date") >= cut).groupBy("date").agg(F.avg("price_index").alias("p"))
    ends = daily.agg(
        safe_double(F.min_by("p", "date")).alias("first"), safe_double(F.max_by("p", "date")).alias("last")
    )
    price = ends.select(pct_change(F.col("last"), F.col("first")).alias("price_30d_chg"))
    spot = on_latest_date(filter_category(panel, spotlight)).agg(
        steady_round(safe_double(F.avg("sentiment_index")) * 100.0, 1).alias("spotlight_sent")
    )
    return beside(lead, best, price, spot, _totals(panel, alerts).drop("total_rows"))


def _rows_list(df: DataFrame, *order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in order]
    return df.agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("items"))


def bundle(
    panel: DataFrame,
    fva: DataFrame,
    events: DataFrame,
    regimes: DataFrame,
    alerts: DataFrame | None = None,
    forecast: DataFrame | None = None,
    category: str = "all",
    weeks: int = 12,
    days: int = 7,
    sparklines: Sequence[str] = ("earbuds", "smartphones"),
    spotlight: str = "headphones",
) -> DataFrame:
    """Every dashboard block as one nested row; each field is a bounded scalar subquery."""
    labelled = with_category(fva, panel)
    chosen, chosen_fva = filter_category(panel, category), filter_category(labelled, category)
    blocks = {
        "kpis": kpis(panel, alerts),
        "w12": as_list(weekly_series(chosen, "demand_index", weeks), "value"),
        "w12_pred": as_list(weekly_series(chosen_fva, "pred_demand", weeks), "value"),
        "w12_by_cat": _rows_list(weekly_series_by_category(panel, "demand_index", weeks), "grp", "period"),
        "w12_by_cat_pred": _rows_list(
            weekly_series_by_category(labelled, "pred_demand", weeks, rank_by="actual_demand"), "grp", "period"
        ),
        "next_days": _rows_list(next_days(labelled, forecast, days, category), "date"),
        "kpis_by_cat": _rows_list(kpis_by_category(panel), "category"),
        "scatter": _rows_list(scatter(panel), "grp", "pos"),
        "radar": _rows_list(radar(panel), "grp", "pos"),
        "radar_by_cat": _rows_list(radar_by_category(panel), "grp", "pos"),
        "trends_data": _rows_list(trends(panel), "grp", "pos", "period"),
        "competitors": _rows_list(competitors(panel).withColumn("_k", -F.col("score")), "_k", "entity_id"),
        "events": _rows_list(latest_events(events, category)),
        "buzz": as_list(buzz(panel), "value"),
        **{f"sparkline_{c}": as_list(category_sparkline(panel, c), "value") for c in sparklines},
        "regime": _rows_list(latest_regimes(regimes), "date"),
        "report": report(panel, alerts, spotlight),
    }
    fields = []
    for name, block in blocks.items():
        only = block.columns == ["items"]
        value = block if only else block.select(F.struct(*block.columns).alias("items"))
        fields.append(value.scalar().alias(name))
    return panel.sparkSession.range(1).select(*fields)
