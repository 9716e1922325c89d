"""Dates, weekly and daily series, and top categories.

Everything here aggregates first; only calendar-sized or top-k-sized results are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.columns import fold_case, safe_double, steady_round, week_start


def beside(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of one-row frames next to ``base``, as scalar subqueries rather than joins."""
    out = base
    for other in others:
        row = other.select(F.struct(*other.columns).alias("row")).scalar()
        out = out.select("*", *[row[c].alias(c) for c in other.columns])
    return out


def latest_date(df: DataFrame) -> Column:
    return df.agg(F.max("date")).scalar()


def latest_two_dates(df: DataFrame) -> DataFrame:
    """One row with the latest and the previous distinct date (NULL where there is none)."""
    # Distinct dates are bounded by the calendar.
    days = df.agg(F.slice(F.sort_array(F.collect_set("date"), asc=False), 1, 2).alias("d"))
    return days.select(F.get("d", F.lit(0)).alias("latest"), F.get("d", F.lit(1)).alias("previous"))


def on_latest_date(df: DataFrame) -> DataFrame:
    return df.filter(F.col("date") == latest_date(df))


def top_categories(df: DataFrame, n: int = 3, value: str = "demand_index") -> DataFrame:
    """The ``n`` categories with the highest mean on the latest date; ``key`` is the folded name."""
    means = on_latest_date(df).groupBy("category").agg(F.avg(value).alias("mean_value"))
    return (
        means.orderBy(F.desc_nulls_last("mean_value"), "category")
        .limit(n)
        .withColumn("key", fold_case(F.col("category")))
    )


def of_top_categories(df: DataFrame, top: DataFrame) -> DataFrame:
    """Rows of the top categories under the name ``grp``; ``top`` holds a handful of rows."""
    names = F.broadcast(top.select("key", F.col("category").alias("grp")))
    return df.withColumn("key", fold_case(F.col("category"))).join(names, "key").drop("key")


def _tail_by_period(df: DataFrame, period: Column, value: Column, n: int, by: list[str]) -> DataFrame:
    means = df.filter(F.col("date").isNotNull()).groupBy(*by, period.alias("period")).agg(
        F.avg(value).alias("mean_value")
    )
    if by:
        newest = Window.partitionBy(*by).orderBy(F.desc("period"))
        tail = means.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")
    else:
        tail = means.orderBy(F.desc("period")).limit(n)
    return tail.select(*by, "period", steady_round(safe_double(F.col("mean_value")), 2).alias("value"))


def weekly_series(df: DataFrame, value: str, weeks: int = 12, by: list[str] | None = None) -> DataFrame:
    """Mean per Monday-start week, last ``weeks`` weeks that have rows."""
    return _tail_by_period(df, week_start(F.col("date")), F.col(value), weeks, by or [])


def weekly_series_by_category(
    df: DataFrame, value: str, weeks: int = 12, n: int = 3, rank_by: str = "demand_index"
) -> DataFrame:
    """Weekly series of each top category (column ``grp``)."""
    return weekly_series(of_top_categories(df, top_categories(df, n, rank_by)), value, weeks, ["grp"])


def daily_series(df: DataFrame, value: str | Column, n: int, by: list[str] | None = None) -> DataFrame:
    """Mean per day, last ``n`` days that have rows."""
    column = F.col(value) if isinstance(value, str) else value
    return _tail_by_period(df, F.col("date"), column, n, by or [])


def as_list(series: DataFrame, *fields: str) -> DataFrame:
    """One row holding a bounded series as an array, oldest first."""
    ordered = F.array_sort(F.collect_list(F.struct("period", *fields)))
    return series.agg(
        F.transform(ordered, lambda r: r[fields[0]] if len(fields) == 1 else r).alias("items")
    )
