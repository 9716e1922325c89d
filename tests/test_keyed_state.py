"""Keyed streaming state and streamed summaries against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepanel.operators.dashboard import daily_summary
from tidepanel.operators.features import feature_frame
from tidepanel.operators.policy import streaks
from tidepanel.session import scratch_dir
from tidepanel.streaming.cycle import distinct_over, stream_daily_summary
from tidepanel.streaming.keyed import run_keyed, stream_features, stream_last_rows, stream_streaks

D = dt.date(2025, 4, 1)


def _day(k):
    return D + dt.timedelta(days=k)


def _deliver(spark, folder, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ddl).parquet(folder)


def test_streaks_go_on_after_a_restart(spark):
    ddl = "segment STRING, date DATE, hit BOOLEAN, segment_1 INT"
    hits = [(s, _day(k), (k * 7 + ord(s)) % 3 > 0, k) for k in range(12) for s in "ab"] + [(None, _day(2), True, 0)]
    folder, out, check = scratch_dir(spark, "feed"), scratch_dir(spark, "out"), scratch_dir(spark, "check")
    # Out of order within a delivery; two rows without a date and one without a hit.
    first = [r for r in hits if r[1] < _day(5)][::-1] + [("a", None, True, 0), ("b", None, None, 0)]
    for rows in (first, [r for r in hits if r[1] >= _day(5)], [("a", _day(3), False, 0)], [("a", _day(12), None, 0)]):
        run_keyed(stream_streaks(_deliver(spark, folder, rows, ddl), "segment", "hit"), out, check)
    want = streaks(spark.createDataFrame(hits + [("a", _day(12), False, 0)], ddl), "hit", ["segment"], ["date"])
    got = sorted(map(str, spark.read.parquet(out).select("segment", "date", "streak").collect()))
    assert got == sorted(map(str, want.select("segment", "date", "streak").collect())) and len(got) == 26


def test_features_from_state_equal_the_batch(spark):
    ddl = "date DATE, entity_id STRING, demand_index DOUBLE, price_index DOUBLE, search_index DOUBLE"
    rows = [(_day(k), e, float((k * 13 + ord(e)) % 17), 60.0 + k % 4 if k % 5 else None, float(k))
            for k in range(25) for e in "abc" if (k + ord(e)) % 6]
    folder, out, check = scratch_dir(spark, "feed"), scratch_dir(spark, "out"), scratch_dir(spark, "check")
    for low, high in ((0, 3), (3, 4), (4, 15), (15, 25)):
        part = [r for r in rows if _day(low) <= r[0] < _day(high)]
        # A row without a date, a repeated one and a late one change nothing.
        part += [(None, "a", 1.0, 1.0, 1.0), part[0], (_day(-1), "a", 9.0, 9.0, 9.0)] if low else [part[0]]
        stream_features(_deliver(spark, folder, part, ddl), out, check)
    want = feature_frame(spark.createDataFrame(rows, ddl))
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == len(rows)


def test_state_of_a_key_is_bounded(spark):
    ddl = "date DATE, entity_id STRING, demand_index DOUBLE"
    folder, out, check = scratch_dir(spark, "feed"), scratch_dir(spark, "out"), scratch_dir(spark, "check")
    for low in (0, 20, 30):
        rows = [(_day(k), "a", float(k)) for k in range(low, 30 if low == 20 else low + 20)]
        run_keyed(stream_last_rows(_deliver(spark, folder, rows, ddl), 3), out, check)
    got = spark.read.parquet(out)
    assert got.filter("fresh").count() == 50
    assert sorted(r.demand_index for r in got.filter("NOT fresh").collect()) == [17.0, 18.0, 19.0, 27.0, 28.0, 29.0]


@pytest.fixture(scope="module")
def summary(spark):
    ddl = "date DATE, entity_id STRING, demand_index DOUBLE, price_index DOUBLE, search_index DOUBLE, ad_index DOUBLE, sentiment_index DOUBLE, event_type STRING"
    day = "(id % 14)"
    rows = spark.range(42000).selectExpr(
        f"date_add(DATE'2025-03-31', CAST({day} AS INT)) AS date", "concat('e', id % 9001) AS entity_id",
        "CAST(id % 100 AS DOUBLE) AS demand_index", "IF(id % 3 = 0, NULL, 1.0D * id) AS price_index", "1.0D AS search_index",
        "CAST(NULL AS DOUBLE) AS ad_index", "0.5D AS sentiment_index", "IF(id % 7 = 0, 'promo', IF(id % 7 = 1, 'organic', NULL)) AS event_type")
    folder, out, check = scratch_dir(spark, "feed"), scratch_dir(spark, "out"), scratch_dir(spark, "check")
    late = (F.col("date") == F.lit("2025-04-05").cast("date")) & (F.col("entity_id") > "e5")
    closing = spark.createDataFrame([(dt.date(2025, 5, 1),)], "date DATE")
    parts = [rows.filter(f"date <= DATE'2025-04-06'").filter(~late), rows.filter(late | F.expr("date > DATE'2025-04-06'")),
             closing.unionByName(rows.limit(0), allowMissingColumns=True)]
    for part in parts:  # a part of a date comes a delivery late, within the watermark
        part.select(*rows.columns).coalesce(1).write.mode("append").parquet(folder)
        stream_daily_summary(spark.readStream.schema(ddl).parquet(folder), "2 days").writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return rows, spark.read.parquet(out)


def test_streamed_summary_counts_exactly_with_late_rows(summary):
    rows, streamed = summary
    want = daily_summary(rows)
    got = streamed.select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 14


def test_sketches_merge_over_weeks(summary):
    rows, streamed = summary
    want = {r.start: r.n for r in rows.groupBy(F.date_trunc("week", "date").cast("date").alias("start")).agg(
        F.countDistinct("entity_id").alias("n")).collect()}
    got = {r.start: r.product_count for r in distinct_over(streamed).collect()}
    assert set(got) == set(want) == {dt.date(2025, 3, 31), dt.date(2025, 4, 7)}
    assert all(abs(got[k] - n) <= 0.05 * n for k, n in want.items()) and min(want.values()) > 6000
