"""Keyed state on Structured Streaming: streaks per segment and the last rows of each entity.

State lies in RocksDB by key and a micro-batch touches only the keys it brings, where the cycle's ``tail`` is rewritten for
all entities every day. Each key's state is a fixed number of rows. Rows of a key that come at or before its newest date
are late and left out; within a micro-batch they may come in any order and any number of files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from tidepanel.operators.features import FEATURE_LOOKBACK, feature_frame
from tidepanel.session import scratch_dir, wide_plans

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs RocksDB; a stream that is started in here has it, and the setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Streak(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("streak", "date DATE, streak BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits: dict = {}
        for part in rows:
            for day, hit in zip(part["date"], part["hit"]):
                if not pd.isna(day):
                    hits[day] = hits.get(day, False) or (not pd.isna(hit) and bool(hit))
        held = self._held.get()
        last, streak = (held[0], held[1]) if held else (None, 0)
        out = []
        for day in sorted(d for d in hits if last is None or d > last):
            streak = streak + 1 if hits[day] else 0
            out.append((*key, day, streak))
        if out:
            self._held.update((out[-1][-2], streak))
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass

    def __init__(self, segment: str) -> None:
        self.names = [segment, "date", "streak"]


def stream_streaks(rows: DataFrame, segment: str, hit: str) -> DataFrame:
    """Per segment and date of a stream: consecutive dates with a hit, up to and including it.

    A date of several rows is a hit if one of them is; a null hit is none, and rows without a date are left out.
    A micro-batch must hold a segment's dates whole: what comes later for a date that was counted is late.
    """
    asked = rows.select(segment, "date", F.col(hit).alias("hit"))
    schema = StructType([asked.schema[segment], asked.schema["date"]]).add("streak", "long")
    return asked.groupBy(segment).transformWithStateInPandas(
        _Streak(segment), outputStructType=schema, outputMode="Append", timeMode="None")


class _LastRows(StatefulProcessor):
    def __init__(self, schema: StructType, depth: int) -> None:
        self.schema, self.depth = schema, depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._ring = handle.getListState("ring", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        day = self.schema.names.index("date")
        held = [tuple(r) for r in self._ring.get()]
        last = held[-1][day] if held else None
        fresh: dict = {}
        for row in rows:
            if row[day] is not None and (last is None or row[day] > last):
                row = tuple(None if v != v else v for v in row)  # NaN is absent
                kept = fresh.get(row[day])
                # The same winner whatever the order in which a shuffle delivers.
                if kept is None or tuple(map(str, row)) > tuple(map(str, kept)):
                    fresh[row[day]] = row
        if fresh:
            new = [fresh[d] for d in sorted(fresh)]
            self._ring.put((held + new)[-self.depth:])
            named = Row(*self.schema.names, "fresh")
            yield from (named(*r, False) for r in held)
            yield from (named(*r, True) for r in new)

    def close(self) -> None:
        pass


def stream_last_rows(rows: DataFrame, depth: int = FEATURE_LOOKBACK) -> DataFrame:
    """For each entity of a micro-batch its new rows (``fresh``) behind the last ``depth`` rows before them.

    Repeated rows of a date become one, chosen by the whole row. Rows without a date are left out.
    """
    schema = rows.schema
    # Plain rows: a frame per entity would cost far more than its few rows.
    return rows.groupBy("entity_id").transformWithState(
        _LastRows(schema, depth), outputStructType=StructType([*schema.fields, StructField("fresh", BooleanType())]),
        outputMode="Append", timeMode="None")


def run_keyed(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Consume what waits into ``path``, a folder a micro-batch; a batch that is replayed overwrites itself."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = shape(batch) if shape else batch
        with wide_plans(batch.sparkSession):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with rocksdb_state(spark):
        query = stream.writeStream.foreachBatch(handle).outputMode("append").option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def stream_features(panel: DataFrame, path: str, checkpoint: str, events: DataFrame | None = None,
                    regimes: DataFrame | None = None) -> None:
    """Features of a stream's new rows, each entity's history read from its state instead of a table."""
    def shape(batch: DataFrame) -> DataFrame:
        rows = scratch_dir(batch.sparkSession, "last-rows")
        batch.write.parquet(rows)  # the state is read and moved on once, however often the rows are read
        rows = batch.sparkSession.read.schema(batch.schema).parquet(rows)
        new = rows.filter("fresh").groupBy("entity_id").agg(F.min("date").alias("_first"))
        frame = feature_frame(rows.drop("fresh"), events, regimes)
        return frame.join(new, "entity_id").filter(F.col("date") >= F.col("_first")).drop("_first")

    run_keyed(stream_last_rows(panel), path, checkpoint, shape)
