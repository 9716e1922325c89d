"""Exact quantiles without gathering a group in one place.

``percentile`` keeps every distinct value of a group in one task's memory. Here a sketch first
brackets each wanted rank; everything outside the brackets collapses to one row per gap, so only
the few values inside travel, already counted per distinct value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.session import scratch_dir, wide_plans

SKETCH_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = SKETCH_ACCURACY,
    bounded_groups: bool = False,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``.

    ``also`` names further aggregates of ``value`` (written on the column ``_v``) that ride along
    in the sketch pass.

    ``bounded_groups`` says the number of groups is small by construction (for example one per
    feature column), which lets the bracket table be broadcast to the rows.
    """
    rows = df.select(*group, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    margin = 3.0 / accuracy
    edges = [e for p in probs.values() for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    extras = also or {}
    sketch = rows.groupBy(*group).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", edges, accuracy).alias("_e"),
        *[c.alias(f"_x_{n}") for n, c in extras.items()],
    )
    # One value per group: carried as plain numbers, so the aggregations below stay hashed.
    constant = ["_n", *[f"_x_{n}" for n in extras]]
    joined = rows.join(F.broadcast(sketch) if bounded_groups else sketch, list(group))

    def passed(offset: int, strict: bool) -> Column:
        marks = [F.col("_e")[i] for i in range(offset, len(edges), 2)]
        hits = [(m < F.col("_v") if strict else m <= F.col("_v")).cast("int") for m in marks]
        return reduce(lambda a, b: a + b, hits)

    opened, closed = passed(0, strict=False), passed(1, strict=True)
    # Both counts grow with the value, so their sum orders gaps and brackets alike.
    placed = joined.select(
        *group, *constant, "_v", (opened + closed).alias("_zone"),
        F.when(opened > closed, F.col("_v")).alias("_inside"),
    )
    piles = placed.groupBy(*group, "_zone", "_inside").agg(
        F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        *[F.any_value(c).alias(c) for c in constant],
    )
    upward = Window.partitionBy(*group).orderBy("_zone", "_lo")
    piles = piles.withColumn(
        "_upto", F.sum("_c").over(upward.rowsBetween(Window.unboundedPreceding, 0))
    )

    def at(rank: Column) -> Column:
        first, last = F.col("_upto") - F.col("_c") + 1, F.col("_upto")
        return F.max(F.when(rank == first, F.col("_lo")).when(rank == last, F.col("_hi")).when(
            (rank > first) & (rank < last) & (F.col("_lo") == F.col("_hi")), F.col("_lo")
        ))

    aggs = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [at(F.floor(place) + 1).alias(f"_{name}_a"), at(F.ceil(place) + 1).alias(f"_{name}_b")]
    found = piles.groupBy(*group).agg(*aggs, *[F.any_value(c).alias(c) for c in constant])

    def interpolate(name: str, p: float) -> Column:
        low, high = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        place = F.lit(float(p)) * (F.col("_n") - 1)
        value_ = low + (high - low) * (place - F.floor(place))
        # A rank outside its bracket would mean a broken sketch: fail rather than guess.
        missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
        return F.when(low.isNull() | high.isNull(), missed).otherwise(value_)

    return found.select(
        *group, *[F.col(f"_x_{n}").alias(n) for n in extras],
        *[interpolate(n, p).alias(n) for n, p in probs.items()],
    )


# ---- all columns of a wide frame ------------------------------------------------------------------

_BUFFER = 1 << 16  # rows of a column that are sorted together
_KEPT = 1 << 10  # of them, those that go on
_SIGN = np.int64(0x7FFF_FFFF_FFFF_FFFF)
_TOP = np.float64(np.nan).view(np.int64)


def ordered_keys(values: pa.Array) -> np.ndarray:
    """Present doubles as integers of the same order; NaN is the largest, as in Spark."""
    x = values.drop_null().to_numpy(zero_copy_only=False) + 0.0  # one zero
    bits = x.view(np.int64)
    return np.where(np.isnan(x), _TOP, np.where(bits < 0, bits ^ _SIGN, bits))


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ _SIGN, keys).astype(np.int64).view(np.float64)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names, kinds = zip(*[part.split() for part in schema.split(", ")])
    types = {"INT": pa.int32(), "BIGINT": pa.int64(), "DOUBLE": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


_SKETCH = "f INT, v DOUBLE, w BIGINT, n BIGINT, mean DOUBLE, square DOUBLE, low DOUBLE, high DOUBLE, loose BIGINT"
_CELLS = "f INT, v DOUBLE, c BIGINT"


def _sketched(width: int, buffer: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and column: its moments, and every ``step``-th value of each sorted buffer with its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(width)]
        facts = [(0, 0.0, 0.0, _TOP, -_SIGN, 0) for _ in range(width)]

        def flush(f: int) -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held[f]))
            held[f] = []
            step = max(len(keys) // _KEPT, 1)
            ends = np.unique(np.append(np.arange(step, len(keys) + 1, step), len(keys)))
            weights = np.diff(ends, prepend=0)
            x = _values(keys)
            n, mean, square, low, high, loose = facts[f]
            with np.errstate(all="ignore"):
                here = float(x.mean())
                total, gap = n + len(x), here - mean if n else here
                square += float(((x - here) ** 2).sum()) + (gap * gap * (n * len(x) / total) if n else 0.0)
                mean = mean + gap * (len(x) / total) if n else here
            facts[f] = (total, mean, square, min(low, keys[0]), max(high, keys[-1]), loose + step - 1)
            none = [None] * len(ends)
            return _batch(_SKETCH, [f] * len(ends), x[ends - 1], weights, none, none, none, none, none, none)

        waiting = 0
        for batch in batches:
            waiting += batch.num_rows
            for f, column in enumerate(batch.columns):
                keys = ordered_keys(column)
                if len(keys):
                    held[f].append(keys)
            if waiting >= buffer:
                yield from (flush(f) for f in range(width) if held[f])
                waiting = 0
        yield from (flush(f) for f in range(width) if held[f])
        for f, (n, mean, square, low, high, loose) in enumerate(facts):
            if n:
                edges = _values(np.array([low, high]))
                yield _batch(_SKETCH, [f], [None], [0], [n], [mean], [square], [edges[0]], [edges[1]], [loose])

    return run


def _counted(brackets: dict[int, list[tuple[float, float]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and column the values inside the brackets, counted, and how many lie below each (value NULL, in the
    bracket's place below zero)."""
    as_keys = {f: [tuple(ordered_keys(pa.array(pair, pa.float64()))) for pair in pairs] for f, pairs in brackets.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = {f: [0] * len(pairs) for f, pairs in as_keys.items()}
        for batch in batches:
            for f, pairs in as_keys.items():
                keys = ordered_keys(batch.column(f))
                inside = np.zeros(len(keys), bool)
                for j, (low, high) in enumerate(pairs):
                    below[f][j] += int((keys < low).sum())
                    inside |= (keys >= low) & (keys <= high)
                found, counts = np.unique(keys[inside], return_counts=True)
                if len(found):
                    yield _batch(_CELLS, [f] * len(found), _values(found), counts)
        for f, numbers in below.items():
            places = [f * len(numbers) + j for j in range(len(numbers))]
            yield _batch(_CELLS, [-1 - p for p in places], [None] * len(numbers), numbers)

    return run


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: dict[str, float], buffer: int = _BUFFER) -> DataFrame:
    """:func:`exact_quantiles` of each of the columns, one row per column (``feature``) that has a value, with its min,
    max, mean and std.

    Two passes over Arrow batches, all columns at once. The first sorts each task's rows in buffers and sends on every
    ``step``-th value with its weight; a value's rank is then known up to the sum of the steps, which gives a bracket
    that holds the wanted ranks for certain. The second counts what lies below the brackets and inside them. The driver
    reads a row per task and column, and the brackets.
    """
    wide = df.select(*[F.col(f"`{n}`").cast("double").alias(f"c{k}") for k, n in enumerate(columns)])
    spark, width = df.sparkSession, len(columns)
    path = scratch_dir(spark, "quantile-sketch")
    with wide_plans(spark):
        wide.mapInArrow(_sketched(width, buffer), _SKETCH).write.parquet(path)
    sketch = spark.read.schema(_SKETCH).parquet(path)
    facts: dict[int, tuple] = {}
    for r in sketch.filter("w = 0").drop("v", "w").orderBy("f", "n", "mean", "square", "low", "high").collect():
        n, mean, square, low, high, loose = facts.get(r["f"], (0, 0.0, 0.0, r["low"], r["high"], 0))
        gap, total = r["mean"] - mean if n else r["mean"], n + r["n"]
        facts[r["f"]] = (
            total, mean + gap * (r["n"] / total) if n else r["mean"],
            square + r["square"] + (gap * gap * (n * r["n"] / total) if n else 0.0),
            r["low"] if math.isnan(low) or r["low"] < low else low, r["high"] if math.isnan(r["high"]) or r["high"] > high else high,
            loose + r["loose"],
        )
    known = spark.createDataFrame(
        [(columns[f], f, n, low, high, mean, math.sqrt(square / (n - 1)) if n > 1 else None, loose)
         for f, (n, mean, square, low, high, loose) in facts.items()],
        "feature STRING, f INT, _n BIGINT, min DOUBLE, max DOUBLE, mean DOUBLE, std DOUBLE, _loose BIGINT")
    upward = Window.partitionBy("f").orderBy("v")
    ranked = sketch.filter("w > 0").groupBy("f", "v").agg(F.sum("w").alias("w")).withColumn(
        "_least", F.sum("w").over(upward.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(known), "f")
    floors = [F.floor(F.lit(float(p)) * (F.col("_n") - 1)) for p in probs.values()]
    edges = ranked.groupBy("f").agg(*[
        F.struct(
            # At most ``rank`` values are up to the lower edge, at least two more up to the upper one.
            F.coalesce(F.max(F.when(F.col("_least") + F.col("_loose") <= rank, F.col("v"))), F.first("min")).alias("a"),
            F.coalesce(F.min(F.when(F.col("_least") >= rank + 2, F.col("v"))), F.first("max")).alias("b"),
        ).alias(f"e{j}") for j, rank in enumerate(floors)
    ])
    brackets = {r["f"]: [(r[f"e{j}"]["a"], r[f"e{j}"]["b"]) for j in range(len(probs))] for r in edges.collect()}
    path = scratch_dir(spark, "quantile-cells")
    with wide_plans(spark):
        wide.mapInArrow(_counted(brackets), _CELLS).write.parquet(path)
    piles = spark.read.schema(_CELLS).parquet(path).groupBy("f", "v").agg(F.sum("c").alias("_c"))
    below = {-1 - r["f"]: r["_c"] for r in piles.filter("f < 0").collect()}
    places = spark.createDataFrame(
        [(f, j, facts[f][0], a, b, below[f * len(probs) + j], float(p) * (facts[f][0] - 1))
         for f, pairs in brackets.items() for j, ((a, b), p) in enumerate(zip(pairs, probs.values(), strict=True))],
        "f INT, _j INT, _n BIGINT, _a DOUBLE, _b DOUBLE, _below BIGINT, _at DOUBLE")
    placed = piles.filter("f >= 0").join(F.broadcast(places), "f").filter(F.col("v").between(F.col("_a"), F.col("_b")))
    counted = Window.partitionBy("f", "_j").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_upto", F.col("_below") + F.sum("_c").over(counted))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank > F.col("_upto") - F.col("_c")) & (rank <= F.col("_upto")), F.col("v")))

    found = placed.groupBy("f", "_j").agg(
        at(F.floor("_at") + 1).alias("_low"), at(F.ceil("_at") + 1).alias("_high"), F.any_value("_at").alias("_at"))
    # A rank outside its bracket would mean a broken sketch: fail rather than guess.
    missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
    low, high = F.col("_low"), F.col("_high")
    value = F.when(low.isNull() | high.isNull(), missed).otherwise(low + (high - low) * (F.col("_at") - F.floor("_at")))
    across = found.groupBy("f").agg(*[F.max(F.when(F.col("_j") == j, value)).alias(n) for j, n in enumerate(probs)])
    return across.join(F.broadcast(known), "f").select("feature", "min", "max", "mean", "std", *probs)
