"""What each input adds to a prediction of the boosted trees: exact Shapley values along the paths of the trees.

An input that is unknown is averaged over by the training rows that went either way (path-dependent expectation).
A leaf is then a product over the inputs on its path, one factor each: 1 or 0 where the input is known and inside the
leaf's interval or not, and the share of rows that stay on the path where it is unknown. Shares of all leaves add up
to the prediction minus its mean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

SHARES = "_shares"
MOST_INPUTS = 12  # on one path: a leaf's table has two to this power rows
_ROWS = 2048


@dataclass(frozen=True)
class Leaves:
    """One row per leaf, one column per input on its path; places left over are inputs that always fit."""

    feature: np.ndarray  # [leaf, place]
    low: np.ndarray  # the leaf holds low < x <= high
    high: np.ndarray
    stays: np.ndarray  # share of the rows that stay on the path where the input is unknown
    value: np.ndarray  # [leaf], times the tree's weight
    first: np.ndarray  # [tree + 1]: the leaves of a tree stand together

    @property
    def mean(self) -> float:
        return float((self.value * self.stays.prod(axis=1)).sum())


def read_leaves(spark: SparkSession, path: str) -> Leaves:
    """The leaves of the boosted trees of a stored pipeline; as many rows come to the driver as the model has nodes."""
    stage = f"{path}/stages/*"
    weights = {r["_1"]: r["_3"] for r in spark.read.parquet(f"{stage}/treesMetadata").select("_1", "_3").collect()}
    nodes: dict[int, dict[int, dict]] = {t: {} for t in weights}
    for r in spark.read.parquet(f"{stage}/data").select("treeID", "nodeData.*").collect():
        nodes[r["treeID"]][r["id"]] = r
    found: list[tuple[dict[int, tuple[float, float, float]], float]] = []
    first = [0]
    for tree in sorted(nodes):
        waiting = [(0, {})]
        while waiting:
            at, box = waiting.pop()
            node = nodes[tree][at]
            if node["leftChild"] < 0:
                found.append((box, node["prediction"] * weights[tree]))
                continue
            if node["split"]["numCategories"] >= 0:
                raise ValueError("splits by category are not explained")
            feature, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            low, high, stays = box.get(feature, (-math.inf, math.inf, 1.0))
            for child, bounds in ((node["leftChild"], (low, min(high, cut))), (node["rightChild"], (max(low, cut), high))):
                share = nodes[tree][child]["impurityStats"][0] / node["impurityStats"][0]
                waiting.append((child, box | {feature: (*bounds, stays * share)}))
        first.append(len(found))
    places = max((len(box) for box, _ in found), default=0)
    if places > MOST_INPUTS:
        raise ValueError(f"a path has {places} inputs, more than {MOST_INPUTS}")
    shape = (len(found), places)
    feature, low, high, stays = np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
    for k, (box, _) in enumerate(found):
        for place, (f, (a, b, z)) in enumerate(sorted(box.items())):
            feature[k, place], low[k, place], high[k, place], stays[k, place] = f, a, b, z
    return Leaves(feature, low, high, stays, np.array([v for _, v in found]), np.array(first))


def _tables(stays: np.ndarray, value: np.ndarray) -> np.ndarray:
    """[leaf, pattern, place]: the share of each input of a leaf for every pattern of inputs that fit."""
    places = stays.shape[1]
    fits = (np.arange(1 << places)[:, None] >> np.arange(places) & 1).astype(float)
    weight = [math.factorial(k) * math.factorial(places - 1 - k) / math.factorial(places) for k in range(places)]
    out = np.empty((len(stays), len(fits), places))
    for place in range(places):
        known = np.zeros((len(stays), len(fits), places))  # by the number of other inputs that are known
        known[:, :, 0] = 1.0
        for other in range(places):
            if other != place:
                more = known[:, :, :-1] * fits[None, :, other, None]
                known *= stays[:, None, other, None]
                known[:, :, 1:] += more
        out[:, :, place] = (fits[None, :, place] - stays[:, None, place]) * (known @ np.array(weight)) * value[:, None]
    return out


def shares(leaves: Leaves, rows: np.ndarray) -> np.ndarray:
    """The share of each input in each row's prediction; one tree at a time, so only its tables are held."""
    out = np.zeros(rows.shape)
    places = leaves.feature.shape[1]
    if not places:
        return out
    for a, b in zip(leaves.first[:-1], leaves.first[1:], strict=True):
        table = _tables(leaves.stays[a:b], leaves.value[a:b])
        goes_to = np.zeros(((b - a) * places, rows.shape[1]))
        goes_to[np.arange((b - a) * places), leaves.feature[a:b].ravel()] = 1.0
        for k in range(0, len(rows), _ROWS):
            x = rows[k:k + _ROWS][:, leaves.feature[a:b]]
            pattern = ((x > leaves.low[a:b]) & (x <= leaves.high[a:b])) @ (1 << np.arange(places))
            out[k:k + _ROWS] += table[np.arange(b - a), pattern].reshape(len(x), -1) @ goes_to
    return out


def with_shares(frame: DataFrame, leaves: Leaves, features: list[str]) -> DataFrame:
    """``frame`` and ``_shares``, the share of each feature in its order; absent values count as 0."""
    inputs = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    held = frame.sparkSession.sparkContext.broadcast(leaves)  # as large as the model
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            found = pa.array(list(shares(held.value, x)), pa.list_(pa.float64()))
            columns = [*batch.columns[:-1], found]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = StructType([*frame.schema.fields, StructField(SHARES, ArrayType(DoubleType()))])
    return frame.withColumn(SHARES, inputs).mapInArrow(run, schema)


def largest_text(parts: Column, top: int = 3) -> Column:
    """The ``top`` entries (v, f) of an array that are largest by absolute value, in words; ties by name."""

    def larger_first(a: Column, b: Column) -> Column:
        return F.when(F.abs(a["v"]) > F.abs(b["v"]), -1).when(F.abs(a["v"]) < F.abs(b["v"]), 1).when(
            a["f"] < b["f"], -1
        ).when(a["f"] > b["f"], 1).otherwise(0)

    lines = F.transform(
        F.slice(F.array_sort(parts, larger_first), 1, top),
        lambda p: F.concat(
            p["f"], F.lit(" contributed to "),
            F.when(p["v"] > 0, "increase").otherwise("decrease"), F.lit(" demand"),
        ),
    )
    return F.array_join(lines, " | ")


def shares_text(features: list[str], top: int = 3) -> Column:
    """The ``top`` inputs by their shares; an input without any share is not named."""
    named = F.zip_with(F.col(SHARES), F.array(*[F.lit(f) for f in features]), lambda v, f: F.struct(v.alias("v"), f.alias("f")))
    return largest_text(F.filter(named, lambda p: p["v"] != 0), top)
