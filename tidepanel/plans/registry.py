"""Registered queries: one Spark plan and, where SQL can say it, the equivalent ANSI SQL.

A query's ``spec`` names its output columns and their kinds; the same spec shapes the Spark
result and wraps the SQL, so both sides agree on names, types and rounding.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.operators import drift, features
from tidepanel.operators.series import latest_date
from tidepanel.session import scratch_dir, wide_plans
from tidepanel.sources import panels

LIVE_DAYS = 10
# Doubles are compared on a grid of six decimals. Halves, which two engines may sum to either
# side of, lie a thousandth of a step above the cut. The grid ends where its steps are no longer
# exact in a double; larger numbers, infinities and NaN are shown as they are.
GRID = 1e6
CUT = 0.501
GRID_END = 2.0**53 / GRID


class Inputs:
    """The given tables as panels, built when a query asks for them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return panels.table(self.spark, self.folder, name)

    def scratch(self, label: str) -> str:
        return scratch_dir(self.spark, label)

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        """The frame written once to the shared folder and read back, for plans that read it often."""
        path = self.scratch(label)
        with wide_plans(self.spark):
            df.write.parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def retail(self) -> DataFrame:
        return panels.retail_panel(self.spark, self.folder)

    @cached_property
    def retail_table(self) -> DataFrame:
        """The retail panel as a written table, for reports that scan it several times."""
        return self.stored(self.retail, "retail-panel")

    @cached_property
    def activity(self) -> DataFrame:
        return panels.activity_panel(self.spark, self.folder)

    @cached_property
    def events(self) -> DataFrame:
        return panels.interventions(self.spark, self.folder)

    @cached_property
    def regimes(self) -> DataFrame:
        return panels.regime_shifts(self.activity)

    @cached_property
    def forecasts(self) -> DataFrame:
        return panels.reference_forecasts(self.activity)

    @cached_property
    def errors(self) -> DataFrame:
        """Forecast against actual of the activity panel; the day number is the insertion order."""
        aligned = drift.align_forecasts(self.activity, self.forecasts)
        return aligned.withColumn("first_seq", F.unix_date("date").cast("bigint"))

    @cached_property
    def first_live_date(self):
        return F.date_sub(latest_date(self.activity), LIVE_DAYS - 1)

    @cached_property
    def feature_rows(self) -> DataFrame:
        return features.feature_frame(self.activity, self.events, self.regimes)


@dataclass(frozen=True)
class Query:
    name: str
    spec: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return present(self.build(Inputs(spark, folder)), self.spec)


QUERIES: dict[str, Query] = {}


def query(name: str, spec: str, sql: str | None = None):
    """Register a builder; ``sql`` may use the shared tables of :mod:`tidepanel.plans.shared_sql`."""
    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = Query(name, spec, build, sql)
        return build
    return add


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in re.split(r",\s*", spec.strip())]


_GRID_SPARK = (
    "(CASE WHEN abs(CAST({c} AS DOUBLE)) < " + f"{GRID_END!r}D" + " THEN floor(CAST({c} AS DOUBLE) * "
    + f"{GRID}D + {CUT}D) / {GRID}D" + " ELSE CAST({c} AS DOUBLE) END)"
)


def present(df: DataFrame, spec: str) -> DataFrame:
    kinds = {
        "s": "CAST({c} AS STRING)",
        "d": "date_format({c}, 'yyyy-MM-dd')",
        "i": "CAST({c} AS BIGINT)",
        "f": _GRID_SPARK,
    }
    return df.selectExpr(*[kinds[k].format(c=f"`{n}`") + f" AS `{n}`" for n, k in _columns(spec)])


def on_grid(df: DataFrame, names: list[str]) -> DataFrame:
    """The named doubles rounded as they are compared."""
    rest = [f"`{c}`" for c in df.columns if c not in names]
    return df.selectExpr(*rest, *[_GRID_SPARK.format(c=f"`{n}`") + f" AS `{n}`" for n in names])


def grid_sql(expression: str) -> str:
    x = f"CAST({expression} AS DOUBLE)"
    return f"(CASE WHEN abs({x}) < {GRID_END!r} THEN floor({x} * {GRID} + {CUT}) / {GRID} ELSE {x} END)"


def present_sql(spec: str, body: str) -> str:
    kinds = {
        "s": "CAST({c} AS VARCHAR)",
        "d": "strftime({c}, '%Y-%m-%d')",
        "i": "CAST({c} AS BIGINT)",
        "f": grid_sql("{c}"),
    }
    shown = ", ".join(kinds[k].format(c=n) + f" AS {n}" for n, k in _columns(spec))
    return f"SELECT {shown} FROM ({body}) AS q"
