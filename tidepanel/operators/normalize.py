"""Canonical forms of the inputs, lenient casts and the contract audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.columns import finite_sql, fold_case, safe_sql
from tidepanel.operators.dedup import keep_last
from tidepanel.operators.drift import long_form
from tidepanel.sources import schemas as S


def _keys_sql(df: DataFrame, date_names: Sequence[str] = ("date",)) -> list[str]:
    """SQL of entity_id and date, coalescing the accepted spellings in listed order."""
    found = {}
    for key, spellings in (("entity_id", S.ENTITY_ALIASES), ("date", date_names)):
        present = [f"`{n}`" for n in spellings if n in df.columns]
        if not present:
            raise ValueError(f"missing required column: {key}")
        found[key] = f"coalesce({', '.join(present)})"
    return [f"CAST({found['entity_id']} AS STRING) AS entity_id", f"try_cast({found['date']} AS DATE) AS date"]


def _order_columns(df: DataFrame) -> list[str]:
    return [c for c in ("_rank", "_seq") if c in df.columns]


_KEYED = "date IS NOT NULL AND entity_id IS NOT NULL"


def normalize_feed(df: DataFrame, signals: Sequence[str] = ()) -> DataFrame:
    """A daily feed as the 17 canonical columns; rows without a usable key are dropped.

    Those of ``signals`` that the feed has are kept beside them, with NULL where they say nothing.
    """
    columns = df.columns
    measures = []
    for name in S.FEED_MEASURES:
        source = next((c for c in (name, S.FEED_ALIASES.get(name)) if c in columns), None)
        measures.append(safe_sql(source, name) if source else f"0.0D AS {name}")
    texts = [
        f"CAST({n} AS STRING) AS {n}" if n in columns else f"'{default}' AS {n}"
        for n, default in S.FEED_TEXT_DEFAULTS.items()
    ]
    more = [n for n in signals if n in columns]
    kept = [f"nanvl(try_cast(`{n}` AS DOUBLE), NULL) AS `{n}`" for n in more]
    order = _order_columns(df)
    shaped = df.selectExpr(*_keys_sql(df), *measures, *texts, *kept, *order).filter(_KEYED)
    return shaped.select(*S.FEED_COLUMNS, *more, *order)


def canonical_panel(df: DataFrame) -> DataFrame:
    """Panel rows with aliases, casts and defaults applied, duplicates still present."""
    columns = df.columns
    measures = []
    for name, default in S.PANEL_MEASURE_DEFAULTS.items():
        given = [f"nanvl(try_cast(`{c}` AS DOUBLE), NULL)" for c in (name, S.PANEL_ALIASES.get(name)) if c in columns]
        measures.append(f"coalesce({', '.join([*given, f'{default}D'])}) AS {name}")
    texts = [
        f"coalesce(CAST({n} AS STRING), '{d}') AS {n}" if n in columns else f"'{d}' AS {n}"
        for n, d in S.PANEL_TEXT_DEFAULTS.items()
    ]
    # Demand gaps stay NULL: the windows skip them.
    demand = f"try_cast({S.TARGET} AS DOUBLE)" if S.TARGET in columns else "CAST(NULL AS DOUBLE)"
    extras = [n for n in ("brand", "product_name", "category", "price_index") if n in columns]
    return df.selectExpr(
        *_keys_sql(df), *extras, f"nanvl({demand}, NULL) AS {S.TARGET}", *measures, *texts, *_order_columns(df)
    ).filter(_KEYED)


def normalize_panel(df: DataFrame) -> DataFrame:
    """Canonical panel with one row per (entity, date), the last by ``_seq``."""
    shaped = canonical_panel(df)
    return keep_last(shaped, ["entity_id", "date"], _order_columns(df)).drop("_rank", "_seq")


def normalize_events(df: DataFrame) -> DataFrame:
    """Events with one intensity, one row per (entity, date, type)."""
    try:
        keys = _keys_sql(df, S.EVENT_DATE_ALIASES)
    except ValueError:
        return df.sparkSession.createDataFrame(
            [], "entity_id STRING, date DATE, event_type STRING, event_intensity_score DOUBLE"
        )
    kind = "CAST(event_type AS STRING)" if "event_type" in df.columns else f"'{S.GENERIC_EVENT_TYPE}'"
    source = next((c for c in S.INTENSITY_COLUMNS if c in df.columns), None)
    name = "event_intensity_score"
    intensity = safe_sql(source, name, 1.0) if source else f"1.0D AS {name}"
    shaped = df.selectExpr(*keys, f"{kind} AS event_type", intensity, *_order_columns(df)).filter(_KEYED)
    return keep_last(shaped, ["entity_id", "date", "event_type"], _order_columns(df)).drop("_rank", "_seq")


def normalize_regimes(df: DataFrame) -> DataFrame:
    """Regime change points, one row per (entity, date)."""
    try:
        keys = _keys_sql(df)
    except ValueError:
        return df.sparkSession.createDataFrame(
            [], "entity_id STRING, date DATE, recent_change_point_flag DOUBLE, regime_shift_strength DOUBLE"
        )

    def first_column(names: Sequence[str], name: str) -> str:
        found = next((c for c in names if c in df.columns), None)
        return safe_sql(found, name) if found else f"0.0D AS {name}"

    shaped = df.selectExpr(
        *keys, first_column(S.CHANGE_FLAG_COLUMNS, "recent_change_point_flag"),
        first_column(S.SHIFT_STRENGTH_COLUMNS, "regime_shift_strength"), *_order_columns(df),
    ).filter(_KEYED)
    return keep_last(shaped, ["entity_id", "date"], _order_columns(df)).drop("_rank", "_seq")


def finalize_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Absent features become 0.0; NULL, NaN and infinities become 0.0."""
    kept = [c for c in df.columns if c not in features]
    present = set(df.columns)
    ready = [finite_sql(f) if f in present else f"0.0D AS `{f}`" for f in features]
    return df.selectExpr(*[f"`{c}`" for c in kept], *ready)


def filter_category(df: DataFrame, category: str = "all") -> DataFrame:
    """Rows of one category, ignoring case; ``all`` keeps every row."""
    if category == "all":
        return df
    if "category" not in df.columns:
        return df.filter(F.lit(False))
    return df.filter(fold_case(F.col("category")) == category.lower())


def contract_columns(df: DataFrame, contract: Sequence[str]) -> dict[str, list[str]]:
    """Contract columns the frame lacks and has."""
    return {
        "missing": [c for c in contract if c not in df.columns],
        "present": [c for c in contract if c in df.columns],
    }


def contract_audit(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """Per contract column: is it there, and how many cells are NULL, NaN, infinite or zero."""
    present = contract_columns(df, contract)["present"]
    wide = df.select(
        *[(F.col(c).cast("double") if c in present else F.lit(None).cast("double")).alias(c) for c in contract]
    )
    value = F.col("value")
    return (
        long_form(wide, list(contract))
        .groupBy("feature")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_if(value.isNull()).alias("n_null"),
            F.count_if(F.isnan(value)).alias("n_nan"),
            F.count_if(F.abs(value) == float("inf")).alias("n_inf"),
            F.count_if(value == 0.0).alias("n_zero"),
        )
        .withColumn("present", F.col("feature").isin(present))
    )
