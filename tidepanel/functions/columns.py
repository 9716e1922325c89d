"""Column expressions shared by the operators. All are JVM-side built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def lenient_double(value: Column) -> Column:
    """Number from anything castable; bad text and NaN become NULL (NaN would poison max and avg)."""
    return F.nanvl(value.try_cast("double"), F.lit(None))


def lenient_date(value: Column) -> Column:
    """Date from a date, timestamp or ISO text; anything else becomes NULL."""
    return value.try_cast("date")


def safe_double(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(lenient_double(value), F.lit(float(default)))


def finite_or(value: Column, default: float = 0.0) -> Column:
    """NULL, NaN and both infinities become ``default`` (NaN compares above every number)."""
    number = value.cast("double")
    return F.when(F.abs(number) < float("inf"), number).otherwise(float(default))


def finite_sql(name: str, default: float = 0.0) -> str:
    """:func:`finite_or` as SQL text, for frames of many columns."""
    number = f"CAST(`{name}` AS DOUBLE)"
    return f"CASE WHEN abs({number}) < DOUBLE('Infinity') THEN {number} ELSE {default}D END AS `{name}`"


def safe_sql(source: str, name: str, default: float = 0.0) -> str:
    """:func:`safe_double` as SQL text."""
    return f"coalesce(nanvl(try_cast(`{source}` AS DOUBLE), NULL), {default}D) AS `{name}`"


def first_present(df: DataFrame, names: Sequence[str]) -> Column | None:
    """Coalesce of those ``names`` the frame has, in the order listed; None if it has none."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        return None
    return F.coalesce(*present) if len(present) > 1 else present[0]


# Two runs may add the same numbers in another order; the nudge keeps exact halves on one side, so
# a reported figure does not flip its last digit when a lost task is computed again.
ROUNDING_NUDGE = 1e-9


def steady_round(value: Column, digits: int) -> Column:
    return F.round(value + ROUNDING_NUDGE, digits)


def pct_change(current: Column, previous: Column) -> Column:
    """Signed percent change, one decimal; 0 where there is nothing to compare with."""
    flat = previous.isNull() | (F.abs(previous) < 1e-9)
    return F.when(flat, F.lit(0.0)).otherwise(
        steady_round(F.try_divide(current - previous, previous) * 100.0, 1)
    )


def severity(abs_error: Column) -> Column:
    return F.when(abs_error > 10, "high").when(abs_error > 5, "medium").otherwise("low")


def scale_100(value: Column, low: Column, high: Column) -> Column:
    """Min-max position on 0..100; a flat or empty range gives 50."""
    flat = low.isNull() | high.isNull() | (F.abs(high - low) < 1e-9)
    position = F.try_divide(value - low, high - low) * 100.0
    return F.when(flat, F.lit(50.0)).otherwise(
        F.when(position.isNotNull(), F.least(F.greatest(position, F.lit(0.0)), F.lit(100.0)))
    )


def week_start(date: Column) -> Column:
    """Monday of the date's week."""
    return F.date_trunc("week", date).cast("date")


def day_number(date: Column) -> Column:
    return F.unix_date(date)


def title_case(value: Column) -> Column:
    return F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))


def fold_case(value: Column) -> Column:
    return F.lower(value.cast("string"))
