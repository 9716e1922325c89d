"""Keep-one-per-key operators and unions of layered sources.

Each is a ``groupBy`` whose buffer is one struct, so duplicates collapse on the map side
before the shuffle: a key that owns a third of the input still sends one row per task.
Comparing the whole struct makes the winner the same on every re-run of a lost task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def _pick_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick: str) -> DataFrame:
    columns = df.columns
    order = [c for c in order if c in columns]
    rest = [c for c in columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.expr(f"{pick}(struct({_names([*order, *rest])})) AS _row"))
    return picked.selectExpr(*[f"`{c}`" if c in keys else f"_row.`{c}` AS `{c}`" for c in columns])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("_seq",)) -> DataFrame:
    """One row per key: the greatest by ``order``, ties settled by the remaining columns."""
    return _pick_one(df, keys, order, "max")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("_seq",)) -> DataFrame:
    """One row per key: the least by ``order``, ties settled by the remaining columns."""
    return _pick_one(df, keys, order, "min")


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; ``_rank`` numbers the sources so later ones win in :func:`keep_last`."""
    layered = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    out = layered[0]
    for frame in layered[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def union_keep_last(
    frames: Sequence[DataFrame],
    keys: Sequence[str] = ("entity_id", "date"),
    order: Sequence[str] = ("_seq",),
) -> DataFrame:
    """History, then newer sources: one row per key, the newest source winning."""
    return keep_last(stack(*frames), keys, ["_rank", *order]).drop("_rank")


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    keep_from_first: Sequence[str] = ("first_seq",),
    order: Sequence[str] = ("_seq",),
) -> DataFrame:
    """Insert-or-update by key; ``keep_from_first`` columns stay as first inserted."""
    both = stack(existing, incoming)
    columns = both.columns
    order = [c for c in ("_rank", *order) if c in columns]
    kept = [c for c in keep_from_first if c in columns]
    rest = [c for c in columns if c not in keys and c not in kept and c not in order]
    merged = both.groupBy(*keys).agg(
        F.expr(f"max(struct({_names([*order, *rest])})) AS _new"),
        F.expr(f"min(struct({_names([*order, *kept])})) AS _old"),
    )
    return merged.selectExpr(
        *[
            f"`{c}`" if c in keys else f"_old.`{c}` AS `{c}`" if c in kept else f"_new.`{c}` AS `{c}`"
            for c in columns
            if c != "_rank"
        ]
    )


def latest_dimension(panel: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Each entity's attributes as of its last date."""
    present = [a for a in attributes if a in panel.columns]
    newest = panel.groupBy("entity_id").agg(F.max(F.struct("date", *present)).alias("_row"))
    return newest.select("entity_id", *[F.col(f"_row.{a}").alias(a) for a in present])
