"""Connected components of a link table by alternating large and small stars, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.storage import Scratch


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Each round hangs neighbours on smaller nodes until nothing moves, which takes about log2 of the longest
    chain. Only two numbers a round reach the driver. Null ends and links of a node with itself are ignored.
    """
    edges = scratch.store(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(),
        f"{label}-edges")
    state, turn = _state(edges), 0
    while state[0]:
        both = edges.select(F.col("v").alias("n"), F.col("m").alias("o")).union(edges.select("m", "v"))
        least = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
        large = both.where("o > n").join(least, "n").select(F.col("o").alias("v"), "m").distinct()
        lowest = large.groupBy("v").agg(F.min("m").alias("least"))
        hung = large.join(lowest, "v").select(F.when(F.col("m") == F.col("least"), F.col("v")).otherwise(F.col("m")).alias("v"),
                                              F.col("least").alias("m"))
        turn += 1
        moved = scratch.store(hung.where("v <> m").distinct(), f"{label}-edges{turn}")
        now = _state(moved)
        scratch.drop(f"{label}-edges{turn - 1 if turn > 1 else ''}")
        edges = moved
        if now == state:
            break
        state = now
    return edges.select(F.col("v").alias("node"), F.col("m").alias("component")).union(
        edges.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())


def _state(edges: DataFrame):
    """How many edges there are and a sum that changes with any of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())
