"""Near-duplicate documents: fast similarity sketches, bands, exact verification, components.

The sketch has t bins. In round i < t every element of a set goes to one hashed bin with the value i plus a
hashed fraction, and a bin keeps its least value; in round t + j every element goes to bin j. A set stops
once all its bins are filled, after about t ln t / n rounds for n elements, and 2 t rounds fill every bin
of any set that is not empty. Two sets agree in a bin with a probability equal to their similarity, and the
estimate is as concentrated as that of t independent hash functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.components import components
from tidepanel.llm.storage import Scratch
from tidepanel.llm.words import CHUNK_BYTES, LOWER, chunks, mix, signed, window_hashes, windows, word_hashes, words

WORDS = 5
PERCENT = 75
ROWS = 4
MISS = 1e-7
BLOCK = 256
_UNFILLED = np.uint64(0xFFFFFFFFFFFFFFFF)


def band_count(percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` bins so that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    data = LOWER[data]
    w = words(data, offsets)
    hashes = word_hashes(data, w)
    at = windows(w, size)
    found = window_hashes(hashes, at, size)
    first = np.searchsorted(at, w.first)
    sets = []
    for k, n in enumerate(w.counts):
        if 0 < n < size:
            sets.append(window_hashes(hashes, w.first[k:k + 1], int(n)))
        else:
            sets.append(np.unique(found[first[k]:first[k + 1]]))
    return sets


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` values for each set; the row of an empty set says nothing."""
    sizes = np.array([len(s) for s in sets], np.int64)
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out = np.full((len(sets), bins), _UNFILLED, np.uint64)
    flat, low = out.reshape(-1), np.uint64(0xFFFFFFFF)
    for turn in range(2 * bins):
        if not len(element):
            break
        x = mix(element + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = ((x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(flat, owner * bins + at, np.uint64(turn << 32) | (x & low))
        open_sets = (out == _UNFILLED).any(axis=1)
        more = open_sets[owner]
        element, owner = element[more], owner[more]
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    bands = values.shape[1] // rows
    parts = values[:, :bands * rows].reshape(len(values), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), parts.shape[:2])
    for r in range(rows):
        keys = mix(keys ^ parts[:, :, r])
    return keys


def _lists(rows: list[np.ndarray], kind: type) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(flat).view(kind)))


def _sketches(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text"), CHUNK_BYTES):
                sets = shingle_sets(c.data, c.offsets, size)
                keys = band_keys(sketch(sets, bands * rows), rows)
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column("doc").slice(c.rows.start, len(c.rows)),
                    "n": pa.array(np.array([len(s) for s in sets], np.int64)),
                    "fp1": pa.array(signed(np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64))),
                    "fp2": pa.array(signed(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                                                     for s in sets], np.uint64))),
                    "bands": _lists([k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)], np.int64),
                })
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text"), CHUNK_BYTES):
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column("doc").slice(c.rows.start, len(c.rows)),
                    "items": _lists(shingle_sets(c.data, c.offsets, size), np.int64),
                })
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS,
                    percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` (smallest linked id) and ``kept``.

    Texts with equal sets form one class, whose smallest id stands for it. Bands propose pairs of classes: first
    every member of a bucket with the hub, the member that shares most with others (of a group of copies the one
    with the fewest edits); then, for members that these links did not bring together, with the members of the
    bucket's other components whose sizes and sketches allow a link. Every proposed pair is counted on full
    sets, so no link is made by a sketch; a link at the threshold is lost with a probability of about ``miss``.

    Null and empty texts and texts without words have an empty set and stand alone. Texts of fewer words than a
    shingle have one shingle. Rows without an id are left out; a repeated row is returned as often as it
    comes. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    bands = band_count(percent, rows, miss)
    source = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sketches = scratch.store(
        source.mapInArrow(_sketches(size, bands, rows),
                          "doc long, n long, fp1 long, fp2 long, bands array<long>"), "sketches")
    classes = scratch.store(
        sketches.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("rep")), "classes")
    banded = sketches.join(classes.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi").select(
        "doc", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = scratch.store(banded.join(shared, "key").distinct(), "buckets")
    degrees = buckets.groupBy("doc").agg(F.sum("members").alias("degree"))
    ranked = buckets.join(degrees, "doc").select("key", "doc", F.struct("degree", (-F.col("doc")).alias("order")).alias("rank"))
    hubs = ranked.groupBy("key").agg((-F.max("rank")["order"]).alias("hub"))
    stars = (buckets.join(hubs, "key").where("doc <> hub")
             .select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b")).distinct())
    starred = _verified(scratch, stars, source, size, percent)
    near = scratch.store(components(starred, scratch, "star"), "star-components")

    # What the hubs did not bring together: only hubs that still have members in two components.
    groups = scratch.store(
        buckets.join(hubs, "key").select("hub", "doc").distinct()
        .join(near.withColumnRenamed("node", "doc"), "doc", "left")
        .select("hub", "doc", F.coalesce("component", "doc").alias("part")), "groups")
    split = groups.groupBy("hub").agg(
        F.min("part").alias("least"), F.max("part").alias("most"),
        F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).where("least < most").select("hub", "blocks")
    rest = groups.join(split, "hub")
    sets = scratch.store(_set_table(source, rest.select("doc").distinct(), size), "group-sets")
    rest = rest.join(sets, "doc")
    left = rest.withColumn("block", F.expr("pmod(xxhash64(doc), blocks)"))
    right = rest.select(F.explode(F.expr("sequence(0L, blocks - 1)")).alias("in_block"),
                        *(F.col(c).alias(f"other_{c}") for c in ("hub", "doc", "part", "items")))
    crossed = scratch.store(left.join(right, F.expr(
        f"""hub = other_hub and block = in_block and doc < other_doc and part <> other_part
            and 100 * least(size(items), size(other_items)) >= {percent} * greatest(size(items), size(other_items))
            and {_linked("items", "other_items", percent)}"""))
        .select(F.col("doc").alias("a"), F.col("other_doc").alias("b")), "crossed")
    links = starred.union(crossed)
    whole = scratch.store(components(links, scratch, "all"), "components")
    named = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp1", "fp2", "n", F.coalesce("component", "rep").alias("root"))
    component = F.coalesce("root", "doc")
    return sketches.select("doc", "n", "fp1", "fp2").join(named, ["fp1", "fp2", "n"], "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (component == F.col("doc")).alias("kept"))


def _linked(x: str, y: str, percent: int) -> str:
    shared = f"size(array_intersect({x}, {y}))"
    return f"{100 + percent} * {shared} >= {percent} * (size({x}) + size({y}))"


def _set_table(source: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full sets of the wanted documents; an id that comes with several texts has the union of their sets."""
    sets = source.join(wanted, "doc", "left_semi").mapInArrow(_sets(size), "doc long, items array<long>")
    return sets.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _verified(scratch: Scratch, pairs: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links on full sets, which are made again for documents in pairs only."""
    pairs = scratch.store(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    sets = scratch.store(_set_table(source, wanted, size), "pair-sets")
    left = sets.select(F.col("doc").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    out = scratch.store(pairs.join(left, "a").join(right, "b").where(_linked("x", "y", percent)).select("a", "b"), "starred")
    scratch.drop("pair-sets")
    return out
