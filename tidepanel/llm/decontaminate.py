"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all benchmark items.

The automaton reads word numbers, not characters: words of the benchmark have a number each, all other words
share the number 0, so a document is read once and a match ends at a word, whose bytes in the original are known.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.words import LOWER, chunks, words

WINDOW = 13
PERCENT = 5
BLOCK_BYTES = 4 << 20

SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SPACED = np.where(SEPARATOR[LOWER], np.uint8(0x20), LOWER)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def benchmark_words(text: str | None) -> list[bytes]:
    return _SPACED[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


class Matcher:
    """The windows of some items; the automaton is built on first use in a process."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.numbers, self.windows, self.automaton = _Numbers(), {}, None
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in benchmark_words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                self.windows.setdefault(tuple(ids[k:k + window]), set()).add(item)
        self.shortest = min(map(len, self.windows), default=0)

    def find(self, found: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items with a window here."""
        hit, items = np.zeros(len(found), dtype=bool), set()
        if not self.windows or len(found) < self.shortest:
            return hit, items
        ids = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        gaps = np.diff(np.flatnonzero(ids == 0), prepend=-1, append=len(ids)) - 1
        if gaps.max() < self.shortest:  # no run of benchmark words is as long as the shortest window
            return hit, items
        if self.automaton is None:
            built = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, names in self.windows.items():
                built.add_word(key, (len(key), names))
            built.make_automaton()
            self.automaton = built
        for last, (size, names) in self.automaton.iter(tuple(ids.tolist())):
            hit[last - size + 1:last + 1] = True
            items |= names
        return hit, items


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = shared.value  # stays with the Python process, and so does what is built from it
        m = box.get("matcher") or box.setdefault("matcher", Matcher(box["items"], box["window"]))
        for batch in batches:
            for c in chunks(batch.column("text")):
                spaced = _SPACED[c.data]
                counts, hits, items, spans = [], [], [], []
                for k in range(len(c.rows)):
                    found = spaced[c.offsets[k]:c.offsets[k + 1]].tobytes().split()
                    hit, names = m.find(found)
                    counts.append(len(found))
                    hits.append(np.flatnonzero(hit).tolist())
                    items.append(sorted(names))
                    spans.append([])
                    if names:
                        text = LOWER[c.data[c.offsets[k]:c.offsets[k + 1]]]
                        w = words(text, np.array([0, len(text)]), SEPARATOR)
                        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                        spans[-1] = [{"start": int(w.starts[a]), "end": int(w.ends[b - 1])}
                                     for a, b in zip(edge[::2], edge[1::2], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column("doc").slice(c.rows.start, len(c.rows)),
                    "row": batch.column("row").slice(c.rows.start, len(c.rows)),
                    "n_words": pa.array(counts, pa.int64()),
                    "hits": pa.array(hits, pa.list_(pa.int32())),
                    "items": pa.array(items, pa.list_(pa.string())),
                    "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                })
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted), ``spans`` (bytes of the original
    text that are hit), ``contaminated`` (something is hit, and at least ``percent`` of the words).

    Words are runs of a-z, 0-9 and characters beyond ASCII after A-Z are lower-cased. A window is ``window`` words of
    an item, or the whole of a shorter one. The items' size is measured first: they are sent to the executors in
    blocks of about ``block_bytes`` bytes of text, and the documents are read once for each block (once in all
    for a benchmark below that size).

    Null or empty texts and items without words hit nothing. Items without an id are left out, rows that repeat an
    item's id add to its windows. Documents without an id are left out, repeated ones come as often as given. Other
    columns are ignored. Without documents or items the result is empty or has no hits.
    """
    spark = docs.sparkSession
    source = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    shape = "doc long, row long, n_words long, hits array<int>, items array<string>, spans array<struct<start int, end int>>"
    # A row number is wanted only where several blocks meet again.
    source = source.withColumn("row", F.monotonically_increasing_id() if blocks > 1 else F.lit(0).cast("long"))
    parts = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast({"items": [(r.item, r.text) for r in mine.collect()], "window": window})
        parts.append(source.mapInArrow(_scan(shared), shape))
    out = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            out = out.union(part)
        flat = lambda c: F.flatten(F.collect_list(c))
        out = out.groupBy("doc", "row").agg(
            F.max("n_words").alias("n_words"), F.array_distinct(flat("hits")).alias("hits"),
            F.array_sort(F.array_distinct(flat("items"))).alias("items"), F.array_sort(flat("spans")).alias("spans"))
    hit = F.size("hits").cast("long")
    return out.select(
        F.col("doc").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        "spans", ((hit > 0) & (hit * 100 >= F.col("n_words") * percent)).alias("contaminated"))
