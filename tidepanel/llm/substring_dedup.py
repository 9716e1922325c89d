"""Repeated word windows, removed from all documents but the first, by level-wise doubling.

A window of n words can only repeat if the windows inside it do. So the first level looks at windows of about
half the wanted length, and only those found in two different texts are extended to twice that length, until the
wanted length is reached or no candidate survives. The first level reads a window's least-hashed part
only (equal windows have equal least parts, so nothing is lost): about a quarter of the positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.storage import Scratch
from tidepanel.llm.words import Chunk, Words, chunks, mix, signed, window_hashes, windows, word_hashes, words

WINDOW = 13
SHORTEST = 7


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the first level to ``window``, each at most twice the one before."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _parts(w: Words, hashes: np.ndarray, part: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``window`` words: where they begin, where their least part begins, and that part's hash by place."""
    at = windows(w, window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    span = window - part + 1
    every = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
    inner = windows(w, part)
    every[inner] = window_hashes(hashes, inner, part)
    seen = np.lib.stride_tricks.sliding_window_view(every, span)
    least = np.empty(len(at), np.int64)
    for a in range(0, len(at), 1 << 16):
        b = min(len(at), a + (1 << 16))
        least[a:b] = at[a:b] + seen[at[a:b]].argmin(axis=1)
    return at, least, every


def _scan(part: int, window: int):
    """Per document: words, the fingerprint of its word sequence, the digest of its words, its least parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                w = words(c.data, c.offsets)
                hashes = word_hashes(c.data, w)
                at, least, every = _parts(w, hashes, part, window)
                first = np.searchsorted(at, w.first)
                found, prints, digests = [], np.zeros((len(c.rows), 2), np.uint64), []
                for k, n in enumerate(w.counts):
                    found.append(np.unique(every[least[first[k]:first[k + 1]]]))
                    joined = b" ".join(c.text(k).split())
                    digest = hashlib.sha256(joined)
                    digests.append(digest.hexdigest())
                    prints[k] = np.frombuffer(digest.digest()[:16], np.uint64)
                counts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column("doc").slice(c.rows.start, len(c.rows)),
                    "n": pa.array(w.counts.astype(np.int64)),
                    "fp1": pa.array(signed(np.ascontiguousarray(prints[:, 0]))),
                    "fp2": pa.array(signed(np.ascontiguousarray(prints[:, 1]))),
                    "sha": pa.array(digests),
                    "parts": pa.ListArray.from_arrays(pa.array(counts), pa.array(signed(np.concatenate(found)))),
                })
    return run


def _survivors(c: Chunk, batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name).slice(c.rows.start, len(c.rows))
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _windows(part: int, lengths: list[int], last: int):
    """(h1, h2, doc, at): the windows of length ``last`` around surviving parts, by 96 bits of two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                w = words(c.data, c.offsets)
                hashes = word_hashes(c.data, w)
                at, least, every = _parts(w, hashes, part, lengths[1])
                doc = np.repeat(np.arange(len(c.rows)), w.counts)
                chosen, owner = signed(every[least]), doc[at]
                keep = np.zeros(len(at), dtype=bool)
                ends = np.searchsorted(owner, np.arange(len(c.rows) + 1))
                for k, alive in enumerate(_survivors(c, batch, "alive")):
                    if len(alive):
                        keep[ends[k]:ends[k + 1]] = np.isin(chosen[ends[k]:ends[k + 1]], alive)
                at = at[keep]
                at = at[at + last <= w.first[doc[at] + 1]]
                second = word_hashes(c.data, w, 1)
                ids = np.asarray(batch.column("doc").slice(c.rows.start, len(c.rows)))
                for a in range(0, len(at), 1 << 16):
                    some = at[a:a + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({
                        "h1": pa.array(signed(window_hashes(hashes, some, last))),
                        "h2": pa.array((window_hashes(second, some, last, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        "doc": pa.array(ids[doc[some]]),
                        "at": pa.array((some - w.first[doc[some]]).astype(np.int32)),
                    })
    return run


def _cut(window: int):
    """(doc, n_removed, sha, kept) of documents with windows to remove."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column("text")):
                removed, digests, texts = [], [], []
                for k, starts in enumerate(_survivors(c, batch, "starts")):
                    found = c.text(k).split()
                    cover = np.zeros(len(found) + window + 1, np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + window, -1)
                    gone = np.cumsum(cover)[:len(found)] > 0
                    left = b" ".join([x for x, g in zip(found, gone, strict=True) if not g])
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(left).hexdigest())
                    texts.append(left.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column("doc").slice(c.rows.start, len(c.rows)),
                    "n_removed": pa.array(removed, pa.int64()), "cut_sha": pa.array(digests, pa.string()),
                    "kept_text": pa.array(texts, pa.string())})
    return run


def repeated_windows_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                             with_text: bool = False) -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed``, ``kept_sha256`` and, if wanted, ``kept_text``.

    A word is removed if a window of ``window`` words over it also starts in a document with a smaller id; windows
    are judged on the input. Documents with the same word sequence are judged once: of those with at least
    one window all but the smallest id lose every word, and only the smallest id is compared with other texts.

    Null and empty texts have no words. A text of fewer words than a window keeps them all. Rows without an id
    are left out. Rows that repeat an id are one document: equal texts are judged alike, and no window of an
    id is removed for another row of that id. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    source = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    lengths = levels(window) if window > SHORTEST else [max(1, window - 1), window]
    scanned = scratch.store(source.mapInArrow(
        _scan(lengths[0], lengths[1]),
        "doc long, n long, fp1 long, fp2 long, sha string, parts array<long>"), "scanned")
    first = scanned.where(f"n >= {window}").groupBy("fp1", "fp2").agg(F.min("doc").alias("rep"))
    first = scratch.store(first, "first")

    # First level: least parts found in two different texts.
    parts = scanned.select("fp1", F.explode("parts").alias("part"))
    twice = parts.groupBy("part").agg(F.min("fp1").alias("one"), F.max("fp1").alias("other")).where("one <> other").select("part")
    alive = scratch.store(parts.join(twice, "part").groupBy("fp1").agg(F.collect_set("part").alias("alive")), "alive")
    texts = source.join(alive.join(first, "fp1").groupBy(F.col("rep").alias("doc")).agg(
        F.array_distinct(F.flatten(F.collect_list("alive"))).alias("alive")), "doc")
    candidates = scratch.store(texts, "texts")
    least = None
    for last in lengths[1:]:
        rows = candidates.mapInArrow(_windows(lengths[0], lengths, last), "h1 long, h2 int, doc long, at int")
        if least is not None:
            rows = rows.join(least, ["doc", "at"], "left_semi")
        rows = scratch.store(rows, f"windows-{last}")
        owners = rows.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("most")).where("owner < most")
        if last < window:
            least = scratch.store(rows.join(owners, ["h1", "h2"]).select("doc", "at"), f"alive-{last}")
    starts = scratch.store(
        rows.join(owners.select("h1", "h2", "owner"), ["h1", "h2"]).where("owner < doc")
        .groupBy("doc").agg(F.collect_set("at").alias("starts")), "starts")
    cut = scratch.store(candidates.select("doc", "text").join(starts, "doc").select("doc", "text", "starts").mapInArrow(
        _cut(window), "doc long, n_removed long, cut_sha string, kept_text string")
        .select(*(["doc", "n_removed", "cut_sha"] + ["kept_text"] * with_text)), "cut")
    scratch.drop(*(f"windows-{n}" for n in lengths[1:]))
    whole = scanned.select("doc", "n", "fp1", "fp2", "sha").join(first, ["fp1", "fp2"], "left").join(
        cut.withColumnRenamed("n_removed", "some"), "doc", "left")
    copy = F.coalesce(F.col("rep") < F.col("doc"), F.lit(False))
    out = whole.select(
        F.col("doc").alias(id_col), F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("some", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        *([copy.alias("_copy"), "kept_text"] if with_text else []))
    if not with_text:
        return out
    plain = source.select(F.col("doc").alias(id_col), F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")).alias("_all"))
    return out.join(plain.dropDuplicates([id_col]), id_col).select(
        id_col, "n_words", "n_removed", "kept_sha256",
        F.when(F.col("_copy"), "").otherwise(F.coalesce("kept_text", "_all", F.lit(""))).alias("kept_text"))
