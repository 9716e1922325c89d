"""Packing by optimal length buckets.

A dynamic programme over the histogram of all lengths chooses the bucket boundaries with the least padding; batches
that hold at most a budget of (padded) tokens are then filled inside each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.storage import Scratch
from tidepanel.llm.token_files import Encoder, default_tokenizer
from tidepanel.llm.words import chunks

BUCKETS = 8
LONGEST = 2048
BUDGET = 32768
SLICE_ROWS = 100_000


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """At most ``buckets`` lengths to pad to, with the least padding in all; among equals the least boundaries.

    With lengths l1 < l2 < ... the cost of padding lengths i+1..j to lj follows from sums of counts and of tokens.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    n = len(lengths)
    many, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    back = []
    for _ in range(min(buckets, n)):
        now, came = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        for j in range(1, n + 1):
            cost = best[:j] + (lengths[j - 1] * (many[j] - many[:j]) - (tokens[j] - tokens[:j]))
            came[j] = int(cost.argmin())
            now[j] = cost[came[j]]
        best = now
        back.append(came)
    out, j = [], n
    for came in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(came[j])
    return sorted(out)


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = shared.value  # stays with the Python process
        encoder = box.get("encoder") or box.setdefault("encoder", Encoder(box["path"]))
        for batch in batches:
            sizes = [len(ids) for c in chunks(batch.column("text")) for ids in encoder.encode(c)]
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "n_tokens": pa.array(sizes, pa.int64())})
    return run


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, ``n_tokens``) of each row in one pass, by the tokenizer of the token files; null and empty texts have none.

    All rows are returned, also repeated ones and those without an id. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"path": tokenizer or default_tokenizer()})
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(_count(shared), "doc long, n_tokens long").select(F.col("doc").alias(id_col), "n_tokens")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
         buckets: int = BUCKETS, longest: int = LONGEST, budget: int = BUDGET) -> DataFrame:
    """(id, segment, first_token, length, bucket, batch, slot): where each piece of each document goes.

    A document's length is ``length_col`` or else its number of words between white space; one above ``longest`` is
    cut into segments of that length and a rest, so no token is dropped and the histogram that the driver reads has
    at most ``longest`` rows. ``bucket`` is the length to pad to, ``batch`` counts from 0 in each bucket, ``slot`` in each
    batch; a batch times its bucket stays within ``budget`` (one sequence, if a bucket alone is above it).

    Documents without words (null, empty) have one row of length 0 in bucket 0 without batch. Rows without an id
    are left out; repeated rows are packed as often as they come. Other columns are ignored. An empty table gives
    an empty result. Places are numbered in slices of ``SLICE_ROWS`` rows chosen by a hash of the id and the row's
    place, with the slices' totals added, so that no bucket is one task.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    size = F.coalesce(F.col(length_col), F.lit(0)).cast("long") if length_col else words.cast("long")
    sized = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), size.alias("size"))
    pieces = sized.select("doc", "size", F.explode(F.expr(f"sequence(0L, greatest(0L, cast(ceil(size / {longest}) as long) - 1))")).alias("segment"))
    pieces = scratch.store(pieces.select(
        "doc", "segment", (F.col("segment") * longest).alias("first_token"),
        F.least(F.lit(longest).cast("long"), F.col("size") - F.col("segment") * longest).alias("length")), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = sum(counts.values())
    edges = boundaries({k: v for k, v in counts.items() if k > 0}, buckets)
    bucket = F.expr("filter(array({}), e -> e >= length)[0]".format(", ".join(f"{e}L" for e in edges)) if edges else "0L")
    slices = max(1, -(-rows // SLICE_ROWS))
    placed = pieces.withColumn("bucket", F.when(F.col("length") > 0, bucket).otherwise(F.lit(0)).cast("long")).withColumn(
        "slice", F.pmod(F.xxhash64("doc", "segment"), F.lit(slices)))
    totals = placed.groupBy("bucket", "slice").count()
    offsets = totals.select("bucket", "slice", (
        F.sum("count").over(Window.partitionBy("bucket").orderBy("slice")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("doc", "segment", "length"))
    numbered = placed.withColumn("rank", rank).join(offsets, ["bucket", "slice"]).withColumn(
        "at", F.col("before") + F.col("rank") - 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket")))).cast("long")
    used = F.col("length") > 0
    return numbered.select(
        F.col("doc").alias(id_col), "segment", "first_token", "length", "bucket",
        F.when(used, F.floor(F.col("at") / room)).cast("long").alias("batch"),
        F.when(used, F.col("at") % room).cast("long").alias("slot"))
