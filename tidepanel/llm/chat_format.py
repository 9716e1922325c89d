"""Conversations as marked text with a loss mask, and back again, in Spark expressions.

A formatted conversation is a row of blocks ``<turn>role\\ntext</turn>``. Adjacent turns of one role are one block
with their texts apart by ``<next>``. In texts and roles ``\\`` is written ``\\b`` and ``<`` is written ``\\l`` (in roles
a line feed is ``\\n``), so no text can hold a mark, and what is read back is what went in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.storage import Scratch

OPEN, NEXT, CLOSE = "<turn>", "<next>", "</turn>"
LEARNED = "assistant"
WHOLE_ROWS = 1024
WHOLE_CHARS = 1 << 24
PART_ROWS = 64
BROADCAST_IDS = 1 << 20


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(_escaped(role), F.lit("\n"), F.lit("\\n"))


def _plain_role(role: Column) -> Column:
    return _plain(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _size(x: Column) -> Column:
    return F.length(x).cast("long")


def _merged(turns: Column) -> Column:
    """Sorted turns as blocks (role, texts); a turn joins the block before it if that has its role."""
    block = "array<struct<role:string,texts:array<string>>>"

    def step(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        own = F.struct(turn.role.alias("role"), F.array(turn.text).alias("texts"))
        longer = F.struct(last.role.alias("role"), F.concat(last.texts, F.array(turn.text)).alias("texts"))
        joins = F.when(F.size(blocks) > 0, last.role == turn.role).otherwise(F.lit(False))
        return F.when(joins, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))).otherwise(
            F.concat(blocks, F.array(own)))

    return F.aggregate(turns, F.array().cast(block), step)


def _mask(blocks: Column, learned: str) -> Column:
    """(start, size) in code points of each text of the learned role, in the formatted text."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,size:bigint>>").alias("spans"))

    def text(learns: Column, mark: str):
        def step(s: Column, x: Column) -> Column:
            span = F.struct(s.at.alias("start"), _size(x).alias("size"))
            return F.struct((s.at + _size(x) + len(mark)).alias("at"),
                            F.when(learns, F.concat(s.spans, F.array(span))).otherwise(s.spans).alias("spans"))
        return step

    def block(s: Column, b: Column) -> Column:
        begin = F.struct((s.at + len(OPEN) + _size(b.role) + 1).alias("at"), s.spans.alias("spans"))
        # The mark behind the last text is the closing one.
        done = F.aggregate(b.texts, begin, text(b.role == learned, NEXT))
        return F.struct((done.at - len(NEXT) + len(CLOSE)).alias("at"), done.spans.alias("spans"))

    return F.aggregate(blocks, state, block).spans


def _parts(rows: DataFrame) -> DataFrame:
    """(conv, part, row) of every row. A conversation is one part (null) unless it is very long; such a one is put in
    order by ranges, so that no task holds it, and cut every ``PART_ROWS`` rows. Equal rows are counted first."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("rows"), F.sum(_size(F.col("row.text"))).alias("chars"))
    long_ones = sizes.where((F.col("rows") > WHOLE_ROWS) | (F.col("chars") > WHOLE_CHARS)).select(F.col("conv").alias("long_conv"))
    long_ones = Scratch(rows.sparkSession, "long-conversations").store(long_ones, "ids")
    if long_ones.count() <= BROADCAST_IDS:  # then the texts need not be shuffled for it
        long_ones = F.broadcast(long_ones)
    same = F.col("conv").eqNullSafe(F.col("long_conv"))
    whole = rows.join(long_ones, same, "left_anti").withColumn("part", F.lit(None).cast("long"))
    counted = rows.join(long_ones, same, "left_semi").groupBy("conv", "row").agg(F.count("*").alias("copies"))
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PART_ROWS))))
    times = F.least(F.lit(PART_ROWS).cast("long"), F.col("copies") - F.col("piece") * PART_ROWS).cast("int")
    order = ["conv", "row", "piece"]
    # An id that grows along the ranges; it is written before it is used, so it is given once.
    placed = pieces.select(*order, times.alias("times")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id())
    placed = Scratch(rows.sparkSession, "long-conversations").store(placed, "placed")
    cut = placed.select("conv", F.explode(F.array_repeat("row", F.col("times"))).alias("row"),
                        F.expr(f"at div {PART_ROWS}").alias("part"))
    return whole.select("conv", "row", "part").unionByName(cut)


def format_conversations(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", learned: str = LEARNED) -> DataFrame:
    """(conv_id, part, formatted, mask): the marked text of each conversation and the places that a model learns from.

    Turns go by ``turn``, nulls first; turns with the same number by role and text, so repeated rows follow one another
    and each of them is kept. Null texts and roles are empty. Rows without an id are one conversation, whose id is null.
    An empty table gives no rows; other columns are ignored. ``part`` is null for a whole conversation. One of more
    than 1,024 rows or 16 Mi characters comes in parts of up to 4,096 rows whose texts make up the whole in the order of
    ``part``; there turns of one role are merged within a part. ``mask`` lists (start, size) in code points of each text of
    the learned role in ``formatted``, without the marks around it.
    """
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = _parts(conversations.select(F.col(id_col).cast("long").alias("conv"), row.alias("row")))
    turns = parts.groupBy("conv", "part").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    marked = F.transform("turns", lambda t: F.struct(_escaped_role(t.role).alias("role"), _escaped(t.text).alias("text")))
    blocks = turns.withColumn("blocks", _merged(marked))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(OPEN), b.role, F.lit("\n"), F.array_join(b.texts, NEXT), F.lit(CLOSE))), "")
    return blocks.select(F.col("conv").alias(id_col), "part", formatted.alias("formatted"), _mask(F.col("blocks"), learned).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text was made of."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(OPEN) + 1, 1 << 30), "\n", 1)
        texts = F.split(F.substr(block, F.length(role) + len(OPEN) + 2), NEXT)
        return F.transform(texts, lambda t: F.struct(_plain_role(role).alias("role"), _plain(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_mask(formatted: Column, mask: Column) -> Column:
    """The text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: _plain(F.substr(formatted, (s.start + 1).cast("int"), s.size.cast("int")))), "")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order to one row a conversation; only the state of the two hashes is held."""
    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**sums, "conv": conv, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}],
                                          schema=_HASHED)

    started, conv, sums, turns, loss = False, None, {}, None, None
    for batch in batches:
        for part in batch.to_pylist():
            if not started or part["conv"] != conv:
                if started:
                    yield row()
                started, conv, turns, loss = True, part["conv"], hashlib.sha256(), hashlib.sha256()
                sums = {"n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
            turns.update(part["turns_text"].encode())
            loss.update(part["loss_text"].encode())
            for name in sums:
                sums[name] += part[name]
    if started:
        yield row()


_HASHED = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its formatted text: turns, hashes of turns and of the learned text, sizes.

    ``turns_sha256`` is that of role, line feed, text, line feed of each turn in order; ``loss_sha256`` that of the text
    under the mask. A hash of a text in parts needs them one after another: those alone are streamed through Python.
    """
    turns = read_turns(F.col("formatted"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = formatted.select(
        F.col(id_col).alias("conv"), "part", F.size(turns).cast("long").alias("n_turns"), text.alias("turns_text"),
        read_mask(F.col("formatted"), F.col("mask")).alias("loss_text"), _size(F.col("formatted")).alias("formatted_chars"))
    read = read.withColumn("loss_chars", _size(F.col("loss_text")))
    whole = read.where("part is null").select(
        "conv", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), "loss_chars",
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")
    parts = read.where("part is not null").repartition("conv").sortWithinPartitions("conv", "part")
    hashed = parts.mapInArrow(_hash, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    both = whole.unionByName(hashed)
    return both.withColumnRenamed("conv", id_col)


def conversations_round_trip(conversations: DataFrame) -> DataFrame:
    """Write the formatted conversations to the shared folder and read them back."""
    files = Scratch(conversations.sparkSession, "chat").store(format_conversations(conversations), "formatted")
    return conversation_digests(files)
