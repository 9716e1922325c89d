"""Token ids of whole texts in grammar-compressed shards (Re-Pair), readable from any token on.

A shard is one row of a Parquet table with these little-endian arrays:
``docs`` int64 ids, ``first_symbol`` int64 (docs + 1) places in the sequence, ``terminals`` uint32 token ids of the first
symbols, ``rules`` uint32 pairs (symbol ``len(terminals) + k`` stands for pair k, whose parts come before it),
``lengths`` uint32 tokens that each symbol expands to, ``sequence`` uint16 or uint32 symbols (``width`` bytes each).
No rule spans two documents, so each document is decoded alone, and sums of ``lengths`` find any token.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.llm.storage import Scratch
from tidepanel.llm.words import Chunk, Words, chunks, word_hashes, words

END = 0
SHARD_TOKENS = 1 << 20
LEAST_COUNT = 7  # a rule takes twelve bytes, as six symbols do
CACHE_PIECES = 2_000_000
_JOINED = 2000
_BATCH_TEXT = 1 << 22

SHARD = ("part long, seq int, n_tokens long, docs binary, first_symbol binary, terminals binary, rules binary, "
         "lengths binary, width int, sequence binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ONLY_SPACE = np.zeros(256, dtype=bool)
_ONLY_SPACE[0x20] = True
_ASCII_WHITE = np.zeros(256, dtype=bool)
_ASCII_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def space_after_white(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents have a space after white space of any kind, or at their begin or end."""
    padded = np.concatenate([np.zeros(3, np.uint8), data])
    at = np.flatnonzero(data == 0x20)
    a, b, c = padded[at + 2], padded[at + 1], padded[at]  # the bytes before, nearest first
    bad = _ASCII_WHITE[a]
    bad |= (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80)
    bad |= (c == 0xE2) & (b == 0x80) & ((a >= 0x80) & (a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    bad |= (c == 0xE2) & (b == 0x81) & (a == 0x9F) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
    out = np.zeros(len(offsets) - 1, dtype=bool)
    out[np.searchsorted(offsets, at[bad], "right") - 1] = True
    some = np.flatnonzero(np.diff(offsets))
    out[some] |= (data[offsets[some]] == 0x20) | (data[offsets[some + 1] - 1] == 0x20)
    return out


class Encoder:
    """Whole texts to ids. A byte-level vocabulary starts a new piece at every single space, whatever stands before
    it, so texts are cut there, and each piece is encoded once while it stays in the cache. A piece is known by 96
    bits of two hashes. Texts in which a space follows white space or that hold the string of an added token, and
    other kinds of tokenizer, are encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces are kept here; keeping them there as well costs a third of the time
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        self.added = [x["content"].encode() for x in plan.get("added_tokens") or [] if x["content"]]
        pre = plan.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not plan.get("normalizer")
        self.cuts = self.cuts and not any(b" " in x for x in self.added)  # pieces are put together with spaces
        self._forget()
        if self.cuts:
            vocabulary = self.tokenizer.get_vocab()  # one character for each byte
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.sizes[list(vocabulary.values())] = [len(x) for x in vocabulary]

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.first, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)  # places in ``flat``
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces with their space before them, one after another, and how many each has. Many pieces are
        encoded as one text, which is cut at their bytes again; odd ones are encoded alone."""
        flat, many = [], []
        for a in range(0, len(pieces), _JOINED):
            some = pieces[a:a + _JOINED]
            if all(p == p.strip() for p in some):
                ids = self._whole([" " + " ".join(some)])[0]
                ends = np.cumsum(np.fromiter(map(len, map(str.encode, some)), np.int64, len(some)) + 1)
                so_far = np.cumsum(self.sizes[ids])
                at = np.searchsorted(so_far, ends) + 1
                if (so_far[at - 1] == ends).all():
                    flat.append(ids)
                    many.append(np.diff(at, prepend=0))
                    continue
            alone = self._whole([" " + p for p in some])
            flat += alone
            many.append(np.array([len(x) for x in alone], np.int64))
        return np.concatenate(flat), np.concatenate(many)

    def _room(self, more: int) -> None:
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(self.used + 2 * more, np.uint32)])

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[str]) -> None:
        ids, many = self._pieces(pieces)
        self._room(len(ids))
        self.flat[self.used:self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        first = self.used + np.cumsum(many) - many
        for name, new in (("keys", keys), ("checks", checks), ("first", first), ("many", many)):
            setattr(self, name, np.insert(getattr(self, name), at, new))
        self.used += len(ids)

    def _with_added(self, c: Chunk) -> np.ndarray:
        """Which documents of a chunk hold the string of an added token."""
        out, data = np.zeros(len(c.rows), dtype=bool), c.data.tobytes()
        for mark in self.added:
            at = data.find(mark)
            while at >= 0:
                k = int(np.searchsorted(c.offsets, at, "right")) - 1
                if at + len(mark) <= c.offsets[k + 1]:  # not over the end of a text
                    out[k] = True
                    at = data.find(mark, int(c.offsets[k + 1]))
                else:
                    at = data.find(mark, at + 1)
        return out

    def encode(self, c: Chunk) -> list[np.ndarray]:
        """Ids of each text of a chunk, without the end id."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(c.rows)
        odd = space_after_white(c.data, c.offsets) | self._with_added(c) if self.cuts else np.ones(len(c.rows), dtype=bool)
        whole = np.flatnonzero(odd & (np.diff(c.offsets) > 0)).tolist()
        for k, ids in zip(whole, self._whole([c.text(k).decode() for k in whole]), strict=True):
            out[k] = ids
        w = words(c.data, c.offsets, _ONLY_SPACE)
        head = np.zeros(len(w.starts), dtype=bool)
        head[w.first[:-1][w.counts > 0]] = True
        piece = np.flatnonzero(~head & ~odd[w.doc])
        fine = np.flatnonzero((w.counts > 0) & ~odd)
        heads = self._whole([c.data[w.starts[w.first[k]]:w.ends[w.first[k]]].tobytes().decode() for k in fine])
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        spans = Words(w.starts[piece], w.ends[piece], np.zeros(1, np.int64))
        keys = word_hashes(c.data, spans)
        checks = (word_hashes(c.data, spans, 1) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(keys)
        edge = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else order
        kind = np.empty(len(keys), np.int64)
        kind[order] = np.repeat(np.arange(len(edge)), np.diff(edge, append=len(keys)))
        one, own = order[edge], keys[order[edge]]
        at = np.minimum(np.searchsorted(self.keys, own), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != own) if len(self.keys) else np.arange(len(own))
        if len(new):
            texts = [c.data[a:b].tobytes().decode() for a, b in zip(spans.starts[one[new]].tolist(), spans.ends[one[new]].tolist(), strict=True)]
            self._learn(own[new], checks[one[new]], texts)
            at = np.searchsorted(self.keys, own)
        same = self.checks[at[kind]] == checks if len(keys) else np.zeros(0, dtype=bool)
        if not same.all():  # two pieces with one key: such texts are encoded as a whole
            for k in set(w.doc[piece[~same]].tolist()):
                out[k] = self._whole([c.text(k).decode()])[0]
                odd[k] = True
        # One row of (place, length) for each word of the texts that were cut, heads behind the cache.
        first, many = np.zeros(len(w.starts), np.int64), np.zeros(len(w.starts), np.int64)
        first[piece], many[piece] = self.first[at[kind]], self.many[at[kind]]
        size = np.array([len(x) for x in heads], np.int64)
        begin = self.used + np.cumsum(size) - size
        self._room(int(size.sum()))
        self.flat[self.used:self.used + int(size.sum())] = np.concatenate(heads) if heads else 0
        first[w.first[fine]], many[w.first[fine]] = begin, size
        ends = np.cumsum(many)
        ids = self.flat[np.repeat(first - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate([[0], ends])
        for k in fine.tolist():
            if not odd[k]:
                out[k] = ids[stops[w.first[k]]:stops[w.first[k + 1]]]
        return out


def _maybe_frequent(pairs: np.ndarray) -> np.ndarray:
    """Leaves out pairs that a count of hashed buckets already shows to be rare."""
    bits = max(10, int(len(pairs)).bit_length())
    bucket = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(bucket, minlength=1 << bits)[bucket] >= LEAST_COUNT


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs, how often each stands, and the kind of every given one."""
    order = np.argsort(pairs)
    held = pairs[order]
    edge = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1], [True]]))
    kind = np.empty(len(pairs), np.int64)
    kind[order] = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    return held[edge[:-1]], np.diff(edge), kind


def _every_other(at: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Of places whose symbol equals the next one: every second one of each run, from its left."""
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (seq[at[1:]] != seq[at[:-1]])])
    first = at[new][np.cumsum(new) - 1]
    return at[(at - first) % 2 == 0]


def compress(ids: np.ndarray, ends: np.ndarray) -> dict:
    """Re-Pair over one shard. ``ends`` marks the last token of each document.

    Rounds go on until no pair stands ``LEAST_COUNT`` times, below which a rule takes more than it saves. In a round every
    place with a frequent pair is replaced unless a place that overlaps it has a more frequent one; of a run of equal
    symbols every second place is taken, from its left. A pair gets a rule if that is so ``LEAST_COUNT`` times, as it always
    is for the most frequent one. A pair that is rare stays so, as new pairs hold a new symbol; a round looks at places of
    new and of frequent pairs only.
    """
    terminals = np.flatnonzero(np.bincount(ids))
    place = np.zeros(terminals[-1] + 1, np.uint32)
    place[terminals] = np.arange(len(terminals))
    seq, ends = place[ids].astype(np.int32), ends.copy()
    rules: list[np.ndarray] = []
    n = len(terminals)
    look = np.flatnonzero(~ends[:-1])  # where a pair begins that may be frequent
    while True:
        pairs = seq[look].astype(np.int64) << 32 | seq[look + 1]
        some = _maybe_frequent(pairs)
        look, pairs = look[some], pairs[some]
        equal = seq[look] == seq[look + 1]
        if equal.any():
            free = ~equal
            free[np.searchsorted(look, _every_other(look[equal], seq))] = True
            look, pairs = look[free], pairs[free]
        if not len(look):
            break
        kinds, count, kind = _counted(pairs)
        rank = np.empty(len(kinds), np.int32)
        rank[np.argsort(count, kind="stable")] = np.arange(1, len(kinds) + 1)
        rank[count < LEAST_COUNT] = 0
        if not rank.any():
            break
        best = np.zeros(len(seq) + 1, np.int32)
        best[look] = rank[kind]
        own = best[look]
        wins = (own > best[look + 1]) & (own > best[look - 1])  # before the first place lies the last one, a 0
        chosen = np.bincount(kind[wins], minlength=len(kinds)) >= LEAST_COUNT
        wins &= chosen[kind]
        at = look[wins]
        wanted = np.zeros(len(seq), dtype=bool)
        wanted[look[own > 0]] = True  # frequent pairs that are left come again
        seq[at] = (np.cumsum(chosen) - 1 + n)[kind[wins]]
        ends[at] = ends[at + 1]
        wanted[at] = True
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        before = at[at > 0] - 1
        wanted[np.where(keep[before], before, before - 1)] = True
        seq, ends, wanted = seq[keep], ends[keep], wanted[keep]
        rules.append(np.stack([kinds[chosen] >> 32, kinds[chosen] & 0xFFFFFFFF], axis=1))
        n += int(chosen.sum())
        look = np.flatnonzero(wanted[:-1] & ~ends[:-1])
    lengths = np.ones(n, np.int64)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    done = len(terminals)
    for parts in rules:
        lengths[done:done + len(parts)] = lengths[parts].sum(axis=1)
        done += len(parts)
    width = 2 if n <= 1 << 16 else 4
    return {"first_symbol": np.concatenate([[0], np.flatnonzero(ends) + 1]).astype("<i8").tobytes(),
            "terminals": terminals.astype("<u4").tobytes(), "rules": pairs.astype("<u4").tobytes(),
            "lengths": lengths.astype("<u4").tobytes(), "width": width, "sequence": seq.astype(f"<u{width}").tobytes()}


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, as many as its ``size``, one after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """Reads one row of the files."""

    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["docs"], "<i8")
        self.first_symbol = np.frombuffer(row["first_symbol"], "<i8")
        self.sequence = np.frombuffer(row["sequence"], f"<u{row['width']}")
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.terminals = np.frombuffer(row["terminals"], "<u4")
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of all symbols one after another, and where each begins. Rules whose parts are all known are
        expanded together."""
        if self._flat is None:
            first = np.concatenate([[0], np.cumsum(self.lengths)])
            flat = np.empty(first[-1], np.uint32)
            base, done = len(self.terminals), 0
            flat[:base] = self.terminals
            newest = np.maximum.accumulate(self.rules.max(axis=1)) if len(self.rules) else np.zeros(0, np.int64)
            while done < len(self.rules):
                stop = int(np.searchsorted(newest, base + done))
                parts = self.rules[done:stop].reshape(-1)
                flat[first[base + done]:first[base + stop]] = flat[_places(first[parts], self.lengths[parts])]
                done = stop
            self._flat = flat, first
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, first = self._table()
        return flat[_places(first[symbols], self.lengths[symbols])]

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.sequence[self.first_symbol[k]:self.first_symbol[k + 1]])

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Tokens of the shard from ``start`` to ``stop``; only the symbols that cover them are expanded."""
        ends = np.cumsum(self.lengths[self.sequence])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(self.sequence[a:b])[start - before:stop - before]


def _write(shared, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = shared.value  # stays with the Python process, so pieces are encoded once in it
        encoder = box.get("encoder") or box.setdefault("encoder", Encoder(box["path"]))
        docs, ids, size, part, seq = [], [], 0, None, 0

        def shard() -> pa.RecordBatch:
            ends = np.zeros(size, dtype=bool)
            ends[np.cumsum([len(x) for x in ids]) - 1] = True
            row = {"part": part, "seq": seq, "n_tokens": size, "docs": np.array(docs, "<i8").tobytes()}
            row |= compress(np.concatenate(ids), ends)
            return pa.RecordBatch.from_pylist([row], schema=_SHARD_ARROW)

        for batch in batches:
            ids_of = batch.column("doc").to_pylist()
            for c in chunks(batch.column("text"), _BATCH_TEXT):
                for doc, found in zip(ids_of[c.rows.start:c.rows.stop], encoder.encode(c), strict=True):
                    part = doc if part is None else part
                    docs.append(doc)
                    ids.append(np.append(found, np.uint32(END)))
                    size += len(found) + 1
                    if size >= shard_tokens:
                        yield shard()
                        docs, ids, size, seq = [], [], 0, seq + 1
        if docs:
            yield shard()
    return run


_SHARD_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t])
                          for n, t in (x.split() for x in SHARD.split(", "))])


def token_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode whole texts, append the end id to each, and make shards in ascending order of the id.

    Null and empty texts are the end id alone. Rows without an id are left out; rows with the same id follow one
    another in the order of their texts. Other columns are ignored. An empty table gives no shards. A shard ends
    with the document that fills it, so a very long text is a long shard of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"path": tokenizer or default_tokenizer()})
    ordered = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).repartitionByRange("doc").sortWithinPartitions("doc", "text")
    return ordered.mapInArrow(_write(shared, shard_tokens), SHARD)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1).to_pylist()[0]
            shard = Shard(row)
            ids = memoryview(shard.expand(shard.sequence).astype("<u4").tobytes())
            stops = np.concatenate([[0], np.cumsum(shard.lengths[shard.sequence])])[shard.first_symbol]
            sums = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc": pa.array(shard.docs), "start": pa.array(row["start"] + stops[:-1]), "n_tokens": pa.array(np.diff(stops)),
                "ids_crc32": pa.array(sums, pa.int64())})


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids_crc32``.

    Starts are sums within each range of ids first, then over the ranges, of which there are as many as write tasks.
    """
    within = Window.partitionBy("part").orderBy("seq")
    local = files.withColumn("before", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    ranges = files.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    ranges = ranges.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    placed = local.join(ranges, "part").withColumn("start", F.col("base") + F.col("before"))
    out = placed.mapInArrow(_read, "doc long, start long, n_tokens long, ids_crc32 long")
    return out.select(F.col("doc").alias(id_col), "start", "n_tokens", "ids_crc32")


def token_files_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back."""
    return read_token_files(Scratch(docs.sparkSession, "token-files").store(token_shards(docs, id_col, text_col), "files"), id_col)
