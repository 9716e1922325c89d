"""Tokens of two vocabularies laid over the same bytes, and how often each pair of ids meets in the corpus.

Tasks encode documents and keep (pair, document, times) records. A full memory is a run: its records, side-major (by id
of B, then of A), are cut by the low bits of the B id into parts, and each part is a row of zstd bytes, heads (pairs and
their sums) apart from bodies (documents). The heads of a part from all runs go through k-way heap merges, many at a time
and level by level, until there is one list of pairs with their counts; as it is side-major, the highest count of each B id
is known when its pairs have gone by. At last the lists stream past the bodies, part by part, and each record gives
its document its share. Bodies are dealt by run, so a pair that every document has lands in no single task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.storage import Scratch

PARTS = 64
RUN_RECORDS = 1 << 21
FAN_IN = 64
SLICE_BYTES = 1 << 25
CACHE_BYTES = 128 << 20
PIECE_WORDS = 1 << 17
_JOINED = 2000
RUN_DOCS = 1 << 16
GROUP_CHARS = 1 << 19

_DOC_BITS = 20  # documents of a run
_WHITE = r"\s᠎▁"
_ODD = re.compile(rf"[{_WHITE}] | [{_WHITE}]|^ | $")
_CUT = re.compile(rf"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _bytes_of_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others
    follow from 256 on in their order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both encodings of words, and what follows from them; a word is worked out once while it stays in the cache.

    Both vocabularies start a token at every single space between other characters: pieces of the byte-level one begin
    with their space, and no piece of the other has its space mark behind another character (looked up, else texts are
    taken whole). So texts are cut there, and groups and links never reach over a cut.
    """

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of = _bytes_of_characters()
        size_a = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        names = [self.a.id_to_token(k) or "" for k in range(size_a)]
        self.bytes_a = [bytes(map(of.__getitem__, x)) if all(c in of for c in x) else x.encode() for x in names]
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode()
                        for k, x in enumerate(names)]
        # Id 2k is k with a comma, 2k + 1 is k with the sign behind the last one of a group.
        self.names = {side: np.array([f"{k}{x}" for k in range(n) for x in ("," + sign)], object)
                      for side, n, sign in (("a", size_a, "|"), ("b", len(names), ";"))}
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.cuts = not any("▁" in x.lstrip("▁") for x in names)
        self.quick = self._ranked(byte_level)
        # Side-major, the part first: low bits of the B id, its other bits, the A id.
        self.bits_a = max(1, (size_a - 1).bit_length())
        self.bits_b = max(1, (len(names) - 1).bit_length())
        assert self.bits_a + self.bits_b + _DOC_BITS < 64
        self._forget()

    def _ranked(self, path: str):
        """The same encoder as ranks of bytes, several times as fast, if the file is one: merges in the order of their ids
        after the bytes, and the usual byte-level pattern. Else None."""
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        model, pre = plan["model"], plan.get("pre_tokenizer") or {}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        if (plan.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space")
                or [model["vocab"].get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs)))):
            return None
        ranks = {self.bytes_a[k]: k for k in range(256 + len(pairs))}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick:
            return [self.quick.encode_ordinary(x) for x in texts]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.shown: list[str] = []
        # A row a word: tokens of A and B, groups, links, place of its first link, whether its bytes come back.
        self.facts, self.links, self.used = np.zeros((1024, 6), np.int64), np.zeros(1 << 14, np.int64), 0

    def _keep(self, words: list[str], shown: list[str], facts: np.ndarray, links: np.ndarray) -> None:
        n = len(self.index)
        while n + len(words) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        while self.used + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.facts[n:n + len(words)] = facts
        self.facts[n:n + len(words), 4] += self.used
        self.links[self.used:self.used + len(links)] = links
        self.used += len(links)
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        self.shown += shown
        self.held += 300 * len(words) + 8 * len(links) + sum(map(len, words)) + sum(map(len, shown))

    def words(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = b & (PARTS - 1), b // PARTS
        return (low << (self.bits_b + self.bits_a)) | (high << self.bits_a) | a

    def learn(self, words: list[str]) -> None:
        """Align words that are not in the cache yet: many as one text, which is cut at their bytes again. Words that
        begin or end in white space, and those of a text that does not come back, are encoded alone."""
        plain = [w for w in words if w and w == w.strip()] if self.cuts else []
        for k in range(0, len(plain), _JOINED):
            some = plain[k:k + _JOINED]
            text = " ".join(some)
            if not self._align(some, self._ids_a([" " + text])[0], self.b.encode(text)):
                self._alone(some)
        if len(plain) < len(words):
            self._alone([w for w in words if not w or w != w.strip()] if self.cuts else words)

    def _alone(self, words: list[str]) -> None:
        ids_b = self.b.encode(words, num_threads=1)
        for w, a, b in zip(words, self._ids_a([" " + w for w in words]), ids_b, strict=True):
            if not self._align([w], a, b):
                self._keep([w], [""], np.zeros((1, 6), np.int64), np.zeros(0, np.int64))

    def _align(self, words: list[str], ids_a: list[int], ids_b: list[int]) -> bool:
        """Groups and links of words that were encoded together; False if bytes differ or a cut is inside a token."""
        raw = "".join(" " + w for w in words).encode()
        if not raw == b"".join(map(self.bytes_a.__getitem__, ids_a)) == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            return False
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        stops = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(ends_a, ends_b)  # between two of them lies one link
        keys = self.key(a[np.searchsorted(ends_a, ends)], b[np.searchsorted(ends_b, ends)])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_group = np.searchsorted(both, stops)
        if last_group[-1] == len(both) or not (both[last_group] == stops).all():
            return False
        last = np.stack([np.searchsorted(x, stops, "right") for x in (ends_a, ends_b, both, ends)], axis=1)
        counts = np.diff(last, axis=0, prepend=0)
        facts = np.column_stack([counts, last[:, 3] - counts[:, 3], np.ones(len(words), np.int64)])
        # Tokens of A and then of B, group by group, each with the sign behind it.
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        before_b, upto_a = np.searchsorted(group_b, group_a), np.searchsorted(group_a, group_b, "right")
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + before_b] = self._signed("a", a, both[group_a] == ends_a)
        shown[np.arange(len(b)) + upto_a] = self._signed("b", b, both[group_b] == ends_b)
        at = last[:, 0] + last[:, 1] - 1  # the last token of each word
        shown[at] = [x[:-1] + "\n" for x in shown[at].tolist()]
        self._keep(words, "".join(shown.tolist()).split("\n")[:-1], facts, keys)
        return True

    def _signed(self, side: str, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.names[side][ids * 2 + ends]

    def numbers(self, words: list[str]) -> list[int]:
        """The place of each word in the cache."""
        try:
            return list(map(self.index.__getitem__, words))
        except KeyError:
            self.learn([w for w in dict.fromkeys(words) if w not in self.index])
            return list(map(self.index.__getitem__, words))

    def prepared(self, texts: list[str]) -> list[list[str]]:
        """The words of some texts, those that are new learned together."""
        if self.held > CACHE_BYTES:
            self._forget()
        words = [self.words(x) if x else [] for x in texts]
        new = dict.fromkeys(w for some in words for w in some[:PIECE_WORDS] if w not in self.index)
        if new:
            self.learn(list(new))
        return words

    def align(self, text: str, words: list[str] | None = None) -> tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]:
        """((A tokens, B tokens, groups, links), hash of the groups, pairs, how often each is linked); a pair that
        several words have comes several times."""
        none = (0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        words = words or self.prepared([text])[0]
        digest, sums = hashlib.sha256(), np.zeros(4, np.int64)
        keys, times = [], []
        for k in range(0, len(words), PIECE_WORDS):  # a very long text some words at a time
            at = self.numbers(words[k:k + PIECE_WORDS])
            kinds, many = np.unique(np.array(at, np.int64), return_counts=True)
            facts = self.facts[kinds]
            if not facts[:, 5].all():
                return none if words == [text] else self._whole(text)
            digest.update(((";" if k else "") + ";".join(map(self.shown.__getitem__, at))).encode())
            sums += many @ facts[:, :4]
            n = facts[:, 3]
            ends = np.cumsum(n)
            keys.append(self.links[np.repeat(facts[:, 4] - (ends - n), n) + np.arange(ends[-1])])
            times.append(np.repeat(many, n))
        return tuple(sums.tolist()), digest.hexdigest(), np.concatenate(keys), np.concatenate(times)

    def _whole(self, text: str) -> tuple[tuple[int, int, int, int], str, np.ndarray, np.ndarray]:
        """A text with a word that does not come back on its own is judged as one word."""
        cuts, self.cuts = self.cuts, False
        try:
            return self.align(text)
        finally:
            self.cuts = cuts


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative numbers, each in the narrowest width that holds it, as zstd bytes."""
    out = []
    for x in arrays:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
        out.append(np.array([len(x), width], "<i8").tobytes() + x.astype(f"<u{width}").tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpacked(raw: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(raw), [], 0
    while at < len(data):
        n, width = np.frombuffer(data, "<i8", 2, at).tolist()
        out.append(np.frombuffer(data, f"<u{width}", n, at + 16).astype(np.int64))
        at += 16 + n * width
    return out


# One table holds the documents and the parts of the runs; ``kind`` tells them apart.
_RUNS = pa.schema([
    ("kind", pa.string()), ("run", pa.int64()), ("part", pa.int32()), ("at", pa.int32()), ("doc", pa.int64()),
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string()),
    ("head", pa.binary()), ("body", pa.binary())])
_RUNS_DDL = ("kind string, run long, part int, at int, doc long, n_a long, n_b long, n_groups long, n_links long, sha string, "
             "head binary, body binary")


def _prepared(batch: pa.RecordBatch, aligner: Aligner) -> Iterator[tuple[int | None, str, list[str]]]:
    """(document, text, words) of a batch, about ``GROUP_CHARS`` of text looked up together."""
    group: list[tuple[int | None, str]] = []
    size = 0
    for k, (doc, text) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True), 1):
        group.append((doc, text.as_py() or ""))
        size += len(group[-1][1])
        if size >= GROUP_CHARS or k == len(batch):
            for (one, own), words in zip(group, aligner.prepared([x for _, x in group]), strict=True):
                yield one, own, words
            group, size = [], 0


def _encode(shared, run_records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        box = shared.value  # stays with the Python process, and so does the cache of words
        aligner = box.get("aligner") or box.setdefault("aligner", Aligner(*box["paths"]))
        number = TaskContext.get().partitionId() << 32
        docs: list[dict] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        records = 0

        def rows() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pylist(docs, schema=_RUNS)
            yield pa.RecordBatch.from_pylist(list(_run_rows(held, number, aligner)), schema=_RUNS)

        for doc, text, words in (x for batch in batches for x in _prepared(batch, aligner)):
            n, sha, keys, times = aligner.align(text, words)
            docs.append({"kind": "doc", "run": number, "at": len(docs), "doc": doc, "sha": sha,
                         **dict(zip(("n_a", "n_b", "n_groups", "n_links"), n))})
            held.append((keys, times))
            records += len(keys)
            if records >= run_records or len(docs) == RUN_DOCS:
                yield from rows()
                docs, held, records, number = [], [], 0, number + 1
        if docs:
            yield from rows()
    return run


def _run_rows(held: list[tuple[np.ndarray, np.ndarray]], number: int, aligner: Aligner) -> Iterator[dict]:
    """The records of a run by (part, pair, document), a row for each part that has some."""
    keys = np.concatenate([k for k, _ in held])
    times = np.concatenate([t for _, t in held])
    docs = np.repeat(np.arange(len(held)), [len(k) for k, _ in held])
    both = keys << _DOC_BITS | docs
    order = np.argsort(both)
    both = both[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else order
    times = np.add.reduceat(times[order], first) if len(both) else times
    keys, docs = both[first] >> _DOC_BITS, both[first] & (1 << _DOC_BITS) - 1
    shift = aligner.bits_a + aligner.bits_b
    for a, b in _spans(keys >> shift):
        first = np.flatnonzero(np.concatenate([[True], keys[a + 1:b] != keys[a:b - 1]]))
        pairs = keys[a:b][first] & (1 << shift) - 1
        yield {"kind": "run", "run": number, "part": int(keys[a] >> shift),
               "head": _packed(np.diff(pairs, prepend=0), np.add.reduceat(times[a:b], first)),
               "body": _packed(np.diff(first, append=b - a), docs[a:b], times[a:b])}


def _spans(keys: np.ndarray) -> list[tuple[int, int]]:
    edge = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return [(a, b) for a, b in zip(edge, edge[1:]) if a < b]


def _pairs(head: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, sums = _unpacked(head)[:2]
    return np.cumsum(steps), sums


_BLOCK = 4096


def _entries(head: bytes) -> Iterator[tuple[int, int]]:
    """(pair, sum) of a run in order, a block at a time as Python numbers."""
    pairs, sums = _pairs(head)
    for a in range(0, len(pairs), _BLOCK):
        yield from zip(pairs[a:a + _BLOCK].tolist(), sums[a:a + _BLOCK].tolist())


def _merged(heads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A k-way heap merge of sorted runs: each pair once with its count."""
    if len(heads) == 1:
        return _pairs(heads[0])
    pairs, counts, last = [], [], -1
    for pair, n in heapq.merge(*map(_entries, heads), key=itemgetter(0)):
        if pair == last:
            counts[-1] += n
        else:
            pairs.append(pair)
            counts.append(n)
            last = pair
    return np.array(pairs, np.int64), np.array(counts, np.int64)


def _merge(finish: Callable[[np.ndarray, np.ndarray], bytes]):
    """Rows sorted by (part, group): one row for each, merged; a group is at most some runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (part, group), some in groupby(rows, key=lambda r: (r["part"], r["group"])):
            merged = finish(*_merged([r["head"] for r in some]))
            yield pa.RecordBatch.from_pylist([{"part": part, "run": group, "head": merged}], schema=_HEAD)
    return run


_HEAD = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("head", pa.binary())])


def _level(pairs: np.ndarray, counts: np.ndarray) -> bytes:
    return _packed(np.diff(pairs, prepend=0), counts)


def _with_best(bits_a: int):
    """The last level also marks the pairs with the highest count of their B id: pairs come side by side."""
    def finish(pairs: np.ndarray, counts: np.ndarray) -> bytes:
        side = pairs >> bits_a
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(side)))
        return _packed(np.diff(pairs, prepend=0), counts, (counts == highest).astype(np.int64))
    return finish


def pair_counts(runs: DataFrame, n_runs: int, bits_a: int, fan_in: int = FAN_IN) -> DataFrame:
    """(part, head): all pairs of a part with their counts and whether a count is the highest of its B id."""
    scratch = Scratch(runs.sparkSession, "pair-counts")
    heads, level = runs.select("part", "run", "head"), 0
    while True:
        # A merge has about ``fan_in`` runs open. The number of tasks is given, as little bytes are much work here.
        last, groups = n_runs <= fan_in, max(1, -(-n_runs // fan_in))
        merge = _merge(_with_best(bits_a) if last else _level)
        grouped = heads.withColumn("group", F.expr(f"pmod(xxhash64(run), {groups}L)"))
        dealt = grouped.repartition(PARTS * min(groups, 64), "part", "group").sortWithinPartitions("part", "group")
        heads = scratch.store(dealt.mapInArrow(merge, "part int, run long, head binary"), f"level{level}")
        if last:
            return heads.select("part", "head")
        n_runs, level = groups, level + 1


_RESULT = pa.schema([("doc", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                     ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _by_doc(docs: np.ndarray, times: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Exact sums of times (by counts) per document. Sums of doubles are exact below 2**53, so counts go in halves."""
    if counts is None:
        return np.bincount(docs, times).astype(np.int64)
    low = np.bincount(docs, times * (counts & (1 << 24) - 1)).astype(np.int64)
    return low + (np.bincount(docs, times * (counts >> 24)).astype(np.int64) << 24)


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (slice, part, list first, run): each part's list, then its bodies, and at last the documents."""
    table: tuple | None = None
    totals: dict[int, np.ndarray] = {}
    at = None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["slice"] != at:
                at, totals, table = r["slice"], {}, None
            if r["kind"] == "list":
                steps, counts, best = _unpacked(r["head"])
                table = np.cumsum(steps), counts, best
            elif r["kind"] == "run":
                assert table is not None
                place = np.searchsorted(table[0], _pairs(r["head"])[0])
                many, docs, times = _unpacked(r["body"])
                place = np.repeat(place, many)
                best, counts = _by_doc(docs, times * table[2][place]), _by_doc(docs, times, table[1][place])
                have = totals.get(r["run"], np.zeros((0, 2), np.int64))
                if len(have) < len(best):
                    have = totals[r["run"]] = np.concatenate([have, np.zeros((len(best) - len(have), 2), np.int64)])
                have[:len(best)] += np.stack([best, counts], axis=1)
            else:
                have = totals.get(r["run"])
                n_best, count_sum = have[r["at"]].tolist() if have is not None and r["at"] < len(have) else (0, 0)
                done.append({"doc": r["doc"], "n_a": r["n_a"], "n_b": r["n_b"], "n_groups": r["n_groups"], "n_links": r["n_links"],
                             "n_best": n_best, "count_sum": count_sum, "groups_sha256": r["sha"]})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_RESULT)


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabularies: tuple[str, str] | None = None,
                 run_records: int = RUN_RECORDS, fan_in: int = FAN_IN, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document: tokens of both vocabularies, groups, links, and what the corpus says of its links.

    ``vocabularies`` are a byte-level one (A) and one of pieces (B). A text that is null or empty, or whose tokens of
    either do not give back a space and the text, has no tokens: zeros and an empty hash. Every row is returned, also repeated ones
    and those without an id (with a null one); repeated texts count as often as they stand. Other columns are ignored;
    an empty table gives an empty result. A very long text is aligned whole, some words at a time.
    """
    spark = docs.sparkSession
    paths = vocabularies or default_vocabularies()
    scratch, shared = Scratch(spark, "alignment"), spark.sparkContext.broadcast({"paths": paths})
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    table = scratch.store(texts.mapInArrow(_encode(shared, run_records), _RUNS_DDL), "runs")
    runs = table.where("kind = 'run'")
    size = runs.agg(F.count_distinct("run").alias("runs"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("bytes")).first()
    lists = pair_counts(runs, size["runs"], Aligner(*paths).bits_a, fan_in)
    # Slices of runs, at least one for each core: the lists go to each of them.
    slices = max(spark.sparkContext.defaultParallelism, -(-int(size["bytes"]) // slice_bytes))
    own = F.expr(f"cast(pmod(xxhash64(run), {slices}) as int)").alias("slice")
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    listed = lists.select(each, F.lit("list").alias("kind"), "part", "head")
    both = table.withColumn("part", F.coalesce("part", F.lit(PARTS))).select(own, "*").unionByName(listed, allowMissingColumns=True)
    dealt = both.repartition(slices, "slice").sortWithinPartitions("slice", "part", F.col("kind") != "list", "run", "at")
    return dealt.mapInArrow(_contribute, "doc long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
                            "groups_sha256 string").withColumnRenamed("doc", id_col)
