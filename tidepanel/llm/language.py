"""Language identification: each document as a mixture of the learned languages, by expectation-maximisation.

A language is a distribution over hashed byte 4-grams. A document's n-grams come from a mixture of languages, whose
shares are estimated by expectation-maximisation. A language enters the set only if it raises the log-likelihood by
more than a penalty that grows with the logarithm of the document's n-grams. The likelihood is concave in the shares,
so n * (largest mean likelihood ratio - 1) bounds what any mixture can gain over the best single language; documents
where that is below the penalty need no iteration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidepanel.llm.words import Chunk, chunks

BITS = 16
GRAM = 4
SMOOTHING = 0.5
PENALTY = 12.0
ROUNDS = 50
UNDETERMINED = "und"
_FLUSH_LANGUAGES = 64


def _padded(column: pa.Array) -> pa.Array:
    """Lower case, and a space around each text so that even one letter has an n-gram."""
    lowered = pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), "")
    space = pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(space, lowered, pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string()))


def _grams(c: Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a chunk, none across documents, and where each document's begin."""
    b = c.data.astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(c.offsets), np.int64)
    code = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    keep = np.ones(len(code), dtype=bool)
    for back in range(1, GRAM):
        cut = c.offsets[1:-1] - back
        keep[cut[cut >= 0]] = False
    return code[keep], np.concatenate([[0], np.cumsum(np.maximum(np.diff(c.offsets) - GRAM + 1, 0))])


def _count(bits: int):
    """(lang, bucket, n) of a partition, summed before they leave it."""
    def rows(have: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in have.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(some), pa.string()),
                "bucket": pa.array(some.astype(np.int32)), "n": pa.array(counts[some])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for c in chunks(_padded(batch.column("text"))):
                grams, first = _grams(c, bits)
                names = np.array(langs[c.rows.start:c.rows.stop], dtype=object)
                owner = np.repeat(names, np.diff(first))
                for lang in set(names):
                    if lang not in have and len(have) >= _FLUSH_LANGUAGES:
                        yield from rows(have)
                        have = {}
                    mine = np.bincount(grams[owner == lang], minlength=1 << bits)
                    have[lang] = have.get(lang, 0) + mine
        yield from rows(have)
    return run


class Mixtures:
    """Learned languages and their n-gram likelihoods."""

    def __init__(self, languages: list[str], table: np.ndarray, penalty: float, rounds: int):
        self.languages, self.table, self.penalty, self.rounds = languages, table, penalty, rounds

    def shares(self, p: np.ndarray, best: int) -> np.ndarray:
        """Shares of the languages from the likelihoods p (n-grams x languages), by EM and penalised selection."""
        n, k = p.shape
        chosen = np.arange(k)
        penalty = self.penalty * np.log(n + 1)
        while True:
            q = p[:, chosen]
            w = np.full(len(chosen), 1 / len(chosen))
            last = -np.inf
            for _ in range(self.rounds):
                mixed = q @ w
                now = np.log(mixed).sum()
                w = w * (q / mixed[:, None]).mean(axis=0)
                if now - last < 1e-3:
                    break
                last = now
            if len(chosen) == 1:
                break
            out = int(w.argmin())
            rest = np.delete(w, out)
            if rest.sum() > 0:
                loss = now - np.log(np.delete(q, out, axis=1) @ (rest / rest.sum())).sum()
            else:
                loss = 0.0
            if loss > penalty:
                break
            chosen = np.delete(chosen, out)
        full = np.zeros(k)
        full[chosen] = w
        return full

    def predict(self, c: Chunk, bits: int) -> list[tuple[np.ndarray, float]]:
        """(shares, score of the largest) of each document of a chunk."""
        grams, first = _grams(c, bits)
        p = self.table[grams]
        logs, out = np.log(p), []
        for a, b in zip(first[:-1], first[1:], strict=True):
            total = logs[a:b].sum(axis=0, dtype=np.float64)
            best, n = int(total.argmax()), b - a
            own = np.exp((total - total[best]) / GRAM)
            share = np.zeros(len(self.languages))
            share[best] = 1.0
            gain = n * ((p[a:b] / p[a:b, best:best + 1]).mean(axis=0, dtype=np.float64).max() - 1) if n else 0.0
            if gain > self.penalty * np.log(n + 1):
                share = self.shares(p[a:b].astype(np.float64), best)
            top = int(share.argmax())
            out.append((share, float(share[top] * (1 / own.sum() if share[top] == 1 else 1))))
        return out


def learn(labelled: DataFrame, text_col: str, lang_col: str, bits: int = BITS, smoothing: float = SMOOTHING,
          penalty: float = PENALTY, rounds: int = ROUNDS) -> Mixtures:
    """Counts over all given rows. What reaches the driver has at most 2**bits numbers for each language."""
    counted = (labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
               .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
               .mapInArrow(_count(bits), "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = counted.column("lang").to_pylist()
    languages = sorted(set(names))
    table = np.full((1 << bits, max(1, len(languages))), smoothing, np.float64)
    place = {x: k for k, x in enumerate(languages)}
    table[counted.column("bucket").to_numpy(), np.array([place[x] for x in names], np.int64)] += counted.column("n").to_numpy()
    return Mixtures(languages, (table / table.sum(axis=0)).astype(np.float32), penalty, rounds)


def _predict(shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mixtures(*shared.value)
        for batch in batches:
            text = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            for c in chunks(_padded(text)):
                preds, scores, shares = [], [], []
                found = m.predict(c, bits) if m.languages else [(np.zeros(0), 0.0)] * len(c.rows)
                for (share, score), any_letter in zip(found, letters[c.rows.start:c.rows.stop], strict=True):
                    known = any_letter and len(share)
                    preds.append(m.languages[int(share.argmax())] if known else UNDETERMINED)
                    scores.append(min(1.0, max(0.0, score)) if known else 0.0)
                    shares.append([(m.languages[k], float(share[k])) for k in np.flatnonzero(share)] if known else [])
                columns = {n: batch.column(n).slice(c.rows.start, len(c.rows)) for n in batch.schema.names if n != "text"}
                yield pa.RecordBatch.from_pydict(columns | {
                    "text": text.slice(c.rows.start, len(c.rows)), "lang_pred": pa.array(preds, pa.string()),
                    "score": pa.array(scores, pa.float64()),
                    "shares": pa.array(shares, pa.map_(pa.string(), pa.float64()))})
    return run


def identify(docs: DataFrame, model: Mixtures, text_col: str = "text", keep: list[str] | None = None,
             bits: int = BITS) -> DataFrame:
    """Per document: the columns of ``keep`` (none but the text are read for the prediction), ``text``,
    ``lang_pred``, ``score`` (share of that language; for a document in one language, how sure it is against the
    others) and ``shares`` of all languages found.

    Null texts, empty ones and texts without a letter, and all texts if no language was learned, get ``und``, score 0
    and no shares. Ties go to the language that sorts first. Repeated rows are judged alike. Columns that are
    not asked for are ignored, so their names can't clash. An empty table gives an empty result.
    """
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.penalty, model.rounds))
    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    out = source.mapInArrow(_predict(shared, bits), f"{kinds}, lang_pred string, score double, shares map<string,double>")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text", "lang_pred", "score", "shares")


def held_out(id_col: str = "doc_id"):
    """The rows that the model never learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
