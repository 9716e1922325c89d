import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidepanel.llm import token_alignment as T
from tidepanel.llm.queries import QUERIES

PATHS = T.default_vocabularies()


def characters():
    """Byte-level characters by the bytes that the tokenizer itself gives for them."""
    plain = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    out, extra = {}, 256
    for b in range(256):
        out[chr(b) if b in plain else chr(extra)] = b
        extra += b not in plain
    return out


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    of = characters()

    def tokens(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        raw = (" " + text).encode()
        return (ids_a, ids_b, raw_a, raw_b) if b"".join(raw_a) == raw == b"".join(raw_b) else None

    def spans(raw):
        at, out = 0, []
        for x in raw:
            out.append((at, at + len(x)))
            at += len(x)
        return out

    def brute(rows):
        found, counts = [], Counter()
        for doc, text in rows:
            got = tokens(text)
            if got is None:
                found.append((doc, 0, 0, 0, [], ""))
                continue
            ids_a, ids_b, raw_a, raw_b = got
            a_at, b_at = spans(raw_a), spans(raw_b)
            links = [(i, j) for i, (s, e) in zip(ids_a, a_at) for j, (x, y) in zip(ids_b, b_at) if s < y and x < e] if len(ids_a) < 600 else walk(ids_a, a_at, ids_b, b_at)
            both = sorted({e for _, e in a_at} & {e for _, e in b_at})
            groups, low = [], 0
            for high in both:
                groups.append(",".join(str(i) for i, (s, e) in zip(ids_a, a_at) if low <= s and e <= high) + "|"
                              + ",".join(str(i) for i, (s, e) in zip(ids_b, b_at) if low <= s and e <= high)) if len(ids_a) < 600 else None
                low = high
            shown = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(ids_a) < 600 else None
            found.append((doc, len(ids_a), len(ids_b), len(both), links, shown))
            counts.update(links)
        highest = {}
        for (_, j), n in counts.items():
            highest[j] = max(highest.get(j, 0), n)
        return sorted(((doc, n_a, n_b, g, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha)
                       for doc, n_a, n_b, g, links, sha in found), key=repr)

    def walk(ids_a, a_at, ids_b, b_at):
        out, j = [], 0
        for i, (s, e) in zip(ids_a, a_at):
            while b_at[j][1] <= s:
                j += 1
            k = j
            while k < len(b_at) and b_at[k][0] < e:
                out.append((i, ids_b[k]))
                k += 1
        return out

    return brute


def rows_of(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                   for r in df.collect()), key=repr)


def odd_texts(n):
    r = random.Random(13)
    bits = ["the", "Straße", " ", "  ", "\n", "\t", "　", "᠎", "\x1c", "日本語", "'s", "<|endoftext|>", "<s>", "</s>", "<0x41>", "é", "é",
            "123", "::", "\U0001f600", "́", "ﬁ", " a", "b ", "\r\n", "don't", "\xa0", "x" * 30, "\x00", "ß", "ΑΒΓ", "​"]
    return ["".join(r.choice(bits) + r.choice(["", "", " "]) for _ in range(r.randint(1, 14))) for _ in range(n)]


def test_words_alone_give_the_tokens_of_the_text(spark, make_docs, plain):
    texts = odd_texts(300) + ["", None, " ", "a", " a ", "x▁y z", "fine words ▁", "same text here"] + ["same text here"] * 150
    rows = list(enumerate(texts)) + [(None, "without an id"), (5, "repeated id"), (5, "repeated id")]
    got = T.align_tokens(make_docs(rows).repartition(5))
    assert rows_of(got) == plain(rows)


@pytest.mark.parametrize("records, fan_in, slice_bytes", [(40, 2, 500), (200, 3, 1 << 20)])
def test_many_runs_and_merge_levels(spark, make_docs, plain, records, fan_in, slice_bytes):
    texts = odd_texts(60) + ["one passage that all of them have, again and again."] * 40
    rows = list(enumerate(texts))
    got = T.align_tokens(make_docs(rows).repartition(4), run_records=records, fan_in=fan_in, slice_bytes=slice_bytes)
    assert rows_of(got) == plain(rows)


def test_a_very_long_text_and_empty_tables(spark, make_docs, plain, monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 12))) for _ in range(4000)]
    rows = [(1, " ".join(r.choice(words) for _ in range(60_000))), (2, "\n\n  ".join(words)), (3, "short"), (4, "y" * 5000)]
    monkeypatch.setattr(T, "PIECE_WORDS", 1000)
    got, want = rows_of(T.align_tokens(make_docs(rows))), plain(rows)
    assert [x[:-1] for x in got] == [x[:-1] for x in want]
    aligner = T.Aligner(*PATHS)
    whole = T.Aligner(*PATHS)
    whole.cuts = False
    for _, text in rows:
        assert aligner.align(text)[:2] == whole.align(text)[:2]
    assert T.align_tokens(make_docs([(1, "x")]).where("doc_id > 1")).count() == 0
    assert rows_of(T.align_tokens(make_docs([(1, None), (2, "")]))) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_the_cache_may_be_small(spark, make_docs, plain, monkeypatch):
    monkeypatch.setattr(T, "CACHE_BYTES", 2000)
    rows = list(enumerate(odd_texts(80)))
    assert rows_of(T.align_tokens(make_docs(rows))) == plain(rows)


def test_the_query_over_the_whole_table(spark, folder, plain):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got, want = rows_of(QUERIES["op13_tokenizer_alignment"](spark, folder)), plain(rows)
    assert [x[:-1] for x in got] == [x[:-1] for x in want]
    assert all(g[-1] == w[-1] for g, w in zip(got, want) if w[-1] is not None)


def test_ranks_give_the_ids_of_the_tokenizer_file():
    aligner = T.Aligner(*PATHS)
    texts = [f" a{chr(c)}1 {chr(c)}b {chr(c)}{chr(c)} 2{chr(c)}\n{chr(c)}'s" for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts += [" " + t for t in odd_texts(300) if t]
    quick = aligner._ids_a(texts)
    assert aligner.quick is not None
    aligner.quick = None
    assert aligner._ids_a(texts) == quick
