import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm import packing, token_files, words
from tidepanel.llm.neighbours import build_index, nearest_neighbours
from tidepanel.llm.queries import QUERIES


def test_boundaries_have_the_least_padding():
    r = random.Random(2)
    for _ in range(30):
        histogram = {x: r.randint(1, 9) for x in r.sample(range(1, 40), r.randint(1, 9))}
        k = r.randint(1, 4)

        def padding(edges):
            return sum(n * (min(e for e in edges if e >= x) - x) for x, n in histogram.items())

        lengths = sorted(histogram)
        best = min(padding([*c, lengths[-1]]) for m in range(k) for c in itertools.combinations(lengths[:-1], min(m, len(lengths) - 1)))
        got = packing.boundaries(histogram, k)
        assert len(got) <= k and padding(got) == best
    assert packing.boundaries({}) == []


def test_packing_places_every_token_once(make_docs, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 7)
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 3, 9, 25, 70]))) for k in range(80)] + [(100, None), (None, "x"), (101, "\n"), (5, "again")]
    got = packing.pack(make_docs(rows), buckets=3, longest=30, budget=100).collect()
    assert len({(x.bucket, x.batch, x.slot) for x in got if x.length}) == sum(1 for x in got if x.length)
    want = {}
    for i, t in rows:
        if i is not None:
            want[i] = want.get(i, 0) + len((t or "").split())
    have = {}
    for x in got:
        have[x.doc_id] = have.get(x.doc_id, 0) + x.length
        assert x.length <= x.bucket <= 30 and x.first_token == 30 * x.segment and (x.batch is None) == (x.length == 0)
    assert have == want
    for bucket in {x.bucket for x in got if x.length}:
        places = sorted((x.batch, x.slot) for x in got if x.bucket == bucket)
        room = max(1, 100 // bucket)
        assert places == [(k // room, k % room) for k in range(len(places))]
    assert packing.pack(make_docs(rows).limit(0)).collect() == []


def test_packing_query_counts_tokens(spark, make_docs, tmp_path):
    rows = [(1, "hello world, unbelievable"), (2, "中文没有空格" * 900), (3, "QmFzZTY0" * 2000), (4, None), (5, ""), (None, "x"), (6, "a <|endoftext|> b")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    whole, have = Tokenizer.from_file(token_files.default_tokenizer()), {}
    for x in QUERIES["op3_length_bucket_packing"](spark, str(tmp_path)).collect():
        have[x.doc_id] = have.get(x.doc_id, 0) + x.length
        assert x.length <= x.bucket <= packing.LONGEST and x.first_token == packing.LONGEST * x.segment
    assert have == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in rows if i is not None}


def test_grammar_decodes_to_what_it_encoded():
    r = np.random.default_rng(1)
    for n_docs, vocabulary in ((1, 3), (40, 5), (40, 50_000)):
        docs = [np.append(r.integers(1, vocabulary, r.integers(0, 800)), 0).astype(np.uint32) for _ in range(n_docs)]
        docs += [np.tile(docs[0], 3), np.array([0], np.uint32)]
        ids = np.concatenate(docs)
        ends = np.zeros(len(ids), dtype=bool)
        ends[np.cumsum([len(d) for d in docs]) - 1] = True
        row = token_files.compress(ids, ends) | {"docs": np.arange(len(docs), dtype="<i8").tobytes()}
        shard = token_files.Shard(row)
        assert all((shard.document(k) == d).all() and len(shard.document(k)) == len(d) for k, d in enumerate(docs))
        for a, b in ((0, len(ids)), (1, 2), (len(ids) // 3, len(ids) // 2 + 1), (len(ids) - 1, len(ids))):
            assert (shard.tokens(a, b) == ids[a:b]).all()
    assert len(shard.sequence) < len(ids) or vocabulary > 1000


def test_no_pair_worth_a_rule_is_left():
    r = np.random.default_rng(5)
    run = np.full(262_144, 7, np.uint32)
    words = [r.integers(1, 400, r.integers(1, 9)).astype(np.uint32) for _ in range(300)]
    text = np.concatenate([words[k] for k in r.zipf(1.3, 6000) % 300])
    mixed = np.concatenate([np.tile([3, 3, 3, 4], 500), np.tile([1, 2, 1], 400), np.repeat([9, 8, 9], [33, 40, 7])]).astype(np.uint32)
    for ids, most in ((run, 2 * 18), (text, len(text) // 3), (mixed, 200)):
        ends = np.zeros(len(ids), dtype=bool)
        ends[-1] = True
        row = token_files.compress(ids, ends)
        shard = token_files.Shard(row | {"docs": np.zeros(1, "<i8").tobytes()})
        left = shard.sequence.astype(np.int64)
        assert (shard.document(0) == ids).all() and len(left) + len(shard.rules) <= most
        counts, k = Counter(), 0
        while k < len(left) - 1:  # of equal symbols, pairs that do not overlap
            counts[left[k], left[k + 1]] += 1
            k += 2 if left[k] == left[k + 1] and k + 2 < len(left) and left[k + 2] == left[k] else 1
        assert max(counts.values(), default=0) < token_files.LEAST_COUNT


def test_encoding_in_pieces_equals_encoding_whole(monkeypatch):
    encoder = token_files.Encoder(token_files.default_tokenizer())
    whole = Tokenizer.from_file(token_files.default_tokenizer())
    assert encoder.cuts
    r = random.Random(7)
    signs = ["a", "B", "é", "ß", "1", "'s", "'ll", ".", "\n", " ", "  ", "\t", " ", "　", "中", "!!", "don't", " ", "\x85", "\x1c", "😀"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    texts += [" ".join(r.choice(signs[:13]) * r.randint(1, 3) for _ in range(r.randint(0, 60))) for _ in range(500)]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for limit in (200, 1 << 16, 1 << 22):
        got = [x.tolist() for c in words.chunks(pa.array(texts), limit) for x in encoder.encode(c)]
        assert got == want
    monkeypatch.setattr(token_files, "word_hashes", lambda data, w, which=0: (w.ends - w.starts).astype(np.uint64) << np.uint64(32)
                        if which else np.zeros(len(w.starts), np.uint64))
    clash, few = token_files.Encoder(token_files.default_tokenizer()), ["a bb ccc", "d ffff", "ff g"]  # all pieces share a key
    assert [x.tolist() for _ in range(2) for c in words.chunks(pa.array(few)) for x in clash.encode(c)] == [
        e.ids for e in whole.encode_batch(few * 2, add_special_tokens=False)]


def test_added_tokens_are_read_as_the_library_does():
    encoder, whole = token_files.Encoder(token_files.default_tokenizer()), Tokenizer.from_file(token_files.default_tokenizer())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain a b", "x<|endoftext|><|endoftext|>y z", "end <|endo", "ftext|> of", "", "a b <|endoftext|"]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    for limit in (10, 1 << 22):
        assert [x.tolist() for c in words.chunks(pa.array(texts * 2), limit) for x in encoder.encode(c)] == want * 2


def test_token_files_round_trip(make_docs):
    rows = [(3, "b a"), (1, "Hello world, hello World"), (2, None), (5, ""), (None, "x"), (3, "a b"), (4, "z " * 20_000)]
    got = sorted(tuple(r) for r in token_files.token_files_round_trip(make_docs(rows)).collect())
    whole, start, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for i, text in sorted((i, t or "") for i, t in rows if i is not None):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert token_files.token_files_round_trip(make_docs(rows).limit(0)).collect() == []


def test_token_query_matches_the_library(spark, folder):
    whole, start = Tokenizer.from_file(token_files.default_tokenizer()), 0
    got = {r.doc_id: r for r in QUERIES["op4_repair_token_files"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*whole.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[row.doc_id].start, got[row.doc_id].n_tokens, got[row.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def _exact(rows, own, query, k=20):
    x = sorted(((-float((np.array(v) * np.array(query)).sum()), i) for i, v in rows if i != own and len(v) == len(query)))
    return [i for _, i in x[:k]]


def test_neighbours_recall(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op10_hnsw_neighbours"](spark, folder).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [(i, v) for i, v in rows if i % 20 == 0]
    assert set(got) == {i for i, _ in asked}
    hit = sum(len({v for _, v, _ in got[i]} & set(_exact(rows, i, q))) for i, q in asked)
    assert hit >= 0.9 * 20 * len(asked)
    assert all([x for x, _, _ in sorted(g)] == list(range(1, 21)) for g in got.values())


def test_neighbours_recall_over_many_shards_built_apart(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    size = max(1, len(rows) // 24)
    index = build_index(table, shard_rows=size)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and index.count() >= 20
    assert index.select("dim", "shard", F.spark_partition_id().alias("task")).distinct().groupBy("task").count().agg(F.max("count")).first()[0] <= 4
    got = {}
    for r in nearest_neighbours(table, shard_rows=size).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [(i, v) for i, v in rows if i % 20 == 0]
    hit = sum(len(got[i] & set(_exact(rows, i, q))) for i, q in asked)
    assert hit >= 0.9 * 20 * len(asked)


@pytest.mark.parametrize("shard_rows", [1000, 40])
def test_neighbours_with_ties_and_odd_vectors(spark, shard_rows):
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=8).round(2).tolist() if k % 3 else [1.0] * 8) for k in range(150)]
    odd = [(200, None), (220, [0.0] * 8), (240, [None] + [1.0] * 7), (260, [float("nan")] * 8), (280, []), (None, [1.0] * 8),
           (300, [1.0, 2.0]), (301, [2.0, 1.0]), (20, rows[20][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, shard int, point string")
    got = {}
    for x in nearest_neighbours(frame, shard_rows=shard_rows).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = x.vec_id
    fine = [*rows, (300, [1.0, 2.0]), (301, [2.0, 1.0])]
    assert set(got) == {i for i, _ in fine if i % 20 == 0}
    same = [[got[i][k + 1] for k in range(len(got[i]))] == _exact(fine, i, v) for i, v in fine if i % 20 == 0]
    assert sum(same) >= 0.9 * len(same) and got[300] == {1: 301}
    assert nearest_neighbours(frame.limit(0)).collect() == []
