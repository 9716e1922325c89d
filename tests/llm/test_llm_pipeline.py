import re

import brute
import corpus_pipeline
from tokenizers import Tokenizer

from tidepanel.llm import packing, pii, token_files
from tidepanel.llm.language import held_out


def test_stages_match_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        found = stage(spark, docs, folder)
        found.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            whole = Tokenizer.from_file(token_files.default_tokenizer())
            want = {i: len(whole.encode(r.text or "", add_special_tokens=False).ids) for i, r in before.items()}
            have, batches = {}, {}
            for r in after.collect():
                have[r.doc_id] = have.get(r.doc_id, 0) + r.length
                assert r.length <= min(r.bucket, packing.LONGEST)
                if r.length:
                    batches[r.bucket, r.batch] = batches.get((r.bucket, r.batch), 0) + r.bucket
            assert have == want and max(batches.values()) <= packing.BUDGET
            break
        assert after.columns == docs.columns
        kept = {r.doc_id: r for r in after.collect()}
        texts = [(i, r.text) for i, r in before.items()]
        if name == "language_id":
            assert set(kept) == {i for i, t in texts if re.search(r"[^\W\d_]", t or "")}
            fresh = {r.doc_id for r in docs.where(held_out()).collect()} & set(kept)
            assert sum(kept[i].lang == before[i].lang for i in fresh) >= 0.97 * len(fresh)
        elif name == "near_dedup":
            assert set(kept) == {i for i, (_, c) in brute.near_duplicates(texts).items() if c == i}
        elif name == "decontaminate":
            assert set(kept) == {i for i, x in brute.contamination(texts, items).items() if not x[4]}
        elif name == "personal_data":
            triggers, names = pii._triggers(), pii.Surrogates()
            for i, text in texts:
                out, at = "", 0
                for a, b, kind in pii.entities(text, triggers):
                    out, at = out + text[at:a] + names.replace(kind, text[a:b]), b
                assert kept[i].text == out + text[at:] and kept[i].n_chars == len(kept[i].text)
        docs = after


def test_stages_take_nulls_and_empty_tables(spark, folder, make_docs):
    rows = [(1, None), (2, ""), (3, "the and of"), (None, "with this and that"), (3, "the and of")]
    for some in (make_docs(rows), make_docs(rows).limit(0), make_docs(rows, ["en", None, "en", None, "de"])):
        for name, stage in corpus_pipeline.STAGES:
            assert name == "packing" or stage(spark, some, folder).columns == some.columns
            stage(spark, some, folder).collect()


def test_pipeline_runs_whole(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len({r.doc_id for r in rows}) > 100 and len(rows) == len({(r.doc_id, r.segment) for r in rows})
