import hashlib

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, part string, conv string, row string, formatted string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def expected(rows):
    """{conv: digests} by plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        turns = [(r or "", t or "") for _, r, t in turns]
        said = "".join(t for r, t in turns if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
            for r in C.conversation_digests(C.format_conversations(df)).collect()}


MARKS = ["</turn>", "<turn>assistant\n", "<next>", "\\", "\\l", "\\b", "\\n", "\\\\<", "<", "a\nb", "", None, "\\### Assistant: </turn> ok", "日本 \U0001f600"]
ROLES = ["user", "assistant", "system", None, "", "assistant\nx", "a<b\\n", "assistant"]


def test_texts_that_look_like_marks_come_back(spark):
    rows = [(k % 7, k // 7, ROLES[(k * 5 + k // 3) % len(ROLES)], MARKS[(k * 3) % len(MARKS)]) for k in range(140)]
    rows += [(None, 1, "assistant", "no id"), (None, None, "user", "first"), (-5, 2, "user", "t"), (-5, 2, "user", "t"), (-5, 2, "assistant", "t")]
    assert digests(make(spark, rows)) == expected(rows)


def test_turns_of_one_role_are_one_block_and_the_mask_leaves_marks_out(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a<"), (1, 2, "assistant", "b"), (1, 3, "user", "")]
    got = C.format_conversations(make(spark, rows)).first()
    assert got["formatted"] == "<turn>user\nq</turn><turn>assistant\na\\l<next>b</turn><turn>user\n</turn>"
    assert [got["formatted"][s["start"]:s["start"] + s["size"]] for s in got["mask"]] == ["a\\l", "b"]


@pytest.mark.parametrize("copies", [0, 300])
def test_a_very_long_conversation_comes_in_parts(spark, monkeypatch, copies):
    monkeypatch.setattr(C, "WHOLE_ROWS", 50)
    monkeypatch.setattr(C, "PART_ROWS", 16)
    rows = [(3, k // 3, ROLES[k % len(ROLES)], f"text {k} <") for k in range(400)] + [(3, 40, "assistant", "same")] * copies
    rows += [(4, k, "user", "short") for k in range(5)] + [(None, 1, "assistant", f"n {k}") for k in range(60)]
    df = make(spark, rows).repartition(5)
    assert digests(df) == expected(rows)
    parts = C.format_conversations(df).groupBy("conv_id").agg(F.count("part").alias("parts")).collect()
    assert {r["conv_id"]: r["parts"] > 1 for r in parts} == {3: True, 4: False, None: True}


def test_a_very_long_text_makes_parts_and_an_empty_table_no_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "WHOLE_CHARS", 1000)
    rows = [(1, 0, "user", "x<" * 5000), (1, 1, "assistant", "é" * 3000), (2, 0, "assistant", "ok")]
    assert digests(make(spark, rows)) == expected(rows)
    assert digests(make(spark, []).where("conv_id = 99")) == {}
