"""State tables before and after compaction: the same rows from fewer files, whatever is lost in between."""

import pytest
from pyspark.sql import functions as F

from tidepanel.session import scratch_dir
from tidepanel.sources import state
from tidepanel.sources.state import LogTable

DDL = "k STRING, v DOUBLE, made STRING"


def _table(spark, **options):
    return LogTable(spark, f"{scratch_dir(spark, 'compact')}/t", DDL, **options)


def _fill(spark, table, batches):
    for b in batches:
        rows = [(f"k{(b + j) % 5}", float(b * 10 + j), f"at {b}") for j in range(3)]
        table.append(spark.createDataFrame(rows, DDL), b)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _files(table):
    return sum(len(f.inputFiles()) for f in table._live())


def test_keyed_rows_and_files_after_many_batches(spark):
    plain, folded = (_table(spark, keys=["k"], keep_from_first=["made"]) for _ in range(2))
    most = []
    for b in range(1, 13):
        for t in (plain, folded):
            _fill(spark, t, [b])
        if b % 2 == 0:
            assert folded.compact(b - 1)
            most.append(_files(folded))
    assert _rows(folded.current()) == _rows(plain.current())
    assert _rows(folded.log(only=12)) == _rows(plain.log(only=12))
    batches = [n for n in folded._listed(folded.path) if n.startswith("_batch=")]
    assert batches == ["_batch=12"] and len(plain._listed(plain.path)) == 12
    segments = folded._manifest()["segments"]
    assert [x["tier"] for x in segments] == [1, 0, 0] and most[-1] <= most[2]  # six folds: four became one
    assert not folded.compact(11) and folded.current().count() == 5
    with pytest.raises(ValueError):
        folded.append(spark.createDataFrame([("k0", 1.0, "x")], DDL), 11)


def test_rows_without_keys_all_stay(spark):
    table = _table(spark)
    _fill(spark, table, range(6))
    before = _rows(table.log())
    assert table.compact(4) and _rows(table.log()) == before and _rows(table.log(only=2)) == [r for r in before if r[3] == 2]
    assert _rows(table.current().select("k", "first_seq")) == sorted((r[0], r[3]) for r in before)


def test_lost_between_write_and_swap_and_after_it(spark, monkeypatch):
    table = _table(spark, keys=["k"])
    _fill(spark, table, range(5))
    before = _rows(table.current())
    with monkeypatch.context() as m:
        m.setattr(table, "_swap", lambda manifest: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.compact(3)
    assert table._manifest()["segments"] == [] and _rows(table.current()) == before
    with monkeypatch.context() as m:  # swapped, but nothing was removed
        swap = table._swap
        m.setattr(table, "_swap", lambda manifest: (swap(manifest), (_ for _ in ()).throw(RuntimeError("lost"))))
        with pytest.raises(RuntimeError):
            table.compact(3)
    assert len([n for n in table._listed(table.path) if n.startswith("_batch=")]) == 5
    assert _rows(table.current()) == before and table.log().where(F.col("_batch") == 4).count() == 3


def test_of_two_compactions_one_fails(spark):
    table = _table(spark, keys=["k"])
    _fill(spark, table, range(3))
    before = _rows(table.current())
    manifest = {"number": 1, "upto": 1, "segments": [table._segment(table._live()[0].filter("_batch <= 1"), 0)]}
    table._swap(manifest)
    with pytest.raises(RuntimeError):
        table._swap({**manifest, "segments": []})
    assert _rows(table.current()) == before


def test_working_sets_keep_their_newest_batch(spark):
    table = _table(spark, only_newest=True)
    _fill(spark, table, range(4))
    assert table.compact(3) and [r[3] for r in _rows(table.log())] == [3, 3, 3]
    assert not table.compact(3) and state.FAN_IN == 4
