import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import whitening as W
from tidepanel.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, vec string, x string, c string, dim string, n string, k string, a string"


def make(spark, rows):
    return spark.createDataFrame([(i, v, *["z"] * 7) for i, v in rows], SCHEMA)


def brute(rows, components=4):
    """{id: (n, deviation, whitened)}, explained, by exact integers and an eigenvalue solver."""
    x = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    d = np.array(fit, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(d.T @ d / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, v in x.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        out[i] = (n, deviation, ((np.array(v) - np.array(sums) / n) @ axes[:, :components]) / np.sqrt(np.maximum(values[:components], 1e-300)))
    return out, values[:components] / values.sum()


def check(got, rows, components=4, places=1e-8):
    want, explained = brute(rows, components)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == set(want)
    first = {}
    for i, (n, deviation, whitened) in want.items():
        assert sorted(by[i]) == list(range(1, components + 1))
        for k in range(1, components + 1):
            r = by[i][k]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(r["explained"] - explained[k - 1]) <= 1e-9 * explained[k - 1]
            assert 0 <= r["identity_error"] <= 1e-9
            sign = first.setdefault(k, np.sign(r["whitened"] * whitened[k - 1]) if abs(whitened[k - 1]) > 1e-3 else None) or first.pop(k, None)
            if sign:
                assert abs(sign * r["whitened"] - whitened[k - 1]) < places


@pytest.mark.parametrize("dim, scales", [(9, None), (6, [3, 1, 1e-1, 1e-2, 1e-2, 1e-2]), (64, None)])
def test_components_match_an_eigenvalue_solver(spark, dim, scales):
    r = np.random.default_rng(dim)
    base = r.standard_normal((400, dim)) * (np.linspace(2, .2, dim) if scales is None else np.array(scales)) + r.standard_normal(dim)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # a third of the rows are equal
    check(W.whiten(make(spark, rows).repartition(5), block_rows=64).collect(), rows)


def test_fewer_directions_than_dimensions(spark):
    r = np.random.default_rng(1)
    flat = r.integers(-5, 6, (60, 2)) @ np.array([[1, 2, 0, -1, 3, 1], [2, 0, 1, 1, -1, 0]]) / 256
    rows = [(i, v.tolist()) for i, v in enumerate(flat)]
    check(W.whiten(make(spark, rows)).collect(), rows, components=2)


def test_repeated_variances_are_all_found(spark):
    rows = [(2 * j + s, [(s * 2 - 1) * 10.0 * (k == j) for k in range(6)]) for j in range(6) for s in range(2)]
    got = W.whiten(make(spark, rows)).collect()
    assert {(r["component"], round(r["explained"], 12)) for r in got} == {(k, round(1 / 6, 12)) for k in range(1, 5)}
    y = np.zeros((12, 4))
    for r in got:
        y[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.allclose(y.T @ y / 12, np.eye(4), atol=1e-10)


def test_rows_that_take_no_part_and_other_lengths(spark):
    good = [(1, [0.1, 0.2]), (2, [0.3, -0.2]), (3, [0.3, 0.5]), (None, [1.0, 1.0])]
    bad = [(4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, []), (9, [3e38, 1.0]), (11, [2.0 ** 45, 1.0]), (10, [1.0, 2.0, 3.0])]
    got = W.whiten(make(spark, good + bad)).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == [(i, k) for i in range(4) for k in (1, 2)]
    assert {r["n"] for r in got} == {4}
    assert W.whiten(make(spark, good[:1])).count() == 0 and W.whiten(make(spark, [])).count() == 0
    two = W.whiten(make(spark, [(i, [float(i)] * 2) for i in range(4)] + [(9, [0.0, 1.0, 2.0]), (10, [4.0, 1.0, 0.0])]))
    assert {(r["vec_id"], r["n"]) for r in two.collect()} == {(i, 4) for i in range(4)} | {(9, 2), (10, 2)}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2 ** 20 + i), float(-3 * i), 5.0]) for i in range(50)]
    got = {r["vec_id"]: r["deviation"] for r in W.whiten(make(spark, rows)).collect()}
    assert got == {i: d for i, (_, d, _) in brute(rows, 1)[0].items()}
    huge = W.whiten(make(spark, [(0, [2.0 ** 44, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])]))
    assert {r["deviation"] for r in huge.where("vec_id = 0").collect()} == {None}


def test_the_query_over_the_whole_table(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = QUERIES["op11_embedding_whitening"](spark, folder)
    assert dict(got.dtypes)["deviation"] == "bigint" and got.where(F.col("whitened").isNull()).count() == 0
    check(got.collect(), rows, places=1e-7)
