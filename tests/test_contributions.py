"""Shares of the trees against all subsets of inputs, and the surrogate against NumPy's normal equations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import features as X
from tidepanel.plans import model as M
from tidepanel.plans.contributions import SHARES, read_leaves, shares, with_shares
from tidepanel.plans.forecast import ModelScorer
from tidepanel.plans.registry import Inputs
from tidepanel.sources import schemas as S

NAMES = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 6)).round(2)
    y = 2 * x[:, 0] + x[:, 1] * x[:, 2] - np.abs(x[:, 3]) + (x[:, 4] > 0)
    frame = spark.createDataFrame([(k, *map(float, row), float(t)) for k, (row, t) in enumerate(zip(x, y))],
                                  "n long, " + ", ".join(f"{c} double" for c in NAMES) + ", target double")
    path = str(tmp_path_factory.mktemp("trees"))
    model = M.Learner(trees=5, depth=5, rate=0.3).pipeline(NAMES).fit(frame)
    model.write().overwrite().save(path)
    return frame, model, path


def _expected(nodes, weight, row, known):
    """Prediction of one tree where only ``known`` inputs are seen."""
    def walk(at):
        node = nodes[at]
        if node["leftChild"] < 0:
            return node["prediction"]
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return walk(node["leftChild"] if row[f] <= cut else node["rightChild"])
        sides = [nodes[node[c]] for c in ("leftChild", "rightChild")]
        return sum(walk(s["id"]) * s["impurityStats"][0] for s in sides) / node["impurityStats"][0]
    return weight * walk(0)


def test_shares_match_all_subsets(spark, fitted):
    frame, _, path = fitted
    weights = {r["_1"]: r["_3"] for r in spark.read.parquet(f"{path}/stages/*/treesMetadata").collect()}
    trees = {t: {} for t in weights}
    for r in spark.read.parquet(f"{path}/stages/*/data").select("treeID", "nodeData.*").collect():
        trees[r["treeID"]][r["id"]] = r
    rows = np.array([[r[c] for c in NAMES] for r in frame.limit(12).collect()])
    got = shares(read_leaves(spark, path), rows)
    for row, have in zip(rows, got):
        worth = {s: sum(_expected(trees[t], weights[t], row, s) for t in trees)
                 for n in range(7) for s in map(frozenset, itertools.combinations(range(6), n))}
        for f in range(6):
            want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / math.factorial(6) * (worth[s | {f}] - worth[s])
                       for s in worth if f not in s)
            assert abs(want - have[f]) < 1e-9


def test_shares_add_up_to_the_prediction(spark, fitted):
    frame, model, path = fitted
    leaves = read_leaves(spark, path)
    odd = frame.unionByName(spark.createDataFrame([(-1, *[None] * 6, 0.0), (-2, *[1e300] * 6, 0.0)], frame.schema))
    scored = with_shares(M.score(model, odd, NAMES), leaves, NAMES)
    gap = F.abs(F.aggregate(SHARES, F.lit(leaves.mean), lambda a, x: a + x) - F.col("pred_demand"))
    worst, rows = scored.agg(F.max(gap), F.count("*")).first()
    assert worst < 1e-9 and rows == 302
    assert with_shares(M.score(model, odd.limit(0), NAMES), leaves, NAMES).collect() == []


def test_trees_without_a_split_have_no_shares(spark, tmp_path):
    frame = spark.createDataFrame([(float(k), 1.0) for k in range(20)], "a double, target double")
    M.Learner(trees=2, depth=3).pipeline(["a"]).fit(frame).write().save(str(tmp_path / "m"))
    leaves = read_leaves(spark, str(tmp_path / "m"))
    assert leaves.mean == 1.0 and not shares(leaves, np.ones((3, 1))).any()


def test_model_forecasts_name_inputs_of_the_trees(spark, fitted):
    frame, model, path = fitted
    kept = M.TrainedModel("v", NAMES, model, None, 0.0, 0.0, [], {}, read_leaves(spark, path))
    scorer = ModelScorer(kept)
    lines = [r["t"] for r in scorer.predict(frame).select(scorer.explain().alias("t")).collect()]
    assert len(lines) == 300 and all(line.count(" contributed to ") == 3 for line in lines)
    assert sum("a contributed to" in line for line in lines) > 250  # the strongest input


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_surrogate_equals_the_normal_equations(spark, folder):
    i = Inputs(spark, folder)
    names = list(S.FEATURE_CONTRACT)
    frame = i.stored(X.training_frame(i.activity, i.events, i.regimes, names), "surrogate")
    got = M.linear_surrogate(frame, names)
    data = frame.select(*names, "target").toPandas().to_numpy(float)
    x, y = data[:, :-1], data[:, -1]
    spread = x.std(axis=0)
    used = spread > 1e-9 * np.maximum(1.0, np.abs(x).max(axis=0))
    z = (x[:, used] - x[:, used].mean(axis=0)) / spread[used]
    want = np.zeros(len(names))
    w = np.linalg.solve(z.T @ z / len(z) + M.RIDGE * np.eye(used.sum()), z.T @ (y - y.mean()) / len(z) / y.std())
    want[used] = w * y.std() / spread[used]
    have = np.array([got[f][0] for f in names])
    assert np.allclose(have[used] * spread[used], want[used] * spread[used], atol=1e-6 * y.std())
    assert np.allclose(have[~used], 0.0) and np.abs(have * spread).max() < 2 * y.std()


def test_surrogate_of_a_constant_label(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0)], "a double, b double, target double")
    assert M.linear_surrogate(frame, ["a", "b"]) == {"a": (0.0, 1.5), "b": (0.0, 3.0)}
