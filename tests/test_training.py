"""The registered training run fits the whole demand model, and boosting can checkpoint in any session."""

import datetime as dt

import pytest

from tidepanel.plans import model as M, queries_state
from tidepanel.plans.registry import Inputs
from tidepanel.session import checkpoints
from tidepanel.sources import schemas as S


class Fitted(Exception):
    pass


@pytest.fixture()
def without_folder(spark):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext._jsc.sc().setCheckpointDir(None)
    yield spark
    spark.sparkContext._jsc.sc().setCheckpointDir(before)


def test_h3_fits_all_trees(without_folder, tmp_path, monkeypatch):
    spark, day = without_folder, dt.datetime(2024, 1, 1, 12)
    rows = [(30 * u + k, day + dt.timedelta(days=k), u, "view", float(u + k), None) for u in range(10) for k in range(30)]
    spark.createDataFrame(
        rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    ).write.parquet(str(tmp_path / "events.parquet"))

    def fit(pipeline, frame):
        assembler, trees = pipeline.getStages()
        assert assembler.getInputCols() == list(S.FEATURE_CONTRACT) and frame.count() == 10 * 23
        assert (trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize()) == (700, 6, 0.03)
        assert (trees.getSubsamplingRate(), trees.getFeatureSubsetStrategy(), trees.getSeed()) == (0.9, "0.9", 42)
        assert spark.sparkContext.getCheckpointDir() and trees.getCheckpointInterval() == 10
        raise Fitted

    monkeypatch.setattr(M.Pipeline, "fit", fit)
    with pytest.raises(Fitted):
        queries_state.h3_gbt_train(Inputs(spark, str(tmp_path)))
    assert spark.sparkContext.getCheckpointDir() is None  # put back


def test_a_given_checkpoint_folder_stays(spark):
    before = spark.sparkContext.getCheckpointDir()
    with checkpoints(spark):
        assert spark.sparkContext.getCheckpointDir() == before
    assert before and spark.sparkContext.getCheckpointDir() == before
