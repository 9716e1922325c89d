"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
# The JVM compiles no method above this size.
_COMPILED = "8000"


def build_session(app_name: str = "tidepanel", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on: UTC dates, ANSI casts, adaptive plans."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def wide_plans(spark: SparkSession) -> Iterator[None]:
    """What runs in here on frames of many columns is compiled by the JVM, and the setting is put back.

    Spark fuses a stage into one method; above 8,000 bytes, as with a few dozen columns, the JVM would interpret it.
    With the limit such a stage is run operator by operator, each in small methods.
    """
    before = spark.conf.get(_METHOD_LIMIT, None)
    spark.conf.set(_METHOD_LIMIT, _COMPILED)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_METHOD_LIMIT)
        else:
            spark.conf.set(_METHOD_LIMIT, before)


@contextmanager
def checkpoints(spark: SparkSession) -> Iterator[None]:
    """What runs in here can checkpoint: a session without a checkpoint folder gets a scratch folder for so long.

    Boosting derives each round's errors from those of the round before, and only a checkpoint cuts that chain, which
    tasks carry with them.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        yield
        return
    context.setCheckpointDir(scratch_dir(spark, "checkpoints"))
    try:
        yield
    finally:
        context._jsc.sc().setCheckpointDir(None)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder the cluster shares through ``spark.checkpoint.dir``.

    Where that is unset, as in a first try on one machine, the warehouse takes its place: it is the other
    folder that driver and executors share. A machine-local temporary folder is never used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
