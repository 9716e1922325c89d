"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepanel.session import scratch_dir

# While a table is written: its shuffle files go when it is there, and since the sides of its joins grow with the data,
# none of them is broadcast, at any size. Texts go to Python some at a time, as they can be long.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


class Scratch:
    """Tables of one run below one folder. A table is written once and then read, so a lost executor costs
    the tasks that read it and never the work before it."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, scratch_dir(spark, label)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = {k: conf.get(k, None) for k in _WRITING}
        for key, value in _WRITING.items():
            conf.set(key, value)
        try:
            df.write.parquet(path)
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
