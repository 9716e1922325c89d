"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from tidepanel.functions.columns import lenient_date, lenient_double
from tidepanel.operators.dedup import keep_last
from tidepanel.operators.normalize import normalize_feed
from tidepanel.sources import schemas as S


def scan_csv(spark: SparkSession, path: str, ddl: str, fill: bool = True) -> DataFrame:
    """CSV with a header, cast leniently to the declared columns.

    Columns are matched by the header, which the files of a folder share; absent ones are NULL (or
    stay away without ``fill``) and undeclared ones stay as text. A path that does not exist is an empty table.
    """
    declared = dict(S.columns(ddl))
    try:
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ddl)

    def typed(name: str, kind: str):
        if name not in raw.columns:
            return F.lit(None).cast(kind).alias(name)
        column = F.col(name)
        if kind == "DATE":
            return lenient_date(column).alias(name)
        if kind == "DOUBLE":
            return lenient_double(column).alias(name)
        return (column if kind == "STRING" else column.try_cast(kind)).alias(name)

    extra = [c for c in raw.columns if c not in declared]
    return raw.select(*[typed(n, k) for n, k in declared.items() if fill or n in raw.columns], *extra)


def scan_json(spark: SparkSession, path: str, ddl: str | None = None) -> DataFrame:
    """One JSON document per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(ddl) if ddl else reader).json(path)


def scan_profile_json(spark: SparkSession, path: str) -> DataFrame:
    """Baseline profile stored as ``{feature: {min, q10, ...}}``, one row per feature."""
    stats = "STRUCT<min: DOUBLE, q10: DOUBLE, q50: DOUBLE, q90: DOUBLE, max: DOUBLE, mean: DOUBLE, std: DOUBLE>"
    whole = spark.read.option("wholetext", True).text(path)
    parsed = whole.select(F.from_json("value", f"MAP<STRING, {stats}>").alias("m"))
    return parsed.select(F.explode("m").alias("feature", "s")).select("feature", "s.*")


def profile_document(profile: DataFrame) -> DataFrame:
    """The profile as one JSON document; it has one entry per feature column."""
    stats = F.struct(*[c for c in profile.columns if c != "feature"])
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", stats.alias("s")))))
    return profile.agg(F.to_json(entries).alias("value"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Every batch of a feed folder, canonical, one row per key."""
    return keep_last(normalize_feed(scan_csv(spark, path, S.FEED, fill=False)), ["date", "entity_id"])


def stream_feed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The feed folder as a stream of text columns named by the header that its files share.

    Columns may come in any order and under any accepted spelling, and may be missing; ``normalize_feed``
    reads them as it reads a batch. A file with another header stops the stream instead of being
    misread. A micro-batch takes every file that waits, so a large date may arrive as many files;
    where a date is one file, ``files_per_batch=1`` takes them one by one.
    """
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        header = S.names(S.FEED)
    names = ", ".join(f"`{c}` STRING" for c in header)
    reader = spark.readStream.schema(names).option("header", True).option("enforceSchema", False)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path)


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a whole table; Spark's commit protocol makes it appear at once."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_panel(df: DataFrame, path: str) -> None:
    """The panel partitioned by date, so date predicates prune files; AQE sizes the files."""
    df.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(path)


def save_bucketed_panel(df: DataFrame, name: str, buckets: int) -> None:
    """The panel bucketed and sorted by entity: entity windows then read it without an exchange."""
    df.write.mode("overwrite").bucketBy(buckets, "entity_id").sortBy("entity_id", "date").saveAsTable(name)
