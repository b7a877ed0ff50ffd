"""Labels, recordings, feature caches and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import subject_from_path
from ..operators.align import DataError, require_none

LABELS = "sentence_id double, sentence string, sentiment_label double"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from CSV: the three required columns, rows with all of them, ids unique, by id."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = {"sentence_id", "sentence", "sentiment_label"} - set(header.columns)
    if missing:
        raise DataError(f"no column {', '.join(sorted(missing))} among the labels")
    rows = header.select(F.col("sentence_id").cast("decimal(38, 9)").cast("bigint").alias("sentence_id"), "sentence", F.col("sentiment_label").cast("double").cast("int").alias("sentiment_label")).dropna()
    require_none(rows.groupBy("sentence_id").count().where("count > 1"), "several labels for one sentence")
    return rows.orderBy("sentence_id")


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Long recordings from Parquet with the subject that each file's name gives."""
    return spark.read.parquet(path).withColumn("subject", subject_from_path(F.col("_metadata.file_path")))


def write_features(features: DataFrame, path: str) -> None:
    """One partition a subject; a subject that is written again replaces its own partition only."""
    features.repartition("subject").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject").parquet(path)


def read_features(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Cached features of all subjects; every row must have ``width`` positions."""
    rows = spark.read.parquet(path)
    counts = rows.groupBy("subject", "sentence_id").agg(F.countDistinct("pos").alias("n")).where(F.col("n") != width)
    require_none(counts, f"feature width is not {width}")
    return rows


def pending(requested: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is requested and not done yet."""
    return requested.join(done.select(*keys).distinct(), keys, "left_anti")


def write_report(df: DataFrame, path: str, keys: list[str], kinds: tuple[str, ...] = ("csv", "json")) -> None:
    """A report table in several formats, each in a folder of its own; files and rows in key order."""
    for kind in kinds:
        writer = df.orderBy(*keys).write.mode("overwrite")
        writer.option("header", True).csv(f"{path}/csv") if kind == "csv" else writer.format(kind).save(f"{path}/{kind}")
