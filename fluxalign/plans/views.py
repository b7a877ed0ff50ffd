"""The experiment's tables as views over the given ones (labels, samples, features, predictions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import uniform

SEEDS = [42, 52, 62]
TEXT_MODES = ["finetune", "frozen"]
CONTROLS = ["shuffled", "noise", "zero"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentence_id, sentence, sentiment_label in -1, 0, 1."""
    marked = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("sentiment_label"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(marked, "doc_id").select(
        F.col("doc_id").alias("sentence_id"), F.col("text").alias("sentence"), "sentiment_label")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, content: every document's text in curly quotes, as another source would have it."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording"), F.concat(F.lit("“"), F.col("text"), F.lit("”")).alias("content"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, channel, at (order), value; every 17th value is missing."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording"), F.col("event_type").alias("channel"), F.struct("ts", "event_id").alias("at"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))


def bands(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """recording, channel, band, value."""
    band = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("recording"), F.col("event_type").alias("channel"), band.alias("band")).agg(F.avg("value").alias("value"))


def features(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """sentence_id, subject, pos, value in long form; a recording that has no label is missing and has no
    rows, unless ``every`` embedding is a recording."""
    e = table(spark, sf_dir, "embeddings")
    if not every:
        e = e.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    e = e.select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    gone = ((F.col("vec_id") + F.col("pos")) % 13 == 0) | (F.col("pos") == 7)
    return e.select(F.floor(F.col("vec_id") / 5).alias("sentence_id"), (F.col("vec_id") % 5).alias("subject"), "pos", F.when(~gone, F.col("value").cast("double")).alias("value"))


def feature_labels(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """sentence_id, sentiment_label of the sentences that have features."""
    return features(spark, sf_dir, every).select("sentence_id").distinct().withColumn("sentiment_label", (F.col("sentence_id") % 3 - 1).cast("int"))


def setup_name(mode, control):
    return F.when(control == "aligned", F.concat(F.lit("gated_"), mode)).otherwise(F.concat(F.lit("gated_"), control, F.lit("_"), mode))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each controlled setup, seed and sentence, with logits and norms."""
    base = labels(spark, sf_dir).select("sentence_id", (F.col("sentiment_label") + 1).alias("target"))
    grid = base.select(
        "*", F.explode(F.array(*map(F.lit, SEEDS))).alias("seed")).select(
        "*", F.explode(F.array(*map(F.lit, TEXT_MODES))).alias("text_mode")).select(
        "*", F.explode(F.array(*map(F.lit, ["aligned", *CONTROLS]))).alias("eeg_control"))
    i, s, m, c = (F.col(x) for x in ("sentence_id", "seed", "text_mode", "eeg_control"))
    without = [uniform("w", i, s, m, k) + F.when(F.col("target") == k, 0.3).otherwise(0.0) for k in range(3)]
    live = F.when(c == "zero", 0.0).otherwise(1.0)
    added = [0.3 * (uniform("c", i, s, m, c, k) - 0.5) * live for k in range(3)]
    out = grid.select(
        setup_name(m, c).alias("setup"), "text_mode", "eeg_control", "seed", "sentence_id", "target",
        F.array(*without).alias("logits_without_eeg"), F.array(*added).alias("added"),
        (1.0 + uniform("t", i, s, m)).alias("text_embedding_norm"), (1.0 + uniform("e", i, s, m, c)).alias("eeg_embedding_norm"),
        (0.2 * uniform("n", i, s, m, c)).alias("candidate_eeg_contribution_norm"))
    return out.withColumn("logits_with_eeg", F.zip_with("logits_without_eeg", "added", lambda a, b: a + b)).withColumn(
        "gated_eeg_contribution_norm", F.col("candidate_eeg_contribution_norm") * F.when(c == "zero", 0.0).otherwise(1.0)).drop("added")


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """setup, seed, sentence_id, target, prediction of the text-only setups."""
    from ..functions.vectors import argmax

    i, s, m = F.col("sentence_id"), F.col("seed"), F.col("text_mode")
    base = labels(spark, sf_dir).select("sentence_id", (F.col("sentiment_label") + 1).alias("target"), F.explode(F.array(*map(F.lit, SEEDS))).alias("seed")).select("*", F.explode(F.array(*map(F.lit, TEXT_MODES))).alias("text_mode"))
    logits = F.array(*(uniform("b", i, s, m, k) + F.when(F.col("target") == k, 0.3).otherwise(0.0) for k in range(3)))
    return base.select(F.concat(F.lit("text_"), m).alias("setup"), "seed", "sentence_id", "target", argmax(logits).alias("prediction"))
