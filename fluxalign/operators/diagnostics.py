"""Held-out diagnostics of each sentence, and their summaries by fold and setup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax, class_name, l2, margin, minus, ratio, softmax
from .align import require_none
from .folds import rank_by_range

NORMS = ["text_embedding_norm", "eeg_embedding_norm", "candidate_eeg_contribution_norm", "gated_eeg_contribution_norm"]


def sentence_diagnostics(predictions: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row a setup, seed and sentence: predictions with and without the signal, flips, norms."""
    x = predictions.join(metadata.withColumnRenamed("target", "label_target"), "sentence_id")
    p = softmax(F.col("logits_without_eeg"))
    x = x.withColumns({"prediction_with_eeg": argmax(F.col("logits_with_eeg")), "prediction_without_eeg": argmax(F.col("logits_without_eeg")), "p": p})
    right = lambda c: (F.col(c) == F.col("target")).cast("int")
    x = x.withColumns({"correct_with_eeg": right("prediction_with_eeg"), "correct_without_eeg": right("prediction_without_eeg")})
    return x.select(
        "setup", "text_mode", "eeg_control", "seed", "sentence_id", "target", class_name(F.col("target").cast("int")).alias("class_name"), "word_count", "length_group",
        *(["reader_count"] if "reader_count" in metadata.columns else []),
        "prediction_with_eeg", "prediction_without_eeg", "correct_with_eeg", "correct_without_eeg",
        (F.col("prediction_with_eeg") != F.col("prediction_without_eeg")).cast("int").alias("prediction_changed"),
        (F.col("correct_with_eeg") * (1 - F.col("correct_without_eeg"))).alias("favorable_flip"),
        (F.col("correct_without_eeg") * (1 - F.col("correct_with_eeg"))).alias("unfavorable_flip"),
        F.array_max("p").alias("text_path_confidence"), margin(F.col("p")).alias("text_path_margin"), *NORMS,
        ratio(F.col("gated_eeg_contribution_norm"), F.col("text_embedding_norm")).alias("contribution_to_text_norm_ratio"),
        l2(minus(F.col("logits_with_eeg"), F.col("logits_without_eeg"))).alias("logit_delta_l2"))


def check_predictions(predictions: DataFrame, metadata: DataFrame) -> None:
    """Every prediction has a labelled sentence with its target, and diagnostics."""
    x = predictions.join(metadata.select("sentence_id", F.col("target").alias("label_target")), "sentence_id", "left")
    bad = x.where(F.col("label_target").isNull() | (F.col("label_target") != F.col("target")) | F.col("logits_with_eeg").isNull() | F.col("logits_without_eeg").isNull())
    if "prediction" in predictions.columns:
        bad = bad.unionByName(x.where(argmax(F.col("logits_with_eeg")) != F.col("prediction")))
    require_none(bad.select("setup", "seed", "sentence_id"), "predictions that don't fit the labels or their logits")


def quartiles(rows: DataFrame, by: list[str], value: str = "text_path_confidence") -> DataFrame:
    """Adds confidence_quartile: ranks (ties by sentence) cut at 1 + (n - 1) q, right-closed."""
    return ranked(rows, by, value).drop("_rank", "_n")


def ranked(rows: DataFrame, by: list[str], value: str = "text_path_confidence") -> DataFrame:
    """Adds _rank and _n within ``by`` and confidence_quartile."""
    x = rank_by_range(rows, by, value, "sentence_id", "_rank", "_n")
    edge = lambda q: F.col("_rank") <= 1 + (F.col("_n") - 1) * q
    name: Column = F.when(edge(0.25), "q1_lowest").when(edge(0.5), "q2").when(edge(0.75), "q3").otherwise("q4_highest")
    return x.withColumn("confidence_quartile", name)


def rank_quantiles(ranks: DataFrame, by: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """by and q0, q1, ...: linear quantiles of a ranked frame, from the two rows beside each."""
    place = lambda q: 1 + (F.col("_n") - 1) * q
    beside = lambda q: (F.col("_rank") == F.floor(place(q))) | (F.col("_rank") == F.ceil(place(q)))
    wanted = ranks.where(reduce(lambda a, b: a | b, map(beside, quantiles)))
    low = lambda q: F.min(F.when(beside(q), F.col(value)))
    high = lambda q: F.max(F.when(beside(q), F.col(value)))
    share = lambda q: F.max(place(q) - F.floor(place(q)))
    return wanted.groupBy(*by).agg(*((low(q) + share(q) * (high(q) - low(q))).alias(f"q{i}") for i, q in enumerate(quantiles)))


def flip_summary(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("setup", "text_mode", "eeg_control").agg(
        F.countDistinct("seed").alias("n_seeds"), F.count("*").alias("n_predictions"), F.sum("prediction_changed").alias("prediction_changed_count"),
        F.avg("prediction_changed").alias("prediction_changed_rate"), F.sum("favorable_flip").alias("favorable_flip_count"), F.sum("unfavorable_flip").alias("unfavorable_flip_count"),
        (F.sum("correct_with_eeg") - F.sum("correct_without_eeg")).alias("net_correct_change"), F.avg("logit_delta_l2").alias("logit_delta_l2_mean"),
        F.avg("contribution_to_text_norm_ratio").alias("contribution_to_text_norm_ratio_mean"))


def fold_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """By setup, seed and fold: mean, std, min, max of the norms and of the logit change."""
    stats = [f(c).alias(f"{c}_{n}") for c in [*NORMS, "logit_delta_l2"] for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return diagnostics.groupBy("setup", "seed", "fold").agg(
        *stats, F.sum("prediction_changed").alias("changed_count"), F.avg("prediction_changed").alias("changed_rate"), F.count("*").alias("n_test"))


def setup_diagnostics(by_fold: DataFrame, gates: DataFrame) -> DataFrame:
    """By setup: plain means of the fold means, norm ratios, share changed and gate values."""
    means = by_fold.groupBy("setup").agg(
        F.countDistinct("seed").alias("n_seeds"), *(F.avg(f"{c}_mean").alias(f"{c}_mean") for c in [*NORMS, "logit_delta_l2"]),
        (F.sum("changed_count") / F.greatest(F.sum("n_test"), F.lit(1))).alias("prediction_changed_without_eeg_rate"))
    gate = gates.groupBy("setup").agg(F.avg("gate").alias("gate_mean"), F.min("gate").alias("gate_min"), F.max("gate").alias("gate_max"))
    x = means.join(gate, "setup", "left")
    text = F.col("text_embedding_norm_mean")
    return x.withColumns({"candidate_to_text_norm_ratio": ratio(F.col("candidate_eeg_contribution_norm_mean"), text), "effective_to_text_norm_ratio": ratio(F.col("gated_eeg_contribution_norm_mean"), text)})
