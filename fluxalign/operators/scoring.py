"""Gated residual scoring of embeddings with a broadcast row of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2, sigmoid


def linear(matrix: Column, bias: Column, x: Column) -> Column:
    """matrix x + bias; the matrix is an array of rows."""
    return F.zip_with(F.transform(matrix, lambda row: dot(row, x)), bias, lambda a, b: a + b)


def gated_scores(rows: DataFrame, parameters: DataFrame, zero: bool = False) -> DataFrame:
    """Logits with and without the gated contribution, and the norms of all parts.

    ``rows``: text, signal (arrays) and other columns. ``parameters``: one row of gate, project,
    project_bias, classify, classify_bias. ``zero`` blocks the contribution, not the candidate.
    """
    x = rows.crossJoin(F.broadcast(parameters))
    candidate = F.zip_with(F.transform("gate", sigmoid), linear(F.col("project"), F.col("project_bias"), F.col("signal")), lambda g, v: g * v)
    x = x.withColumn("candidate", candidate)
    x = x.withColumn("contribution", F.transform("candidate", lambda v: v * 0.0) if zero else F.col("candidate"))
    x = x.withColumn("fused", F.zip_with("text", "contribution", lambda a, b: a + b))
    logits = lambda v: linear(F.col("classify"), F.col("classify_bias"), F.col(v))
    return x.select(
        *(c for c in rows.columns if c not in ("text", "signal")), logits("fused").alias("logits_with_eeg"), logits("text").alias("logits_without_eeg"),
        l2(F.col("text")).alias("text_embedding_norm"), l2(F.col("signal")).alias("eeg_embedding_norm"),
        l2(F.col("candidate")).alias("candidate_eeg_contribution_norm"), l2(F.col("contribution")).alias("gated_eeg_contribution_norm"))


def gate_values(parameters: DataFrame, by: list[str]) -> DataFrame:
    """by, gate: a row for each coordinate's open share."""
    return parameters.select(*by, F.explode("gate").alias("g")).select(*by, sigmoid(F.col("g")).alias("gate"))
