"""Negative controls: destroy the link between recordings and sentences inside each split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import keyed_hash, normal
from .folds import rank_by_hash

GROUP = ["seed", "fold", "split"]


def permutation(splits: DataFrame) -> DataFrame:
    """seed, fold, split, sentence_id, source_id: a permutation inside every split."""
    key = lambda tag: keyed_hash(tag, *(F.col(c) for c in (*GROUP, "sentence_id")))
    to = rank_by_hash(splits.select(*GROUP, "sentence_id"), GROUP, key("to"), "sentence_id", "place")
    source = rank_by_hash(splits.select(*GROUP, "sentence_id"), GROUP, key("from"), "sentence_id", "place").withColumnRenamed("sentence_id", "source_id")
    return to.join(source, [*GROUP, "place"]).drop("place")


def apply_control(features: DataFrame, splits: DataFrame, control: str) -> DataFrame:
    """Feature rows (seed, fold, split, sentence_id, subject, pos, value) under a control.

    shuffled moves the recordings of a sentence, and their absence, to another sentence of the
    split; noise replaces every value of the rows present; aligned and zero leave them.
    """
    if control in ("aligned", "zero"):
        return splits.select(*GROUP, "sentence_id").join(features, "sentence_id").select(*GROUP, "sentence_id", "subject", "pos", "value")
    if control == "shuffled":
        moved = permutation(splits)
        return moved.join(features.withColumnRenamed("sentence_id", "source_id"), "source_id").select(*GROUP, "sentence_id", "subject", "pos", "value")
    if control == "noise":
        rows = splits.select(*GROUP, "sentence_id").join(features, "sentence_id")
        return rows.select(*GROUP, "sentence_id", "subject", "pos", normal(*(F.col(c) for c in ("seed", "fold", "sentence_id", "subject", "pos"))).alias("value"))
    raise ValueError(f"unknown control {control!r}")
