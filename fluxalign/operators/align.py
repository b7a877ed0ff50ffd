"""Matching of recordings with labels, alignment of feature rows, and data checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, word_count
from ..functions.vectors import known


class DataError(ValueError):
    """A table breaks a rule that the experiment relies on."""


def require_none(bad: DataFrame, message: str) -> None:
    """Raise with a few of the offending rows; reads no further than needed."""
    rows = bad.take(5)
    if rows:
        raise DataError(f"{message}: {[tuple(r) for r in rows]}")


def class_target(label):
    """Class 0, 1 or 2 of a label -1, 0 or 1; any other label stops the job."""
    return F.when(label.isin(-1, 0, 1), label + 1).otherwise(F.raise_error(F.concat(F.lit("labels must be -1, 0 or 1, not "), label))).cast("int")


def label_lookup(labels: DataFrame) -> DataFrame:
    """norm_text, sentence_id, sentiment_label; of equal texts the larger id stays."""
    keyed = labels.select(normalize_text(F.col("sentence")).alias("norm_text"), F.struct("sentence_id", "sentiment_label").alias("s"))
    return keyed.groupBy("norm_text").agg(F.max("s").alias("s")).select("norm_text", "s.*")


def match_recordings(recordings: DataFrame, lookup: DataFrame) -> DataFrame:
    """Recordings whose normalised text is labelled; joined on a 256-bit digest, so texts stay put."""
    left = recordings.select("recording", F.sha2(normalize_text(F.col("content")), 256).alias("digest"))
    right = lookup.select("sentence_id", "sentiment_label", F.sha2("norm_text", 256).alias("digest"))
    return left.join(right, "digest").drop("digest")


def last_rows(features: DataFrame, order: str) -> DataFrame:
    """Of several cached rows of a sentence and subject, those of the greatest ``order``."""
    newest = F.max(order).over(Window.partitionBy("sentence_id", "subject"))
    return features.withColumn("newest", newest).where(F.col(order) == F.col("newest")).drop("newest", order)


def drop_reference(features: DataFrame, n_channels: int, reference: int) -> DataFrame:
    """Features without the reference channel, positions renumbered; pos is family-major."""
    channel = F.col("pos") % n_channels
    family = F.floor(F.col("pos") / n_channels)
    return features.where(channel != reference).withColumn("pos", (family * (n_channels - 1) + channel - (channel > reference).cast("int")).cast("int"))


def check_reference(features: DataFrame, n_channels: int, reference: int) -> None:
    """The reference channel has a feature in every family, or in none."""
    n_families = F.countDistinct(F.floor(F.col("pos") / n_channels))
    n_removed = F.countDistinct(F.when(F.col("pos") % n_channels == reference, F.col("pos")))
    require_none(features.agg(n_families.alias("families"), n_removed.alias("removed")).where("removed not in (0, families)"), "the reference channel lacks features of some families")


def align_features(features: DataFrame, labels: DataFrame, n_channels: int, reference: int, order: str | None = None) -> DataFrame:
    """sentence_id, subject, pos, value of labelled sentences; rows without a finite value go."""
    rows = features if order is None else last_rows(features, order)
    rows = drop_reference(rows, n_channels, reference).withColumn("value", known(F.col("value")))
    usable = rows.groupBy("sentence_id", "subject").agg(F.bool_or(F.col("value").isNotNull()).alias("usable")).where("usable").select("sentence_id", "subject")
    return rows.join(usable, ["sentence_id", "subject"], "left_semi").join(labels.select("sentence_id"), "sentence_id", "left_semi")


def check_alignment(aligned: DataFrame, labels: DataFrame, cached_labels: DataFrame | None = None) -> None:
    """Every sentence has a recording; cached labels equal the label table's."""
    require_none(labels.select("sentence_id").join(aligned.select("sentence_id").distinct(), "sentence_id", "left_anti"), "sentences without recordings")
    if cached_labels is not None:
        other = cached_labels.select("sentence_id", F.col("sentiment_label").alias("cached"))
        require_none(labels.join(other, "sentence_id").where("sentiment_label != cached").select("sentence_id", "cached"), "label mismatch")


def check_complete(labels: DataFrame, predictions: DataFrame) -> None:
    """Every labelled sentence has a prediction in every setup and seed."""
    wanted = predictions.select("setup", "seed").distinct().crossJoin(labels.select("sentence_id"))
    require_none(wanted.join(predictions, ["setup", "seed", "sentence_id"], "left_anti"), "sentences without out-of-fold predictions")


def check_same_sentences(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Groups ``keys`` that both frames have hold the same sentences and targets."""
    row = [*keys, "sentence_id", "target"]
    both = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys)
    a, b = (x.select(*row).join(both, keys, "left_semi") for x in (left, right))
    require_none(a.join(b, row, "left_anti").unionByName(b.join(a, row, "left_anti")), "sentences or targets differ between compared runs")


def reader_counts(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("sentence_id").agg(F.countDistinct("subject").alias("reader_count"))


def data_summary(aligned: DataFrame, labels: DataFrame, n_families: int, names: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row: sizes, readers a sentence, class counts, the names of features that are missing
    everywhere, and of the reference features dropped, both in matrix order.

    ``names``: pos, name of the features left; ``dropped``: the same of those dropped. Both have
    one row a feature.
    """
    by_feature = aligned.groupBy("pos").agg(F.count("value").alias("seen")).join(names.select("pos", "name"), "pos")
    listed = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["name"]), ",")
    wide = by_feature.agg(F.count("*").alias("n_features"), F.count_if(F.col("seen") == 0).alias("n_globally_all_missing_features"), listed(F.when(F.col("seen") == 0, F.struct("pos", "name"))).alias("all_missing"))
    wide = wide.crossJoin(dropped.agg(F.count("*").alias("n_dropped_reference_features"), listed(F.struct("pos", "name")).alias("dropped_reference_features")))
    readers = reader_counts(aligned).agg(
        F.sum("reader_count").alias("usable_subject_sentence_rows"), F.min("reader_count").alias("subjects_per_sentence_min"),
        F.max("reader_count").alias("subjects_per_sentence_max"), F.round(F.avg("reader_count"), 6).alias("subjects_per_sentence_mean"))
    classes = labels.agg(F.count("*").alias("n_sentences"), *(F.count_if(F.col("sentiment_label") == v).alias(n) for v, n in ((-1, "negative"), (0, "neutral"), (1, "positive"))))
    subjects = aligned.agg(F.countDistinct("subject").alias("n_subjects"))
    one = wide.crossJoin(readers).crossJoin(classes).crossJoin(subjects)
    return one.withColumn("n_channels", F.floor(F.col("n_features") / n_families)).withColumn("n_feature_families", F.lit(n_families))


def sentence_metadata(labels: DataFrame, readers: DataFrame | None = None) -> DataFrame:
    """sentence_id, target, word_count, length_group; quartiles over all sentences.

    With ``readers`` (sentence_id, reader_count; one row a sentence) those that have one, and
    reader_count.
    """
    if readers is not None:
        for rows in (labels, readers):
            require_none(rows.groupBy("sentence_id").count().where("count > 1"), "sentence_id must be unique")
    words = labels.select("sentence_id", class_target(F.col("sentiment_label")).alias("target"), word_count(F.col("sentence")).alias("word_count"))
    edges = words.agg(F.percentile("word_count", 0.25).alias("low"), F.percentile("word_count", 0.75).alias("high"))
    group = F.when(F.col("word_count") <= F.col("low"), "short").when(F.col("word_count") > F.col("high"), "long").otherwise("medium")
    out = words.crossJoin(F.broadcast(edges)).select("sentence_id", "target", "word_count", group.alias("length_group"))
    return out if readers is None else out.join(readers.select("sentence_id", "reader_count"), "sentence_id")
