"""Imputation and scaling fitted on training rows only, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import known
from ..sources.shared import durable
from .quantiles import exact_quantiles

FEATURE = ["seed", "fold", "pos"]
MOMENTS = {"n": "count(*)", "k": "count(value)", "avg": "avg(value)", "var": "var_pop(value)"}


def _median(rows: DataFrame, group: list[str], members=None) -> DataFrame:
    return exact_quantiles(rows, group, "value", {"m": 0.5}, members)


def _scale(std):
    return F.when(std >= 1e-8, std).otherwise(1.0)


def observed(rows: DataFrame) -> DataFrame:
    """seed, fold, pos, observed: whether a train row has a value, as ``fit`` says it, without a fit."""
    train = rows.where("split = 'train'").withColumn("value", known(F.col("value")))
    return train.groupBy(*FEATURE).agg((F.count("value") > 0).alias("observed"))


def fit(rows: DataFrame) -> DataFrame:
    """seed, fold, pos, observed, median, mean, std over the rows of split train."""
    train = durable(rows.where("split = 'train'").select(*FEATURE, known(F.col("value")).alias("value")))
    return _filled(train.groupBy(*FEATURE).agg(*(F.expr(e).alias(name) for name, e in MOMENTS.items())), _median(train, FEATURE).drop("member"))


def fit_splits(features: DataFrame, splits: DataFrame) -> DataFrame:
    """``fit`` for controls that leave a fold's train rows what they are, as a set: aligned, zero, and
    shuffled, whose recordings change places inside a split.

    A row is shuffled and kept once for all seeds and folds, with the numbers of those that train
    on it; it is multiplied only in the stages that aggregate.
    """
    train = splits.where("split = 'train'")
    pairs = train.select("seed", "fold").distinct().withColumn("member", F.row_number().over(Window.orderBy("seed", "fold")) - 1)  # one a fold and seed
    pairs = F.broadcast(durable(pairs))
    within = train.join(pairs, ["seed", "fold"]).groupBy("sentence_id").agg(F.collect_set("member").alias("_train"))
    x = durable(features.join(within, "sentence_id").select("pos", known(F.col("value")).alias("value"), "_train"))
    seen = x.select("pos", "value", F.explode("_train").alias("member")).groupBy("pos", "member").agg(*(F.expr(e).alias(name) for name, e in MOMENTS.items()))
    return _filled(seen.join(pairs, "member"), _median(x, ["pos"], F.col("_train")).join(pairs, "member"))


def fit_control(rows: DataFrame, features: DataFrame, splits: DataFrame, control: str) -> DataFrame:
    """The fit of a control's ``rows``; only noise, whose values differ by fold, needs them."""
    return fit(rows) if control == "noise" else fit_splits(features, splits)


def _filled(seen: DataFrame, medians: DataFrame) -> DataFrame:
    """Moments with the missing rows at the median, from those of the rows seen."""
    x = seen.join(medians, FEATURE, "left").withColumns({"observed": F.col("m").isNotNull(), "median": F.coalesce("m", F.lit(0.0))})
    share = F.col("k") / F.col("n")
    x = x.withColumn("mean", F.coalesce(F.col("avg") * share, F.lit(0.0)) + F.col("median") * (1 - share))
    spread = lambda c: F.pow(F.coalesce(F.col(c), F.lit(0.0)) - F.col("mean"), F.lit(2))
    x = x.withColumn("std", _scale(F.sqrt(share * (F.coalesce("var", F.lit(0.0)) + spread("avg")) + (1 - share) * spread("median"))))
    return x.select(*FEATURE, "observed", "median", "mean", "std")


def transform(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows with missing values imputed and all scaled; features unseen in training are 0.

    Rows of a fold that had no train rows stop the job.
    """
    x = rows.withColumn("value", known(F.col("value"))).join(F.broadcast(fitted), FEATURE, "left")
    trained = F.broadcast(fitted.select("seed", "fold").distinct().withColumn("_trained", F.lit(True)))
    missing = F.concat(F.lit("no train rows for seed "), F.col("seed").cast("string"), F.lit(", fold "), F.col("fold").cast("string"))
    x = x.join(trained, ["seed", "fold"], "left")
    scaled = F.when(F.col("_trained").isNull(), F.raise_error(missing).cast("double")).when(F.col("observed"), (F.coalesce("value", "median") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return x.select("seed", "fold", "split", "sentence_id", "subject", "pos", scaled.alias("value"))


def pooled(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean over the subjects present: absent recordings have no rows, so they are masked."""
    return rows.groupBy(*by, "sentence_id", "pos").agg(F.avg("value").alias("value"))
