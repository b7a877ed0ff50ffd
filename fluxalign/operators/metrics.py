"""Classification metrics as aggregations over (target, prediction) counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import softmax

CLASSES = 3


def confusion_columns(target: Column, prediction: Column, weight: Column | None = None) -> list[Column]:
    """Nine sums c00 to c22 (true, predicted)."""
    w = F.lit(1) if weight is None else weight
    return [F.sum(F.when((target == i) & (prediction == j), w).otherwise(0)).alias(f"c{i}{j}") for i in range(CLASSES) for j in range(CLASSES)]


def class_f1(k: int, prefix: str = "c") -> Column:
    """2 tp / (true + predicted); 0 where the class is neither true nor predicted."""
    c = lambda i, j: F.col(f"{prefix}{i}{j}")
    both = sum((c(k, j) for j in range(CLASSES)), F.lit(0)) + sum((c(i, k) for i in range(CLASSES)), F.lit(0))
    return F.coalesce(F.try_divide(2.0 * c(k, k), both.cast("double")), F.lit(0.0))


def macro_f1(prefix: str = "c", present_only: bool = False) -> Column:
    """Mean F1 over the fixed classes, or over those true or predicted at least once."""
    scores = sum((class_f1(k, prefix) for k in range(CLASSES)), F.lit(0.0))
    if not present_only:
        return scores / float(CLASSES)
    here = [(sum((F.col(f"{prefix}{k}{j}") for j in range(CLASSES)), F.lit(0)) + sum((F.col(f"{prefix}{i}{k}") for i in range(CLASSES)), F.lit(0)) > 0).cast("int") for k in range(CLASSES)]
    return F.try_divide(scores, sum(here, F.lit(0)).cast("double"))


def classification_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """by, n, accuracy, macro_f1, weighted_f1, f1_0 to f1_2 and the confusion counts."""
    counts = predictions.groupBy(*by).agg(F.count("*").alias("n"), *confusion_columns(F.col("target"), F.col("prediction")))
    true = [sum((F.col(f"c{k}{j}") for j in range(CLASSES)), F.lit(0)) for k in range(CLASSES)]
    right = sum((F.col(f"c{k}{k}") for k in range(CLASSES)), F.lit(0))
    weighted = sum((class_f1(k) * true[k] for k in range(CLASSES)), F.lit(0.0)) / F.col("n")
    return counts.withColumns({"accuracy": right / F.col("n"), "macro_f1": macro_f1(), "weighted_f1": weighted, **{f"f1_{k}": class_f1(k) for k in range(CLASSES)}})


def mean_log_loss(predictions: DataFrame, by: list[str], logits: str) -> DataFrame:
    p = F.get(softmax(F.col(logits)), F.col("target"))
    return predictions.groupBy(*by).agg(F.avg(-F.log(p)).alias("loss"))


def fold_summary(by_fold: DataFrame) -> DataFrame:
    """setup, seed: mean and population deviation of accuracy and macro-F1 over folds."""
    return by_fold.groupBy("setup", "seed").agg(
        F.avg("accuracy").alias("fold_accuracy_mean"), F.stddev_pop("accuracy").alias("fold_accuracy_std"),
        F.avg("macro_f1").alias("fold_macro_f1_mean"), F.stddev_pop("macro_f1").alias("fold_macro_f1_std"))


def mean_confusion(metrics: DataFrame) -> DataFrame:
    """setup, true, predicted, mean_count, share: averaged over seeds, rows normalised."""
    cells = F.array(*(F.struct(F.lit(i).alias("true"), F.lit(j).alias("predicted"), F.col(f"c{i}{j}").alias("c")) for i in range(CLASSES) for j in range(CLASSES)))
    flat = metrics.select("setup", F.explode(cells).alias("x")).groupBy("setup", "x.true", "x.predicted").agg(F.avg("x.c").alias("mean_count"))
    rows = flat.groupBy("setup", "true").agg(F.sum("mean_count").alias("total"))
    return flat.join(rows, ["setup", "true"]).select("setup", "true", "predicted", "mean_count", (F.col("mean_count") / F.greatest("total", F.lit(1.0))).alias("share"))


def best_epoch(history: DataFrame, patience: int) -> DataFrame:
    """run, best_epoch, best_f1, stopped_at: the first best epoch, and where training stops."""
    ordered = F.array_sort(F.collect_list(F.struct("epoch", "f1")))
    start = F.expr("named_struct('best', cast(-1.0 as double), 'at', 0, 'bad', 0, 'stop', 0)")

    def step(s: Column, x: Column) -> Column:
        better = x["f1"] > s["best"] + 1e-8
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        new = F.struct(F.when(better, x["f1"]).otherwise(s["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(s["at"]).alias("at"), bad.alias("bad"), F.when(bad >= patience, x["epoch"]).otherwise(0).alias("stop"))
        return F.when(s["stop"] > 0, s).otherwise(new)

    runs = history.select("run", F.col("epoch").cast("int"), F.col("f1").cast("double")).groupBy("run").agg(F.aggregate(ordered, start, step).alias("s"), F.max("epoch").alias("last"))
    return runs.select("run", F.col("s.at").alias("best_epoch"), F.col("s.best").alias("best_f1"), F.when(F.col("s.stop") > 0, F.col("s.stop")).otherwise(F.col("last")).alias("stopped_at"))
