"""Result documents, manifests and the rules that runs keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import CLASS_NAMES
from ..operators.align import require_none

#: Schema of a result document (one setup and seed).
RESULT = """
setup STRING, seed INT, model_name STRING, fusion STRING, text_mode STRING, eeg_control STRING, zero_eeg_contribution BOOLEAN, n_folds INT,
fold_accuracy_mean DOUBLE, fold_accuracy_std DOUBLE, fold_macro_f1_mean DOUBLE, fold_macro_f1_std DOUBLE,
oof STRUCT<accuracy: DOUBLE, macro_f1: DOUBLE, weighted_f1: DOUBLE, per_class_f1: MAP<STRING, DOUBLE>, confusion_matrix: ARRAY<ARRAY<BIGINT>>, class_names: ARRAY<STRING>>,
folds ARRAY<STRUCT<fold: INT, best_epoch: INT, best_val_macro_f1: DOUBLE,
  test: STRUCT<accuracy: DOUBLE, macro_f1: DOUBLE, weighted_f1: DOUBLE, per_class_f1: MAP<STRING, DOUBLE>, confusion_matrix: ARRAY<ARRAY<BIGINT>>, class_names: ARRAY<STRING>, loss: DOUBLE>, history: ARRAY<STRUCT<epoch: INT, train_loss: DOUBLE, val_loss: DOUBLE, val_accuracy: DOUBLE, val_macro_f1: DOUBLE>>,
  gate_mean: DOUBLE, gate_values: ARRAY<DOUBLE>,
  diagnostics: STRUCT<text_embedding_norm: STRUCT<mean: DOUBLE, std: DOUBLE, min: DOUBLE, max: DOUBLE>, eeg_embedding_norm: STRUCT<mean: DOUBLE, std: DOUBLE, min: DOUBLE, max: DOUBLE>, candidate_eeg_contribution_norm: STRUCT<mean: DOUBLE, std: DOUBLE, min: DOUBLE, max: DOUBLE>, gated_eeg_contribution_norm: STRUCT<mean: DOUBLE, std: DOUBLE, min: DOUBLE, max: DOUBLE>, logit_delta_l2: STRUCT<mean: DOUBLE, std: DOUBLE, min: DOUBLE, max: DOUBLE>, prediction_changed_without_eeg_count: BIGINT, prediction_changed_without_eeg_rate: DOUBLE>,
  initialization: STRUCT<seed: INT, task_sha256: STRING>, n_train: INT, n_val: INT, n_test: INT, n_all_missing_train_features: INT>>,
predictions ARRAY<STRUCT<sentence_id: BIGINT, target: INT, prediction: INT,
  diagnostics: STRUCT<text_embedding_norm: DOUBLE, eeg_embedding_norm: DOUBLE, candidate_eeg_contribution_norm: DOUBLE, gated_eeg_contribution_norm: DOUBLE, logits_with_eeg: ARRAY<DOUBLE>, logits_without_eeg: ARRAY<DOUBLE>>>>
"""


def fold_documents(metrics: DataFrame, losses: DataFrame, histories: DataFrame, gates: DataFrame, diagnostics: DataFrame, fingerprints: DataFrame, sizes: DataFrame) -> DataFrame:
    """setup, seed, folds: the folds of a run with what was measured in each; one array a run.

    All frames have setup, seed and fold. metrics: of the test split; losses: loss; histories:
    epoch, train_loss, val_loss, val_accuracy, val_macro_f1; gates: gate; diagnostics: of
    ``fold_diagnostics``; fingerprints: task_sha256; sizes: n_train, n_val, n_test,
    n_all_missing_train_features. A setup without gates or diagnostics has null there.
    """
    at = ["setup", "seed", "fold"]
    test = metrics.join(losses, at).select(*at, F.struct(*(oof(c) for c in OOF), "loss").alias("test"))
    past = F.array_sort(F.collect_list(F.struct("epoch", "train_loss", "val_loss", "val_accuracy", "val_macro_f1")))
    history = histories.groupBy(*at).agg(past.alias("history"), F.max(F.struct("val_macro_f1", F.negative("epoch").alias("e"))).alias("best"))
    gate = gates.groupBy(*at).agg(F.avg("gate").alias("gate_mean"), F.array_sort(F.collect_list("gate")).alias("gate_values"))
    moments = [F.struct(*(F.col(f"{c}_{n}").alias(n) for n in ("mean", "std", "min", "max"))).alias(c) for c in MEASURED]
    changed = diagnostics.select(*at, F.struct(*moments, F.col("changed_count").alias("prediction_changed_without_eeg_count"), F.col("changed_rate").alias("prediction_changed_without_eeg_rate")).alias("diagnostics"))
    start = fingerprints.select(*at, F.struct((F.col("seed") + 1000 * F.col("fold")).cast("int").alias("seed"), "task_sha256").alias("initialization"))
    x = test.join(history, at, "left").join(gate, at, "left").join(changed, at, "left").join(start, at, "left").join(sizes, at, "left")
    fold = F.struct("fold", F.negative("best.e").alias("best_epoch"), F.col("best.val_macro_f1").alias("best_val_macro_f1"), "test", "history", "gate_mean", "gate_values", "diagnostics", "initialization", "n_train", "n_val", "n_test", "n_all_missing_train_features")
    return x.groupBy("setup", "seed").agg(F.array_sort(F.collect_list(fold), lambda a, b: a["fold"] - b["fold"]).alias("folds"))


OOF = ["accuracy", "macro_f1", "weighted_f1", "per_class_f1", "confusion_matrix", "class_names"]
MEASURED = ["text_embedding_norm", "eeg_embedding_norm", "candidate_eeg_contribution_norm", "gated_eeg_contribution_norm", "logit_delta_l2"]


def oof(name: str) -> Column:
    """A field of the metrics struct from the columns of ``classification_metrics``."""
    if name == "per_class_f1":
        return F.create_map(*(x for k, c in enumerate(CLASS_NAMES) for x in (F.lit(c), F.col(f"f1_{k}")))).alias(name)
    if name == "confusion_matrix":
        return F.array(*(F.array(*(F.col(f"c{i}{j}").cast("long") for j in range(3))) for i in range(3))).alias(name)
    return F.array(*map(F.lit, CLASS_NAMES)).alias(name) if name == "class_names" else F.col(name)


def result_documents(metrics: DataFrame, folds: DataFrame, summary: DataFrame, setups: DataFrame, model_name: str) -> DataFrame:
    """One document a setup and seed, without its predictions, which are rows of their own.

    metrics: out-of-fold metrics by setup and seed; folds: of ``fold_documents``; summary: of
    ``fold_summary``; setups: of ``parse_setups``.
    """
    x = metrics.select("setup", "seed", F.struct(*map(oof, OOF)).alias("oof")).join(folds, ["setup", "seed"]).join(summary, ["setup", "seed"]).join(setups, "setup")
    return x.select("setup", "seed", F.lit(model_name).alias("model_name"), "fusion", "text_mode", "eeg_control", "zero_eeg_contribution", F.size("folds").alias("n_folds"), *(c for c in summary.columns if c not in ("setup", "seed")), "oof", "folds")


def write_results(documents: DataFrame, predictions: DataFrame, path: str) -> None:
    """Documents as JSON and predictions as rows, a partition for each setup and seed, which a
    later run of the same setup and seed replaces."""
    for name, rows, kind in (("documents", documents, "json"), ("predictions", predictions, "parquet")):
        rows = rows.withColumns({"_setup": F.col("setup"), "_seed": F.col("seed")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_setup", "_seed").format(kind).save(f"{path}/{name}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All result documents of a run, one a setup and seed; duplicates stop the job."""
    rows = spark.read.schema(RESULT).json(f"{path}/documents")
    require_none(rows.groupBy("setup", "seed").count().where("count > 1"), "two results of one setup and seed")
    return rows


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/predictions").drop("_setup", "_seed")


def mark_done(spark: SparkSession, path: str, rows: list[tuple[str, int]]) -> None:
    """Markers of setups and seeds whose results are complete; the last thing that a run writes."""
    marks = spark.createDataFrame(rows, "setup string, seed int").withColumns({"_setup": F.col("setup"), "_seed": F.col("seed")})
    marks.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_setup", "_seed").parquet(f"{path}/done")


def done(spark: SparkSession, path: str) -> DataFrame:
    """setup, seed of the markers in a run's folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "setup string, seed int")
    return spark.read.schema("setup string, seed int").parquet(f"{path}/done").select("setup", "seed")


def prediction_rows(results: DataFrame) -> DataFrame:
    """setup, seed, text_mode, eeg_control and the fields of predictions inside documents."""
    x = results.select("setup", "seed", "text_mode", "eeg_control", F.explode("predictions").alias("p"))
    return x.select("setup", "seed", "text_mode", "eeg_control", "p.sentence_id", "p.target", "p.prediction", "p.diagnostics.*")


def metric_rows(results: DataFrame) -> DataFrame:
    """setup, seed, accuracy, macro_f1, weighted_f1 and c00 to c22 of the documents."""
    cells = [F.get(F.get("oof.confusion_matrix", F.lit(i)), F.lit(j)).alias(f"c{i}{j}") for i in range(3) for j in range(3)]
    return results.select("setup", "seed", "oof.accuracy", "oof.macro_f1", "oof.weighted_f1", *cells)


def fold_rows(results: DataFrame) -> DataFrame:
    return results.select("setup", "seed", "text_mode", F.explode("folds").alias("f")).select("setup", "seed", "text_mode", "f.*")


def gate_rows(results: DataFrame) -> DataFrame:
    """setup, seed, fold, gate: every coordinate of every fold."""
    return fold_rows(results).select("setup", "seed", "fold", F.explode("gate_values").alias("gate"))


def diagnostic_rows(results: DataFrame) -> DataFrame:
    """The rows of ``fold_diagnostics`` that the documents hold."""
    x = fold_rows(results).where("diagnostics is not null")
    moments = [F.col(f"diagnostics.{c}.{n}").alias(f"{c}_{n}") for c in MEASURED for n in ("mean", "std", "min", "max")]
    return x.select("setup", "seed", "fold", *moments, F.col("diagnostics.prediction_changed_without_eeg_count").alias("changed_count"), F.col("diagnostics.prediction_changed_without_eeg_rate").alias("changed_rate"), "n_test")


def fingerprint_rows(results: DataFrame) -> DataFrame:
    return fold_rows(results).select("setup", "text_mode", "seed", "fold", "initialization.task_sha256")


def missing_controls(results: DataFrame, setups: DataFrame) -> DataFrame:
    """Controlled setups without any result."""
    return setups.select("setup").join(results.select("setup").distinct(), "setup", "left_anti")


def seed_sets(results: DataFrame) -> DataFrame:
    """text_mode, matched: have all gated setups of a text mode the same seeds?"""
    gated = results.where(F.col("setup").startswith("gated_"))
    sets = gated.groupBy("text_mode", "setup").agg(F.array_join(F.array_sort(F.collect_set("seed")), ",").alias("seeds"))
    return sets.groupBy("text_mode").agg(F.count("*").alias("n_setups"), (F.countDistinct("seeds") == 1).alias("matched"))


def check_controls(results: DataFrame, setups: DataFrame) -> None:
    require_none(missing_controls(results, setups), "the run is missing controlled results")
    require_none(seed_sets(results).where("not matched"), "controlled setups have different seeds")


def run_tag(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "'run_'yyyyMMdd_HHmmss")


def extraction_manifest(features: DataFrame, line_length: str) -> DataFrame:
    """One row: rows by subject, their number, the number of features and the mode."""
    rows = features.groupBy("subject").agg(F.countDistinct("sentence_id").alias("rows"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("subject", "rows"))).alias("subjects"), F.count("*").alias("n_subjects"))
    return one.crossJoin(features.agg(F.countDistinct("pos").alias("n_features"))).withColumn("line_length", F.lit(line_length))


def merge_manifest(existing: DataFrame, new: DataFrame, fixed: list[str], unioned: list[str]) -> DataFrame:
    """The existing manifest with setups and seeds added; ``fixed`` fields must agree."""
    e, n = existing.alias("e"), new.alias("n")
    both = e.crossJoin(n)
    require_none(both.where(" or ".join(f"not (e.{c} <=> n.{c})" for c in fixed)).select(*(f"e.{c}" for c in fixed)), "the run folder has another manifest") if fixed else None
    return both.select(*(F.col(f"e.{c}") for c in fixed), *(F.array_sort(F.array_union(f"e.{c}", f"n.{c}")).alias(c) for c in unioned))


