"""Registered queries: each applies operators to views over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from ..functions.text import normalize_text, subject_from_path, word_count
from ..functions.vectors import argmax, class_name, l2, minus
from ..operators import align, compare, controls, cv, diagnostics, folds, metrics, preprocess, scoring, signal_features
from ..sources import runs, tables
from ..sources.shared import durable, shared_folder
from . import runs as whole_runs
from . import views

SEEDS = views.SEEDS
SAMPLES = 2000
#: Channels and reference channel of the feature view (64 positions: 16 families of 4 channels).
N_CHANNELS, REFERENCE = 4, 3

REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def r(name: str, places: int = 6):
    """Rounded for comparison; a negative zero becomes zero.

    The shifted double is rounded, as SQL engines do. Spark's round takes the shortest decimal
    instead, so a double just under a half would go up.
    """
    return (F.round(F.col(name) * 10.0**places) / 10.0**places + 0.0).alias(name)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query
def labels_scan(spark: SparkSession, sf: str) -> DataFrame:
    x = views.labels(spark, sf)
    target = align.class_target(F.col("sentiment_label"))
    return x.select("sentence_id", F.md5(normalize_text(F.col("sentence"))).alias("norm_md5"), word_count(F.col("sentence")).alias("word_count"), target.alias("target"), class_name(target).alias("class_name"))


@query
def label_lookup(spark, sf):
    return align.label_lookup(views.labels(spark, sf)).select(F.md5("norm_text").alias("norm_md5"), "sentence_id", "sentiment_label")


@query
def recording_match(spark, sf):
    return align.match_recordings(views.recordings(spark, sf), align.label_lookup(views.labels(spark, sf)))


@query
def sentence_metadata(spark, sf):
    return align.sentence_metadata(views.labels(spark, sf))


@query
def signal_statistics(spark, sf):
    return rounded(signal_features.signal_statistics(views.samples(spark, sf)))


@query
def line_length_sum(spark, sf):
    return rounded(signal_features.signal_statistics(views.samples(spark, sf), "sum").select("recording", "channel", "line_length"))


@query
def channel_layout(spark, sf):
    return signal_features.channel_counts(views.samples(spark, sf))


@query
def feature_matrix(spark, sf):
    x = views.samples(spark, sf)
    return rounded(signal_features.feature_rows(signal_features.signal_statistics(x), views.bands(spark, sf, signal_features.BANDS), signal_features.channel_index(x)))


def _aligned(spark, sf, every=False):
    """The feature view twice, an older and a newer cache; the newer rows stay."""
    x = views.features(spark, sf, every)
    both = x.withColumns({"value": F.col("value") - 1, "cache_row": F.lit(0)}).unionByName(x.withColumn("cache_row", F.lit(1)))
    return whole_runs.alignment(both, views.feature_labels(spark, sf, every), N_CHANNELS, REFERENCE, "cache_row")


@query
def aligned_features(spark, sf):
    return rounded(_aligned(spark, sf))


@query
def data_summary(spark, sf):
    names = signal_features.feature_names(N_CHANNELS - 1, spark).where("pos < 48")  # the reference is the last channel
    dropped = signal_features.feature_names(N_CHANNELS, spark).where((F.col("pos") < 64) & (F.col("channel") == REFERENCE))
    return align.data_summary(_aligned(spark, sf), views.feature_labels(spark, sf), 16, names, dropped)


@query
def reader_counts(spark, sf):
    return align.reader_counts(_aligned(spark, sf))


@query
def metadata_with_readers(spark, sf):
    """The labelled sentences that have aligned recordings; every embedding is one."""
    return align.sentence_metadata(views.labels(spark, sf), align.reader_counts(_aligned(spark, sf, every=True)))


@query
def subject_layouts(spark, sf):
    x = views.samples(spark, sf).withColumn("subject", F.col("recording") % 7)
    layouts = signal_features.subject_layouts(x)
    signal_features.check_layouts(layouts)
    return layouts


@query
def subject_ids(spark, sf):
    """Subjects of paths of every kind: named as recordings, in folders that Spark wrote, and otherwise."""
    named = F.regexp_replace("source", "[^A-Za-z0-9]", "")
    kinds = [("/d/results", named, "doc_id", "_SR.x.mat"), ("/d/results", F.concat("source", F.lit("-")), "doc_id", "_SR.mat"), ("/d/resultsP", F.lit(""), "doc_id", "_SR.parquet/part-00000-a.parquet"), ("/d/my_results", F.lit(""), "doc_id", ".mat"), ("/d/S", F.lit(""), "doc_id", ".h5/part-00001-b.parquet")]
    path = F.element_at(F.array(*(F.concat(F.lit(a), b, c, F.lit(d)) for a, b, c, d in kinds)), (F.col("doc_id") % 5 + 1).cast("int"))
    return views.table(spark, sf, "documents").select("doc_id", subject_from_path(path).alias("subject"))


@query
def run_tags(spark, sf):
    return views.table(spark, sf, "events").select("event_id", runs.run_tag(F.col("ts")).alias("tag"))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query
def labels_from_csv(spark, sf):
    """The labels written as CSV and read by the labels source."""
    path = _folder(spark)
    views.labels(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    x = tables.read_labels(spark, path)
    return x.select("sentence_id", F.md5(normalize_text(F.col("sentence"))).alias("norm_md5"), "sentiment_label")


@query
def features_from_cache(spark, sf):
    """The features written as a cache of subjects and read back."""
    path = _folder(spark)
    tables.write_features(views.features(spark, sf), path)
    return rounded(tables.read_features(spark, path, 64).select("sentence_id", F.col("subject").cast("long").alias("subject"), "pos", "value"))


@query
def setup_grid(spark, sf):
    """Setups parsed, crossed with the seeds and folds that the label table has."""
    names = spark.createDataFrame([(s,) for s in folds.SETUPS], "setup string")
    used = folds.assign_folds(views.labels(spark, sf), SEEDS).select("seed", "fold").distinct()
    parsed = folds.parse_setups(names)
    return folds.experiment_grid(parsed, SEEDS).join(used, ["seed", "fold"]).join(parsed, "setup")


@query
def fold_assignment(spark, sf):
    return folds.assign_folds(views.labels(spark, sf), SEEDS)


@query
def split_assignment(spark, sf):
    return folds.assign_splits(folds.assign_folds(views.labels(spark, sf), SEEDS))


def _splits(spark, sf):
    return folds.assign_splits(folds.assign_folds(views.feature_labels(spark, sf), SEEDS))


@query
def shuffled_control(spark, sf):
    return controls.permutation(_splits(spark, sf))


@query
def noise_control(spark, sf):
    return rounded(controls.apply_control(views.features(spark, sf), _splits(spark, sf), "noise"))


@query
def fold_preprocessing(spark, sf):
    return rounded(preprocess.fit_splits(views.features(spark, sf), durable(_splits(spark, sf))))


@query
def shuffled_transform(spark, sf):
    features, splits = views.features(spark, sf), durable(_splits(spark, sf))
    rows = controls.apply_control(features, splits, "shuffled")
    return rounded(preprocess.transform(rows, preprocess.fit_control(rows, features, splits, "shuffled")))


@query
def pooled_features(spark, sf):
    return rounded(preprocess.pooled(views.features(spark, sf), []))


def _scored(spark, sf):
    return views.predictions(spark, sf).withColumn("prediction", argmax(F.col("logits_with_eeg")))


@query
def classification_metrics(spark, sf):
    return rounded(metrics.classification_metrics(_scored(spark, sf), ["setup", "seed"]))


@query
def log_loss(spark, sf):
    return rounded(metrics.mean_log_loss(_scored(spark, sf), ["setup", "seed"], "logits_with_eeg"))


def _by_fold(spark, sf):
    fold = folds.assign_folds(views.labels(spark, sf), SEEDS).select("sentence_id", "seed", "fold")
    return _scored(spark, sf).join(fold, ["sentence_id", "seed"])


@query
def fold_summary(spark, sf):
    return rounded(metrics.fold_summary(metrics.classification_metrics(_by_fold(spark, sf), ["setup", "seed", "fold"])))


def _gates(spark, sf, by_fold=None):
    """Gate logits by setup, seed and fold that have predictions: four coordinates each."""
    keys = (_by_fold(spark, sf) if by_fold is None else by_fold).select("setup", "seed", "fold").distinct()
    logits = F.array(*(4 * uniform("g", F.col("setup"), F.col("seed"), F.col("fold"), k) - 2 for k in range(4)))
    return scoring.gate_values(keys.withColumn("gate", logits), ["setup", "seed", "fold"])


@query
def seed_summary(spark, sf):
    return rounded(compare.seed_summary(metrics.classification_metrics(_scored(spark, sf), ["setup", "seed"]), _gates(spark, sf)))


def _diagnostics(spark, sf):
    return diagnostics.sentence_diagnostics(views.predictions(spark, sf), align.sentence_metadata(views.labels(spark, sf)))


@query
def sentence_diagnostics(spark, sf):
    return rounded(_diagnostics(spark, sf))


@query
def flip_summary(spark, sf):
    return rounded(diagnostics.flip_summary(_diagnostics(spark, sf)))


def _fold_diagnostics(spark, sf):
    fold = folds.assign_folds(views.labels(spark, sf), SEEDS).select("sentence_id", "seed", "fold")
    return diagnostics.fold_diagnostics(_diagnostics(spark, sf).join(fold, ["sentence_id", "seed"]))


@query
def fold_diagnostics(spark, sf):
    return rounded(_fold_diagnostics(spark, sf))


@query
def setup_diagnostics(spark, sf):
    return rounded(diagnostics.setup_diagnostics(_fold_diagnostics(spark, sf), _gates(spark, sf)))


@query
def confidence_quartiles(spark, sf):
    return diagnostics.quartiles(_diagnostics(spark, sf), ["text_mode", "eeg_control", "seed"]).select("setup", "seed", "sentence_id", "confidence_quartile")


@query
def paired_predictions(spark, sf):
    d = _diagnostics(spark, sf)
    compare.check_pairs(d)
    return compare.paired_frame(d).select("text_mode", "control", "seed", "sentence_id", "target", "prediction_with_eeg_aligned", "prediction_with_eeg_control", "delta", "prediction_agreement", "confidence_quartile")


@query
def contribution_comparisons(spark, sf):
    return rounded(compare.contribution_comparisons(_diagnostics(spark, sf), SAMPLES))


def _comparisons(spark, sf):
    return compare.subset_comparisons(compare.paired_frame(compare.compared(_diagnostics(spark, sf))), SAMPLES)


@query
def subset_comparisons(spark, sf):
    return rounded(_comparisons(spark, sf))


@query
def reader_subsets(spark, sf):
    """Comparisons by number of readers, for the sentences with recordings."""
    metadata = align.sentence_metadata(views.labels(spark, sf), align.reader_counts(_aligned(spark, sf)))
    paired = compare.paired_frame(compare.compared(diagnostics.sentence_diagnostics(views.predictions(spark, sf), metadata)))
    return rounded(compare.subset_comparisons(paired, SAMPLES).where("subset_type = 'reader_count'"))


@query
def stop_decision(spark, sf):
    return compare.stop_decision(_comparisons(spark, sf))


@query
def chart_rows(spark, sf):
    return compare.chart_rows(_comparisons(spark, sf)).select("text_mode", "control", "subset_name", *(r(c, 4) for c in ("bar", "error_low", "error_high")))


@query
def report_findings(spark, sf):
    d = _diagnostics(spark, sf)
    return rounded(compare.findings(_comparisons(spark, sf), compare.contribution_comparisons(d, SAMPLES), diagnostics.flip_summary(d)))


@query
def control_report(spark, sf):
    return rounded(compare.control_report(_scored(spark, sf), SAMPLES))


@query
def baseline_delta(spark, sf):
    return rounded(compare.baseline_delta(_scored(spark, sf), views.baseline_predictions(spark, sf), SAMPLES))


@query
def initialization_audit(spark, sf):
    """Fingerprints of parameter tables that depend on text mode, seed and fold only."""
    runs_ = _by_fold(spark, sf).select("setup", "text_mode", "seed", "fold").distinct()
    p = runs_.select("*", F.explode(F.array(F.lit("head.weight"), F.lit("head.bias"), F.lit("text_encoder.weight"))).alias("name"))
    value = F.when(F.col("name").startswith("text_encoder"), F.col("setup")).otherwise(F.concat_ws("|", "text_mode", "seed", "fold"))
    p = p.withColumns({"kind": F.lit("float32"), "shape": F.lit("(3,)"), "value": value.cast("binary")})
    prints = compare.fingerprint(p, ["setup", "text_mode", "seed", "fold"])
    compare.verified_initializations(prints)
    return compare.initialization_audit(prints)


@query
def parameter_fingerprints(spark, sf):
    runs_ = _by_fold(spark, sf).select("setup", "seed", "fold").distinct()
    p = runs_.select("*", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("name")).withColumns({"kind": F.lit("float32"), "shape": F.lit("(2, 2)"), "value": F.concat_ws("|", "seed", "fold").cast("binary")})
    return compare.fingerprint(p, ["setup", "seed", "fold"])


@query
def mean_confusion(spark, sf):
    return rounded(metrics.mean_confusion(metrics.classification_metrics(_scored(spark, sf), ["setup", "seed"])))


def _documents(spark, sf):
    """The run's result documents, written with its predictions and read back."""
    at = ["setup", "seed", "fold"]
    # Predictions and folds are computed once; every table of the documents reads them.
    assigned = durable(folds.assign_folds(views.labels(spark, sf), SEEDS))
    scored = durable(_scored(spark, sf))
    by_fold = durable(scored.join(assigned.select("sentence_id", "seed", "fold"), ["sentence_id", "seed"]))
    diagnosed = diagnostics.sentence_diagnostics(scored, align.sentence_metadata(views.labels(spark, sf))).join(assigned.select("sentence_id", "seed", "fold"), ["sentence_id", "seed"])
    epochs = by_fold.select(*at).distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("epoch"))
    u = lambda name: uniform(name, *(F.col(c) for c in (*at, "epoch"))).alias(name)
    histories = epochs.select(*at, "epoch", *map(u, ("train_loss", "val_loss", "val_accuracy", "val_macro_f1")))
    prints = by_fold.select(*at, F.md5(F.concat_ws("|", "text_mode", "seed", "fold")).alias("task_sha256")).distinct()
    splits = folds.assign_splits(assigned).groupBy("seed", "fold").agg(*(F.count_if(F.col("split") == s).cast("int").alias(f"n_{s}") for s in ("train", "val", "test")))
    sizes = by_fold.select(*at).distinct().join(splits, ["seed", "fold"]).withColumn("n_all_missing_train_features", F.lit(0))
    fold_metrics = metrics.classification_metrics(by_fold, at)
    folded = runs.fold_documents(fold_metrics, metrics.mean_log_loss(by_fold, at, "logits_with_eeg"), histories, _gates(spark, sf, by_fold), diagnostics.fold_diagnostics(diagnosed), prints, sizes)
    setups = folds.parse_setups(spark.createDataFrame([(s,) for s in folds.SETUPS], "setup string"))
    documents = runs.result_documents(metrics.classification_metrics(scored, ["setup", "seed"]), folded, metrics.fold_summary(fold_metrics), setups, "multinomial logistic regression")
    path = _folder(spark)
    runs.write_results(documents, scored, path)
    return runs.read_results(spark, path), runs.read_predictions(spark, path)


@query
def seed_summary_from_files(spark, sf):
    documents, _ = _documents(spark, sf)
    return rounded(compare.seed_summary(runs.metric_rows(documents), runs.gate_rows(documents)))


@query
def setup_diagnostics_from_files(spark, sf):
    documents, _ = _documents(spark, sf)
    return rounded(diagnostics.setup_diagnostics(runs.diagnostic_rows(documents), runs.gate_rows(documents)))


@query
def mean_confusion_from_files(spark, sf):
    documents, predictions = _documents(spark, sf)
    compare.verified_initializations(runs.fingerprint_rows(documents))
    align.check_complete(views.labels(spark, sf), predictions)
    return rounded(metrics.mean_confusion(runs.metric_rows(documents)))


@query
def predictions_from_files(spark, sf):
    documents, predictions = _documents(spark, sf)
    runs.check_controls(documents, predictions.select("setup").distinct())
    return rounded(metrics.classification_metrics(predictions, ["setup", "seed"]).join(documents.select("setup", "seed", "n_folds", "fold_accuracy_mean"), ["setup", "seed"]).select("setup", "seed", "n", "macro_f1", "n_folds", "fold_accuracy_mean"))


@query
def score_chart(spark, sf):
    return compare.score_chart(compare.seed_summary(metrics.classification_metrics(_scored(spark, sf), ["setup", "seed"]), _gates(spark, sf)))


@query
def flip_chart(spark, sf):
    return compare.flip_chart(diagnostics.flip_summary(_diagnostics(spark, sf)))


@query
def best_epochs(spark, sf):
    """Histories of macro-F1 over 12 epochs for each setup, seed and fold with predictions."""
    runs_ = _by_fold(spark, sf).select(F.concat_ws("/", "setup", "seed", "fold").alias("run")).distinct()
    history = runs_.select("run", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("epoch"))
    return rounded(metrics.best_epoch(history.withColumn("f1", uniform("f1", F.col("run"), F.col("epoch"))), 4))


@query
def run_completeness(spark, sf):
    """Seeds and setups of the controlled run by text mode: complete and matched?"""
    return runs.seed_sets(views.predictions(spark, sf).select("setup", "text_mode", "seed").distinct())


@query
def pending_runs(spark, sf):
    """The grid without what the run has: the setups that are not controlled ones."""
    names = spark.createDataFrame([(s,) for s in folds.SETUPS], "setup string")
    grid = folds.experiment_grid(names, SEEDS).select("setup", "seed").distinct()
    return tables.pending(grid, views.predictions(spark, sf), ["setup", "seed"])


@query
def run_manifest(spark, sf):
    """Setups and seeds of the run in one row, as the manifest unions them."""
    x = views.predictions(spark, sf).select("setup", "seed").distinct()
    old = x.where("eeg_control = 'aligned'") if "eeg_control" in x.columns else x.where(F.col("setup").isin("gated_finetune", "gated_frozen"))
    pack = lambda d: d.agg(F.collect_set("setup").alias("setups"), F.collect_set("seed").alias("seeds"), F.lit(5).alias("n_folds"))
    merged = runs.merge_manifest(pack(old), pack(x), ["n_folds"], ["setups", "seeds"])
    return merged.select("n_folds", F.array_join("setups", ",").alias("setups"), F.array_join("seeds", ",").alias("seeds"))


@query
def extraction_manifest(spark, sf):
    x = runs.extraction_manifest(views.features(spark, sf), "normalized")
    return x.select("n_subjects", "n_features", "line_length", F.array_join(F.transform("subjects", lambda s: F.concat_ws(":", s["subject"], s["rows"])), ",").alias("subjects"))


def _parameters(spark):
    """A fixed parameter row for 64 signal features, 8 text features and 3 classes."""
    def u(name, n):
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: uniform(name, i) - 0.5)

    def m(name, rows, n):
        return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: uniform(name, i, j) - 0.5))

    return spark.range(1).select(u("gate", 8).alias("gate"), m("project", 8, 64).alias("project"), u("pb", 8).alias("project_bias"), m("classify", 3, 8).alias("classify"), u("cb", 3).alias("classify_bias"))


def _embedded(spark, sf):
    pooled = preprocess.pooled(views.features(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0))), [])
    signal = pooled.groupBy("sentence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("signal"))
    return signal.withColumn("text", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: uniform("text", F.col("sentence_id"), i)))


@query
def gated_scoring(spark, sf):
    x = scoring.gated_scores(_embedded(spark, sf), _parameters(spark))
    z = scoring.gated_scores(_embedded(spark, sf), _parameters(spark), zero=True).select("sentence_id", argmax(F.col("logits_with_eeg")).alias("zero_prediction"), F.col("gated_eeg_contribution_norm").alias("zero_norm"))
    x = x.select("sentence_id", *(F.get(c, F.lit(k)).alias(f"{n}{k}") for n, c in (("with_", "logits_with_eeg"), ("without_", "logits_without_eeg")) for k in range(3)), "text_embedding_norm", "eeg_embedding_norm", "candidate_eeg_contribution_norm", "gated_eeg_contribution_norm")
    return rounded(x.join(z, "sentence_id"))


@query
def experiment_predictions(spark, sf):
    """An experiment of the gated setup: who is predicted where, and that its parts add up."""
    sentences = views.table(spark, sf, "documents").select(F.col("doc_id").alias("sentence_id"), F.col("text").alias("sentence"))
    labels = views.feature_labels(spark, sf).join(sentences, "sentence_id")
    found, _ = whole_runs.experiment(views.features(spark, sf), labels, "gated_frozen", SEEDS[:1], [0.1])
    added = l2(minus(F.col("logits_with_eeg"), F.col("logits_without_eeg")))
    return found.select(
        "setup", "seed", "fold", "sentence_id", "target", (F.col("prediction") == argmax(F.col("logits_with_eeg"))).alias("fits_logits"),
        ((F.abs(added - F.col("gated_eeg_contribution_norm")) < 1e-9) & (F.col("text_embedding_norm") > 0)).alias("parts_add_up"))


@query
def cross_validated(spark, sf):
    """Out-of-fold predictions of text and signal together, two penalties."""
    sentences = views.table(spark, sf, "documents").select(F.col("doc_id").alias("sentence_id"), F.col("text").alias("sentence"))
    labels = views.feature_labels(spark, sf).join(sentences, "sentence_id")
    splits = durable(folds.assign_splits(folds.assign_folds(labels.select("sentence_id", "sentiment_label"), SEEDS)))
    signal = cv.signal_block(views.features(spark, sf), splits, "aligned")
    rows = splits.withColumn("target", align.class_target(F.col("sentiment_label"))).drop("sentiment_label")
    out = cv.cross_validate(cv.fused_vectors(rows, labels, signal, "concat"), "concat_frozen", [0.01, 0.1])
    return out.select("setup", "seed", "fold", "sentence_id", "target", "prediction", "penalty")
