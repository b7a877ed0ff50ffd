"""Whole runs: extraction, alignment, cross-validated experiments, report and closeout.

Every run checks its data before it computes: what breaks a rule raises ``align.DataError``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, compare, controls, cv, diagnostics, folds, metrics, preprocess, signal_features
from ..sources import runs, tables
from ..sources.manifest import commit_manifest
from ..sources.shared import durable

#: Hashed words of the text block by text mode, and the name that result documents give the model.
WORDS, MODEL = {"frozen": 256, "finetune": 1024, "none": 256}, "multinomial logistic regression"


def extraction(samples: DataFrame, bands: DataFrame, recordings: DataFrame, labels: DataFrame, line_length: str = "normalized") -> DataFrame:
    """Feature rows of the recordings that match a label: recording, sentence_id, label, pos, name, value.

    Recordings are matched before any statistic is computed, and rows without a value go. Where
    samples have a subject, all subjects must have the same channels. Values are single precision,
    as the cache holds them.
    """
    if "subject" in samples.columns:
        signal_features.check_layouts(signal_features.subject_layouts(samples))
    matched = align.match_recordings(recordings, align.label_lookup(labels))
    used = samples.join(matched.select("recording"), "recording", "left_semi")
    channels = signal_features.channel_index(samples)
    rows = signal_features.feature_rows(signal_features.signal_statistics(used, line_length), bands, channels)
    rows = rows.withColumn("value", rows.value.cast("float"))
    usable = rows.where("value is not null").select("recording").distinct()
    return rows.join(usable, "recording", "left_semi").join(matched, "recording")


def alignment(features: DataFrame, labels: DataFrame, n_channels: int, reference: int, order: str | None = None, cached_labels: DataFrame | None = None) -> DataFrame:
    """Aligned features: the reference channel is whole or absent, every sentence has a recording,
    and cached labels are those of the label table."""
    align.check_reference(features, n_channels, reference)
    aligned = durable(align.align_features(features, labels, n_channels, reference, order))  # read by the checks and by what follows
    align.check_alignment(aligned, labels, cached_labels)
    return aligned


def extraction_run(features: DataFrame, folder: str, line_length: str = "normalized", subjects_table: str = "features") -> dict:
    """Writes extracted features (sentence_id, subject, pos, value) as a cache; returns its manifest.

    A cache of another mode or number of features stops the run; subjects are added to those there.
    """
    one = runs.extraction_manifest(features, line_length).first()
    manifest = commit_manifest(features.sparkSession, folder, {"line_length": line_length, "n_features": one.n_features}, {"subjects": [str(s.subject) for s in one.subjects]})
    tables.write_features(features, f"{folder}/{subjects_table}")
    return manifest


def experiment(features: DataFrame, labels: DataFrame, setup: str, seeds: list[int], penalties: list[float], n_folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of one setup, and what each penalty gave in each fold.

    The setup's control comes first, then preprocessing fitted on train. Predictions of gated
    setups have logits with and without the signal and the norms of all parts; a blocked signal
    (zero) leaves the logits as they are. Every labelled sentence must end with a prediction for
    every seed.
    """
    spark = labels.sparkSession
    rule = folds.parse_setups(spark.createDataFrame([(setup,)], "setup string")).first()
    marked = durable(labels.select("sentence_id", "sentiment_label"))  # read by the folds and the check; texts are read once
    splits = durable(folds.assign_splits(folds.assign_folds(marked, seeds, n_folds), n_folds))
    signal = cv.signal_block(features, splits, rule.eeg_control) if rule.uses_eeg else None
    rows = splits.withColumn("target", align.class_target(F.col("sentiment_label"))).drop("sentiment_label")
    fused = cv.fused_vectors(rows, labels, signal, rule.fusion, WORDS[rule.text_mode], rule.zero_eeg_contribution)
    found, history = cv.fit_folds(fused, setup, penalties, n_words=WORDS[rule.text_mode] if rule.fusion == "gated" else None)
    if rule.fusion != "gated":
        found = found.withColumns({c: F.lit(None).cast("array<double>" if c.startswith("logits") else "double") for c in cv.OWN})
    found = durable(found.withColumnRenamed("logits", "logits_with_eeg").withColumns({"text_mode": F.lit(rule.text_mode), "eeg_control": F.lit(rule.eeg_control)}))
    align.check_complete(marked, found)
    return found, history


def documents(predictions: DataFrame, history: DataFrame, features: DataFrame, labels: DataFrame, n_folds: int = 5) -> DataFrame:
    """The result documents of predictions of ``experiment``, one a setup and seed."""
    spark = labels.sparkSession
    at = ["setup", "seed", "fold"]
    seeds = sorted(r.seed for r in predictions.select("seed").distinct().collect())
    splits = durable(folds.assign_splits(folds.assign_folds(labels, seeds, n_folds), n_folds))
    setups = folds.parse_setups(predictions.select("setup").distinct())
    by_fold = metrics.classification_metrics(predictions, at)
    gated = predictions.where("logits_without_eeg is not null")
    detail = diagnostics.sentence_diagnostics(gated, align.sentence_metadata(labels)).join(gated.select("setup", "seed", "sentence_id", "fold"), ["setup", "seed", "sentence_id"])
    gates = gated.select(*at, F.when(F.col("eeg_control") == "zero", 0.0).otherwise(1.0).alias("gate")).distinct()
    # All fits start from zeros, so a setup's start is its shape.
    start = predictions.select(*at, "text_mode").distinct().select(*at, F.lit("text.weight").alias("name"), F.lit("float64").alias("kind"), F.concat(F.lit("(3, "), F.element_at(F.create_map(*(F.lit(x) for pair in WORDS.items() for x in pair)), F.col("text_mode")).cast("string"), F.lit(")")).alias("shape"), F.lit(b"\0").alias("value"))
    sizes = splits.groupBy("seed", "fold").agg(*(F.count_if(F.col("split") == x).cast("int").alias(f"n_{x}") for x in ("train", "val", "test")))
    control = setups.where("uses_eeg").select("eeg_control").distinct().collect()
    missing = [preprocess.observed(controls.apply_control(features, splits, r.eeg_control)).groupBy("seed", "fold").agg(F.count_if(~F.col("observed")).cast("int").alias("n")).withColumn("eeg_control", F.lit(r.eeg_control)) for r in control]
    where = predictions.select(*at).distinct().join(setups.select("setup", "uses_eeg", "eeg_control"), "setup")
    unseen = where.select(*at, F.lit(0).alias("n_all_missing_train_features"))
    if missing:
        every = missing[0]
        for frame in missing[1:]:
            every = every.unionByName(frame)
        unseen = where.join(every, ["seed", "fold", "eeg_control"], "left").select(*at, F.coalesce(F.when(F.col("uses_eeg"), F.col("n")), F.lit(0)).alias("n_all_missing_train_features"))
    folded = runs.fold_documents(
        by_fold, metrics.mean_log_loss(predictions, at, "logits_with_eeg"), history, gates, diagnostics.fold_diagnostics(detail), compare.fingerprint(start, at), unseen.join(sizes, ["seed", "fold"]))
    return runs.result_documents(metrics.classification_metrics(predictions, ["setup", "seed"]), folded, metrics.fold_summary(by_fold), setups, MODEL)


def data_digest(features: DataFrame, labels: DataFrame) -> dict:
    """Sizes and order-free hashes of a run's data, for its manifest."""
    def of(df: DataFrame, *columns: str) -> list:
        r = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        return [r[0], str(r[1])]

    return {"labels": of(labels, "sentence_id", "sentence", "sentiment_label"), "features": of(features, "sentence_id", "subject", "pos", "value")}


def run_experiments(features: DataFrame, labels: DataFrame, setups: list[str], seeds: list[int], penalties: list[float], folder: str, n_folds: int = 5) -> list[tuple[str, int]]:
    """Runs what the folder doesn't have yet of setups x seeds; returns that.

    The folder's manifest is committed first: other settings or data stop the run before any work.
    A setup and seed counts as done when its marker is there, which is written after its documents
    and predictions, so a run that was stopped goes on with the rest and rewrites nothing.
    """
    spark = labels.sparkSession
    fixed = {"penalties": penalties, "n_folds": n_folds, "data": data_digest(features, labels)}
    commit_manifest(spark, folder, fixed, {"setups": setups, "seeds": seeds})
    names = spark.createDataFrame([(s,) for s in setups], "setup string")
    folds.parse_setups(names).collect()  # unknown names stop here
    grid = folds.experiment_grid(names, seeds, n_folds).select("setup", "seed").distinct()
    left = tables.pending(grid, runs.done(spark, folder), ["setup", "seed"]).orderBy("setup", "seed").collect()
    for setup in dict.fromkeys(r.setup for r in left):
        own = [r.seed for r in left if r.setup == setup]
        found, history = experiment(features, labels, setup, own, penalties, n_folds)
        runs.write_results(documents(found, history, features, labels, n_folds), found, folder)
        runs.mark_done(spark, folder, [(setup, seed) for seed in own])
    return [(r.setup, r.seed) for r in left]


def report_run(spark, folder: str, out: str, samples: int = 2000) -> dict[str, DataFrame]:
    """The report tables of a run's result files, written under ``out`` as CSV and JSON.

    Gated setups of one text mode, seed and fold must have started from the same parameters.
    """
    results, predictions = runs.read_results(spark, folder), runs.read_predictions(spark, folder)
    compare.verified_initializations(runs.fingerprint_rows(results))
    gated, text = F.col("setup").startswith("gated_"), F.col("setup").startswith("text_")
    candidates = predictions.withColumn("baseline", compare.baseline_name(F.col("setup")))
    candidates = candidates.join(predictions.select(F.col("setup").alias("baseline")).distinct(), "baseline", "left_semi").drop("baseline")
    made = {
        "summary": (compare.seed_summary(runs.metric_rows(results), runs.gate_rows(results)), ["setup"]),
        "fold_diagnostics": (runs.diagnostic_rows(results), ["setup", "seed", "fold"]),
        "setup_diagnostics": (diagnostics.setup_diagnostics(runs.diagnostic_rows(results), runs.gate_rows(results)), ["setup"]),
        "mean_confusion": (metrics.mean_confusion(runs.metric_rows(results)), ["setup", "true", "predicted"]),
        "control_comparisons": (compare.control_report(predictions.where(gated), samples), ["text_mode", "control"]),
        "baseline_deltas": (compare.baseline_delta(candidates, predictions.where(text), samples), ["setup"])}
    return _written(made, out)


def _written(made: dict[str, tuple[DataFrame, list[str]]], out: str) -> dict[str, DataFrame]:
    """Each table computed once, written, and returned as it was computed."""
    kept = {name: (durable(df), keys) for name, (df, keys) in made.items()}
    for name, (df, keys) in kept.items():
        flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
        tables.write_report(flat, f"{out}/{name}", keys)
    return {name: df for name, (df, _) in kept.items()}


#: Keys of the closeout tables, in whose order they are written.
CLOSEOUT = {
    "sentence_diagnostics": ["setup", "seed", "sentence_id"], "paired_predictions": ["text_mode", "control", "seed", "sentence_id"], "prediction_flips": ["setup"],
    "modality_contribution_subsets": ["setup", "subset_type", "subset_name"], "subset_control_comparisons": ["text_mode", "control", "subset_type", "subset_name"],
    "decision": ["text_mode", "subset_name"], "findings": ["section", "text_mode", "what"]}


def closeout_run(spark, folder: str, labels: DataFrame, readers: DataFrame | None, out: str, samples: int = 2000, minimum_delta: float = 0.015) -> dict[str, DataFrame]:
    """The closeout of a run's result files, written under ``out``.

    A folder of an analysis with other settings stops the run.
    """
    commit_manifest(spark, out, {"samples": samples, "minimum_delta": minimum_delta, "run": folder})
    predictions = runs.read_predictions(spark, folder).where(F.col("setup").startswith("gated_"))
    found = closeout(predictions, align.sentence_metadata(labels, readers), samples, minimum_delta)
    return _written({name: (df, CLOSEOUT[name]) for name, df in found.items()}, out)


def closeout(predictions: DataFrame, metadata: DataFrame, samples: int = 2000, minimum_delta: float = 0.015) -> dict[str, DataFrame]:
    """All tables of the post-hoc analysis.

    All controlled setups must be there with the same seeds, predictions must fit labels and
    logits, and pairs must be complete. The diagnostics feed all tables, so they are written once.
    """
    spark = predictions.sparkSession
    gated = spark.createDataFrame([(s,) for s in folds.SETUPS if s.startswith("gated_")], "setup string")
    runs.check_controls(predictions.select("setup", "text_mode", "seed").distinct(), gated)
    diagnostics.check_predictions(predictions, metadata)
    frame = durable(diagnostics.sentence_diagnostics(predictions, metadata))
    compare.check_pairs(frame)
    paired = compare.paired_frame(frame)
    comparisons = durable(compare.subset_comparisons(paired, samples))
    contributions, flips = compare.contribution_comparisons(frame, samples), diagnostics.flip_summary(frame)
    return {
        "sentence_diagnostics": frame, "paired_predictions": paired.drop("_rank", "_n"), "prediction_flips": flips,
        "modality_contribution_subsets": contributions, "subset_control_comparisons": comparisons,
        "decision": compare.stop_decision(comparisons, minimum_delta), "findings": compare.findings(comparisons, contributions, flips)}
