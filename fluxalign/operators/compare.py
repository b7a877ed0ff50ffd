"""Comparisons of setups: with controls, with baselines, and by overlapping subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import check_same_sentences, require_none
from ..sources.shared import durable
from .bootstrap import CELLS, class_counts, count_intervals, delta_interval, macro_of_counts, paired_delta
from .diagnostics import rank_quantiles, ranked

CONTROLS = ["shuffled", "noise", "zero"]
PRIORITY = ["low_confidence_25", "low_confidence_50", "no_eeg_incorrect"]
#: What places a row in its subsets, and what comparisons read of diagnostics besides.
PLACING = ["seed", "sentence_id", "class_name", "length_group", "text_path_confidence", "correct_without_eeg", "confidence_quartile"]
COMPARED = ["setup", "text_mode", "eeg_control", "target", *PLACING[:-1], "correct_with_eeg", "prediction_with_eeg", "prediction_changed", "favorable_flip", "unfavorable_flip"]


def paired_frame(diagnostics: DataFrame) -> DataFrame:
    """Aligned rows beside each control's, with correctness difference, agreement and quartile.

    _rank and _n are the place by confidence within (text mode, control, seed) and its size.
    """
    keys = ["text_mode", "seed", "sentence_id", "target"]
    both = ["prediction_with_eeg", "correct_with_eeg"]
    aligned = diagnostics.where("eeg_control = 'aligned'").select(*(F.col(c).alias(f"{c}_aligned") if c in both else F.col(c) for c in diagnostics.columns if c not in ("setup", "eeg_control")))
    other = diagnostics.where(F.col("eeg_control").isin(CONTROLS)).select(*keys, F.col("eeg_control").alias("control"), *(F.col(c).alias(f"{c}_control") for c in both))
    pair = aligned.join(other, keys)
    pair = pair.withColumn("delta", F.col("correct_with_eeg_aligned") - F.col("correct_with_eeg_control"))
    pair = pair.withColumn("prediction_agreement", (F.col("prediction_with_eeg_aligned") == F.col("prediction_with_eeg_control")).cast("int"))
    return ranked(pair, ["text_mode", "control", "seed"])


def compared(diagnostics: DataFrame) -> DataFrame:
    """The columns that comparisons read; others need not be computed, ranked and written for them."""
    return diagnostics.select(*(c for c in diagnostics.columns if c in (*COMPARED, "reader_count")))


def check_pairs(diagnostics: DataFrame) -> None:
    """Every aligned row has exactly one partner in every control."""
    n = diagnostics.groupBy("text_mode", "seed", "sentence_id", "target").agg(
        F.count_if(F.col("eeg_control") == "aligned").alias("aligned"), *(F.count_if(F.col("eeg_control") == c).alias(c) for c in CONTROLS))
    require_none(n.where("aligned > 0").where(" or ".join(f"{c} != 1" for c in ["aligned", *CONTROLS])), "incomplete pairs")


def subset_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each row once for every subset that holds it: (subset_type, subset_name, with_f1).

    ``rows`` are ranked by confidence within ``by`` and seed, whose quantiles bound two subsets.
    They are written once, as several readers follow.
    """
    rows = durable(rows)
    x = rows.join(F.broadcast(rank_quantiles(rows, [*by, "seed"], "text_path_confidence", [0.25, 0.5])), [*by, "seed"])

    def tag(kind: str, name: str | Column, when: Column, f1: bool = False) -> Column:
        named = F.lit(name) if isinstance(name, str) else name
        return F.when(when, F.struct(F.lit(kind).alias("subset_type"), named.alias("subset_name"), F.lit(f1).alias("with_f1")))

    sure = F.col("text_path_confidence")
    tags = [
        tag("all", "all", F.lit(True), True), tag("text_difficulty", PRIORITY[0], sure <= F.col("q0"), True), tag("text_difficulty", PRIORITY[1], sure <= F.col("q1"), True),
        tag("text_difficulty", PRIORITY[2], F.col("correct_without_eeg") == 0, True), tag("true_class", F.col("class_name"), F.lit(True)),
        tag("sentence_length", F.col("length_group"), F.lit(True)), tag("confidence_quartile", F.col("confidence_quartile"), F.lit(True))]
    if "reader_count" in rows.columns:
        tags.append(tag("reader_count", F.col("reader_count").cast("string"), F.lit(True)))
    return x.select("*", F.explode(F.array_compact(F.array(*tags))).alias("_s")).select("*", "_s.*").drop("q0", "q1", "_rank", "_n", "_s")


SUBSET = ["subset_type", "subset_name"]


def _per_seed(rows: DataFrame, group: list[str]) -> DataFrame:
    return rows.groupBy(*group, "seed").agg(F.avg("delta").alias("d")).groupBy(*group).agg(
        F.avg("d").alias("seed_delta_accuracy_mean"), F.min("d").alias("seed_delta_accuracy_min"), F.max("d").alias("seed_delta_accuracy_max"), F.count_if(F.col("d") > 0).alias("n_seeds_better"))


#: The seeds of the two comparisons.
CONTRIBUTION_SEED, SUBSET_SEED = 20260724, 20260723


def contribution_comparisons(diagnostics: DataFrame, samples: int = 2000, seed: int = CONTRIBUTION_SEED) -> DataFrame:
    """Each gated setup with and without its own contribution, by subset."""
    x = ranked(compared(diagnostics), ["setup", "seed"]).withColumn("delta", F.col("correct_with_eeg") - F.col("correct_without_eeg"))
    named, group = ["text_mode", "eeg_control"], ["setup", *SUBSET]
    summed = ["correct_with_eeg", "correct_without_eeg", "prediction_changed", "favorable_flip", "unfavorable_flip"]
    rows = subset_rows(x.select("setup", *named, *PLACING, *(c for c in summed if c not in PLACING), "delta", "_rank", "_n"), ["setup"])
    # One row a sentence serves both the sums and the draws.
    clusters = durable(rows.groupBy(*group, *named, "sentence_id").agg(F.sum("delta").alias("s"), F.count("delta").alias("c"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in summed)))
    out = clusters.groupBy(*group, *named).agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_seed_predictions"), F.sum("s").alias("s"), F.sum("c").alias("c"), *(F.sum(c).alias(c) for c in summed))
    share = lambda c, name: (F.col(c) / F.col("n_seed_predictions")).alias(name)
    out = out.select(
        *group, *named, "n_sentences", "n_seed_predictions", share("correct_with_eeg", "with_modality_accuracy"), share("correct_without_eeg", "without_modality_accuracy"), (F.col("s") / F.col("c")).alias("delta_accuracy"),
        share("prediction_changed", "prediction_changed_rate"), F.col("favorable_flip").alias("favorable_flip_count"), F.col("unfavorable_flip").alias("unfavorable_flip_count"))
    out = out.join(delta_interval(clusters.select(*group, "sentence_id", "s", "c"), group, samples, seed), group).join(_per_seed(rows, group).select(*group, F.col("n_seeds_better").alias("n_seeds_modality_better")), group)
    return out.withColumnsRenamed({"low": "delta_accuracy_ci95_low", "high": "delta_accuracy_ci95_high"})


def subset_comparisons(paired: DataFrame, samples: int = 2000, seed: int = SUBSET_SEED) -> DataFrame:
    """Aligned against each control by subset, with cluster bootstrap intervals."""
    group = ["text_mode", "control", *SUBSET]
    summed = ["correct_with_eeg_aligned", "correct_with_eeg_control", "delta", "prediction_agreement"]
    sides = ["prediction_with_eeg_aligned", "prediction_with_eeg_control"]
    rows = subset_rows(paired.select("text_mode", "control", "target", *PLACING, *sides, *summed, *(["reader_count"] if "reader_count" in paired.columns else []), "_rank", "_n"), ["text_mode", "control"])
    # One row a sentence serves both the sums and the draws.
    clusters = durable(class_counts(rows, group, *sides, F.bool_or("with_f1").alias("with_f1"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in summed)))
    out = clusters.groupBy(*group).agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_seed_predictions"), F.bool_or("with_f1").alias("with_f1"), *(F.sum(c).alias(c) for c in [*summed, *CELLS]))
    names = ["aligned_accuracy", "control_accuracy", "delta_accuracy", "prediction_agreement"]
    out = out.select(
        *group, "n_sentences", "n_seed_predictions", "with_f1", *((F.col(c) / F.col("n_seed_predictions")).alias(name) for c, name in zip(summed, names)),
        macro_of_counts("x", False).alias("aligned_macro_f1"), macro_of_counts("y", False).alias("control_macro_f1"))
    out = out.withColumn("delta_macro_f1", F.col("aligned_macro_f1") - F.col("control_macro_f1"))
    between = count_intervals(clusters.select(*group, "sentence_id", *CELLS), group, samples, seed)
    f1 = lambda end: F.when(F.col("with_f1"), F.col(f"f1_{end}")).alias(f"delta_macro_f1_ci95_{end}")
    out = out.join(between, group)
    out = out.select(*(c for c in out.columns if c != "with_f1" and not c.endswith(("_low", "_high"))), *(F.col(f"accuracy_{e}").alias(f"delta_accuracy_ci95_{e}") for e in ("low", "high")), f1("low"), f1("high"))
    return out.join(_per_seed(rows, group).withColumnRenamed("n_seeds_better", "n_seeds_aligned_better"), group)


def stop_decision(comparisons: DataFrame, minimum_delta: float = 0.015) -> DataFrame:
    """text_mode, subset_name, passed_all_controls, detected (any row passed)."""
    passes = (F.col("delta_accuracy") >= minimum_delta) & (F.col("delta_accuracy_ci95_low") > 0) & (F.col("n_seeds_aligned_better") >= 2)
    x = comparisons.where(F.col("subset_name").isin(PRIORITY)).groupBy("text_mode", "subset_name").agg(
        ((F.array_sort(F.collect_set("control")) == F.array(*map(F.lit, sorted(CONTROLS)))) & F.bool_and(passes)).alias("passed_all_controls"))
    return x.crossJoin(F.broadcast(x.agg(F.coalesce(F.bool_or("passed_all_controls"), F.lit(False)).alias("detected"))))


def control_report(predictions: DataFrame, samples: int = 2000, seed: int = 42) -> DataFrame:
    """text_mode, control: means over seeds of macro-F1, paired difference, interval, agreement.

    Compared runs must have the same sentences and targets.

    ``predictions``: text_mode, eeg_control, seed, sentence_id, target, prediction.
    """
    keys = ["text_mode", "seed", "sentence_id", "target"]
    predictions = durable(predictions.select(*keys, "eeg_control", "prediction"))  # read by the check and both sides
    aligned = predictions.where("eeg_control = 'aligned'").select(*keys, F.col("prediction").alias("pa"))
    others = predictions.where("eeg_control != 'aligned'").select(*keys, F.col("eeg_control").alias("control"), F.col("prediction").alias("pc"))
    groups = others.select("text_mode", "seed", "control").distinct()
    check_same_sentences(others, aligned.join(groups, ["text_mode", "seed"]), ["text_mode", "control", "seed"])
    pair = others.join(aligned, keys)
    group = ["text_mode", "control", "seed"]
    each = paired_delta(pair, group, samples, seed, "pa", "pc")
    return each.groupBy("text_mode", "control").agg(
        F.count("*").alias("n_seeds"), F.avg("candidate_macro_f1").alias("aligned_macro_f1_mean"), F.avg("baseline_macro_f1").alias("control_macro_f1_mean"), F.avg("delta_macro_f1").alias("delta_aligned_minus_control"),
        F.avg("low").alias("delta_ci95_low"), F.avg("high").alias("delta_ci95_high"), F.avg("agreement").alias("prediction_agreement_mean"))


def baseline_name(setup: Column) -> Column:
    """The text-only setup that a setup is compared with; null for those without one."""
    return F.when((setup != "eeg_only") & ~setup.startswith("text_"), F.when(setup.endswith("finetune"), "text_finetune").otherwise("text_frozen"))


def baseline_delta(candidates: DataFrame, baselines: DataFrame, samples: int = 2000, seed: int = 42) -> DataFrame:
    """setup, baseline, n_seeds and means over matched seeds of the paired bootstrap.

    Matched runs must have the same sentences and targets.
    """
    base = durable(baselines.select(F.col("setup").alias("baseline"), "seed", "sentence_id", "target", F.col("prediction").alias("pb")))
    named = durable(candidates.select("setup", baseline_name(F.col("setup")).alias("baseline"), "seed", "sentence_id", "target", "prediction"))
    groups = named.select("setup", "baseline", "seed").distinct()
    check_same_sentences(named, base.join(groups, ["baseline", "seed"]), ["setup", "baseline", "seed"])
    pair = named.join(base, ["baseline", "seed", "sentence_id", "target"])
    each = paired_delta(pair, ["setup", "baseline", "seed"], samples, seed, "prediction", "pb", by_sentence=True)
    return each.groupBy("setup", "baseline").agg(F.count("*").alias("n_seeds"), F.avg("delta_macro_f1").alias("delta_macro_f1"), F.avg("low").alias("delta_ci95_low"), F.avg("high").alias("delta_ci95_high"))


def seed_summary(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """setup: seeds, mean and deviation of accuracy and macro-F1, mean of the folds' gate means."""
    x = metrics.groupBy("setup").agg(F.count("*").alias("n_seeds"), F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"), F.avg("macro_f1").alias("macro_f1_mean"), F.stddev_pop("macro_f1").alias("macro_f1_std"))
    g = gates.groupBy("setup", "seed", "fold").agg(F.avg("gate").alias("g")).groupBy("setup").agg(F.avg("g").alias("gate_mean"))
    return x.join(g, "setup", "left")


def initialization_audit(fingerprints: DataFrame) -> DataFrame:
    """text_mode, seed, fold, n_setups, matched of gated setups; groups of one are skipped.

    ``fingerprints``: setup, text_mode, seed, fold, task_sha256.
    """
    x = fingerprints.where(F.col("setup").startswith("gated_") & F.col("task_sha256").isNotNull())
    x = x.groupBy("text_mode", "seed", "fold").agg(F.countDistinct("setup").alias("n_setups"), F.countDistinct("task_sha256").alias("n"))
    return x.where("n_setups >= 2").select("text_mode", "seed", "fold", "n_setups", (F.col("n") == 1).alias("matched"))


def verified_initializations(fingerprints: DataFrame) -> int:
    """How many groups of gated setups started from the same parameters; raises if any did not."""
    audit = initialization_audit(fingerprints)
    require_none(audit.where("not matched"), "setups of one text mode, seed and fold start from different parameters")
    return audit.count()


def fingerprint(parameters: DataFrame, by: list[str], skip_prefix: str = "text_encoder.") -> DataFrame:
    """by, task_sha256 over name, kind, shape (strings) and value (binary) of the parameters, by name.

    A group is one model's parameters; prefixes that differ on purpose are left out.
    """
    item = F.struct("name", F.concat(*(F.hex(F.encode(c, "utf-8")) for c in ("name", "kind", "shape")), F.hex("value")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]), "")
    return parameters.where(~F.col("name").startswith(skip_prefix)).groupBy(*by).agg(F.sha2(F.unhex(joined), 256).alias("task_sha256"))


def score_chart(summary: DataFrame) -> DataFrame:
    """setup, metric, bar, error: mean and deviation over seeds of accuracy and macro-F1."""
    bars = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(f"{m}_mean", 4).alias("bar"), F.round(F.greatest(F.lit(0.0), F.col(f"{m}_std")), 4).alias("error")) for m in ("accuracy", "macro_f1")))
    return summary.select("setup", F.explode(bars).alias("x")).select("setup", "x.*")


def flip_chart(flips: DataFrame) -> DataFrame:
    """setup, kind, bar: favorable flips upward, unfavorable ones downward."""
    bars = F.array(F.struct(F.lit("favorable").alias("kind"), F.col("favorable_flip_count").alias("bar")), F.struct(F.lit("unfavorable").alias("kind"), F.negative("unfavorable_flip_count").alias("bar")))
    return flips.select("setup", F.explode(bars).alias("x")).select("setup", "x.*")


def chart_rows(comparisons: DataFrame) -> DataFrame:
    """Bars of accuracy differences: value and error lengths, never negative."""
    x = comparisons.where(F.col("subset_name").isin("all", *PRIORITY))
    value = F.col("delta_accuracy")
    return x.select("text_mode", "control", "subset_name", F.round(value, 4).alias("bar"), F.round(F.greatest(F.lit(0.0), value - F.col("delta_accuracy_ci95_low")), 4).alias("error_low"), F.round(F.greatest(F.lit(0.0), F.col("delta_accuracy_ci95_high") - value), 4).alias("error_high"))


def findings(comparisons: DataFrame, contributions: DataFrame, flips: DataFrame) -> DataFrame:
    """The slices that a report quotes: section, text_mode, what, value."""
    pick = lambda df, when, section, what, value: df.where(when).select(F.lit(section).alias("section"), "text_mode", what.alias("what"), value.cast("double").alias("value"))
    return pick(comparisons, F.col("subset_name") == "all", "all", F.col("control"), F.col("delta_accuracy")).unionByName(
        pick(comparisons, F.col("subset_name").isin(PRIORITY), "priority", F.concat_ws("|", "control", "subset_name"), F.col("delta_accuracy"))).unionByName(
        pick(contributions, (F.col("eeg_control") == "aligned") & F.col("subset_name").isin("all", *PRIORITY), "contribution", F.col("subset_name"), F.col("delta_accuracy"))).unionByName(
        pick(flips, F.col("eeg_control") == "aligned", "flips", F.col("setup"), F.col("net_correct_change")))
