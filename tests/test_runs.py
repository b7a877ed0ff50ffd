"""Whole runs stop where their data break a rule."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxalign.functions.keyed import draws
from fluxalign.operators import align, bootstrap, compare, cv, folds
from fluxalign.operators.align import DataError
from fluxalign.plans import runs, views

from .conftest import TINY


@pytest.fixture(scope="module")
def predictions(spark):
    return views.predictions(spark, TINY).persist()


@pytest.fixture(scope="module")
def metadata(spark):
    return align.sentence_metadata(views.labels(spark, TINY)).persist()


def test_closeout_gives_every_table(predictions, metadata):
    out = runs.closeout(predictions, metadata, samples=20)
    assert out["decision"].count() == 6 and out["paired_predictions"].count() == 3 * out["sentence_diagnostics"].where("eeg_control = 'aligned'").count()
    assert set(out) >= {"prediction_flips", "modality_contribution_subsets", "subset_control_comparisons", "findings"}


@pytest.mark.parametrize("break_it, message", [
    (lambda p: p.where("eeg_control != 'noise'"), "controlled results"),
    (lambda p: p.where("setup != 'gated_frozen' or seed != 42"), "different seeds"),
    (lambda p: p.withColumn("target", F.col("target") * 0), "don't fit the labels"),
    (lambda p: p.withColumn("sentence_id", F.col("sentence_id") + 10**9), "don't fit the labels"),
    (lambda p: p.withColumn("logits_with_eeg", F.when(F.col("seed") == 42, F.lit(None)).otherwise(F.col("logits_with_eeg"))), "don't fit the labels"),
    (lambda p: p.withColumn("prediction", F.lit(0)), "don't fit the labels"),
    (lambda p: p.where("eeg_control != 'zero' or sentence_id % 5 != 0"), "incomplete pairs"),
])
def test_closeout_stops(predictions, metadata, break_it, message):
    with pytest.raises(DataError, match=message):
        runs.closeout(break_it(predictions), metadata, samples=20)


def test_alignment_stops(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "sentence_id long, sentiment_label int")
    rows = [(i, 0, p, 1.0) for i in (1, 2) for p in range(6)]
    x = spark.createDataFrame(rows, "sentence_id long, subject int, pos int, value double")
    assert runs.alignment(x, labels, 3, 2, cached_labels=labels).count() == 8
    with pytest.raises(DataError, match="reference channel"):
        runs.alignment(x.where("pos != 5"), labels, 3, 2)
    with pytest.raises(DataError, match="without recordings"):
        runs.alignment(x.where("sentence_id = 1"), labels, 3, 2)
    with pytest.raises(DataError, match="label mismatch"):
        runs.alignment(x, labels, 3, 2, cached_labels=labels.withColumn("sentiment_label", F.lit(0)))


def test_extraction_matches_and_keeps_single_precision(spark):
    samples = spark.createDataFrame([(s, r, c, t, 0.1 * t) for s, r in (("A", 1), ("B", 2)) for c in "ab" for t in range(4)], "subject string, recording long, channel string, at int, value double")
    bands = spark.createDataFrame([], "recording long, channel string, band string, value double")
    recordings = spark.createDataFrame([(1, "A text"), (2, "other")], "recording long, content string")
    labels = spark.createDataFrame([(7, "a  TEXT", 1)], "sentence_id long, sentence string, sentiment_label int")
    out = runs.extraction(samples, bands, recordings, labels)
    assert {(r.recording, r.sentence_id) for r in out.collect()} == {(1, 7)} and dict(out.dtypes)["value"] == "float" and out.count() == 48
    with pytest.raises(DataError, match="layouts differ"):
        runs.extraction(samples.where("subject = 'A' or channel = 'a'"), bands, recordings, labels)


def test_metadata_takes_one_row_a_sentence(spark):
    labels = spark.createDataFrame([(1, "a b", 0), (2, "c", 1)], "sentence_id long, sentence string, sentiment_label int")
    counts = spark.createDataFrame([(1, 4)], "sentence_id long, reader_count long")
    assert [(r.sentence_id, r.reader_count) for r in align.sentence_metadata(labels, counts).collect()] == [(1, 4)]
    with pytest.raises(DataError, match="unique"):
        align.sentence_metadata(labels, counts.union(counts))


def test_reports_need_the_same_sentences(spark):
    rows = [("frozen", c, 1, i, 0, 0) for c in ("aligned", "noise") for i in range(4)]
    p = spark.createDataFrame(rows, "text_mode string, eeg_control string, seed int, sentence_id long, target int, prediction int")
    assert compare.control_report(p, 10).first().delta_aligned_minus_control == 0
    for broken in (p.where("eeg_control = 'noise' or sentence_id > 0"), p.withColumn("target", F.when((F.col("eeg_control") == "noise") & (F.col("sentence_id") == 2), 1).otherwise(0))):
        with pytest.raises(DataError, match="differ between"):
            compare.control_report(broken, 10)
    base = spark.createDataFrame([("text_frozen", 1, i, 0, 0) for i in range(4)], "setup string, seed int, sentence_id long, target int, prediction int")
    own = base.withColumn("setup", F.lit("gated_frozen"))
    assert compare.baseline_delta(own, base, 10).first().n_seeds == 1
    assert compare.baseline_delta(own.union(own.withColumn("seed", F.lit(9))), base, 10).first().n_seeds == 1  # unmatched seeds are skipped
    with pytest.raises(DataError, match="differ between"):
        compare.baseline_delta(own.where("sentence_id > 0"), base, 10)


def test_missing_predictions_stop(spark):
    labels = spark.createDataFrame([(1,), (2,)], "sentence_id long")
    with pytest.raises(DataError, match="out-of-fold"):
        align.check_complete(labels, spark.createDataFrame([("a", 1, 1)], "setup string, seed int, sentence_id long"))


def test_verified_initializations(spark):
    schema = "setup string, text_mode string, seed int, fold int, task_sha256 string"
    rows = [(f"gated_{c}frozen", "frozen", 1, f, "a") for c in ("", "zero_") for f in (1, 2)]
    assert compare.verified_initializations(spark.createDataFrame(rows, schema)) == 2
    with pytest.raises(DataError, match="different parameters"):
        compare.verified_initializations(spark.createDataFrame([*rows, ("gated_noise_frozen", "frozen", 1, 1, "b")], schema))


def test_fingerprints_tell_shapes_apart(spark):
    rows = [(1, "w", "float32", "(2, 3)", b"\0\1"), (2, "w", "float32", "(3, 2)", b"\0\1"), (3, "w", "float32", "(2, 3)", b"\0\1"), (3, "text_encoder.x", "f", "", b"z")]
    p = compare.fingerprint(spark.createDataFrame(rows, "m int, name string, kind string, shape string, value binary"), ["m"])
    sha = {r.m: r.task_sha256 for r in p.collect()}
    assert sha[1] == sha[3] != sha[2]


def test_draws_are_even_and_differ_by_replicate():
    n = 10
    x = np.array([draws(123456, r + 1, np.arange(100), n) for r in range(2000)])
    counts = np.bincount(x.ravel())
    assert len(counts) == n and np.abs(counts - 20_000).max() < 700
    assert 0.25 < x.mean(axis=1).std() < 0.33  # 2.87 / sqrt(100)


def test_sums_are_those_of_the_draws(spark, monkeypatch):
    """Two groups of clusters with few different vectors, in any stretches of draws."""
    rng = np.random.default_rng(1)
    rows = [(g, i, int(rng.integers(3)), int(rng.integers(2))) for g, n in (("a", 130), ("b", 7)) for i in range(n)]
    x = spark.createDataFrame(rows, "g string, sentence_id long, s long, c long").repartition(5)
    got = []
    for chunk, together in ((1 << 22, 40), (50, 3)):
        monkeypatch.setattr(bootstrap, "CHUNK", chunk)
        monkeypatch.setattr(bootstrap, "TOGETHER", together)
        got.append(sorted(map(tuple, bootstrap.resampled(x, ["s", "c"], ["g"], 11, 5).select("g", "replicate", "s", "c").collect())))
    want = []
    for g in "ab":
        vectors = np.array(sorted((s, c) for h, _, s, c in rows if h == g))
        key = int(hashlib.md5(f"5|{g}".encode()).hexdigest()[:8], 16)
        want += [(g, r, *vectors[draws(key, r, np.arange(len(vectors)), len(vectors))].sum(axis=0).tolist()) for r in range(1, 12)]
    assert got[0] == got[1] == want


def test_intervals_do_not_depend_on_the_number_of_clusters_held(spark):
    """300,000 clusters of two kinds: the interval is that of a binomial share."""
    x = spark.range(300_000).select(F.lit("g").alias("g"), F.col("id").alias("sentence_id"), (F.col("id") % 10 == 0).cast("int").alias("delta"))
    r = bootstrap.accuracy_interval(x, ["g"], 200, 3).first()
    assert abs(r.low - (0.1 - 1.96 * 0.000548)) < 0.0004 and abs(r.high - (0.1 + 1.96 * 0.000548)) < 0.0004


def test_intervals_are_those_of_resampled_means(spark):
    rows = [("g", i, 0, 0, int(i % 4 == 0)) for i in range(200)]
    x = spark.createDataFrame(rows, "g string, sentence_id long, target int, a int, b int")
    r = bootstrap.comparison_intervals(x, ["g"], 2000, 7, "a", "b").first()
    assert abs(r.accuracy_low - 0.19) < 0.02 and abs(r.accuracy_high - 0.31) < 0.02 and r.f1_low > 0


def test_penalty_is_chosen_on_validation_and_test_is_read_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(cv, "classification_metrics", lambda df, by: read.append({"metrics"}) or metrics(df, by))
    from fluxalign.operators.metrics import classification_metrics as metrics
    from pyspark.ml.linalg import Vectors

    rows = [(1, 1, s, i, i % 3, Vectors.dense([float(i % 3 == k) for k in range(3)])) for i, s in enumerate(["train"] * 12 + ["val"] * 6 + ["test"] * 6)]
    x = spark.createDataFrame(rows, ["seed", "fold", "split", "sentence_id", "target", "fused"])
    out = cv.cross_validate(x, "text_frozen", [100.0, 0.01])
    got = out.collect()
    assert len(read) == 2 and {r.penalty for r in got} <= {100.0, 0.01} and sorted(r.sentence_id for r in got) == list(range(18, 24))
    assert all(r.prediction == r.target for r in got)
