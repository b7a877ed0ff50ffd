"""From labels and features to the decision: runs, resume, guards, report and closeout."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from fluxalign.operators import align, folds, preprocess
from fluxalign.operators.align import DataError
from fluxalign.plans import runs
from fluxalign.sources import manifest
from fluxalign.sources import runs as files

GATED = [s for s in folds.SETUPS if s.startswith("gated_")]


@pytest.fixture(scope="module")
def data(spark):
    """60 sentences of three classes, three subjects, a signal that follows the class in one feature."""
    rng = random.Random(1)
    labels = [(i, f"{['bad', 'plain', 'good'][i % 3 if rng.random() < 0.8 else rng.randrange(3)]} {rng.choice('abcdef')} {rng.choice('ghijk')}", i % 3 - 1) for i in range(60)]
    rows = [(i, s, p, rng.gauss(0, 1) + (0.9 * (i % 3) if p == 0 else 0)) for i in range(60) for s in range(3) for p in range(4)]
    return spark.createDataFrame(rows, "sentence_id long, subject int, pos int, value double").persist(), spark.createDataFrame(labels, "sentence_id long, sentence string, sentiment_label int").persist()


@pytest.mark.parametrize("setup", ["text_frozen", "eeg_only", "concat_finetune", "gated_frozen", "gated_zero_frozen"])
def test_every_kind_of_setup_is_fitted(spark, data, setup):
    found, history = runs.experiment(*data, setup, [42], [0.01, 1.0], n_folds=2)
    rows = found.collect()
    assert sorted(r.sentence_id for r in rows) == list(range(60)) and history.count() == 4
    assert sum(r.prediction == r.target for r in rows) > (25 if setup == "eeg_only" else 32)
    if setup.startswith("gated"):
        for r in rows:
            added = [a - b for a, b in zip(r.logits_with_eeg, r.logits_without_eeg)]
            assert abs(sum(x * x for x in added) ** 0.5 - r.gated_eeg_contribution_norm) < 1e-9 and r.text_embedding_norm > 0
            assert (r.gated_eeg_contribution_norm == 0) == ("zero" in setup) and r.prediction == max(range(3), key=lambda k: r.logits_with_eeg[k])
    else:
        assert all(r.logits_without_eeg is None for r in rows)


def test_from_labels_to_the_decision(spark, data, tmp_path):
    features, labels = data
    folder, setups = str(tmp_path / "run"), ["text_frozen", "text_finetune", *GATED]
    first = runs.run_experiments(features, labels, setups[:3], [42], [0.1], folder, n_folds=2)
    assert sorted(first) == [(s, 42) for s in sorted(setups[:3])]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "run" / "predictions").rglob("*.parquet")}
    (tmp_path / "run" / "done" / "_setup=text_finetune").rename(tmp_path / "lost")  # as if the run had been stopped before this marker
    with pytest.raises(DataError, match="another penalties"):
        runs.run_experiments(features, labels, setups, [42], [0.2], folder, n_folds=2)
    with pytest.raises(DataError, match="another data"):
        runs.run_experiments(features.where("pos < 3"), labels, setups, [42], [0.1], folder, n_folds=2)
    second = runs.run_experiments(features, labels, setups, [42], [0.1], folder, n_folds=2)
    assert sorted(second) == sorted((s, 42) for s in setups if s not in ("text_frozen", setups[2]))
    assert all(p.stat().st_mtime_ns == t for p, t in before.items() if "text_finetune" not in str(p)) and runs.run_experiments(features, labels, setups, [42], [0.1], folder, n_folds=2) == []
    assert manifest.read_manifest(spark, folder)[1]["lists"] == {"setups": sorted(setups), "seeds": [42]}

    report = runs.report_run(spark, folder, str(tmp_path / "report"), samples=20)
    assert report["summary"].count() == 10 and report["control_comparisons"].count() == 6 and report["baseline_deltas"].count() == 8
    assert spark.read.json(str(tmp_path / "report" / "summary" / "json")).count() == 10
    zero = report["setup_diagnostics"].where("setup = 'gated_zero_frozen'").first()
    assert zero.prediction_changed_without_eeg_rate == 0 and zero.gate_mean == 0
    readers = align.reader_counts(features)
    made = runs.closeout_run(spark, folder, labels, readers, str(tmp_path / "closeout"), samples=20)
    assert made["decision"].count() == 6 and made["paired_predictions"].count() == 2 * 3 * 60
    assert spark.read.option("header", True).csv(str(tmp_path / "closeout" / "decision" / "csv")).count() == 6
    with pytest.raises(DataError, match="another samples"):
        runs.closeout_run(spark, folder, labels, readers, str(tmp_path / "closeout"), samples=30)
    documents = files.read_results(spark, folder).where("setup = 'gated_frozen'").first()
    assert documents.n_folds == 2 and documents.folds[0].n_test == 30 and documents.folds[0].history[0].val_loss > 0


def test_two_writers_commit_one_manifest(spark, tmp_path):
    errors = []

    def write(k):
        try:
            manifest.commit_manifest(spark, str(tmp_path), {"n_folds": 5}, {"seeds": [k]})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    for group in range(3):
        threads = [threading.Thread(target=write, args=(10 * group + k,)) for k in range(2)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    assert not errors and manifest.read_manifest(spark, str(tmp_path))[1]["lists"]["seeds"] == [0, 1, 10, 11, 20, 21]
    with pytest.raises(DataError, match="another n_folds"):
        manifest.commit_manifest(spark, str(tmp_path), {"n_folds": 4}, {"seeds": [1]})


def test_extraction_guards_its_cache(spark, data, tmp_path):
    features, _ = data
    made = runs.extraction_run(features.where("subject = 0"), str(tmp_path))
    assert made["lists"]["subjects"] == ["0"] and runs.extraction_run(features.where("subject = 1"), str(tmp_path))["lists"]["subjects"] == ["0", "1"]
    assert spark.read.parquet(str(tmp_path / "features")).count() == 480
    with pytest.raises(DataError, match="another line_length"):
        runs.extraction_run(features, str(tmp_path), "sum")


def test_folds_without_train_rows_stop(spark):
    schema = "seed int, fold int, split string, sentence_id long, subject int, pos int, value double"
    rows = spark.createDataFrame([(1, 1, "train", 1, 0, 0, 2.0), (1, 1, "test", 2, 0, 0, 3.0), (1, 1, "test", 2, 0, 1, 3.0), (1, 2, "test", 1, 0, 0, 2.0)], schema)
    fitted = preprocess.fit(rows)
    got = preprocess.transform(rows.where("fold = 1"), fitted).where("split = 'test'").select("pos", "value").collect()
    assert sorted(map(tuple, got)) == [(0, 1.0), (1, 0.0)]
    with pytest.raises(Exception, match="no train rows for seed 1, fold 2"):
        preprocess.transform(rows, fitted).agg(F.sum("value")).collect()
