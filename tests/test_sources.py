import pytest
from pyspark.sql import functions as F

from fluxalign.operators.align import DataError
from fluxalign.operators import folds
from fluxalign.plans import queries
from fluxalign.sources import runs, tables

from .conftest import TINY


def test_labels_from_csv(spark, tmp_path):
    p = tmp_path / "labels.csv"
    p.write_text('sentence_id,sentence,sentiment_label,extra\n20,"b, ""quoted""",0,x\n10,a,-1,y\n30,,1,z\n')
    assert [tuple(r) for r in tables.read_labels(spark, str(p)).collect()] == [(10, "a", -1), (20, 'b, "quoted"', 0)]
    p.write_text("sentence_id,sentence,sentiment_label\n1,a,0\n1,b,0\n")
    with pytest.raises(DataError):
        tables.read_labels(spark, str(p))
    p.write_text("sentence_id,sentence\n1,a\n")
    with pytest.raises(DataError, match="sentiment_label"):
        tables.read_labels(spark, str(p))


def test_feature_cache_replaces_one_subject(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda s, v: spark.createDataFrame([(s, 1, p, v) for p in range(2)], "subject string, sentence_id long, pos int, value double")
    tables.write_features(rows("A", 1.0).union(rows("B", 2.0)), path)
    tables.write_features(rows("B", 3.0), path)
    got = tables.read_features(spark, path, 2).groupBy("subject").agg(F.max("value").alias("v")).orderBy("subject").collect()
    assert [tuple(r) for r in got] == [("A", 1.0), ("B", 3.0)]
    with pytest.raises(DataError):
        tables.read_features(spark, path, 3)


def test_results_round_trip(spark, tmp_path):
    """Documents and predictions written and read; a rerun of one seed replaces its own only."""
    documents, predictions = queries._documents(spark, TINY)
    path = str(tmp_path / "run")
    runs.write_results(documents, predictions, path)
    runs.write_results(documents.where("seed = 42"), predictions.where("seed = 42"), path)
    back, rows = runs.read_results(spark, path), runs.read_predictions(spark, path)
    assert back.count() == documents.count() == 24 and rows.count() == predictions.count()
    r = back.where("setup = 'gated_zero_frozen' and seed = 42").first()
    assert (r.n_folds, r.fusion, r.eeg_control, r.zero_eeg_contribution) == (5, "gated", "zero", True)
    assert [f.fold for f in r.folds] == [1, 2, 3, 4, 5] and len(r.folds[0].gate_values) == 4 and len(r.folds[0].history) == 3
    assert abs(sum(f.test.accuracy for f in r.folds) / 5 - r.fold_accuracy_mean) < 1e-9 and r.folds[0].diagnostics.logit_delta_l2.max == 0
    best = max(r.folds[1].history, key=lambda h: h.val_macro_f1)
    assert r.folds[1].best_epoch == best.epoch and sum(sum(row) for row in r.oof.confusion_matrix) == 87
    assert runs.seed_sets(back).where("not matched").count() == 0
    gated = spark.createDataFrame([(s,) for s in folds.SETUPS if s.startswith("gated_")], "setup string")
    runs.check_controls(back, gated)
    with pytest.raises(DataError, match="controlled results"):
        runs.check_controls(back.where("eeg_control != 'noise'"), gated)
    with pytest.raises(DataError, match="different seeds"):
        runs.check_controls(back.where("setup != 'gated_frozen' or seed != 42"), gated)
    back.write.json(f"{path}/documents/_setup=x/_seed=1")
    with pytest.raises(DataError, match="two results"):
        runs.read_results(spark, path)


def test_predictions_inside_documents(spark, tmp_path):
    path = str(tmp_path / "nested")
    (tmp_path / "nested" / "documents").mkdir(parents=True)
    (tmp_path / "nested" / "documents" / "a.json").write_text('{"setup": "gated_zero_frozen", "seed": 1, "predictions": [{"sentence_id": 5, "target": 1, "prediction": 2, "diagnostics": {"logits_with_eeg": [1.0]}}]}')
    r = runs.prediction_rows(runs.read_results(spark, path)).first()
    assert (r.sentence_id, r.target, r.prediction, r.logits_with_eeg) == (5, 1, 2, [1.0])


def test_recordings_know_their_subject(spark, tmp_path):
    spark.range(40).repartition(3).write.parquet(str(tmp_path / "resultsYAC_SR.parquet"))
    spark.range(40).repartition(3).write.parquet(str(tmp_path / "other"))
    read = lambda name: {r.subject for r in tables.read_recordings(spark, str(tmp_path / name)).collect()}
    assert read("resultsYAC_SR.parquet") == {"YAC"} and read("other") == {"other"}


def test_ids_keep_all_their_digits(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("sentence_id,sentence,sentiment_label\n9007199254740993,a b,1\n12.0,c,-1.0\n")
    assert [tuple(r) for r in tables.read_labels(spark, str(tmp_path / "labels.csv")).collect()] == [(12, "c", -1), (9007199254740993, "a b", 1)]


def test_pending_and_manifest(spark):
    grid = spark.createDataFrame([("a", 1), ("a", 2)], "setup string, seed int")
    assert tables.pending(grid, grid.where("seed = 1"), ["setup", "seed"]).collect() == [("a", 2)]
    m = lambda n, s: spark.createDataFrame([(n, s)], "n_folds int, seeds array<int>")
    assert runs.merge_manifest(m(5, [2, 1]), m(5, [3]), ["n_folds"], ["seeds"]).first().seeds == [1, 2, 3]
    with pytest.raises(DataError):
        runs.merge_manifest(m(5, [1]), m(4, [1]), ["n_folds"], ["seeds"])


def test_run_tag_and_report(spark, tmp_path):
    tag = spark.range(1).select(runs.run_tag(F.lit("2026-01-02 03:04:05").cast("timestamp"))).first()[0]
    assert tag == "run_20260102_030405"
    tables.write_report(spark.range(300).selectExpr("(id * 7) % 300 AS id").repartition(5), str(tmp_path / "t"), ["id"])
    assert spark.read.json(str(tmp_path / "t" / "json")).count() == 300
    import glob
    import json

    lines = [json.loads(line)["id"] for f in sorted(glob.glob(str(tmp_path / "t" / "json" / "part*"))) for line in open(f)]
    assert lines == list(range(300))
