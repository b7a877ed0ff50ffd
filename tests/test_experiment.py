import pytest
from pyspark.sql import functions as F

from fluxalign.operators import align, bootstrap, compare, controls, diagnostics, folds, metrics, preprocess, scoring
from fluxalign.sources.shared import durable

LABEL = "sentence_id long, sentiment_label int"


def labelled(spark, n=60):
    return spark.createDataFrame([(i, i % 3 - 1) for i in range(n)], LABEL)


def test_folds_are_disjoint_and_cover_everything(spark):
    splits = folds.assign_splits(folds.assign_folds(labelled(spark), [42]), val_size=0.2)
    rows = splits.collect()
    tested = [r.sentence_id for r in rows if r.split == "test"]
    assert sorted(tested) == list(range(60))
    assert len({(r.fold, r.sentence_id) for r in rows}) == len(rows) == 300
    sizes = {(f, s): sum(r.fold == f and r.split == s for r in rows) for f in range(1, 6) for s in ("train", "val", "test")}
    assert {sizes[f, "test"] for f in range(1, 6)} == {12} and {sizes[f, "val"] for f in range(1, 6)} == {10}


def split_rows(spark, values, train):
    rows = [(1, 1, "train" if i in train else "test", i, 0, p, v) for i, vs in enumerate(values) for p, v in enumerate(vs)]
    return spark.createDataFrame(rows, "seed int, fold int, split string, sentence_id long, subject int, pos int, value double")


def test_preprocessing_reads_train_rows_only(spark):
    fitted = preprocess.fit(split_rows(spark, [(1.0, None), (3.0, 5.0), (1000.0, 1000.0)], {0, 1})).orderBy("pos").collect()
    assert [r.median for r in fitted] == [2.0, 5.0]


def test_fits_of_all_folds_read_at_once_equal_fits_of_their_rows(spark):
    """Features with missing values, a feature never seen in training, ties, a sentence without rows."""
    labels = spark.createDataFrame([(i, i % 3 - 1) for i in range(40)], "sentence_id long, sentiment_label int")
    splits = durable(folds.assign_splits(folds.assign_folds(labels, [1, 2])))
    rows = [(i, s, p, None if p == 2 or (i + p) % 5 == 0 else float((i * 7 + s) % 11) - 4.5 * p) for i in range(39) for s in range(2) for p in range(4)]
    features = spark.createDataFrame(rows, "sentence_id long, subject int, pos int, value double")
    got = {(r.seed, r.fold, r.pos): r for r in preprocess.fit_splits(features, splits).collect()}
    assert len(got) == 40 and not any(got[key].observed for key in got if key[2] == 2)
    for control in ("aligned", "shuffled"):
        want = preprocess.fit(controls.apply_control(features, splits, control)).collect()
        assert {(r.seed, r.fold, r.pos) for r in want} == set(got)
        for r in want:
            assert got[r.seed, r.fold, r.pos][3:] == pytest.approx(r[3:], rel=1e-12), (control, r)


def test_features_unseen_in_training_are_zero(spark):
    rows = split_rows(spark, [(1.0, None), (3.0, None), (5.0, 900.0)], {0, 1})
    fitted = preprocess.fit(rows)
    assert fitted.where("not observed").count() == 1
    assert [r.value for r in preprocess.transform(rows, fitted).where("pos = 1").collect()] == [0.0, 0.0, 0.0]


def test_constant_features_are_not_divided_by_zero(spark):
    assert preprocess.fit(split_rows(spark, [(2.0,), (2.0,)], {0, 1})).first()["std"] == 1.0


def control_input(spark):
    splits = spark.createDataFrame([(1, 1, s, i) for s, ids in (("train", (0, 1, 2)), ("val", (3,)), ("test", (4, 5))) for i in ids], "seed int, fold int, split string, sentence_id long")
    values = spark.createDataFrame([(i, 0, p, float(2 * i + p)) for i in range(6) for p in range(2)], "sentence_id long, subject int, pos int, value double")
    return values, splits


def test_shuffle_keeps_each_split(spark):
    values, splits = control_input(spark)
    before = controls.apply_control(values, splits, "aligned").groupBy("split").agg(F.sort_array(F.collect_list("value")).alias("v"))
    after = controls.apply_control(values, splits, "shuffled").groupBy("split").agg(F.sort_array(F.collect_list("value")).alias("v"))
    assert sorted(before.collect()) == sorted(after.collect())


def test_zero_control_leaves_input(spark):
    values, splits = control_input(spark)
    same = controls.apply_control(values, splits, "zero").select(*values.columns)
    assert same.exceptAll(values).count() == 0 and same.count() == 12
    with pytest.raises(ValueError):
        controls.apply_control(values, splits, "other")


def test_noise_is_independent_of_partitioning(spark):
    values, splits = control_input(spark)
    a = controls.apply_control(values, splits, "noise")
    b = controls.apply_control(values.repartition(3), splits.repartition(2), "noise")
    assert a.exceptAll(b).count() == 0


def test_lookup_keeps_the_larger_id_and_matches(spark):
    labels = spark.createDataFrame([(1, "Same text!", 1), (2, "same TEXT", -1)], "sentence_id long, sentence string, sentiment_label int")
    lookup = align.label_lookup(labels)
    assert lookup.collect() == [("same text", 2, -1)]
    found = align.match_recordings(spark.createDataFrame([(7, "“Same,text”"), (8, "none"), (9, None)], "recording long, content string"), lookup)
    assert found.collect() == [(7, 2, -1)]


def test_alignment_drops_reference_and_takes_last_rows(spark):
    rows = [(10, 0, p, float(c), c) for c in (0, 1) for p in range(6)] + [(20, 0, p, None, 1) for p in range(6)]
    x = spark.createDataFrame(rows, "sentence_id long, subject int, pos int, value double, cache_row int")
    out = align.align_features(x, spark.createDataFrame([(10,), (20,)], "sentence_id long"), 3, 2, "cache_row")
    assert sorted((r.sentence_id, r.pos, r.value) for r in out.collect()) == [(10, p, 1.0) for p in range(4)]
    with pytest.raises(align.DataError):
        align.check_alignment(out, spark.createDataFrame([(10,), (20,)], "sentence_id long"))


def test_unknown_label_stops(spark):
    with pytest.raises(Exception, match="labels must be"):
        spark.createDataFrame([(5,)], "l int").select(align.class_target(F.col("l"))).collect()


def test_macro_f1_conventions(spark):
    x = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "g int, target int, prediction int")
    m = metrics.classification_metrics(x, ["g"])
    assert abs(m.first().macro_f1 - 2 / 3) < 1e-12
    assert m.select(metrics.macro_f1("c", True).alias("f")).first().f == 1.0


def test_early_stop(spark):
    h = spark.createDataFrame([("a", i + 1, f) for i, f in enumerate([0.3, 0.5, 0.4, 0.4, 0.6])], "run string, epoch int, f1 double")
    r = metrics.best_epoch(h, 2).first()
    assert (r.best_epoch, r.stopped_at) == (2, 4)


def test_constant_deltas_give_a_point_interval(spark):
    x = spark.createDataFrame([("g", s, 1) for s in (10, 20, 30) for _ in range(3)], "g string, sentence_id long, delta int")
    r = bootstrap.accuracy_interval(x, ["g"], 100, 1).first()
    assert (r.low, r.high) == (1.0, 1.0)


def test_quartiles_of_six(spark):
    x = spark.createDataFrame([("g", i, i / 10) for i in range(6)], "g string, sentence_id long, text_path_confidence double")
    got = [r.confidence_quartile for r in diagnostics.quartiles(x, ["g"]).orderBy("sentence_id").collect()]
    assert got == ["q1_lowest", "q1_lowest", "q2", "q3", "q4_highest", "q4_highest"]


def test_ranks_of_crowded_values_are_spread(spark):
    """Most confidences near or at 1: exact ranks, and no partition with more than its share."""
    x = spark.range(60_000).select(F.lit("g").alias("g"), F.col("id").alias("sentence_id"), F.when(F.col("id") % 10 == 0, F.rand(3)).when(F.col("id") % 3 == 0, 1.0).otherwise(1 - F.exp(-6 - 8 * F.rand(4))).alias("c"))
    x = x.unionByName(spark.createDataFrame([("h", i, 0.5) for i in range(5)], x.schema)).persist()
    got = folds.rank_by_range(x, ["g"], "c", "sentence_id", "k", "n").collect()
    for g in "gh":
        rows = sorted((r.c, r.sentence_id, r.k, r.n) for r in got if r.g == g)
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1)) and {r[3] for r in rows} == {len(rows)}
    sizes = [r["count"] for r in x.repartitionByRange(8, "g", "c", "sentence_id").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 60_000 / 8


DECISION = "text_mode string, control string, subset_name string, delta_accuracy double, delta_accuracy_ci95_low double, n_seeds_aligned_better int"


def test_decision_needs_every_control(spark):
    rows = [("frozen", c, "low_confidence_25", 0.02, 0.001, 2) for c in ("shuffled", "noise", "zero")]
    passed = lambda r: compare.stop_decision(spark.createDataFrame(r, DECISION)).first()
    assert passed(rows).passed_all_controls and passed(rows).detected
    assert not passed(rows[:2]).detected


def test_incomplete_pairs_stop(spark):
    rows = [("frozen", 1, 5, 0, c) for c in ("aligned", "shuffled", "noise")]
    with pytest.raises(align.DataError):
        compare.check_pairs(spark.createDataFrame(rows, "text_mode string, seed int, sentence_id long, target int, eeg_control string"))


def test_audit_finds_unequal_fingerprints(spark):
    rows = [("gated_frozen", "frozen", 1, 1, "a"), ("gated_zero_frozen", "frozen", 1, 1, "b"), ("text_frozen", "frozen", 1, 1, "c"), ("gated_frozen", "frozen", 1, 2, "a")]
    out = compare.initialization_audit(spark.createDataFrame(rows, "setup string, text_mode string, seed int, fold int, task_sha256 string")).collect()
    assert [(r.fold, r.n_setups, r.matched) for r in out] == [(1, 2, False)]


def test_setups_parse(spark):
    got = {r.setup: r for r in folds.parse_setups(spark.createDataFrame([(s,) for s in folds.SETUPS], "setup string")).collect()}
    assert got["gated_zero_frozen"].zero_eeg_contribution and not got["gated_frozen"].zero_eeg_contribution
    assert (got["eeg_only"].fusion, got["eeg_only"].text_mode, got["eeg_only"].uses_text) == ("eeg", "none", False)
    with pytest.raises(Exception, match="unknown setup"):
        folds.parse_setups(spark.createDataFrame([("x",)], "setup string")).collect()


def test_zero_contribution_preserves_logits(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], [3.0])], "sentence_id long, text array<double>, signal array<double>")
    p = spark.createDataFrame([([-2.0, -2.0], [[1.0], [2.0]], [0.5, 0.5], [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], [0.0, 0.0, 0.0])], "gate array<double>, project array<array<double>>, project_bias array<double>, classify array<array<double>>, classify_bias array<double>")
    z = scoring.gated_scores(rows, p, zero=True).first()
    assert z.logits_with_eeg == z.logits_without_eeg and z.gated_eeg_contribution_norm == 0 and z.candidate_eeg_contribution_norm > 0
    assert scoring.gated_scores(rows, p).first().logits_with_eeg != z.logits_with_eeg


def test_baselines(spark):
    x = spark.createDataFrame([("eeg_only",), ("text_frozen",), ("concat_finetune",), ("gated_zero_frozen",)], "setup string")
    assert [r[0] for r in x.select(compare.baseline_name(F.col("setup"))).collect()] == [None, None, "text_finetune", "text_frozen"]
