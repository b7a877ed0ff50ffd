"""Cases behind the findings of round 3, each held against SQL or a plain computation."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fluxalign.functions.keyed import draws
from fluxalign.operators import bootstrap, cv, signal_features
from fluxalign.plans import oracles, queries, runs, views

from .conftest import TINY


#: Sixteen values with two decimals each, whose variances end in a half at the seventh place.
HALVES = [
    [178.37, 30.6, 8.61, 31.0, 88.5, 9.26, 70.84, 24.04, 8.34, 48.96, 184.47, 77.74, 65.84, 5.09, 6.79, 25.63],
    [61.5, 37.64, 54.2, 2.19, 10.49, 19.99, 7.64, 2.78, 192.78, 5.01, 2.28, 14.18, 16.95, 46.31, 2.82, 21.4],
    [3.07, 56.2, 37.48, 9.81, 20.72, 168.5, 50.54, 184.92, 18.99, 3.89, 337.77, 50.06, 104.52, 112.36, 6.78, 22.79]]


def test_variances_that_end_in_a_half_round_as_in_sql(spark, tmp_path):
    """the side to which a half is rounded follows from the last bits of the variance."""
    rows = [(17 * (16 * u + k) + 1, u, "a", v, 1_000_000 + k) for u, values in enumerate(HALVES) for k, v in enumerate(values)]
    x = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    x.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'").fetchall()
    cur = con.execute(oracles.build()["signal_statistics"])  # whole: without its other columns it would not read in order of time
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = queries.signal_statistics(spark, str(tmp_path)).select(*names)
    assert sorted(map(tuple, got.collect())) == want


def test_ordered_and_merged_variances_agree(spark, monkeypatch):
    """above ORDERED samples the variance is merged; both ways differ in the last bits only."""
    rows = [(1, "a", i, (i * 37 % 101) / 100 if i % 9 else None) for i in range(300)]
    x = spark.createDataFrame(rows, "recording long, channel string, at int, value double")
    one = signal_features.signal_statistics(x).first()
    monkeypatch.setattr(signal_features, "ORDERED", 10)
    other = signal_features.signal_statistics(x).first()
    assert one["var"] == pytest.approx(other["var"], rel=1e-12) and one["std"] == pytest.approx(other["std"], rel=1e-12)


def test_readers_are_counted_over_every_embedding(spark):
    """a sentence has the readers of all its five embeddings, whether or not those have labels of their own."""
    got = {r.sentence_id: r.reader_count for r in queries.metadata_with_readers(spark, TINY).collect()}
    have = {r.s: r.n for r in spark.read.parquet(f"{TINY}/embeddings.parquet").groupBy(F.floor(F.col("vec_id") / 5).alias("s")).agg(F.countDistinct("vec_id").alias("n")).collect()}
    labelled = {r.doc_id for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()} & {r.doc_id for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    assert got == {s: n for s, n in have.items() if s in labelled}


def test_counts_are_those_of_the_plain_draws():
    """F4 to F10: blocks of any shape, few and many places, hashes and replicates at their ends."""
    from fluxalign.functions.keyed import BLOCK, draw_counts

    for g, n, start, stop in ((0, 1, 0, 1), ((1 << 32) - 1, 7, 0, 7), (123456789, 5000, 0, 5000), ((1 << 32) - 1, 3 * BLOCK + 5, 0, 3 * BLOCK + 5), (77, 1_000_003, 900_000, 1_000_003), (5, (1 << 38) + 1, 1 << 38, (1 << 38) + 1)):
        owner = lambda d: d % 11
        got = draw_counts(g, range(1, 6), start, stop, n, owner, 11)
        want = [np.bincount(owner(draws(g, r, np.arange(start, stop), n)), minlength=11).tolist() for r in range(1, 6)]
        assert got.tolist() == want, (g, n)


def test_time_of_a_draw_does_not_grow_with_the_places():
    """F4 to F10: a draw among 2,000,000 places took twice that among 50,000; it took 25 ns, plain ones over 80."""
    import time

    from fluxalign.functions.keyed import draw_counts

    n = 2_000_000
    owner = (np.arange(n) // (n // 50 + 1)).astype(np.uint8)
    began = time.perf_counter()
    got = draw_counts(9, range(1, 3), 0, n, n, owner.__getitem__, 50)
    middle = time.perf_counter()
    want = [np.bincount(owner[draws(9, r, np.arange(n), n)], minlength=50).tolist() for r in range(1, 3)]
    assert got.tolist() == want and middle - began < time.perf_counter() - middle


def test_baseline_places_go_by_sentence(spark):
    """every sentence has a place of its own, by its hash, as in the SQL of the first rounds."""
    rows = [("g", i, float(i % 3), 1.0) for i in range(40)] + [("h", i, float(i % 5), 1.0) for i in range(25)]
    x = spark.createDataFrame(rows, "g string, sentence_id long, s double, c double")
    got = sorted(map(tuple, bootstrap.resampled(x, ["s", "c"], ["g"], 9, 5, by_sentence=True).select("g", "replicate", "s", "c").collect()))
    hashed = lambda *key: int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)
    want = []
    for name in "gh":
        s = np.array([r[2] for r in sorted((r for r in rows if r[0] == name), key=lambda r: (hashed("cluster", r[1]), r[1]))])
        want += [(name, r, s[draws(hashed(5, name), r, np.arange(len(s)), len(s))].sum(), float(len(s))) for r in range(1, 10)]
    assert got == want


def test_features_of_an_experiment_are_read_twice(spark):
    """once for the fit and once for the signal block, which the assembler had computed a second time for its size."""
    read = spark.sparkContext.accumulator(0)

    def counted(value):
        read.add(1)
        return value

    labels = spark.createDataFrame([(i, ["bad", "plain", "good"][i % 3], i % 3 - 1) for i in range(30)], "sentence_id long, sentence string, sentiment_label int")
    features = spark.createDataFrame([(i, s, p, float((i + s) % 3 + p)) for i in range(30) for s in range(2) for p in range(2)], "sentence_id long, subject int, pos int, value double")
    features = features.persist().withColumn("value", F.udf(counted, "double")("value"))
    found, _ = runs.experiment(features, labels, "gated_frozen", [42], [0.1], n_folds=2)
    assert found.count() == 30 and read.value == 2 * 120


def test_words_are_counted_in_many_tasks(spark):
    """sentences of neighbouring ids, which a join had left in one task, were all hashed there."""
    texts = spark.range(200).coalesce(1).select(F.col("id").alias("sentence_id"), F.concat(F.lit("A word, "), F.col("id")).alias("sentence"))
    known = spark.range(100).select(F.col("id").alias("sentence_id"))
    words = cv.word_vectors(texts.join(F.broadcast(known), "sentence_id"), 64)
    per_task = [r["count"] for r in words.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 100 and max(per_task) < 30
    rows = known.select("sentence_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("fold"))
    fused = cv.fused_vectors(rows, texts, None, "text", 64).withColumn("n", F.aggregate(vector_to_array("fused"), F.lit(0.0), lambda a, b: a + b))
    assert [tuple(r) for r in fused.groupBy("fold").agg(F.count("*"), F.sum("n")).orderBy("fold").collect()] == [(1, 100, 300.0), (2, 100, 300.0)]


def test_result_documents_compute_predictions_once(spark, monkeypatch):
    """each table of the documents had computed the predictions anew."""
    read = spark.sparkContext.accumulator(0)

    def counted(value):
        read.add(1)
        return value

    plain = views.predictions(spark, TINY).persist()
    n = plain.count()
    monkeypatch.setattr(views, "predictions", lambda spark, sf: plain.withColumn("target", F.udf(counted, "int")("target")))
    assert queries.mean_confusion_from_files(spark, TINY).count() > 0 and read.value == n > 0
    plain.unpersist()
