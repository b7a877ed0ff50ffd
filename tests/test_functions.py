import math

from pyspark.sql import functions as F

from fluxalign.functions import keyed, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize_text(spark):
    assert one(spark, text.normalize_text(F.lit("“Hello,  World’s”"))) == "hello world s"
    assert one(spark, text.normalize_text(F.lit("  "))) == ""
    assert one(spark, text.normalize_text(F.lit(None).cast("string"))) is None


def test_word_count_reads_all_scripts(spark):
    assert one(spark, text.word_count(F.lit("Été naïve don't a_b"))) == 5


def test_subject_from_path(spark):
    assert one(spark, text.subject_from_path(F.lit("/a/resultsZAB_SR.mat"))) == "ZAB"
    for path, subject in {"/a/other.mat": "other.mat", "/d/YAC.h5": "YAC.h5", "/d/my_results.mat": "my_.mat", "/d/resultsA_SR.mat/x.mat": "A", "/d/YAC.h5/part-00000-1.parquet": "YAC.h5", "q_SR.mat": "q"}.items():
        assert one(spark, text.subject_from_path(F.lit(path))) == subject


def test_softmax_margin_argmax(spark):
    a = F.array(F.lit(1000.0), F.lit(1000.0), F.lit(0.0))
    p = one(spark, vectors.softmax(a))
    assert [round(x, 9) for x in p] == [0.5, 0.5, 0.0]
    assert one(spark, vectors.argmax(a)) == 0
    assert abs(one(spark, vectors.margin(vectors.softmax(a)))) < 1e-12


def test_norm_ratio_sigmoid(spark):
    assert one(spark, vectors.l2(F.array(F.lit(3.0), F.lit(4.0)))) == 5.0
    assert one(spark, vectors.ratio(F.lit(1.0), F.lit(0.0))) == 1e12
    assert one(spark, vectors.sigmoid(F.lit(0.0))) == 0.5


def test_known_values_only(spark):
    for bad in (float("nan"), float("inf"), float("-inf"), None):
        assert one(spark, vectors.known(F.lit(bad).cast("double"))) is None
    assert one(spark, vectors.known(F.lit(1.5))) == 1.5


def test_keyed_values_are_stable(spark):
    assert one(spark, keyed.keyed_hash("a", 1)) == 225584429
    x = spark.range(4000).select(keyed.normal(F.col("id")).alias("x")).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert abs(x.m) < 0.1 and abs(x.s - 1) < 0.1 and not math.isnan(x.s)
