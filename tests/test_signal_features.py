import pytest

from fluxalign.operators import signal_features as sf
from fluxalign.operators.align import DataError


def signal(spark, **series):
    rows = [(1, c, i, v) for c, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "recording long, channel string, at int, value double")


def stats(spark, mode="normalized", **series):
    return {r.channel: r for r in sf.signal_statistics(signal(spark, **series), mode).collect()}


def test_line_length_does_not_depend_on_duration(spark):
    s = stats(spark, short=[0.0, 1.0, 0.0, 1.0], long=[0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0])
    assert s["short"].line_length == s["long"].line_length == 1.0


def test_line_length_sum(spark):
    s = stats(spark, "sum", a=[0.0, 1.0, 0.0, 1.0], b=[None, None])
    assert s["a"].line_length == 3.0 and s["b"].line_length == 0.0
    with pytest.raises(ValueError):
        sf.signal_statistics(signal(spark, a=[1.0]), "other")


def test_constant_signal_has_no_shape(spark):
    s = stats(spark, a=[1.0, 1.0, 1.0])["a"]
    assert (s.skew, s.kurtosis, s.hjorth_mobility, s.hjorth_complexity) == (None,) * 4
    assert (s.mean, s["std"], s.ptp, s.zcr) == (1.0, 0.0, 0.0, 0.0)


def test_zero_crossing_counts_moves_to_and_from_zero(spark):
    assert stats(spark, a=[-1.0, 0.0, 1.0])["a"].zcr == 1.0


def test_missing_samples_break_differences(spark):
    s = stats(spark, a=[0.0, None, 5.0, 6.0], b=[float("nan"), 2.0])
    assert s["a"].line_length == 1.0 and s["a"]["max"] == 6.0
    assert s["b"]["mean"] == 2.0 and s["b"].line_length is None


def test_feature_names_are_family_major(spark):
    names = [r.name for r in sf.feature_names(2, spark).orderBy("pos").collect()]
    assert names[:3] == ["raw_mean_ch0", "raw_mean_ch1", "raw_std_ch0"] and names[-1] == "bandmean_g2_ch1" and len(names) == 48


def test_every_recording_has_every_feature(spark):
    x = signal(spark, a=[1.0, 2.0], b=[3.0, 4.0])
    bands = spark.createDataFrame([(1, c, "t1", v) for c, v in (("a", 9.0), ("b", 8.0))], "recording long, channel string, band string, value double")
    rows = {r.name: r.value for r in sf.feature_rows(sf.signal_statistics(x), bands, sf.channel_index(x)).collect()}
    assert len(rows) == 48 and rows["bandmean_t1_ch0"] == 9.0 and rows["bandmean_t1_ch1"] == 8.0 and rows["raw_mean_ch1"] == 3.5 and rows["bandmean_t2_ch0"] is None


def test_blocks_of_the_wrong_shape_are_missing(spark):
    """Recording 2 has one of two channels; band t1 of recording 1 too: those blocks are null."""
    rows = [(1, "a", 0, 1.0), (1, "b", 0, 2.0), (2, "a", 0, 3.0)]
    x = spark.createDataFrame(rows, "recording long, channel string, at int, value double")
    bands = spark.createDataFrame([(1, "a", "t1", 9.0), (2, "a", "t2", 7.0), (2, "b", "t2", 6.0)], "recording long, channel string, band string, value double")
    got = {(r.recording, r.name): r.value for r in sf.feature_rows(sf.signal_statistics(x), bands, sf.channel_index(x)).collect()}
    assert len(got) == 96 and got[1, "raw_mean_ch1"] == 2.0 and got[1, "bandmean_t1_ch0"] is None
    assert all(v is None for (i, n), v in got.items() if i == 2 and n.startswith("raw_")) and got[2, "bandmean_t2_ch1"] == 6.0


def test_layouts_follow_first_recordings_and_must_agree(spark):
    rows = [("A", 1, "a"), ("A", 1, "b"), ("A", 2, "a"), ("B", 3, "a"), ("B", 3, "b")]
    layouts = sf.subject_layouts(spark.createDataFrame(rows, "subject string, recording long, channel string"))
    assert sorted(map(tuple, layouts.collect())) == [("A", 2), ("B", 2)]
    sf.check_layouts(layouts)
    with pytest.raises(DataError, match="layouts differ"):
        sf.check_layouts(layouts.union(spark.createDataFrame([("C", 3)], "subject string, n long")))


def test_empty_samples(spark):
    assert sf.signal_statistics(signal(spark, a=[1.0]).limit(0)).count() == 0


@pytest.mark.parametrize("mode", ["normalized", "sum"])
def test_blocks_of_time_give_the_same_statistics(spark, monkeypatch, mode):
    """Seams between blocks, missing samples beside them, constant and short channels, null keys."""
    import random

    monkeypatch.setattr(sf, "BLOCK", 7)
    rng = random.Random(5)
    series = {"a": [rng.gauss(0, 1) if i % 11 else None for i in range(200)], "b": [2.0] * 50, "c": [1.0, -1.0], "d": [float(i % 7 - 3) for i in range(70)], "e": [None] * 30, "f": [rng.choice([0.0, 1.0, float("nan")]) for _ in range(64)]}
    x = signal(spark, **series).unionByName(signal(spark, z=[1.0, 5.0, 2.0] * 9).withColumn("channel", sf.F.lit(None).cast("string")))
    want = {r.channel: r.asDict() for r in sf.signal_statistics(x, mode).collect()}
    got = {r.channel: r.asDict() for r in sf.signal_statistics(x, mode, long=10).collect()}
    assert set(got) == set(want) == {*series, None}
    for channel, row in want.items():
        for name, value in row.items():
            assert got[channel][name] == (pytest.approx(value, rel=1e-9, abs=1e-12) if isinstance(value, float) else value), (channel, name)
