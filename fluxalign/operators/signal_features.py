"""Statistics of raw signals by recording and channel, and the feature matrix made of them.

Samples come in long form (recording, channel, at, value) with null for missing; all moments are
population moments over the values present. Differences next to a missing sample are missing.
One window by (recording, channel) gives the differences, one aggregation the statistics; the
crossings need the mean first and use the same partitioning. Very long recordings are cut into
blocks of time instead, whose moments are merged; their quartiles come from radix selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import known
from ..sources.shared import durable
from .align import require_none
from .folds import rank_by_range
from .quantiles import bounded, exact_quantiles

#: Fixed names of the statistics and frequency bands, in the order of the feature matrix.
RAW_STATS = ["mean", "std", "var", "min", "max", "ptp", "median", "iqr", "skew", "kurtosis", "rms", "mav", "line_length", "zcr", "hjorth_mobility", "hjorth_complexity"]
BANDS = ["t1", "t2", "a1", "a2", "b1", "b2", "g1", "g2"]
KEYS = ["recording", "channel"]
#: A recording's channel of more samples than this is cut; and samples a block.
LONG, BLOCK = 1 << 22, 1 << 20
#: The variance of up to so many samples is taken sample by sample in order of time.
ORDERED = 1 << 16


def signal_statistics(samples: DataFrame, line_length: str = "normalized", long: int = LONG) -> DataFrame:
    """recording, channel and the 16 statistics; undefined ones are null.

    A recording's channel of more than ``long`` samples is cut into blocks of time, which any task
    may take; shorter ones are each read in one piece. Both ways give the same statistics.
    """
    if line_length not in ("normalized", "sum"):
        raise ValueError(f"no way {line_length!r} to measure a line")
    x = samples.select(*KEYS, "at", known(F.col("value")).alias("value"))
    large = durable(x.groupBy(*KEYS).count().where(F.col("count") > long).drop("count"))
    if large.isEmpty():
        return _in_pieces(x, line_length)
    large = bounded(large)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"large.{c}")) for c in KEYS]
    part = lambda how: x.alias("x").join(large.alias("large"), same, how)
    return _in_pieces(part("left_anti"), line_length).unionByName(_in_blocks(durable(part("left_semi")), line_length))


def _in_pieces(x: DataFrame, line_length: str) -> DataFrame:
    """One window by recording and channel, then aggregates in the same partitions."""
    by = Window.partitionBy(*KEYS)
    v = F.col("value")
    x = _differences(x.withColumns({"mean": F.avg(v).over(by), "n": F.count(v).over(by)}), by.orderBy("at"))
    quartiles = [F.median(v).alias("median"), (F.percentile(v, 0.75) - F.percentile(v, 0.25)).alias("iqr")]
    few = F.sort_array(F.collect_list(F.when(v.isNotNull() & (F.col("n") <= ORDERED), F.struct("at", "value"))))
    out = x.groupBy(*KEYS).agg(*_mergeable(line_length), *quartiles, few.alias("few"))
    out = out.withColumn("var", F.when(F.size("few") > 0, _ordered_variance(F.col("few"))).otherwise(F.col("var")))
    return _shaped(out.withColumn("std", F.sqrt("var")))


def _ordered_variance(pairs: Column) -> Column:
    """Population variance of (at, value) pairs by Welford's recurrence in their order.

    Variances of few values with two decimals often end in a half at the seventh place. The order
    fixes their last bits, and so the side to which they are rounded, whatever the partitioning.
    """
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s: Column, x: Column) -> Column:
        v, n = x["value"].cast("double"), s["n"] + 1.0
        mean = s["mean"] + (v - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (v - mean) * (v - s["mean"])).alias("m2"))

    return F.aggregate(pairs, start, step, lambda s: s["m2"] / s["n"])


def _in_blocks(x: DataFrame, line_length: str) -> DataFrame:
    """Samples numbered by ranges of time and cut every BLOCK of them; a block also gets the last two
    samples before it, from which its differences begin, and which count in their own block only."""
    named = [f"_{c}" for c in KEYS]
    means = x.groupBy(*KEYS).agg(F.avg("value").alias("mean")).withColumnsRenamed(dict(zip(KEYS, named)))
    x = x.join(bounded(means), [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(KEYS, named)]).drop(*named)
    # Null keys are not equal to themselves where places meet their offsets, so keys travel as structs.
    x = rank_by_range(x.select(F.struct(*KEYS).alias("_k"), "at", "value", "mean"), ["_k"], "at", "value", "_g", "_size")
    block = F.floor((F.col("_g") - 1) / BLOCK)
    ahead = (F.col("_g") - 1) % BLOCK >= BLOCK - 2
    x = x.withColumn("_b", block).select("*", F.explode(F.when(ahead, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_halo"))
    x = x.withColumn("_b", F.col("_b") + F.col("_halo"))
    own = _differences(x, Window.partitionBy("_k", "_b").orderBy("_g")).where("_halo = 0")
    own = durable(own.select(F.col("_k.recording").alias("recording"), F.col("_k.channel").alias("channel"), "value", "d1", "d2", "crossed"))
    q = exact_quantiles(own, KEYS, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(*(F.col(c).alias(n) for c, n in zip(KEYS, named)), "median", (F.col("q3") - F.col("q1")).alias("iqr"))
    out = own.groupBy(*KEYS).agg(*_mergeable(line_length))
    return _shaped(out.join(q, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(KEYS, named)], "left").drop(*named))


def _differences(x: DataFrame, ordered) -> DataFrame:
    """First and second differences, and whether the sign about the mean changed."""
    x = x.withColumn("d1", F.col("value") - F.lag("value").over(ordered))
    x = x.withColumn("d2", F.col("d1") - F.lag("d1").over(ordered)).withColumn("sign", F.signum(F.coalesce(F.col("value") - F.col("mean"), F.lit(0.0))))
    return x.withColumn("crossed", (F.col("sign") != F.lag("sign").over(ordered)).cast("int"))


def _mergeable(line_length: str) -> list:
    """Aggregates whose parts are merged from constant state."""
    v = F.col("value")
    length = F.avg(F.abs("d1")) if line_length == "normalized" else F.coalesce(F.sum(F.abs("d1")), F.lit(0.0))
    return [
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("ptp"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg(F.abs(v)).alias("mav"), length.alias("line_length"),
        (F.coalesce(F.sum("crossed"), F.lit(0)) / F.greatest(F.count("*") - 1, F.lit(1))).alias("zcr"), F.var_pop("d1").alias("v1"), F.var_pop("d2").alias("v2")]


def _shaped(out: DataFrame) -> DataFrame:
    out = out.withColumn("hjorth_mobility", F.sqrt(F.try_divide("v1", "var")))
    out = out.withColumn("hjorth_complexity", F.try_divide(F.sqrt(F.try_divide("v2", "v1")), F.col("hjorth_mobility")))
    return out.select(*KEYS, *RAW_STATS)


def channel_index(samples: DataFrame) -> DataFrame:
    """channel, number: channels in order of their names; one row a channel."""
    return samples.select("channel").distinct().withColumn("number", (F.row_number().over(Window.orderBy("channel")) - 1).cast("int"))


def channel_counts(samples: DataFrame) -> DataFrame:
    """recording, n_channels; recordings of an agreed layout have equal counts."""
    return samples.groupBy("recording").agg(F.countDistinct("channel").alias("n_channels"))


def subject_layouts(samples: DataFrame) -> DataFrame:
    """subject, n_channels of the subject's first recording; subjects without samples have no row."""
    sizes = samples.groupBy("subject", "recording").agg(F.countDistinct("channel").alias("n"))
    return sizes.groupBy("subject").agg(F.min_by("n", "recording").alias("n_channels"))


def check_layouts(layouts: DataFrame) -> None:
    """All subjects have the same number of channels."""
    require_none(layouts.groupBy("n_channels").agg(F.min("subject").alias("subject")).withColumn("n", F.count("*").over(Window.partitionBy())).where("n > 1"), "channel layouts differ between subjects")


def feature_names(n_channels: int, spark) -> DataFrame:
    """pos, family, channel, name: family by family, channels within."""
    families = [f"raw_{s}" for s in RAW_STATS] + [f"bandmean_{b}" for b in BANDS]
    dim = spark.range(len(families) * n_channels).select(F.col("id").cast("int").alias("pos"))
    family = F.element_at(F.array(*map(F.lit, families)), (F.floor(F.col("pos") / n_channels) + 1).cast("int"))
    channel = (F.col("pos") % n_channels).cast("int")
    return dim.select("pos", family.alias("family"), channel.alias("channel"), F.concat(family, F.lit("_ch"), channel).alias("name"))


def feature_rows(stats: DataFrame, bands: DataFrame, channels: DataFrame) -> DataFrame:
    """recording, pos, name, value: statistics and band means in matrix order, null where missing.

    Every recording has a row for every position, whichever blocks it lacks. A block of the wrong
    shape (raw statistics, or one band, not of exactly the channels there are) is null throughout.
    """
    n = channels.count()
    raw = stats.select(*KEYS, F.explode(F.array(*(F.struct(F.lit(f"raw_{s}").alias("family"), F.col(s).cast("double").alias("value")) for s in RAW_STATS))).alias("x")).select(*KEYS, "x.*")
    band = bands.select(*KEYS, F.concat(F.lit("bandmean_"), F.col("band")).alias("family"), "value")
    numbered = lambda x: x.join(channels, "channel").drop("channel")
    whole = lambda x, block: x.join(x.groupBy("recording", *block).agg(F.countDistinct("channel").alias("_n")).where(F.col("_n") == n).drop("_n"), ["recording", *block], "left_semi")
    present = numbered(whole(raw, [])).unionByName(numbered(whole(band, ["family"])))
    dim = feature_names(n, stats.sparkSession)
    every = stats.select("recording").distinct().crossJoin(F.broadcast(dim))
    return every.join(present, (every.recording == present.recording) & (every.family == present.family) & (every.channel == present.number), "left").select(every.recording, "pos", "name", "value")
