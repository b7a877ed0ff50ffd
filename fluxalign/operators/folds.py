"""Stratified folds and validation splits of sentences, and the experiment grid.

Places within a class follow from keyed hashes. Classes are few, so the ranks inside a class are
computed over hash buckets: a bucket's offset is a running sum over BUCKETS rows, and only
the rows of one bucket are ordered together. Ranks of values that may crowd go over ranges instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import keyed_hash
from ..sources.shared import durable

BUCKETS = 4096


def rank_in_buckets(df: DataFrame, group: list[str], value: Column, share: Column, tie: str, name: str, size: str | None = None) -> DataFrame:
    """row_number by (value, tie) within a group, without a group in one task.

    ``share``, 0 to 1 and rising with the value, deals a group's rows over BUCKETS. ``size`` names
    a column for the number of rows of the group. Rows of equal value share a bucket.
    """
    bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    x = df.withColumn("_h", value).withColumn("_b", bucket)
    sizes = x.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*group)
    sizes = sizes.withColumns({"_o": F.sum("_n").over(by.orderBy("_b")) - F.col("_n"), "_all": F.sum("_n").over(by)}).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", tie))
    x = x.withColumn("_r", inside).join(sizes, [*group, "_b"]).withColumn(name, (F.col("_r") + F.col("_o")).cast("long"))
    return (x if size is None else x.withColumn(size, F.col("_all"))).drop("_h", "_b", "_r", "_o", "_all")


def rank_by_range(df: DataFrame, group: list[str], value: str, tie: str, name: str, size: str) -> DataFrame:
    """row_number by (value, tie) within a group, and the group's size, however the values are spread.

    Rows are dealt by ranges of (group, value, tie) that Spark takes from a sample of them, so a value
    that most rows have is cut by the tie, and a group spans as many tasks as its rows need. The
    partitions are written once: both the places inside them and their offsets read the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = durable(df.repartitionByRange(parts, *group, value, tie).withColumn("_p", F.spark_partition_id()))
    by = Window.partitionBy(*group)
    sizes = x.groupBy(*group, "_p").agg(F.count("*").alias("_n"))
    sizes = sizes.select(*group, "_p", (F.sum("_n").over(by.orderBy("_p")) - F.col("_n")).alias("_o"), F.sum("_n").over(by).alias(size))
    inside = F.row_number().over(Window.partitionBy(*group, "_p").orderBy(value, tie))
    return x.withColumn("_r", inside).join(sizes, [*group, "_p"]).withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_p", "_r", "_o")


def rank_by_hash(df: DataFrame, group: list[str], h: Column, tie: str, name: str) -> DataFrame:
    """row_number by (h, tie) within a group; h has 32 bits."""
    return rank_in_buckets(df, group, h, h / (1 << 32), tie, name)


def assign_folds(labels: DataFrame, seeds: list[int], n_folds: int = 5) -> DataFrame:
    """sentence_id, sentiment_label, seed, fold (1 to n_folds): each sentence is tested once."""
    sizes = labels.groupBy("sentiment_label").agg(F.count("*").alias("n"))
    before = sizes.withColumn("off", F.sum("n").over(Window.orderBy("sentiment_label")) - F.col("n")).drop("n")
    x = labels.select("sentence_id", "sentiment_label", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    x = rank_by_hash(x, ["seed", "sentiment_label"], keyed_hash(F.col("seed"), F.col("sentence_id")), "sentence_id", "rn")
    return x.join(F.broadcast(before), "sentiment_label").select("sentence_id", "sentiment_label", "seed", ((F.col("off") + F.col("rn") - 1) % n_folds + 1).cast("int").alias("fold"))


def assign_splits(folds: DataFrame, n_folds: int = 5, val_size: float = 0.15) -> DataFrame:
    """sentence_id, sentiment_label, seed, fold, split: train, val or test for every fold.

    Validation quotas of the classes follow largest remainders (ties: the smaller label).
    """
    every = folds.withColumnRenamed("fold", "own").select("*", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
    test = every.where("own = fold").drop("own").withColumn("split", F.lit("test"))
    fit = every.where("own != fold").drop("own")
    sizes = fit.groupBy("seed", "fold", "sentiment_label").agg(F.count("*").alias("n"))
    by = Window.partitionBy("seed", "fold")
    sizes = sizes.withColumn("n_fit", F.sum("n").over(by)).withColumn("n_val", F.ceil(F.col("n_fit") * val_size))
    sizes = sizes.withColumn("exact", F.col("n_val") * F.col("n") / F.col("n_fit")).withColumn("base", F.floor("exact"))
    place = F.row_number().over(by.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), "sentiment_label"))
    sizes = sizes.withColumn("quota", F.col("base") + (place <= F.col("n_val") - F.sum("base").over(by)).cast("int"))
    ranked = rank_by_hash(fit, ["seed", "fold", "sentiment_label"], keyed_hash("val", F.col("seed"), F.col("fold"), F.col("sentence_id")), "sentence_id", "rn")
    fitted = ranked.join(F.broadcast(sizes.select("seed", "fold", "sentiment_label", "quota")), ["seed", "fold", "sentiment_label"])
    fitted = fitted.withColumn("split", F.when(F.col("rn") <= F.col("quota"), "val").otherwise("train")).drop("rn", "quota")
    return fitted.unionByName(test).select("sentence_id", "sentiment_label", "seed", "fold", "split")


def experiment_grid(setups: DataFrame, seeds: list[int], n_folds: int = 5) -> DataFrame:
    """setup, seed, fold, fold_seed."""
    x = setups.select("setup", F.explode(F.array(*map(F.lit, seeds))).alias("seed")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
    return x.withColumn("fold_seed", F.col("seed") + 1000 * F.col("fold"))


#: Fixed names of the setups.
SETUPS = ["text_frozen", "text_finetune", "eeg_only", "concat_frozen", "concat_finetune", "gated_frozen", "gated_finetune", "gated_shuffled_frozen", "gated_shuffled_finetune", "gated_noise_frozen", "gated_noise_finetune", "gated_zero_frozen", "gated_zero_finetune"]


def parse_setups(names: DataFrame) -> DataFrame:
    """setup, fusion, text_mode, eeg_control, uses_text, uses_eeg, zero_eeg_contribution."""
    s = F.col("setup")
    checked = F.when(s.isin(SETUPS), s).otherwise(F.raise_error(F.concat(F.lit("unknown setup "), s)))
    fusion = F.when(s == "eeg_only", "eeg").otherwise(F.split_part(s, F.lit("_"), F.lit(1)))
    mode = F.when(s == "eeg_only", "none").when(s.endswith("finetune"), "finetune").otherwise("frozen")
    control = F.regexp_extract(s, "_(shuffled|noise|zero)_", 1)
    x = names.select(checked.alias("setup"), fusion.alias("fusion"), mode.alias("text_mode"), F.when(control != "", control).otherwise("aligned").alias("eeg_control"))
    return x.withColumns({"uses_text": F.col("fusion") != "eeg", "uses_eeg": F.col("fusion") != "text", "zero_eeg_contribution": (F.col("fusion") == "gated") & (F.col("eeg_control") == "zero")})
