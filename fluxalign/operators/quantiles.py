"""Exact quantiles of many groups by radix selection, in a fixed number of counters a group.

A double is mapped to a 64-bit integer of the same order. Four passes over the rows count 16 bits
each: a pass keeps, for every rank sought, the digit that holds it, and the next one counts only
rows that begin with the digits found. Rows stay where they are; only counts are shuffled, so a
group of any size, or one value in most of its rows, does not come together in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import durable

DIGIT = 16
#: Ranks sought are broadcast while they are this many (about 60 bytes each), else joined.
BROADCAST_ROWS = 500_000


def order_key(x: Column) -> Column:
    """A long whose unsigned order is that of the doubles; both zeros are one value. Not for nulls."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    # Negative ones are inverted, others get the leading bit: both are an exclusive or with the sign's bits.
    return F.transform(F.array(bits), lambda b: b.bitwiseXOR(F.shiftright(b, 63).bitwiseOR(F.lit(-(1 << 63)))))[0]


def from_key(key: Column) -> Column:
    """The double of an ``order_key``."""
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(-(1 << 63)))).otherwise(F.bitwise_not(key))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def bounded(df: DataFrame) -> DataFrame:
    """Broadcast after its rows were counted, or left to an ordinary join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which nulls are equal: the left columns, then the right ones that are not keys."""
    a, b = left.alias("a"), right.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on]
    return a.join(b, same).select("a.*", *(F.col(f"b.{c}") for c in right.columns if c not in on))


def exact_quantiles(rows: DataFrame, group: list[str], value: str, shares: dict[str, float], members: Column | None = None) -> DataFrame:
    """group, member and one column for each share: quantiles interpolated between neighbours.

    ``members`` is an array of numbers: those of the (overlapping) parts of a group that a row is in.
    Rows are multiplied by them in the stage that counts, not before. All are in part 0 without it.
    Null values are ignored; a group and member without values has no row, an empty table gives
    none. NaN is not allowed for (``functions.vectors.known`` makes it null).
    """
    x = durable(rows.where(F.col(value).isNotNull()).select(*group, order_key(F.col(value).cast("double")).alias("_key"), (F.array(F.lit(0)) if members is None else members).alias("_in")))
    digit = lambda shift: F.shiftrightunsigned("_key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))

    def counted(of: DataFrame, by: list[str], shift: int) -> DataFrame:
        each = of.select(*by, digit(shift).alias("_d"), F.explode("_in").alias("member"))
        return each.groupBy(*by, "member", "_d").agg(F.count("*").alias("_n"))

    counts = durable(counted(x, group, 64 - DIGIT))
    sizes = durable(counts.groupBy(*group, "member").agg(F.sum("_n").alias("_all")))
    place = lambda p: F.lit(p) * (F.col("_all") - 1)
    ends = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), f(place(p)).alias("rank")) for name, p in shares.items() for side, f in ((0, F.floor), (1, F.ceil))))
    target = [*group, "member", "name", "side"]

    def narrowed(sought: DataFrame) -> DataFrame:
        """The digit that holds each rank: target, the prefix with it, the rank among the rows under it."""
        up_to = F.sum("_n").over(Window.partitionBy(*target).orderBy("_d"))
        kept = sought.withColumn("_below", up_to - F.col("_n")).where((F.col("rank") >= F.col("_below")) & (F.col("rank") < F.col("_below") + F.col("_n")))
        return durable(kept.select(*target, F.shiftleft("_prefix", DIGIT).bitwiseOR(F.col("_d")).alias("_prefix"), (F.col("rank") - F.col("_below")).alias("rank")))

    targets = sizes.select(*group, "member", F.inline(ends)).withColumn("_prefix", F.lit(0).cast("long"))
    found = narrowed(_joined(targets, counts, [*group, "member"]))
    for shift in range(64 - 2 * DIGIT, -1, -DIGIT):
        # One row a group and prefix: all that is sought under one prefix is counted together.
        prefixes = bounded(found.select(*group, "_prefix").distinct())
        hits = _joined(x.withColumn("_prefix", F.shiftrightunsigned("_key", shift + DIGIT)), prefixes, [*group, "_prefix"])
        found = narrowed(_joined(found, counted(hits, [*group, "_prefix"], shift), [*group, "member", "_prefix"]))
    value_of = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_value")))
    values = found.withColumn("_value", from_key(F.col("_prefix"))).groupBy(*group, "member").agg(*(value_of(name, side).alias(f"_{name}_{side}") for name in shares for side in (0, 1)))
    between = lambda name, p: F.col(f"_{name}_0") + (F.col(f"_{name}_1") - F.col(f"_{name}_0")) * (place(p) - F.floor(place(p)))
    return _joined(sizes, values, [*group, "member"]).select(*group, "member", *(between(name, p).alias(name) for name, p in shares.items()))
