"""Bootstrap intervals over sentence clusters with keyed draws.

Rows are reduced to one additive vector a cluster first (counts of hits and classes), so a
replicate is a sum over its draws, and accuracy and macro-F1 come from the same draws. Clusters
with equal vectors are interchangeable, and there are few different vectors (counts of a few seeds
and classes), so a group goes on as its vectors and their numbers of clusters: places 0 to n - 1 are
dealt out to the vectors in their order. A draw is a few integer operations on (group, replicate,
number), and the place it gives is looked up in a list of their vectors. Work is dealt out by
replicates and stretches of CHUNK draws; nothing of the size of the clusters is sent anywhere, but
for places in the order of sentences: then a group's list, a byte or two a cluster, goes with its work.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import draw_counts, keyed_hash
from ..sources.shared import durable
from .folds import rank_by_hash
from .metrics import CLASSES

QUANTILES = [0.025, 0.975]
#: Draws of a replicate, and replicates, that are taken together.
CHUNK, TOGETHER = 1 << 22, 40
#: Places whose vectors' numbers are packed together, and places that a task lists.
STRETCH, LISTED = 1 << 14, 1 << 26
#: Hits, predicted and true counts of each class; x is the candidate's side, y the other one.
SIDE = [f"{p}{kind}{k}" for p in "xy" for kind in ("hit", "said") for k in range(CLASSES)]
CELLS = [*SIDE, *(f"true{k}" for k in range(CLASSES))]


def resampled(clusters: DataFrame, cells: list[str], group: list[str], samples: int, seed: int, by_sentence: bool = False) -> DataFrame:
    """group, replicate and the cells' sums over as many draws as the group has clusters.

    ``clusters``: group, sentence_id, cells (numbers). Groups are few (one row each is numbered).
    Places go to the clusters in the order of their cells, or ``by_sentence`` in that of their
    sentences' keyed hashes; then a group goes on as the numbers of its vectors by place.
    """
    if by_sentence:
        clusters = durable(clusters)
    vectors = clusters.groupBy(*group, *cells).agg(F.count("*").alias("_m"))
    inside = Window.partitionBy(*group).orderBy(*cells)
    vectors = durable(vectors.withColumns({"_end": F.sum("_m").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_vid": F.row_number().over(inside) - 1}))
    groups = vectors.groupBy(*group).agg(F.sum("_m").alias("_n"), F.sort_array(F.collect_list(F.struct("_end", F.array(*(F.col(c).cast("double") for c in cells)).alias("x")))).alias("v"))
    groups = durable(groups.withColumns({"_gid": F.row_number().over(Window.orderBy(*group)).cast("long"), "_g": keyed_hash(seed, *map(F.col, group))}))
    work, held, together, width = groups, F.array().cast("array<binary>"), TOGETHER, 1
    if by_sentence:
        most = vectors.agg(F.coalesce(F.max("_vid"), F.lit(0))).first()[0]
        width = np.min_scalar_type(most).itemsize
        work, held, together = groups.join(_by_place(clusters, vectors, cells, group, width), group), F.col("_held"), 5 * TOGETHER
    whole = lambda c: F.lit(c).cast("long")
    work = work.select("_gid", "_g", "_n", F.col("v._end").alias("ends"), F.flatten("v.x").alias("cells"), held.alias("held"), F.explode(F.sequence(whole(1), whole(samples), whole(together))).alias("first"))
    work = work.withColumn("start", F.explode(F.sequence(whole(0), F.col("_n") - 1, whole(CHUNK))))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, g, n, ends, x, held, first, start in zip(*(c.to_pylist() for c in batch.columns)):
                ends, x = np.array(ends), np.array(x).reshape(len(ends), -1)
                # Up to LISTED places are looked up in a list of their vectors, more among the vectors' ends.
                if held:
                    owner = np.frombuffer(b"".join(held), dtype=f">u{width}").astype(f"u{width}").__getitem__
                elif n <= LISTED:
                    owner = np.repeat(np.arange(len(ends), dtype=np.min_scalar_type(len(ends) - 1)), np.diff(ends, prepend=0)).__getitem__
                else:
                    owner = partial(np.searchsorted, ends, side="right")
                replicates = range(first, min(first + together, samples + 1))
                sums = draw_counts(g, replicates, start, min(start + CHUNK, n), n, owner, len(ends)) @ x
                yield pa.RecordBatch.from_arrays([pa.array([gid] * len(sums)), pa.array(replicates), *map(pa.array, sums.T)], ["_gid", "replicate", *cells])

    shape = ", ".join(["_gid long", "replicate long", *(f"{c} double" for c in cells)])
    parts = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = work.repartition(4 * parts, "_gid", "first", "start").mapInArrow(draw, shape).groupBy("_gid", "replicate").agg(*(F.sum(c).alias(c) for c in cells))
    return sums.join(groups.select("_gid", *group), "_gid").drop("_gid")


def _by_place(clusters: DataFrame, vectors: DataFrame, cells: list[str], group: list[str], width: int) -> DataFrame:
    """group and _held: the vectors' numbers in the order of the sentences' hashes, ``width`` bytes a
    place, in stretches of places that are put together by any task."""
    placed = rank_by_hash(clusters, group, keyed_hash("cluster", F.col("sentence_id")), "sentence_id", "_place")
    numbered = placed.join(F.broadcast(vectors.select(*group, *cells, "_vid")), [*group, *cells])
    stretch = numbered.groupBy(*group, F.floor((F.col("_place") - 1) / STRETCH).alias("_s")).agg(F.sort_array(F.collect_list(F.struct("_place", "_vid"))).alias("_p"))
    packed = F.unhex(F.array_join(F.transform("_p._vid", lambda i: F.lpad(F.hex(i), 2 * width, "0")), ""))
    return stretch.select(*group, F.struct("_s", packed.alias("_b")).alias("_x")).groupBy(*group).agg(F.sort_array(F.collect_list("_x"))["_b"].alias("_held"))


def _interval(replicates: DataFrame, group: list[str], **values: Column) -> DataFrame:
    """group and name_low, name_high for each value."""
    at = F.array(*map(F.lit, QUANTILES))
    q = replicates.groupBy(*group).agg(*(F.percentile(v, at).alias(k) for k, v in values.items()))
    return q.select(*group, *(F.get(k, F.lit(i)).alias(f"{k}_{end}") for k in values for i, end in enumerate(("low", "high"))))


def accuracy_interval(rows: DataFrame, group: list[str], samples: int, seed: int) -> DataFrame:
    """group, low, high of mean(delta), resampling sentences with all their rows."""
    return delta_interval(rows.groupBy(*group, "sentence_id").agg(F.sum("delta").alias("s"), F.count("delta").alias("c")), group, samples, seed)


def delta_interval(clusters: DataFrame, group: list[str], samples: int, seed: int) -> DataFrame:
    """The same of sentences with their sums (s) and numbers (c) of deltas."""
    drawn = resampled(clusters, ["s", "c"], group, samples, seed)
    return _interval(drawn, group, d=F.col("s") / F.col("c")).withColumnsRenamed({"d_low": "low", "d_high": "high"})


def class_counts(rows: DataFrame, group: list[str], candidate: str, baseline: str, *more: Column) -> DataFrame:
    """One row a sentence: hits and predictions of both sides, and true counts, by class; and ``more``."""
    said = lambda c, k: F.sum((F.col(c) == k).cast("int"))
    hit = lambda c, k: F.sum(((F.col(c) == k) & (F.col("target") == k)).cast("int"))
    sums = {f"{p}{kind}{k}": f(c, k) for p, c in (("x", candidate), ("y", baseline)) for kind, f in (("hit", hit), ("said", said)) for k in range(CLASSES)}
    return rows.groupBy(*group, "sentence_id").agg(*(v.alias(k) for k, v in sums.items()), *(said("target", k).alias(f"true{k}") for k in range(CLASSES)), *more)


def macro_of_counts(side: str, present_only: bool) -> Column:
    """Macro-F1 of one side: over the fixed classes, or those true or predicted at least once."""
    both = [F.col(f"{side}said{k}") + F.col(f"true{k}") for k in range(CLASSES)]
    scores = sum((F.coalesce(F.try_divide(2.0 * F.col(f"{side}hit{k}"), both[k].cast("double")), F.lit(0.0)) for k in range(CLASSES)), F.lit(0.0))
    return F.try_divide(scores, sum(((b > 0).cast("int") for b in both), F.lit(0)).cast("double")) if present_only else scores / float(CLASSES)


def comparison_intervals(rows: DataFrame, group: list[str], samples: int, seed: int, candidate: str, baseline: str, present_only: bool = False) -> DataFrame:
    """group, accuracy_low, accuracy_high, f1_low, f1_high of candidate minus baseline, from the
    same draws of sentences, with all their rows."""
    return count_intervals(class_counts(rows, group, candidate, baseline), group, samples, seed, present_only)


def count_intervals(clusters: DataFrame, group: list[str], samples: int, seed: int, present_only: bool = False, by_sentence: bool = False) -> DataFrame:
    """The same of sentences with their ``class_counts``."""
    drawn = resampled(clusters, CELLS, group, samples, seed, by_sentence)
    hits = lambda p: sum((F.col(f"{p}hit{k}") for k in range(CLASSES)), F.lit(0))
    true = sum((F.col(f"true{k}") for k in range(CLASSES)), F.lit(0))
    return _interval(drawn, group, accuracy=(hits("x") - hits("y")) / true, f1=macro_of_counts("x", present_only) - macro_of_counts("y", present_only))


def paired_delta(rows: DataFrame, group: list[str], samples: int, seed: int, candidate: str, baseline: str, by_sentence: bool = False) -> DataFrame:
    """group, delta_macro_f1, low, high; F1 means run over the classes present. And over all classes
    candidate_macro_f1, baseline_macro_f1, and agreement."""
    clusters = durable(class_counts(rows, group, candidate, baseline, F.count("*").alias("n"), F.sum((F.col(candidate) == F.col(baseline)).cast("int")).alias("same")))
    seen = clusters.groupBy(*group).agg(*(F.sum(c).alias(c) for c in [*CELLS, "n", "same"]))
    seen = seen.select(
        *group, (macro_of_counts("x", True) - macro_of_counts("y", True)).alias("delta_macro_f1"), macro_of_counts("x", False).alias("candidate_macro_f1"),
        macro_of_counts("y", False).alias("baseline_macro_f1"), (F.col("same") / F.col("n")).alias("agreement"))
    between = count_intervals(clusters, group, samples, seed, True, by_sentence)
    return seen.join(between.select(*group, F.col("f1_low").alias("low"), F.col("f1_high").alias("high")), group)
