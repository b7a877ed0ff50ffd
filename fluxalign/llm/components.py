"""Connected components of a link table: in one task while it is small, else by star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, stored

#: Links that one task joins at most (two numbers each, 16 MB); more are contracted by shuffles.
MOST_ALONE = 1 << 20


def components(links: DataFrame, most_alone: int = MOST_ALONE) -> DataFrame:
    """(node, component) for every node of the stored ``links`` (a, b); component is its least node."""
    links = links.select("a", "b")
    return alone(links) if links.count() <= most_alone else contracted(links)


def alone(links: DataFrame) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.array([c.to_numpy() for c in batch.columns]) for batch in batches]
        if not parts:
            return
        nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(nodes))
        while len(a):  # hang the larger root on the smaller one, then shorten all paths
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    return links.repartition(1).mapInArrow(join, "node long, component long")


def contracted(links: DataFrame) -> DataFrame:
    """Each round hangs nodes on the least neighbour known (first larger neighbours, then smaller
    ones), so paths shorten by halves. Only minima are gathered for a node, never its neighbours, so
    a hub is no larger than any other node."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
