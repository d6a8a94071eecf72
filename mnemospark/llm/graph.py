"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: as many as it has nodes at most."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array([root(x) for x in nodes], type=pa.int64())], names=["u", "v"])


#: Links that one task joins, in arrays of some 60 MB.
CHUNK = 1 << 20


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node and component of all nodes of at most CHUNK links: trees are hung on smaller roots and flattened, all at once."""
    ends = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
    if not ends:
        return
    nodes, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = place.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, component (its smallest node) of every node that has a link; links are two columns of longs.

    Each partition's links become stars first. What is left is joined by one task if it is `chunk` links at most. More are
    joined in rounds: large stars (every larger neighbour goes to the smallest node around) and small stars alternate,
    each an aggregation and a join, until every node hangs on the smallest of its component. Nothing but a count comes to
    the driver; every round is written to the shared folder.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v").mapInArrow(_forest, "u long, v long").distinct()
    edges = common.materialize(edges, "links")
    if edges.count() <= chunk:
        return edges.coalesce(1).mapInArrow(_whole, "node long, component long")
    while True:
        # Done when no node that others hang on hangs on one itself, and no node hangs on two.
        hanging = edges.groupBy("u").agg(F.count("*").alias("n"))
        if hanging.where("n > 1").isEmpty() and edges.join(hanging.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(least, "v").select("u", F.col("m").alias("v")).where("u != v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = common.materialize(small.where("u != v").distinct(), "links")
