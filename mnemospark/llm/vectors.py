"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves, each half has a codebook of its own, and pairs of codes form a grid of cells. A
vector lives in the cell of its nearest codes. As a query it visits cells in the order of the multi-sequence traversal,
nearest first by how far the vector must move to cross into them (the distance to the boundary between two codes'
regions, in each half), until the bound passes `reach` times the radius that the similarity allows. Of two cells, the
one that comes first in a fixed order asks the other, so a pair meets in one cell only. A reach of 1 misses
nothing; the reach of a target recall is taken from all true pairs of a bounded sample (each counting alike, and each row
counting alike: the larger reach stands), and never less than what
evenly spread differences of that size need. Vectors of a cell are then compared exactly, in double precision.

The number of codes follows the table, so that a cell holds `per_cell` vectors of the group that a vector is in, as long as
the sample has CODE of its vectors for each code. Vectors travel as they came, in single precision where they are.

Exact copies are collapsed first and counted. A cell with more than `block` vectors is compared block against block, so
no task holds more than two blocks at a time, and a task returns sums of links for each vector and a forest of the links found:
rows in proportion to its vectors, never all pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or id, link with
nothing and come back alone. Vectors of different lengths aren't compared; a length with a few vectors has one cell and no
codebook. Repeated rows are copies of each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph, shingles

SIMILARITY = 0.98
SAMPLE = 20_000
#: Vectors of the sample whose near pairs, all of them, the reach is taken from.
FIT = 4000
BLOCK = 1024
#: Vectors of the sample for one code, at least.
CODE = 8


def _array(value) -> np.ndarray | None:
    """A vector that can have links, in double precision."""
    if value is None or not len(value):
        return None
    x = np.asarray(value, dtype=np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _units(blobs: list[bytes], kind: str = "<f8") -> np.ndarray:
    x = np.stack([np.frombuffer(b, dtype=kind) for b in blobs]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres by Lloyd's rounds from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)
        for c in range(len(centres)):
            if (mine := near == c).any():
                centres[c] = x[mine].mean(axis=0)
    return centres


class Index:
    """Two codebooks for vectors of one length, and how far queries go."""

    def __init__(self, sample: np.ndarray, k: int, similarity: float, recall: float, groups: np.ndarray, fit: int = FIT):
        self.half = sample.shape[1] // 2
        self.books = [_codebook(sample[:, : self.half], k), _codebook(sample[:, self.half :], k)] if self.half else [np.zeros((1, 0)), _codebook(sample, k)]
        self.radius = float(np.sqrt(2 - 2 * similarity))
        self.reach = 1.0
        if recall < 1:
            self.reach = min(1.0, max(4 / np.sqrt(sample.shape[1]), self._needed(sample[:fit], groups[:fit], similarity, recall)))

    def _needed(self, x: np.ndarray, groups: np.ndarray, similarity: float, recall: float) -> float:
        """The reach that finds this part of the sample's own near pairs, and of them with each row's pairs weighing one."""
        bounds = [self.bounds(v) for v in x]
        first, second = (np.stack([b[i] for b in bounds]) for i in (0, 1))
        one, two = first.argmin(axis=1), second.argmin(axis=1)
        asks = self.rank(one * len(self.books[1]) + two)
        found, weights = [], []
        for a in range(len(x)):
            near = a + 1 + np.flatnonzero((x[a + 1 :] @ x[a] >= similarity) & (groups[a + 1 :] == groups[a]))
            if len(near):
                there = np.hypot(first[a, one[near]], second[a, two[near]])
                back = np.hypot(first[near, one[a]], second[near, two[a]])
                # In single precision: 4000 near copies have 8 million pairs.
                found.append(np.where(asks[a] <= asks[near], there, back).astype(np.float32))
                weights.append(len(near))
        if not found:
            return 0.0
        needed = np.concatenate(found)
        order = np.argsort(needed)
        by_row = np.cumsum(np.repeat(1 / np.array(weights), weights)[order])
        at = [min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1), min(len(needed) - 1, int(np.searchsorted(by_row, recall * by_row[-1])))]
        return 1.25 * float(needed[order[max(at)]]) / self.radius

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, how far it must move at least to be nearest to each code."""
        out = []
        for part, book in zip((x[: self.half], x[self.half :]), self.books, strict=True):
            d = ((book - part) ** 2).sum(axis=1)
            a = int(np.argmin(d))
            gaps = np.sqrt(np.maximum(((book - book[a]) ** 2).sum(axis=1), 1e-18))
            lower = (d - d[a]) / (2 * gaps)
            lower[a] = 0
            out.append(np.maximum(lower, 0))
        return out

    @staticmethod
    def home(bounds: list[np.ndarray]) -> tuple[int, int]:
        return int(np.argmin(bounds[0])), int(np.argmin(bounds[1]))

    @staticmethod
    def rank(cells):
        """The order of cells in which the first of two asks the other: one that has nothing to do with their places."""
        return cells * 0x9E3779B1 & 0xFFFFFFFF

    def visit(self, bounds: list[np.ndarray]) -> list[int]:
        """The numbers of the cells to visit, nearest first; the first is the vector's own."""
        first, second = (np.argsort(b, kind="stable") for b in bounds)
        a, b = bounds[0][first] ** 2, bounds[1][second] ** 2
        limit, out, seen, ahead = (self.reach * self.radius) ** 2 + 1e-12, [], {(0, 0)}, [(a[0] + b[0], 0, 0)]
        while ahead:
            bound, i, j = heapq.heappop(ahead)
            if bound > limit:
                break
            out.append(int(first[i]) * len(b) + int(second[j]))
            for n in ((i + 1, j), (i, j + 1)):
                if n[0] < len(a) and n[1] < len(b) and n not in seen:
                    seen.add(n)
                    heapq.heappush(ahead, (a[n[0]] + b[n[1]], *n))
        return out


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of links that join what all links of this matrix join: a forest, a step for each row and column."""
    out: list[tuple[int, int]] = []
    rows, columns = near.any(axis=1), near.any(axis=0)  # those not yet reached
    while rows.any():
        ahead = [int(np.argmax(rows))]
        rows[ahead[0]] = False
        while ahead:
            row = ahead.pop()
            fresh = np.flatnonzero(near[row] & columns)
            columns[fresh] = False
            for column in fresh.tolist():
                out.append((row, column))
                more = np.flatnonzero(near[:, column] & rows)
                rows[more] = False
                for other in more.tolist():
                    out.append((other, column))
                    ahead.append(other)
    return out


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", similarity: float = SIMILARITY, recall: float = 0.9999, sample: int = SAMPLE, block: int = BLOCK, per_cell: int = 16, fit: int = FIT) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Codebooks are learned from at most `sample` vectors, the reach from all near pairs of the first `fit` of them.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector].dataType.containsNull)
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    # Copies of the group have the same bytes, so one row stands for all of them.
    source = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.to_json(F.struct(F.col(group).alias("g"))).alias("g"), F.col(group).isNotNull().alias("has"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, value, has in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x = _array(value) if has and k is not None else None
                out.append(None if x is None else x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, type=pa.binary())], names=["vec_id", "g", "x"])

    rows = common.materialize(source.mapInArrow(clean, "vec_id long, g string, x binary"), "vectors")
    good = rows.where(F.col("x").isNotNull())
    distinct = common.materialize(good.groupBy("g", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vectors")
    # The size of the group that a vector is in, on the average of vectors: a hot group counts as it should.
    groups = distinct.groupBy(F.octet_length("x").alias("size"), "g").agg(F.count("*").alias("n"))
    met = groups.groupBy("size").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("met"))
    codes = {r[0]: int(min(max(1, sample // CODE), round((r[1] / per_cell) ** 0.5))) for r in met.where(F.col("met") >= 4 * per_cell).collect()}
    indexes = {}
    for size, k in codes.items():
        # A sample of at most `sample` vectors fits the codebooks; every vector is indexed.
        some = distinct.where(F.octet_length("x") == size).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("g", "x").collect()
        names = {g: i for i, g in enumerate(dict.fromkeys(r[0] for r in some))}
        indexes[size] = Index(_units([bytes(r[1]) for r in some], kind), k, similarity, recall, np.array([names[r[0]] for r in some]), fit)
    shared = spark.sparkContext.broadcast(indexes)  # at most sample / CODE codes a half

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row where a vector lives, and one for each cell that it asks."""
        for batch in batches:
            blobs, out = batch.column(1).to_pylist(), []
            for i, blob in enumerate(blobs):
                index = shared.value.get(len(blob))
                cells = index.visit(index.bounds(_units([blob], kind)[0])) if index else [0]
                out += [(i, c, c == cells[0]) for c in cells if Index.rank(c) >= Index.rank(cells[0])]
            at = pa.array([x[0] for x in out], type=pa.int64())
            size = pa.array([len(b) // width for b in blobs], type=pa.int32())
            columns = [batch.column(0).take(at), size.take(at), pa.array([x[1] for x in out], type=pa.int32()), pa.array([x[2] for x in out], type=pa.bool_()), batch.column(2).take(at), batch.column(3).take(at), batch.column(1).take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "size", "cell", "lives", "rep", "weight", "x"])

    placed = common.materialize(distinct.select("g", "x", "rep", "weight").mapInArrow(place, "g string, size int, cell int, lives boolean, rep long, weight long, x binary"), "cells")
    cell = ["g", "size", "cell"]
    counts = placed.groupBy(*cell).agg(F.sum(F.col("lives").cast("long")).alias("points"), F.count("*").alias("queries"))
    dealt = placed.join(counts.where("points > 0 and queries > 1"), cell)
    blocks, asks = F.ceil(F.col("points") / block).cast("int"), F.ceil(F.col("queries") / block).cast("int")
    own_block, own_ask = F.pmod(F.xxhash64("rep"), blocks).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), asks).cast("int")
    as_point = F.when(F.col("lives"), F.transform(F.sequence(F.lit(0), asks - 1), lambda a: F.struct(own_block.alias("b"), a.alias("a"), F.lit(True).alias("point")))).otherwise(F.expr("cast(array() as array<struct<b:int,a:int,point:boolean>>)"))
    as_query = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(b.alias("b"), own_ask.alias("a"), F.lit(False).alias("point")))
    # A vector's point and query rows meet in one task where they can; a row of a split cell goes to each facing block.
    tasks = dealt.select(*cell, "rep", "weight", "x", "lives", F.explode(F.concat(as_point, as_query)).alias("t"))
    n = common.buckets(spark, 4, placed)
    packed = tasks.select(F.pmod(F.xxhash64(*cell, "t.b", "t.a"), F.lit(n)).alias("bucket"), *cell, "t.*", "rep", "weight", "x", "lives")

    def compare(table: pa.Table) -> pa.Table:
        """Sums of links of each vector (b is null) and links that join what they join (n is null)."""
        out: list[tuple] = []
        names = pa.table([table[c] for c in (*cell, "b", "a")], names=[*cell, "b", "a"]).to_pandas().groupby([*cell, "b", "a"], sort=False).ngroup().to_numpy()
        order = np.argsort(names, kind="stable")
        point, lives = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("point", "lives"))
        rep, weight, blobs = table["rep"].to_numpy(), table["weight"].to_numpy(), table["x"]
        for s, e in zip(*shingles.runs(names[order]), strict=True):
            mine = order[s:e]
            p, q = mine[point[mine]], mine[~point[mine]]
            if not len(p) or not len(q):
                continue
            near = _units([blobs[int(i)].as_py() for i in q], kind) @ _units([blobs[int(i)].as_py() for i in p], kind).T >= similarity
            near &= rep[q][:, None] != rep[p][None]
            if not near.any():
                continue
            got = near @ weight[p]
            # A query from another cell is asked about nowhere else; one of this cell is a point to those that it finds.
            back = weight[q] @ (near & ~lives[q][:, None])
            for who, sums in ((q, got), (p, back)):
                out += zip(rep[who][sums > 0].tolist(), [None] * int((sums > 0).sum()), sums[sums > 0].astype(np.int64).tolist(), strict=True)
            out += [(int(rep[q[x]]), int(rep[p[y]]), None) for x, y in _spanning(near)]
        return pa.table({c: pa.array([r[i] for r in out], type=pa.int64()) for i, c in enumerate("abn")})

    found = common.materialize(packed.groupBy("bucket").applyInArrow(compare, "a long, b long, n long"), "links")
    sums = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = graph.components(found.where("b is not null").select("a", "b"))
    known = distinct.join(sums, "rep", "left").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    linked = good.join(known, ["g", "x"]).select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where(F.col("x").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
