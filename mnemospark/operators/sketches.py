"""Candidates of near sets: all pairs of a scope whose sizes fit, compared by sketches in blocks of bounded size.

A sketch has a bit for each remainder of a token's hash: whether an odd number of the set's tokens have it. Two sketches differ
in no more bits than their sets do in tokens, and sets of Jaccard t differ in (1 - t) / (1 + t) of the sum of their sizes at
most. So a pair whose sketches differ in more isn't near, and none that is near is lost; those that are left are compared on
their tokens. What is compared for a pair is a few numbers, first some of its prefix (half of the sketch), and nothing is written for a
pair that differs too much; frequent tokens cost no more than rare ones.

Sizes are in classes, each 1 / t times as wide as the one before. A class compares its sets with one another and with the
smaller ones that are in reach.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _runs

#: Rows of a block, and numbers of all its sketches.
ROWS, NUMBERS = 1 << 15, 1 << 18
#: Tokens that are counted, and candidates that are given, at once.
COUNTED, GIVEN = 1 << 19, 1 << 15


def _width(least: float) -> float:
    return max(-math.log(least), 1e-3)


def _class(n: np.ndarray, least: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / _width(least)).astype(np.int64)


def _reach(n: np.ndarray, least: float) -> np.ndarray:
    """The size of the largest set that can be near one of n tokens."""
    return np.floor(n / least + 1e-6).astype(np.int64)


def _numbers(at: np.ndarray, least: float) -> np.ndarray:
    """How many numbers of 64 bits a sketch of each class has: a power of two, a bit for each token at least."""
    return 1 << np.ceil(np.log2(np.maximum(np.exp((at + 1) * _width(least)) / 64, 2)) - 1e-9).astype(np.int64)


def sketched(texts: DataFrame, least: float) -> DataFrame:
    """scope, id of texts (scope, id, text; none null), what their token set is (key), its size (n) and class (own), the largest
    class that it meets (top), and the sketch for the latter (prefix, rest). Tokens are those of text.token_set."""

    def part(batch: pa.RecordBatch, sets: list[set[str]]) -> pa.RecordBatch:
        # Tokens have no spaces, so what is hashed says which set it is.
        keys = [hashlib.sha256(" ".join(sorted(s)).encode()).digest() for s in sets]
        n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        tokens = np.empty(int(n.sum()), dtype=object)
        tokens[:] = list(itertools.chain.from_iterable(sets))
        h = pd.util.hash_array(tokens, categorize=False)
        own, top = _class(n, least), _class(_reach(n, least), least)
        size = _numbers(top, least)
        ends = np.cumsum(size)
        at = np.repeat((ends - size) * 64, n) + (h & (np.repeat(size, n) * 64 - 1).astype(np.uint64)).astype(np.int64)
        odd = (np.bincount(at, minlength=int(ends[-1]) * 64) & 1).astype(np.uint8)
        words = np.packbits(odd, bitorder="little").view(np.int64)
        first = np.arange(len(words)) - np.repeat(ends - size, size) < np.repeat(size // 2, size)
        starts = pa.array(np.concatenate(([0], np.cumsum(size // 2))).astype(np.int32))
        halves = [pa.ListArray.from_arrays(starts, pa.array(words[half])) for half in (first, ~first)]
        columns = [*batch.columns[:2], pa.array(keys, pa.binary()), *(pa.array(x.astype(np.int32)) for x in (n, own, top)), *halves]
        return pa.RecordBatch.from_arrays(columns, names=["scope", "id", "key", "n", "own", "top", "prefix", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, sets = 0, 0, []
            for i in range(batch.num_rows):
                sets.append(set(batch.column(2)[i].as_py().split()))
                held += len(sets[-1])
                if held >= COUNTED or i == batch.num_rows - 1:
                    yield part(batch.slice(at, len(sets)), sets)
                    at, held, sets = i + 1, 0, []

    kinds = {c: texts.schema[c].dataType.simpleString() for c in ("scope", "id")}
    return texts.select("scope", "id", "text").mapInArrow(run, f"scope {kinds['scope']}, id {kinds['id']}, key binary, n int, own int, top int, prefix array<long>, rest array<long>")


class _Block:
    """Rows of a class, by size: the ids, sizes and sketches of one side."""

    def __init__(self, parts: list[pa.RecordBatch], numbers: int):
        rows = pa.Table.from_batches(parts)
        self.ids = rows["id"].combine_chunks()
        self.n = rows["n"].to_numpy().astype(np.int64)
        # Sketches for a larger class are folded: a remainder's remainder is that of the hash.
        size = np.asarray(pc.list_value_length(rows["prefix"])) * 2
        words = np.zeros((numbers, len(self.n)), dtype=np.uint64)
        flat = {c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("prefix", "rest")}
        for m in np.unique(size):
            at = np.flatnonzero(size == m)
            places = (np.cumsum(size // 2) - size // 2)[at][:, None] + np.arange(m // 2)
            whole = np.concatenate([flat["prefix"][places], flat["rest"][places]], axis=1)
            words[:, at] = np.bitwise_xor.reduce(whole.reshape(len(at), m // numbers, numbers), axis=1).T
        self.words = words


def _differ(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In how many bits a sketch differs from each of many."""
    out = np.zeros(many.shape[1], dtype=np.uint16 if len(one) < 1024 else np.int32)
    for w, other in zip(one, many, strict=True):
        out += np.bitwise_count(other ^ w)
    return out


def _met(block: _Block, other: _Block, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in other and block of the pairs that may be near, of the same block each pair once."""
    share, half = (1 - least) / (1 + least), len(block.words) // 2
    lo = np.arange(1, len(other.n) + 1) if same else np.searchsorted(block.n, np.ceil(other.n * least - 1e-6))
    hi = np.searchsorted(block.n, _reach(other.n, least), side="right")
    for i in np.flatnonzero(lo < hi):
        window = slice(lo[i], hi[i])
        most = np.floor((block.n[window] + other.n[i]) * share + 1e-6).astype(np.int32)
        # Of a number, sketches of sets that have little in common differ in 32 bits: so many as tell most of them, of the prefix.
        few = min(half, int(most[-1]) // 32 + 1)
        at = np.flatnonzero(_differ(other.words[:few, i], block.words[:few, window]) <= most)
        if len(at):
            many = block.words[:, lo[i] + at]
            at = at[_differ(other.words[:, i], many) <= most[at]]
            if len(at):
                yield np.full(len(at), i), lo[i] + at


def candidates(sets: DataFrame, least: float) -> DataFrame:
    """scope, x < y: pairs of ids of sets (scope, id and what sketched gives), all near ones and few others."""
    spark = sets.sparkSession
    rows = sets.withColumn("at", F.explode(F.sequence("own", "top"))).withColumn("mine", F.col("at") == F.col("own"))
    numbers = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.exp((F.col("at") + 1) * _width(least)) / 64, F.lit(2.0))) - 1e-9))
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(ROWS)), F.floor(NUMBERS / numbers)))
    blocks = lambda mine: F.ceil(F.count(F.when(F.col("mine") == mine, 1)) / F.first(most)).cast("int")
    counts = rows.groupBy("scope", "at").agg(blocks(True).alias("own_blocks"), blocks(False).alias("other_blocks")).where("own_blocks > 0")
    rows = rows.join(counts, ["scope", "at"]).withColumn("b", F.pmod(F.xxhash64("id"), F.when(F.col("mine"), F.col("own_blocks")).otherwise(F.col("other_blocks"))).cast("int"))
    # A block of the class meets itself, those after it, and each block of smaller sets.
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    b = F.col("b")
    own = F.concat(
        F.transform(upto("own_blocks"), lambda j: place("own", F.least(b, j), F.greatest(b, j), F.when(b <= j, 0).otherwise(1))),
        F.transform(upto("other_blocks"), lambda j: place("other", b, j, F.lit(0))),
    )
    other = F.transform(upto("own_blocks"), lambda i: place("other", i, b, F.lit(1)))
    rows = rows.withColumn("place", F.explode(F.when(F.col("mine"), own).otherwise(other)))
    part = F.concat_ws("/", "place.kind", "place.i", "place.j", "at", F.col("scope").cast("string")).alias("part")
    dealt = rows.select(part, F.col("place.side").alias("side"), F.expr("place.kind = 'own' and place.i = place.j").alias("same"), "at", "scope", "id", "n", "prefix", "rest")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "side", "n")

    def given(scope: pa.Array, block: _Block, other: _Block, same: bool) -> Iterator[pa.RecordBatch]:
        held, found = 0, []

        def batch() -> pa.RecordBatch:
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([scope.take(pa.array(np.zeros(len(i), dtype=np.int64))), other.ids.take(pa.array(i)), block.ids.take(pa.array(j))], names=["scope", "a", "b"])

        for pair in _met(block, other, same, least):
            found.append(pair)
            held += len(pair[0])
            if held >= GIVEN:
                yield batch()
                held, found = 0, []
        if found:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            for piece in _runs(batch) if batch.num_rows else ():
                name, side, same = (piece.column(c)[0].as_py() for c in ("part", "side", "same"))
                if name != now:
                    yield from itself(parts, block)
                    now, parts, block = name, [], None
                if side == 0:
                    parts.append(piece)
                elif parts:
                    block = block or _Block(parts, numbers_of(piece))
                    yield from given(piece.column("scope").slice(0, 1), block, _Block([piece], numbers_of(piece)), False)
        yield from itself(parts, block)

    def numbers_of(piece: pa.RecordBatch) -> int:
        return int(_numbers(np.array([piece.column("at")[0].as_py()]), least)[0])

    def itself(parts: list[pa.RecordBatch], block: _Block | None) -> Iterator[pa.RecordBatch]:
        """The pairs within a block, where that is what the part is for."""
        if parts and parts[0].column("same")[0].as_py():
            block = _Block(parts, numbers_of(parts[0]))
            yield from given(parts[0].column("scope").slice(0, 1), block, block, True)

    kinds = {c: sets.schema[c].dataType.simpleString() for c in ("scope", "id")}
    met = dealt.mapInArrow(run, f"scope {kinds['scope']}, a {kinds['id']}, b {kinds['id']}")
    return met.select("scope", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
