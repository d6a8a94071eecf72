"""Token sets of two tables compared within a scope, block by block.

Rows of a scope are dealt by the hash of their id into blocks, and each block of the one side meets each block of the other in
a task: the first is indexed by token there, and rows of the second stream past it and count what they share with all of the
first at once. So a task holds one block of bounded size, nothing is made for a pair but its count, and what a pair isn't asked
for isn't written. Sets are compared by their tokens, not by hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of an indexed block, and rows of one that streams past it.
TOKENS, ROWS = 1 << 20, 4096
#: Rows of a batch that a task gives.
GIVEN = 1 << 15

#: Which rows of an indexed block, in the order of their ids, a row of the other side is given: from their scores (NaN: null) and sizes.
Chooser = Callable[[np.ndarray, np.ndarray], np.ndarray]


def at_least(gate: float) -> Chooser:
    return lambda score, _: np.flatnonzero(score >= gate)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, best first and then by place."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return at[np.argsort(-score[at], kind="stable")][:k]
    return np.argsort(-score, kind="stable")


def top(gate: float, band: float, cap: int) -> Chooser:
    """At or above the gate and within the band below the block's best, at most cap: all that can be so among more blocks."""

    def choose(score: np.ndarray, _: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(score >= gate)
        if len(at):
            at = at[score[at] >= score[at].max() * (1 - band)]
        return at[_best(score[at], cap)]

    return choose


def within(budget: int) -> Chooser:
    """Best first while their sizes fit into the budget: all that can fit among more blocks. Null scores come last."""

    def choose(score: np.ndarray, size: np.ndarray) -> np.ndarray:
        most = int(np.searchsorted(np.cumsum(np.sort(size)), budget, side="right"))
        at = _best(np.where(np.isnan(score), -1.0, score), max(most, 1))
        return at[np.cumsum(size[at]) <= budget]

    return choose


class _Index:
    """A block's rows by token."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.rows = rows
        tokens = rows["tokens"].combine_chunks() if rows["tokens"].num_chunks != 1 else rows["tokens"].chunk(0)
        self.n = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.null = pc.is_null(tokens).to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        self.words = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.owners = np.repeat(np.arange(len(self.n)), self.n)[np.argsort(codes, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(self.words)))))
        self.size = rows["size"].fill_null(0).to_numpy().astype(np.int64)

    def scores(self, tokens: pa.ListArray) -> Iterator[np.ndarray]:
        """Of each row of tokens, its similarity to every row of the block; NaN where either is null."""
        found = pc.index_in(tokens.flatten(), self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(tokens).to_pylist()
        at = 0
        for n in sizes:
            if n is None:
                yield np.full(len(self.n), np.nan)
                continue
            hit = found[at : at + n]
            at += n
            hits = [self.owners[self.starts[c] : self.starts[c + 1]] for c in hit if c >= 0]
            both = np.bincount(np.concatenate(hits), minlength=len(self.n)) if hits else np.zeros(len(self.n), dtype=np.int64)
            either = n + self.n - both
            score = np.where(either == 0, 1.0, both / np.maximum(either, 1))
            score[self.null] = np.nan
            yield score


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where the part or the side changes."""
    part, side = batch.column(0), batch.column(1)
    differs = pc.or_(pc.not_equal(part[1:], part[:-1]), pc.not_equal(side[1:], side[:-1])).to_numpy(zero_copy_only=False) if len(part) > 1 else np.zeros(0, dtype=bool)
    cuts = [0, *(np.flatnonzero(differs) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def compare(asked: DataFrame, found: DataFrame, scope: str, choose: Chooser | None = None, with_text: bool = True) -> DataFrame:
    """query_id, id, (text,) score of the pairs that are chosen, or of all.

    asked: scope, query_id, tokens. found: scope, id, tokens, and text and size (of a text in the budget) as far as they are needed.
    """
    spark = asked.sparkSession
    key = F.col(scope).cast("string")
    q = asked.where(F.col(scope).isNotNull()).select(key.alias("scope"), "query_id", "tokens")
    f = found.where(F.col(scope).isNotNull()).select(key.alias("scope"), "id", "tokens", (F.col("text") if with_text else F.lit(None)).cast("string").alias("text"), (F.col("size") if "size" in found.columns else F.lit(0)).cast("long").alias("size"))
    count = lambda df, name, total, most: df.groupBy("scope").agg(F.greatest(F.lit(1), F.ceil(total / F.lit(most))).cast("int").alias(name))
    blocks = count(f, "f_blocks", F.sum(F.coalesce(F.size("tokens"), F.lit(0)) + 1), TOKENS).join(count(q, "q_blocks", F.count("*"), ROWS), "scope")
    dealt: Callable[[str, str], Column] = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every: Callable[[str], Column] = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = F.concat_ws("/", "qb", "fb", "scope").alias("part")
    q = q.join(blocks, "scope").withColumn("qb", dealt("query_id", "q_blocks")).withColumn("fb", every("f_blocks"))
    f = f.join(blocks, "scope").withColumn("fb", dealt("id", "f_blocks")).withColumn("qb", every("q_blocks"))
    left = f.select(part, F.lit(0).alias("side"), "id", "tokens", "text", "size")
    right = q.select(part, F.lit(1).alias("side"), "query_id", "tokens")
    met = left.unionByName(right, allowMissingColumns=True).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "side", "id")
    kinds = {"query_id": asked.schema["query_id"].dataType.simpleString(), "id": found.schema["id"].dataType.simpleString(), **({"text": "string"} if with_text else {}), "score": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, facts, index = None, [], None
        for batch in batches:
            for piece in _runs(batch) if batch.num_rows else ():
                name, side = piece.column(0)[0].as_py(), piece.column(1)[0].as_py()
                if name != now:
                    now, facts, index = name, [], None
                if side == 0:
                    facts.append(piece)
                    continue
                if not facts and index is None:
                    continue
                if index is None:
                    index, facts = _Index(facts), []
                yield from _given(index, piece)

    def _given(index: _Index, piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, whose, which, scores, held = piece.column("query_id"), [], [], [], 0
        names = ["id", *(["text"] if with_text else [])]

        def batch() -> pa.RecordBatch:
            rows = index.rows.select(names).take(pa.array(np.concatenate(which))).combine_chunks()
            score = np.concatenate(scores)
            out = [ids.take(pa.array(np.concatenate(whose))), *(rows[n].chunk(0) for n in names), pa.array(score, mask=np.isnan(score))]
            return pa.RecordBatch.from_arrays(out, names=["query_id", *names, "score"])

        every_row = np.arange(len(index.n))
        for i, score in enumerate(index.scores(piece.column("tokens"))):
            at = choose(score, index.size) if choose else every_row
            if not len(at):
                continue
            whose.append(np.full(len(at), i))
            which.append(at)
            scores.append(score[at])
            held += len(at)
            if held >= GIVEN:
                yield batch()
                whose, which, scores, held = [], [], [], 0
        if held:
            yield batch()

    return met.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in kinds.items()))
