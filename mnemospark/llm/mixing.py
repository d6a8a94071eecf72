"""Documents drawn so that each source comes near its target weight: targets by water-filling, draws by the cube method.

Sizes are numbers of words. Sources in the order of their code points, null last, weigh 3, 1, 2, 3, 1, 2 and so on, and share
`share` times the words of all; a target stops at `most` times its source's words, and what is over is shared again by weight among the
others, until none is above. A source that is to give r times its words takes every document floor(r) times and draws
each with the chance r - floor(r) once more.

The draw is balanced: in each source, the words and the number of documents drawn are what the chances add up to. Chances move
along vectors that change neither sum (the null space of the two constraints) until they reach 0 or 1: the largest
undecided document moves, and all smaller ones make up for it. That is done in blocks of a source, `BLOCK` places each; the few that
a block can't decide, its smallest, meet those of `MERGE` other blocks in the next round, until one block is left. What remains there is
the landing problem: of all ways to decide the last two or three the one nearest to the words is taken, and two documents of that
block, one drawn and one not, change places as long as that comes nearer to them (a single one changes if that does better).

No document's chance to be drawn is changed by a move (up and down are drawn in proportion), but by the landing it is a little. None
is taken more than `most` times. Draws depend on the seed, the source's place and the block, blocks on places in the order of (doc_id, size): not on how
rows were dealt to tasks, so another run, or one that loses executors, gives the same rows.

* A null text has size 0, and so has one of spaces; a document of size 0 takes 0 words, whether it is drawn or not.
* A source without words has target 0 and takes nothing. Null sources are one source, the last.
* Rows with one doc_id are documents of their own; of equal rows one may be drawn and another not. A null doc_id comes first.
* An empty table gives no rows. Columns beside doc_id, source and text are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ranks, shingles

#: Weights of sources, again and again in their order.
WEIGHTS = (3, 1, 2)
#: Places of a source that are decided together, and blocks whose undecided documents are.
BLOCK, MERGE = 1024, 256
#: Bytes of texts looked at together.
CHUNK = 4 << 20
GAP = np.zeros(256, dtype=bool)
GAP[[9, 10, 11, 12, 13, 32]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """How many runs of bytes other than 9 to 13 and 32 each text has; 0 for null."""
    plain = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2] or b"", dtype=np.uint8)
    out = np.zeros(len(plain), dtype=np.int64)
    for a, b in shingles.groups_of(np.diff(offsets).tolist(), CHUNK):
        at = offsets[a : b + 1] - offsets[a]
        gap = GAP[data[offsets[a] : offsets[b]]]
        begins = ~gap
        begins[1:] &= gap[:-1]
        first = at[:-1][np.diff(at) > 0]
        begins[first] = ~gap[first]
        upto = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
        out[a:b] = np.diff(upto[at])
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.settle(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(word_counts(batch.column("text")))], ["doc_id", "source", "size"])


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """sources (gid, source, source_size) with place, their rank by code point, and target.

    What goes to the driver are sums: of capped sizes and of the others' weights, once for each time that the excess is shared again.
    """
    ordered = ranks.placed(sources.withColumnRenamed("gid", "of"), [], [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    known = common.materialize(ordered.select(F.col("of").alias("gid"), "source_size", F.col("at").alias("place"), weight.cast("double").alias("weight")), "weights")
    total, weights, n = known.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    goal, level, above = share * (total or 0), 0.0, -1
    if total:
        level = goal / weights
        while True:
            over = F.col("weight") * level > most * F.col("source_size")
            capped, left, count = known.agg(F.sum(F.when(over, most * F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(over.cast("int"))).first()
            if count in (above, n):
                break
            above, level = count, (goal - capped) / left
    return known.withColumn("target", F.least((most * F.col("source_size")).cast("double"), F.col("weight") * level)).drop("weight")


def flight(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances moved until no vector is left that keeps the sums of chance and size * chance; sizes descend.

    The first undecided document goes up or down by one unit, all later ones by a + b * size, the smallest such vector; if the later
    ones are all of one size, which can't make up for it, it waits.
    """
    pi = chance.copy()
    first = 0
    while first < len(pi):
        if not 0.0 < pi[first] < 1.0:
            first += 1
            continue
        rest = np.flatnonzero((pi[first + 1 :] > 0.0) & (pi[first + 1 :] < 1.0)) + first + 1
        if not len(rest):
            break
        sizes = size[rest]
        off = sizes - sizes.mean()
        spread = float(off @ off)
        gap = float(size[first] - sizes.mean())
        if sizes[0] == sizes[-1]:
            if gap:
                first += 1
                continue
            u = np.full(len(rest), -1.0 / len(rest))
        else:
            u = -1.0 / len(rest) - gap / spread * off
        at = np.concatenate(([first], rest))
        u = np.concatenate(([1.0], u))
        p = pi[at]
        moves = np.abs(u) > 1e-12
        at, u, p = at[moves], u[moves], p[moves]
        up, down = np.where(u > 0, (1.0 - p) / np.abs(u), p / np.abs(u)), np.where(u > 0, p / np.abs(u), (1.0 - p) / np.abs(u))
        rise, fall = up.min(), down.min()
        ends, step = (up, rise) if rng.random() * (rise + fall) < fall else (down, -fall)
        moved = p + step * u
        bound = ends <= abs(step) * (1 + 1e-12)
        moved[bound] = np.round(moved[bound])
        moved[moved < 1e-12] = 0.0
        moved[moved > 1 - 1e-12] = 1.0
        pi[at] = moved
    return pi


def landing(size: np.ndarray, chance: np.ndarray, wanted: float) -> np.ndarray:
    """All decided: the last few go to the nearest of all ways in words, then documents change places while that comes nearer to wanted."""
    pi = chance.copy()
    few = np.flatnonzero((pi > 0.0) & (pi < 1.0))  # flight() leaves two or three
    if len(few):
        rest = wanted - float(size @ pi) + float(size[few] @ pi[few])
        count = float(chance[few].sum())
        pi[few] = min(product((0.0, 1.0), repeat=len(few)), key=lambda x: (abs(float(size[few] @ x) - rest), abs(sum(x) - count), x))
    pi = _nearer(size, pi, wanted)
    if len(size) and abs(float(size @ pi) - wanted) > size[-1]:
        # Moves of two got stuck, as one document outweighs many: once without and once with it, filled up from the largest down.
        starts = []
        for first in (0.0, 1.0):
            x, room = np.zeros(len(size)), wanted - first * size[0]
            x[0] = first
            for i in range(1, len(size)):
                if room >= size[i] / 2:
                    x[i], room = 1.0, room - size[i]
            starts.append(_nearer(size, x, wanted))
        pi = min([pi, *starts], key=lambda x: abs(float(size @ x) - wanted))
    return pi


def _nearer(size: np.ndarray, pi: np.ndarray, wanted: float) -> np.ndarray:
    """Documents change, two at a time or one, while the words come nearer to wanted."""
    pi = pi.copy()
    while True:
        over = float(size @ pi) - wanted
        inside, outside = np.flatnonzero(pi == 1.0), np.flatnonzero(pi == 0.0)
        single = [(abs(over - size[i]), (int(i),)) for i in inside] + [(abs(over + size[i]), (int(i),)) for i in outside]
        left, changed = min([_swap(size, inside, outside, over), *single], key=lambda x: (x[0], len(x[1]) != 2), default=(abs(over), ()))
        if left >= abs(over) - 1e-6:
            return pi
        pi[list(changed)] = 1.0 - pi[list(changed)]


def _swap(size: np.ndarray, inside: np.ndarray, outside: np.ndarray, over: float) -> tuple[float, tuple]:
    """The two places, one drawn and one not, whose change brings `over` nearest to 0, and what is left of it."""
    if not len(inside) or not len(outside):
        return abs(over), ()
    ranked = outside[np.argsort(size[outside], kind="stable")]
    at = np.searchsorted(size[ranked], size[inside] - over)
    found = []
    for near in (np.clip(at, 0, len(ranked) - 1), np.clip(at - 1, 0, len(ranked) - 1)):
        left = np.abs(over - size[inside] + size[ranked[near]])
        k = int(left.argmin())
        found.append((float(left[k]), (int(inside[k]), int(ranked[near[k]]))))
    return min(found)


def decide(state: DataFrame, span: int, seed: int) -> DataFrame:
    """The undecided rows of state after one round in blocks of `span` places of their source."""

    def block(key: tuple, table: pa.Table) -> pa.Table:
        size, at = table.column("size").to_numpy(), table.column("at").to_numpy()
        order = np.lexsort((at, -size))
        rng = np.random.default_rng([seed, span, key[1].as_py(), key[2].as_py()])
        chance = table.column("chance").to_numpy()[order]
        size = size[order].astype(float)
        pi = flight(size, chance, rng)
        if table.column("n")[0].as_py() <= span:  # this block is all of its source that is open
            pi = landing(size, pi, float(size @ chance))
        back = np.empty(len(order))
        back[order] = pi
        return table.set_column(table.column_names.index("chance"), "chance", pa.array(back))

    open_rows = state.where("chance > 0 and chance < 1")
    return open_rows.groupBy("gid", "place", F.floor(F.col("at") / span).alias("block")).applyInArrow(block, open_rows.schema)


def mix(docs: DataFrame, share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for each document."""
    common.text_batches(docs.sparkSession)
    sizes = docs.select("doc_id", "source", "text").mapInArrow(_sizes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source {docs.schema['source'].dataType.simpleString()}, size long")
    rows = ranks.placed(common.materialize(sizes, "sizes"), ["source"], [F.col("doc_id").asc_nulls_first(), F.col("size").asc()], "placed")
    sources = rows.groupBy("gid", "source").agg(F.sum("size").alias("source_size"))
    known = targets(common.materialize(sources, "totals"), share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = rows.join(known, "gid").withColumn("whole", F.floor(rate)).withColumn("chance", rate - F.floor(rate))
    state = common.materialize(state, "chances")
    longest = state.agg(F.max("n")).first()[0] or 0
    out, span = state.where("chance <= 0"), BLOCK
    while True:
        state = common.materialize(decide(state, span, seed), "decided")
        out = out.unionByName(state.where("chance <= 0 or chance >= 1"))
        if span >= longest:
            break
        span *= MERGE
    copies = (F.col("whole") + F.when(F.col("chance") >= 1, 1).otherwise(0)).cast("int")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
