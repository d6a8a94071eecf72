"""Best-fit packing of tokenized documents into sequences of fixed length, planned over lengths.

Each document is tokenized, ended with an end id, and cut into pieces of the capacity if it is longer (its first
piece takes the remainder). How many pieces there are of each length is a table of at most `capacity` rows, however
many documents there are, so the plan is made on the driver over lengths with multiplicities:

* pieces above one third of the capacity go at most two to a sequence; the largest is matched greedily with the
  largest partner that fits beside it;
* smaller pieces, longest first, go to the tightest gap that holds them, and to new sequences when none does.

A plan row says: so many sequences with the same lengths at the same offsets. Pieces find their place by their rank
among the pieces of their length. Ranks are made from counts by (length, slice), a slice being a hash of the piece, so
that one length with most of the pieces is ranked by many tasks.

Null texts count as empty ones: a single piece with the end id alone. Every row is packed, repeated ones too; an
empty table gives an empty result. Clashing columns of the input aren't carried along.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

CAPACITY = 1024
END_ID = 2


# --- Tokens ---------------------------------------------------------------------------------------------------------

_LIVE: dict = {}


class Tokens:
    """Ids of whole texts by a byte-level BPE vocabulary file of the tokenizers library.

    A vocabulary whose ids follow its merges is handed to tiktoken, which gives the same ids at a multiple of the
    speed and as an array; the first texts of each worker are compared with the tokenizers library.
    """

    CHECKED = 20

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.left = self.CHECKED
        self.fast = None
        model = (whole := json.loads(spec))["model"]
        pre = whole["pre_tokenizer"] or {}
        letters = self._letters()
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not whole["normalizer"]:
            merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            ranks = {bytes(letters[c] for c in p): i for p, i in model["vocab"].items() if all(c in letters for c in p)}
            ordered = [model["vocab"]["".join(m)] for m in merges]
            special = {t["content"]: t["id"] for t in whole["added_tokens"]}
            ranks = {p: i for p, i in ranks.items() if i not in special.values()}
            if ordered == sorted(ordered) and all(ranks.get(bytes([b]), 1 << 30) < ordered[0] for b in range(256)):
                import public_tokenizers

                self.fast = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    def _letters() -> dict[str, int]:
        """The printable letter of each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        out = self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        if self.left:
            self.left -= 1
            if self.library.encode(text, add_special_tokens=False).ids != out.tolist():
                raise RuntimeError("the ids differ from those of the tokenizers library")
        return out


def tokens(spec: str) -> Tokens:
    if spec not in _LIVE:
        _LIVE.clear()
        _LIVE[spec] = Tokens(spec)
    return _LIVE[spec]


def pieces(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, and with_ids its ids (little-endian 32-bit)."""
    common.text_batches(df.sparkSession)
    with open(tokenizer_path) as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't grow with the data
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(spec.value)
        for batch in common.settle(batches):
            rows, blobs = [], []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.append(t.ids(value.as_py() or ""), np.uint32(end_id)).astype("<u4").tobytes()
                n = len(data) // 4
                first = (n % capacity or capacity) if n > capacity else n
                for i, start in enumerate([0, *range(first, n, capacity)]):
                    part = data[4 * start : 4 * (start + capacity if i else first)]
                    rows.append((k, i, start, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        blobs.append(part)
            arrays = [pa.array(c, type=pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, list(zip(*rows, strict=True)) or [[]] * 5, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(blobs, type=pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return df.select(df[key].cast("long"), df[text]).mapInArrow(run, schema)


# --- The plan -------------------------------------------------------------------------------------------------------


class _Gaps:
    """Groups of like sequences by the room left in them."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(self, gap: int, lengths: tuple[int, ...], n: int) -> None:
        if n:
            if gap not in self.groups:
                bisect.insort(self.sizes, gap)
                self.groups[gap] = []
            self.groups[gap].append((lengths, n))

    def tightest(self, least: int) -> tuple[int, tuple[int, ...], int] | None:
        at = bisect.bisect_left(self.sizes, least)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        lengths, n = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap], self.sizes[at]
        return gap, lengths, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, sequences like it), from how many pieces there are of each length."""
    left = {k: n for k, n in counts.items() if n}
    gaps = _Gaps()
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        size = large[-1]
        at = bisect.bisect_right(large, capacity - size) - 1  # the largest partner that fits
        if at < 0:
            gaps.add(capacity - size, (size,), left.pop(size))
            large.pop()
            continue
        partner = large[at]
        n = left[size] // 2 if partner == size else min(left[size], left[partner])
        if n:
            gaps.add(capacity - size - partner, (size, partner), n)
        for k in (size, partner):
            left[k] -= n
        if partner == size and left[size]:  # one is over
            left[size] = 0
            if at := bisect.bisect_left(large, size):
                partner = large[at - 1]
                gaps.add(capacity - size - partner, (size, partner), 1)
                left[partner] -= 1
            else:
                gaps.add(capacity - size, (size,), 1)
        large = [k for k in large if left.get(k)]
    done = []
    for size in sorted((k for k in left if 3 * k <= capacity and left[k]), reverse=True):
        n = left[size]
        while n:
            found = gaps.tightest(size)
            gap, lengths, like = found or (capacity, (), n)
            each = gap // size
            full = min(like, n // each)
            gaps_left = like - full if found else 0
            if full:
                gaps.add(gap - each * size, lengths + (size,) * each, full)
                n -= full * each
            if n and n < each and (gaps_left or not found):
                gaps.add(gap - n * size, lengths + (size,) * n, 1)
                gaps_left, n = gaps_left - 1, 0
            if gaps_left > 0:
                gaps.add(gap, lengths, gaps_left)
    for groups in gaps.groups.values():
        done += groups
    return sorted(done, reverse=True)


def _places(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces of it in a sequence, first sequence, its offset there)."""
    out, taken, sequence = [], Counter(), 0
    for lengths, n in planned:
        offset = 0
        for size, each in sorted(Counter(lengths).items(), reverse=True):
            out.append((size, taken[size], taken[size] + each * n, each, sequence, offset))
            taken[size] += each * n
            offset += each * size
        sequence += n
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, length); its rows must not change when read again."""
    spark = cut.sparkSession
    slices = common.buckets(spark)
    cut = cut.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)))
    sliced = cut.groupBy("length", "__slice").agg(F.count("*").alias("__n"))
    # At most capacity * slices rows; the driver sees one row for each length.
    by_slice = Window.partitionBy("length").orderBy("__slice")
    first = sliced.withColumn("__first", F.sum("__n").over(by_slice) - F.col("__n")).drop("__n")
    counts = {r[0]: r[1] for r in sliced.groupBy("length").agg(F.sum("__n")).collect()}
    places = _places(plan(counts, capacity))
    table = spark.createDataFrame(places or [(0, 0, 0, 1, 0, 0)], "length long, __from long, __to long, __each long, __sequence long, __offset long")
    within = Window.partitionBy("length", "__slice").orderBy("doc_id", "piece")
    ranked = cut.withColumn("__row", F.row_number().over(within) - 1).join(first, ["length", "__slice"]).withColumn("__rank", F.col("__row") + F.col("__first"))
    at = F.col("__rank") - F.col("__from")
    # The table of places has a few rows for each length, at most some thousands in all.
    return (
        ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
        .withColumns({"sequence_id": F.col("__sequence") + F.floor(at / F.col("__each")), "offset": F.col("__offset") + at % F.col("__each") * ranked["length"]})
        .drop(table["length"])
        .select(*[c for c in cut.columns if c != "__slice"], "sequence_id", "offset")
    )


def pack_documents(df: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset of every piece of every document."""
    return pack(common.materialize(pieces(df, tokenizer_path, text, key, capacity, with_ids=with_ids), "pieces"), capacity)
