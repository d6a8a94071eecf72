"""Language identification by n-gram filters whose cells hold one bit for each language.

One Bloom filter serves all languages: a cell is a bitmask of languages, an n-gram sets its language's bit in each of
its cells, and the AND of an n-gram's cells is the set of languages that contain it. A text's n-grams give a count of
hits for each language; with f the part of all n-grams that a language answers to by chance (the product of its fill
in each cell), hits - f * n over 1 - f is the corrected count. The largest decides, ties by the language's name.

The filter is learned from a bounded sample of labelled rows: for each language the `rows_per_language` rows of the
smallest hash of their id, whole texts; of their n-grams the `grams_per_language` found in most rows, ties by the
n-gram's hash. An n-gram of a single row counts too, at every size, so a language of one row is learned like any
other. Prediction reads the text alone, from end to end.

Texts are lower-cased, and each run of anything but letters counts as one space. Texts that are null or have no letter
are `und` with score 0; so is everything if nothing was learned. The score is the lead of the best language over the
second, as a part of the text's n-grams, from 0 to 1. Rows are kept as they come.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

U64 = np.uint64
SIZES = (3, 4, 5)
PROBES = 3
_GAP = re.compile(r"[\W\d_]+")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of a text, and the size of each; none if it has no letter."""
    flat = _GAP.sub(" ", text.lower()).strip()
    if not flat:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    codes = np.frombuffer(f" {flat} ".encode("utf-32-le"), dtype="<u4")
    prefix = common.prefix_hash(codes)
    found = [common.span_hash(prefix, at := np.arange(max(0, len(codes) - n + 1)), at + n) for n in SIZES]
    return np.concatenate(found), np.repeat(SIZES, [len(x) for x in found])


class Filter:
    """The learned filter: names of the languages, cells of masks, and each language's chance of a false hit."""

    def __init__(self, names: list[str], learned: list[tuple[int, int]], bits: int):
        self.names, self.bits = names, bits
        self.words = max(1, -(-len(names) // 64))
        kind = np.uint8 if len(names) <= 8 else np.uint64
        self.cells = np.zeros((1 << bits, self.words), dtype=kind)
        hashes, languages = (np.array([x[i] for x in learned], dtype=t) for i, t in ((0, np.int64), (1, np.int64)))
        for cell in self.probes(hashes.view(np.uint64)):
            for k in range(len(names)):
                self.cells[cell[languages == k], k // 64] |= kind(1 << k % 64)
        fill = np.array([np.count_nonzero(self.cells[:, k // 64] & kind(1 << k % 64)) for k in range(len(names))]) / (1 << bits)
        self.chance = fill**PROBES

    def probes(self, hashes: np.ndarray) -> list[np.ndarray]:
        step = common.mix(hashes) | U64(1)
        return [((hashes + U64(i) * step) >> U64(64 - self.bits)).astype(np.int64) for i in range(PROBES)]

    def predict(self, text: str | None) -> tuple[str, float]:
        hashes, _ = grams(text or "")
        if not len(hashes) or not self.names:
            return "und", 0.0
        first, *rest = self.probes(hashes)
        masks = self.cells[first]
        for cell in rest:
            masks &= self.cells[cell]
        hits = np.array([np.count_nonzero(masks[:, k // 64] & masks.dtype.type(1 << k % 64)) for k in range(len(self.names))])
        counts = np.clip((hits - self.chance * len(hashes)) / (1 - self.chance + 1e-12), 0, len(hashes))
        order = np.argsort(-counts, kind="stable")
        lead = counts[order[0]] - (counts[order[1]] if len(order) > 1 else 0)
        return self.names[order[0]], float(min(1.0, max(0.0, lead / len(hashes))))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = 400, grams_per_language: int = 60_000, bits: int = 21, languages: int = 512) -> Filter:
    """The filter from rows with a label; what comes to the driver is bounded by the last three parameters."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # Slices first, so that a language with most rows isn't ranked by one task.
    ids = rows.select("id", "lang", F.xxhash64("id").alias("h"))
    for by in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))).where(F.col("n") <= rows_per_language)
    ids = ids.select("id", "lang").distinct()
    names = sorted(r[0] for r in ids.select("lang").distinct().limit(languages + 1).collect())
    if len(names) > languages:
        raise ValueError(f"more than {languages} languages")
    number = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.settle(batches):
            by_language: dict[int, list[np.ndarray]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by_language.setdefault(number[name], []).append(np.unique(grams(value.as_py())[0]))
            for k, found in by_language.items():
                hashes, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k)), pa.array(hashes.view(np.int64)), pa.array(n)], names=["k", "gram", "n"])

    # At most rows_per_language ids of each language: small enough to broadcast.
    sample = rows.join(F.broadcast(ids), ["id", "lang"], "left_semi").select("lang", "text")
    counted = sample.mapInArrow(count, "k long, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("k").orderBy(F.desc("n"), "gram")
    kept = counted.withColumn("r", F.row_number().over(top)).where(F.col("r") <= grams_per_language)
    return Filter(names, [(r.gram, r.k) for r in kept.select("gram", "k").toLocalIterator()], bits)


def predict(df: DataFrame, fitted: Filter, text: str = "text") -> DataFrame:
    """Adds lang_pred and score; columns of df with those names are replaced."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    source = df.select(*kept, df[text].alias("__text"))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    common.text_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(fitted)  # 2^bits cells, whatever the size of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in common.settle(batches):
            found = [f.predict(v.as_py()) for v in batch.column(len(kept))]
            arrays = [pa.array([x[0] for x in found], type=pa.string()), pa.array([x[1] for x in found], type=pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=[*kept, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def lettered(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df whose text has a letter: those that a filter which has learned a language doesn't call `und`."""
    common.text_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.settle(batches):
            yield batch.filter(pa.array([bool(_GAP.sub("", v.as_py() or "")) for v in batch.column(at)], type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", **learning) -> DataFrame:
    """Learns from the rows of df that have a label and aren't held out, and predicts all of them; adds held_out too."""
    fitted = learn(df.where(~F.coalesce(held_out(key), F.lit(False))), text, lang, key, **learning)
    return predict(df.withColumn("held_out", F.coalesce(held_out(key), F.lit(False))), fitted, text)
