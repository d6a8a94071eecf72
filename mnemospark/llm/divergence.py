"""How sources of one language differ: smoothed shares of terms, a divergence for each pair, the terms that stand out.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; null text, lang and source count as ''. A
language keeps the terms that at least `least` of its documents have (V of them). With a term's count in a group (a source of
a language, or the language) and N, the counts' sum over kept terms, p = 1 + floor(10^9 (count + 2) / (N + 2V)); two
shares p and q differ by f = floor((p - q)^2 / (p + q)). All of that is in whole numbers.

1. tally: each task counts the terms of its documents, by group, in a table of bounded size that it writes whenever
   it is full. Texts are read once.
2. sketch: a count-min sketch of document frequencies. Each language's term has a cell in each of `depth` rows; the tasks'
   counts are added up cell by cell. A cell never has less than any term that falls into it, so a term with a cell below
   `least` can't be kept. What goes to all tasks is one bit for each cell, depth * width / 8 bytes at most (8 MiB as given),
   however many terms there are. With more terms than cells it discards less, and the result is the same.
3. Only the terms that are left are shuffled, and counted exactly.
4. Pairs: where both sources have a term, their counts are joined on it; where one of them has, only how often each share comes
   matters; where none has, one number. That is the sum over all kept terms without a row for each.

Documents without terms, or without text, make a group all the same. A document's terms count once in the document frequency
and as often as they come in the counts; repeated rows are documents of their own. A long text is cut between terms
into pieces, which are counted as one document. An empty table gives no rows; columns beside the three aren't read. Doc ids
aren't read either. Equal values are ranked by item, in the order of its bytes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: What each byte of a text becomes: ASCII letters in lower case, bytes beyond ASCII as they are, all others a space.
FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Terms that one task holds before it writes its counts.
HELD = 600_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Positions in one bitmap of Spark's bitmap functions.
BITS = 32_768
SCALE = 1_000_000_000


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    first = 0
    while first < len(text):
        last = len(text)
        if last - first > PIECE:
            last = first + PIECE
            while last < len(text) and FOLD[text[last]] != 32:
                last += 1
        yield text[first:last].translate(FOLD).split()
        first = last


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def written() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            terms, having = list(found), docs[lang, source]
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(part)), pa.repeat(pa.scalar(source), len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([found[t] for t in part], pa.int64()), pa.array([having[t] for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        counts.clear()
        docs.clear()

    held = 0
    for batch in common.settle(batches):
        texts = batch.column("text").cast(pa.binary())
        for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
            here, seen = counts[group], set()
            before = len(here)
            for terms in pieces(texts[k].as_py()):
                here.update(terms)
                seen.update(terms)
            docs[group].update(seen)
            held += len(here) - before
            if held > HELD:
                yield from written()
                held = 0
    yield from written()


def tally(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: what each task counted; a term may have several rows."""
    common.text_batches(docs.sparkSession)
    return docs.mapInArrow(_tally, "lang string, source string, term string, n long, docs long")


def cells(depth: int, width: int) -> list[Column]:
    """The term's cell in each row of the sketch, numbered through all rows."""
    return [F.pmod(F.xxhash64(F.lit(r), "lang", "term"), F.lit(width)) + r * width for r in range(depth)]


def sketch(counted: DataFrame, least: int, depth: int, width: int) -> np.ndarray:
    """A bit for each cell of the merged count-min sketch: whether it has `least` documents. On the driver, depth * width / 8 bytes."""
    sums = counted.select(F.explode(F.array(*cells(depth, width))).alias("cell"), "docs").groupBy("cell").agg(F.sum("docs").alias("docs"))
    full = sums.where(F.col("docs") >= least).withColumn("cell", F.col("cell") + 1)  # Spark's buckets start at 1
    maps = full.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    out = np.zeros(depth * width // 8, dtype=np.uint8)
    for r in maps.toLocalIterator():
        at = (r.bucket - 1) * (BITS // 8)
        out[at : at + BITS // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def possible(counted: DataFrame, least: int, depth: int = 2, width: int = 1 << 25) -> DataFrame:
    """The rows whose term may be in `least` documents of its language: none that is in as many is missing."""
    spark = counted.sparkSession
    width = max(BITS, min(width, 1 << max(1, common.input_bytes(counted) // 4).bit_length()))
    bits = spark.sparkContext.broadcast(sketch(counted, least, depth, width))

    @F.pandas_udf("boolean")
    def enough(*at: pd.Series) -> pd.Series:
        out = np.ones(len(at[0]), dtype=bool)
        for a in at:
            a = a.to_numpy()
            out &= (bits.value[a >> 3] >> (a & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return counted.where(enough(*cells(depth, width)))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count: 1 + floor(SCALE (count + 2) / (total + 2 terms)), exact. 0 without terms, where it isn't used."""
    scaled = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(terms == 0, F.lit(0).cast("long")).otherwise(F.floor(F.call_function("div", scaled, (total + 2 * terms).cast("decimal(19,0)"))) + 1)


def apart(p: Column, q: Column) -> Column:
    """f of two shares: at most 10^18 before the division, so a long holds it."""
    return F.when(p + q == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", (p - q) * (p - q), p + q))


def audit(docs: DataFrame, least: int = 10, top: int = 10, depth: int = 2, width: int = 1 << 25) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to each other source of the language (`pair`)
    and the `top` terms that it has more of than its language (`term`)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    counted = common.materialize(tally(docs), "tally")
    exact = possible(counted, least, depth, width).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    exact = common.materialize(exact, "counts")
    terms = common.materialize(exact.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least).drop("docs"), "terms")
    kept = exact.drop("docs").join(terms, ["lang", "term"])

    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = common.materialize(groups.withColumn("none", share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "none", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("v")).alias("q"))
    shares = common.materialize(shares, "shares")

    best = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).unionByName(pairs(shares, groups).withColumn("rank", F.row_number().over(order)))


def pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value: f summed over all kept terms, for both orders of each two sources of a language."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("none2"))
    two = F.col("source") != F.col("other")
    without = groups.join(other, "lang").where(two).select("lang", "source", "other", (F.col("v") * apart(F.col("none"), F.col("none2"))).alias("value"))
    # What a term adds that only one of the two has, for both orders; where both have it, `both` takes that back.
    often = shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("m"))
    more = F.col("m") * (apart(F.col("p"), F.col("none2")) - apart(F.col("none"), F.col("none2")))
    one = often.join(other, "lang").where(two).groupBy("lang", "source", "other").agg(F.sum(more).alias("value"))
    right = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("p2"), F.col("none").alias("none2"))
    p, a, q, b = (F.col(c) for c in ("p", "none", "p2", "none2"))
    add = apart(p, q) - apart(p, b) - apart(a, q) + apart(a, b)
    both = shares.join(right, ["lang", "term"]).where(F.col("source") < F.col("other")).groupBy("lang", "source", "other").agg(F.sum(add).alias("value"))
    turned = lambda x: x.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    parts = without.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
    return parts.groupBy("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item")).agg(F.sum("value").alias("value"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT d.lang, d.source, coalesce(t.n, 0) AS n, l.v FROM docs d LEFT JOIN totals t ON d.lang = t.lang AND d.source = t.source LEFT JOIN langs l ON d.lang = l.lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v) AS BIGINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM shares WHERE count > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) WHERE part = 'pair' OR rank <= 10
"""
