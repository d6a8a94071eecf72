"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Each shingle of five words is hashed once; the top bits of the hash name its bin and each bin keeps its smallest hash.
A mark above every hash of its bin is sorted in with the hashes, so the first entry of each bin's run is its smallest
hash, or the mark of an empty bin. Empty bins are filled by optimal densification: each tries bins by a universal hash
of its own number and the attempt and copies the first that is full (after PROBES attempts, the full bin of the
smallest hash with its number, which is as even a choice). The low-order four bits of each bin are packed, sixteen bins
to a long. Two fingerprints that agree in m of k bins are alike by (m/k - 1/16) / (1 - 1/16), clipped to 0 and 1:
bins that agree by chance are corrected for.

A text of one to four words has one shingle, all its words. A text without words (null and empty ones too) has no
shingles and the fingerprint of zeros; it is alike by 1 to another such text and by 0 to any other. Words are what
stands between spaces and the characters 9 to 13. Equal texts have equal fingerprints; repeated rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SHINGLE = 5
BIN_BITS = 8
BITS = 4
PROBES = 12
#: Ranges of the key at most; beyond them ranges grow, and are ordered by Spark's sort, which spills.
RANGES = 1 << 14
BINS = 1 << BIN_BITS
_REST = 63 - BIN_BITS
_GAP = "[\\x20\\x09-\\x0D]+"


def _sorted() -> Column:
    """The hashes of the shingles of __words and each bin's mark, ascending."""
    hashes = f"""
        transform(sequence(0, greatest(size(__words) - {SHINGLE}, 0)),
                  i -> shiftrightunsigned(xxhash64({", ".join(f"get(__words, i + {j})" for j in range(SHINGLE))}), 1))"""
    marks = f"transform(sequence(0, {BINS - 1}), b -> shiftleft(cast(b as bigint), {_REST}) | {(1 << _REST) - 1}L)"
    hashes = f"sort_array(concat(if(size(__words) = 0, cast(array() as array<bigint>), {hashes}), {marks}))"
    return F.expr(hashes)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the packed fingerprint (array of longs, null if there are no shingles) of a text column."""
    full = f"(x & {(1 << _REST) - 1}L) != {(1 << _REST) - 1}L"
    low = (1 << BITS) - 1
    per_long = 64 // BITS
    kept = df.columns
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), _GAP), lambda w: w != "")
    one = df.withColumn("__words", words).withColumn("__all", _sorted()).drop("__words")
    one = one.withColumn("__bins", F.expr(f"filter(__all, (x, i) -> i = 0 or shiftright(x, {_REST}) != shiftright(get(__all, i - 1), {_REST}))")).drop("__all")
    two = one.withColumn("__full", F.expr(f"filter(__bins, x -> {full})"))
    filled = f"""
        transform(__bins, (x, b) -> cast(({low}L & if({full}, x, coalesce(
            get(__bins, get(filter(transform(sequence(1, {PROBES}), t -> (hash(b, t) & {BINS - 1})), j -> (get(__bins, j) & {(1 << _REST) - 1}L) != {(1 << _REST) - 1}L), 0)),
            array_min(transform(__full, y -> named_struct('h', hash(b, shiftright(y, {_REST}), 'late'), 'y', y))).y))) as bigint))"""
    three = two.withColumn("__low", F.when(F.size("__full") > 0, F.expr(filled))).drop("__bins", "__full")
    packed = f"transform(sequence(0, {BINS // per_long - 1}), k -> aggregate(slice(__low, k * {per_long} + 1, {per_long}), 0L, (a, x) -> shiftleft(a, {BITS}) | x))"
    return three.withColumn(out, F.when(F.col("__low").isNotNull(), F.expr(packed))).select(*[c for c in kept if c != out], out)


def as_text(fingerprint: str) -> Column:
    """Lowercase hex, one digit for each bin."""
    return F.coalesce(F.expr(f"array_join(transform({fingerprint}, x -> lower(lpad(hex(x), {64 // 4}, '0'))), '')"), F.lit("0" * (BINS * BITS // 4)))


def likeness(a: str, b: str) -> Column:
    """The Jaccard similarity of the shingles of two texts, from their fingerprints."""
    spread = "x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)"
    differ = f"aggregate(zip_with({a}, {b}, (p, q) -> p ^ q), 0, (n, x) -> n + bit_count(({spread}) & {0x1111111111111111}L))"
    chance = 1 / (1 << BITS)
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(1.0) - F.expr(differ) / BINS - chance) / (1 - chance)))
    none_a, none_b = F.col(a).isNull(), F.col(b).isNull()
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(near)


def with_next(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Adds next_<column>: that of the row that follows in ascending order of the key; the first row's, after the last.

    Rows are dealt by ranges of the key, as many as the size of the tables below asks for, and each range gets a copy of
    the next range's first row, so no task orders them all; what comes to the driver is one key for each range, of which
    there are RANGES at most. Repeated keys are ordered by the columns.
    """
    ranges = min(RANGES, common.buckets(df.sparkSession, 2, df))
    step = max(1, int(ranges**0.5))
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], min(20 * ranges, 10 * RANGES))).head()[0] or []
    cuts = sorted(set(cuts))
    if cuts:
        fine, coarse = F.array(*map(F.lit, cuts)), F.array(*map(F.lit, cuts[step - 1 :: step]))
        block = F.size(F.filter(coarse, lambda c: c <= F.col(key)))
        dealt = df.withColumn("__block", F.coalesce(block, F.lit(0)))
        within = F.slice(fine, F.col("__block") * step + 1, F.lit(step))
        dealt = dealt.withColumn("__range", F.col("__block") * step + F.coalesce(F.size(F.filter(within, lambda c: c <= F.col(key))), F.lit(0))).drop("__block")
    else:
        dealt = df.withColumn("__range", F.lit(0))
    firsts = sorted((r[0], r[1]) for r in dealt.groupBy("__range").agg(F.min(key)).collect() if r[1] is not None)
    before = {first[1]: firsts[i - 1][0] for i, first in enumerate(firsts)}
    marked = dealt.withColumn("__copy", F.lit(0))
    if before:
        table = df.sparkSession.createDataFrame(list(before.items()), "__key long, __into int")  # a row for each range
        copies = df.join(F.broadcast(table), df[key] == F.col("__key")).withColumn("__range", F.col("__into")).withColumn("__copy", F.lit(1)).drop("__key", "__into")
        marked = marked.unionByName(copies)
    order = Window.partitionBy("__task", "__range").orderBy("__copy", F.col(key).asc_nulls_first(), *columns)
    # Neighbouring ranges share a task, as many as its share of the input asks for: no hash heaps them up.
    found = len(cuts) + 1
    tasks = min(found, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), common.input_bytes(df) // (4 * common.BUCKET_BYTES)))
    dealt = marked.withColumn("__task", F.floor(F.col("__range") * F.lit(tasks) / F.lit(found)).cast("int")).repartitionById(tasks, F.col("__task"))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(F.col("__copy") == 0).drop("__task", "__range", "__copy")


def compare_edits(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edit, whose second half is the beginning of the next document."""
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = with_next(with_fingerprint(docs, "text", "fp"), "doc_id", "text", "fp").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))).drop("text", "next_text")
    edited = edited.withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    done = with_fingerprint(edited, "edited", "edited_fp")
    return done.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
