"""Evaluation: precision and recall, threshold sweeps, percentiles by index, deterministic splits and samples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import thresholds as th
from ..sources.folders import own_folder


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def with_prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to rows of tp, fp, fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))


def prf(df: DataFrame, got: Column, expected: Column, *by: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of a predicted and an expected boolean."""
    return with_prf(df.groupBy(*by).agg(count_if(got & expected).alias("tp"), count_if(got & ~expected).alias("fp"), count_if(~got & expected).alias("fn")))


def _grid(df: DataFrame, values: tuple[float, ...], name: str) -> DataFrame:
    """df once for each value: expanded where the rows are read and summed there, so nothing but sums is shuffled."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def threshold_sweep(scored: DataFrame, grid: tuple[float, ...] = th.THRESHOLD_GRID) -> DataFrame:
    """A row for each threshold of (score, is_positive) rows."""
    at = _grid(scored.select("score", "is_positive"), grid, "threshold")
    return prf(at, F.col("score") >= F.col("threshold"), F.col("is_positive"), "threshold")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The highest f1, then the lowest threshold."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def conformal_sweep(scored: DataFrame, grid: tuple[float, ...] = th.CONFORMAL_GRID) -> DataFrame:
    """kept, abstained, coverage (1 if nothing is kept) and abstention at each cutoff of (confidence, is_correct) rows."""
    at = _grid(scored.select("confidence", "is_correct"), grid, "min_conf")
    kept = F.col("confidence") >= F.col("min_conf")
    out = at.groupBy("min_conf").agg(count_if(kept).alias("kept"), count_if(kept & F.col("is_correct")).alias("correct"), F.count("*").alias("n"))
    return out.select("min_conf", F.when(F.col("kept") == 0, 1.0).otherwise(F.col("correct") / F.nullif(F.col("kept"), F.lit(0))).alias("coverage"), ((F.col("n") - F.col("kept")) / F.col("n")).alias("abstention"), "kept", (F.col("n") - F.col("kept")).alias("abstained"), "n")


def best_cutoff(sweep: DataFrame, coverage: float = th.CONFORMAL_COVERAGE) -> DataFrame:
    """The lowest cutoff that meets the coverage, else the highest."""
    meets = F.col("coverage") >= coverage
    return sweep.orderBy(F.desc(meets), F.when(meets, F.col("min_conf")).otherwise(-F.col("min_conf"))).limit(1)


#: Parts that a range of values is cut into in one round of a percentile, and rows of a part that are sorted at last.
PARTS, LAST = 1024, 50_000


def percentile_by_index(df: DataFrame, value: str, quantiles: dict[str, float], *by: str) -> DataFrame:
    """The value at index min(n - 1, floor(q n)) of the sorted values of each group: n and a column for each quantile.

    No group is sorted. Each round counts a range of values in PARTS parts, map side first, and goes on with the values of the
    part that the index falls into, from their smallest to their largest, until these are one, or LAST rows at most, which are
    sorted. A round shuffles at most PARTS counts for each task, group and quantile; values spread evenly take one or two
    rounds. Null values don't count, NaN is the largest value, and null is a group of its own.
    """
    known = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col(value).alias("__v"))
    groups = [f"__g{i}" for i in range(len(by))]
    sizes = known.groupBy(*groups).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.col("__n") - 1, F.floor(F.col("__n") * F.lit(q))).cast("long").alias("at")) for name, q in quantiles.items()]))
    state = sizes.withColumn("__q", wanted).select(*groups, "__n", F.col("__n").alias("__c"), "__lo", "__hi", F.col("__q.name").alias("__name"), F.col("__q.at").alias("__at"))
    names = [*groups, "__n", "__name"]
    done = []
    while True:
        state, few = _settled(state)
        done.append(state.where("__lo = __hi"))
        open_ = state.where("__lo != __hi")
        if open_.isEmpty():
            break
        ranges = F.broadcast(open_) if few else open_
        same = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
        for g in groups:
            same = same & F.col(f"k.{g}").eqNullSafe(F.col(f"r.{g}"))
        inner = known.alias("k").join(ranges.alias("r"), same).select(*[F.col(f"r.{g}") for g in groups], "__n", "__c", "__lo", "__hi", "__name", "__at", "__v")
        if open_.agg(F.max("__c")).first()[0] <= LAST:
            place = F.element_at(F.array_sort(F.collect_list("__v")), (F.col("__at") + 1).cast("int"))
            done.append(inner.groupBy(*names, "__at").agg(place.alias("__lo")).select(*groups, "__n", F.lit(None).cast("long").alias("__c"), "__lo", F.col("__lo").alias("__hi"), "__name", "__at"))
            break
        share = (F.col("__v") - F.col("__lo")).cast("double") / (F.col("__hi") - F.col("__lo")).cast("double")
        part = F.when(F.col("__v") == F.col("__hi"), PARTS).otherwise(F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * PARTS), F.lit(PARTS - 1)))
        met = inner.select(*names, "__at", "__v", part.cast("int").alias("__part"))
        parts = met.groupBy(*names, "__at", "__part").agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        upto = F.sum("__c").over(Window.partitionBy(*names).orderBy("__part"))
        inside = (F.col("__at") >= F.col("__upto") - F.col("__c")) & (F.col("__at") < F.col("__upto"))
        state = parts.withColumn("__upto", upto).where(inside).select(*groups, "__n", "__c", "__lo", "__hi", "__name", (F.col("__at") - F.col("__upto") + F.col("__c")).alias("__at"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    picks = [F.max(F.when(F.col("__name") == name, F.col("__lo"))).alias(name) for name in quantiles]
    return found.groupBy(*groups, "__n").agg(*picks).select(*[F.col(g).alias(c) for g, c in zip(groups, by, strict=True)], F.col("__n").alias("n"), *quantiles)


#: Ranges that are kept on the driver between two rounds; more of them are written.
FEW = 10_000


def _settled(df: DataFrame) -> tuple[DataFrame, bool]:
    """df computed, and whether it has FEW rows at most."""
    rows = df.limit(FEW + 1).collect()
    if len(rows) <= FEW:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    path = own_folder(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), False


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType) and value is not None:
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind, strict=True)])
    return F.lit(value).cast(kind)


def _cut_slice(keyed: DataFrame) -> Column:
    """The slice of __k, from 0: how many cut points aren't above it. Null is in the first slice, as it comes first.

    Cut points are keys of a random sample, four slices for each shuffle partition and CUTS at most, so slices are even however
    keys are spelled; places don't depend on which keys were drawn. Rows of one key share a slice.
    """
    kind = keyed.schema["__k"].dataType
    slices = min(CUTS, 4 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = keyed.select("__k").where("__k is not null").orderBy(F.rand(7)).limit(8 * slices).distinct().orderBy("__k").collect()
    cuts = [_literal(r[0], kind) for r in drawn[:: max(1, len(drawn) // slices)]]
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    upto = lambda c: c <= F.col("__k")
    coarse = cuts[step - 1 :: step]
    block = F.coalesce(F.size(F.filter(F.array(*coarse), upto)), F.lit(0))
    return block * step + F.size(F.filter(F.slice(F.array(*cuts), block * step + 1, F.lit(step)), upto))


#: Cut points of a ranking at most.
CUTS = 4096
#: Values of a whole number in one slice of a ranking.
SLICE = 10_000


def numbered(df: DataFrame, order: Column, *by: str) -> DataFrame:
    """Adds __r, a row's place from 0 in its group in order, and __n, the rows of the group.

    No task ranks a whole group: rows are ranked within slices of the order (whole numbers, and structs that begin with one, by SLICE,
    all others by cut points), and slices are counted before they are added up.
    """
    keyed = df.withColumn("__k", order)
    kind, first = keyed.schema["__k"].dataType, F.col("__k")
    while isinstance(kind, T.StructType):
        kind, first = kind[0].dataType, first.getField(kind[0].name)
    part = F.floor(first / SLICE).cast("string") if isinstance(kind, T.IntegralType) else _cut_slice(keyed)
    sliced = keyed.withColumn("__s", part)
    place = F.floor(first / SLICE) if isinstance(kind, T.IntegralType) else F.col("__s")
    counts = sliced.groupBy(*by, "__s").agg(F.count("*").alias("__c"), F.min(place).alias("__o"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__c").over(group.orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [*by, "__s"]
    known = counts.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(names)], before.alias("__before"), F.sum("__c").over(group).alias("__n"))
    within = sliced.withColumn("__w", F.row_number().over(Window.partitionBy(*by, "__s").orderBy("__k")) - 1)
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return within.join(known, same).withColumn("__r", F.col("__before") + F.col("__w")).select(*df.columns, "__r", "__n")


def split(df: DataFrame, key: Column, *strata: str) -> DataFrame:
    """Adds split: of each stratum in the order of key, the first half (rounded down) is train, the rest test."""
    return numbered(df, key, *strata).withColumn("split", F.when(F.col("__r") < F.floor(F.col("__n") / 2), "train").otherwise("test")).drop("__r", "__n")


def every(df: DataFrame, step: int, order: str, *by: str) -> DataFrame:
    """Each step-th row of a group, from the first."""
    return numbered(df, F.col(order), *by).where(F.col("__r") % step == 0).drop("__r", "__n")


def sample_evenly(df: DataFrame, k: int, order: str, *by: str) -> DataFrame:
    """At most k rows of each group, evenly spaced in order: step max(1, n div k), the first k of those.

    That gives min(n, k) rows, as there are at least k steps of n div k in n: none is left to be filled up with others.
    """
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / k))
    return numbered(df, F.col(order), *by).where((F.col("__r") % step == 0) & (F.col("__r") / step < k)).drop("__r", "__n")


def train_hash(df: DataFrame, content: str = "text") -> DataFrame:
    """One row: the hash of the sorted hashes of all texts, joined by commas, and their number.

    Equal texts are counted where they are read; one task sorts the distinct hashes, on disk where memory doesn't do, and streams
    them through one hash, as their order is what is hashed.
    """

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n, begun = hashlib.sha256(), 0, False
        for batch in batches:
            for h, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n += many
                if h is not None:  # a null text is counted, and has no hash
                    for _ in range(many):
                        whole.update(f",{h}".encode() if begun else h.encode())
                        begun = True
        yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest()]), pa.array([n], pa.int64())], names=["train_hash", "train_n"])

    hashes = df.groupBy(F.sha2(F.col(content), 256).alias("h")).agg(F.count("*").alias("n"))
    return hashes.repartition(1).sortWithinPartitions(F.col("h").asc_nulls_last()).mapInArrow(streamed, "train_hash string, train_n long")


def fingerprint(task: str) -> str:
    return hashlib.sha256(task.encode()).hexdigest()


def agreement(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Share of rows where a and b are equal."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), count_if(F.col(a).eqNullSafe(F.col(b))).alias("equal")).withColumn("rate", ratio(F.col("equal"), F.col("n")))


def majority(df: DataFrame, label: str, *by: str) -> DataFrame:
    """The most frequent label of each group, ties to the smaller."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("__n"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("l"))).alias("b")).select(*by, F.col("b.l").alias("majority"), (-F.col("b.n")).alias("n"))
