"""Rolling budgets of calls and characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import thresholds as th


def offered_load(df: DataFrame, scope: str = "user_id", ts: str = "ts", chars: str = "chars", seconds: int = th.WINDOW_SECONDS) -> DataFrame:
    """Adds calls and chars_used: what a scope asked for in the window that ends with each row."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(scope).orderBy("__at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("__at", micros).withColumns({"calls": F.count("*").over(w), "chars_used": F.sum(chars).over(w)}).drop("__at")


class Budget:
    """Admits calls while the window's budget lasts; a refused call uses nothing up."""

    def __init__(self, calls: int = th.CALLS_PER_WINDOW, chars: int = th.CHARS_PER_WINDOW, seconds: float = th.WINDOW_SECONDS, entries: list | None = None):
        self.calls, self.chars, self.seconds = calls, chars, seconds
        self.entries: list[tuple[float, int]] = list(entries or [])

    def _prune(self, now: float) -> None:
        self.entries = [(t, n) for t, n in self.entries if t > now - self.seconds]

    def remaining(self, now: float) -> tuple[int, int]:
        self._prune(now)
        return max(0, self.calls - len(self.entries)), max(0, self.chars - sum(n for _, n in self.entries))

    def check(self, now: float, chars: int) -> tuple[bool, int]:
        """Whether a call is admitted, and after how many seconds to try again."""
        self._prune(now)
        if len(self.entries) >= self.calls or sum(n for _, n in self.entries) + chars > self.chars:
            oldest = min((t for t, _ in self.entries), default=now)
            return False, max(1, int(self.seconds - (now - oldest)) + 1)
        self.entries.append((now, chars))
        return True, 0


def admitted_load(df: DataFrame, scope: str = "user_id", key: str = "event_id", ts: str = "ts", chars: str = "chars", whole: int = 100_000, **budget) -> DataFrame:
    """key, scope, admitted, retry_after: each scope's calls in the order of time and key against its own budget.

    What is admitted depends on what was before, so calls are folded in order; the state is one window's entries. After a
    pause of a window and more nothing of before counts, so what lies between such pauses can be folded by itself: where a scope
    has more than `whole` calls, scopes that have pauses are spread over tasks so (one budget for all is one scope). Pauses are
    found by the windows of time that have calls, which are few beside the calls.
    """
    window = int(budget.get("seconds", th.WINDOW_SECONDS) * 1_000_000)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    source = df.select(F.col(scope).cast("long").alias("scope"), F.col(key).cast("long").alias("key"), at.alias("at"), F.col(chars).cast("long").alias("chars"), F.floor(at / window).alias("span"))
    largest = source.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
    calls = _islands(source) if largest > whole else source.withColumn("island", F.lit(0).cast("long"))
    calls = calls.select("scope", "island", "key", "at", "chars")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, current = Budget(**budget), None
        for batch in batches:
            out = []
            for s, island, k, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, island) != current:
                    limit, current = Budget(**budget), (s, island)
                out.append((k, s, *limit.check(t / 1e6, n)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["key", "scope", "admitted", "retry_after"])

    shape = "key long, scope long, admitted boolean, retry_after long"
    if largest <= whole:
        return calls.repartition("scope").sortWithinPartitions("scope", "island", "at", "key").mapInArrow(fold, shape)
    # Many calls of one island are sorted by ranges, each in its task, and packed, so that the task which folds them orders packs.
    order = ["scope", "island", "at", "key"]
    packs = calls.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, "scope long, island long, at long, key long, calls binary")
    return packs.repartition("scope", "island").sortWithinPartitions(*order).mapInArrow(lambda batches: fold(_unpack(batches)), shape)


#: Calls of one pack, and what the columns of a pack are.
PACK = 10_000
_CALLS = pa.schema([("scope", pa.int64()), ("island", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("chars", pa.int64())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Calls in order, as packs of one island each that begin with its first call."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch[c].cast(pa.int64()) for c in _CALLS.names], schema=_CALLS)
        scope, island = batch["scope"].to_pylist(), batch["island"].to_pylist()
        first = 0
        for at in range(1, batch.num_rows + 1):
            if at < batch.num_rows and at - first < PACK and scope[at] == scope[first] and island[at] == island[first]:
                continue
            part = pa.concat_batches([batch.slice(first, at - first)])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _CALLS, options=options) as out:
                out.write_batch(part)
            row = [[scope[first]], [island[first]], [part["at"][0].as_py()], [part["key"][0].as_py()], [sink.getvalue().to_pybytes()]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, type=pa.int64()) for x in row[:4]), pa.array(row[4], type=pa.binary())], names=["scope", "island", "at", "key", "calls"])
            first = at


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch["calls"]:
            yield from pa.ipc.open_stream(blob.as_py())


def _islands(source: DataFrame) -> DataFrame:
    """Numbers what lies between a scope's pauses of a window and more."""
    busy = source.groupBy("scope", "span").agg(F.lit(1).alias("one"))
    before = Window.partitionBy("scope").orderBy("span")
    fresh = busy.withColumn("fresh", F.when(F.col("span") - F.lag("span").over(before) <= 1, 0).otherwise(1))
    islands = fresh.select(F.col("scope").alias("__scope"), F.col("span").alias("__span"), F.sum("fresh").over(before).alias("island"))
    return source.join(islands, F.col("scope").eqNullSafe(F.col("__scope")) & F.col("span").eqNullSafe(F.col("__span")))

