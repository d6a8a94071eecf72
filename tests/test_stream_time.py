"""Streams by event time over the events table, replayed in files: budgets, exact repeats and sessions against the batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import limits
from mnemospark.streaming import limits as stream_limits
from mnemospark.streaming import windows

SCHEMA = "event_id long, ts timestamp, user_id long, chars long, text string"
FAR = datetime.datetime(2100, 1, 1)


@pytest.fixture(scope="module")
def calls(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 7).alias("user_id"), F.length("props").cast("long").alias("chars"), F.concat(F.lit("  a  "), F.col("event_type"), F.lit(" ")).alias("text")).cache()


def replayed(spark, calls, tmp_path, parts=3, late=None):
    """A stream of the calls in files by time, each file's rows in any order, then one far in the future, twice, to pass the watermark."""
    bounds = [r[1] for r in calls.selectExpr(f"ntile({parts}) over (order by ts, event_id) as p", "ts").groupBy("p").agg(F.max("ts")).orderBy("p").collect()]
    low = None
    for i, high in enumerate(bounds):
        mine = calls.where((F.col("ts") <= F.lit(high)) if low is None else ((F.col("ts") > F.lit(low)) & (F.col("ts") <= F.lit(high))))
        mine.repartition(3, "event_id").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        low = high
    more = [[(-1, FAR, 0, 0, "end")], *([late] if late else []), [(-2, FAR + datetime.timedelta(days=9), 0, 0, "end")]]
    for i, rows in enumerate(more):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(parts + i)))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def results(spark, stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").start()
    try:
        query.processAllAvailable()
        progress = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    finally:
        query.stop()
    return spark.table(name), progress


@pytest.mark.parametrize("scope", ["user_id", "all"])
def test_budgets(spark, calls, tmp_path, scope):
    mine = calls.withColumn("all", F.lit(0).cast("long"))
    budget = {"calls": 3, "seconds": 1800} if scope == "all" else {"calls": 1, "seconds": 7200}
    want = limits.admitted_load(mine, scope=scope, **budget).select("key", "admitted", "retry_after").collect()
    stream = replayed(spark, calls, tmp_path, late=[(-3, datetime.datetime(2000, 1, 1), 1, 1, "late")]).withColumn("all", F.lit(0).cast("long"))
    got, _ = results(spark, stream_limits.admitted_load(stream, scope=scope, **budget), f"budget_{scope}", tmp_path)
    rows = {r.key: (r.admitted, r.retry_after) for r in got.where("key >= 0").collect()}
    assert rows == {r.key: (r.admitted, r.retry_after) for r in want} and len({a for a, _ in rows.values()}) == 2
    assert [tuple(r) for r in got.where("key = -3 and admitted").collect()] == []  # what comes after the watermark isn't admitted


@pytest.mark.parametrize("whole", [0, 100_000])
def test_budgets_of_large_and_small_scopes(spark, calls, whole):
    """Scopes folded as a whole and by what lies between pauses give the same."""
    from mnemospark.operators.limits import Budget

    got = {r.key: (r.admitted, r.retry_after) for r in limits.admitted_load(calls, whole=whole, calls=2, seconds=3600).collect()}
    book = {}
    for r in sorted(calls.collect(), key=lambda r: (r.ts, r.event_id)):
        b = book.setdefault(r.user_id, Budget(calls=2, seconds=3600))
        assert got.pop(r.event_id) == b.check(r.ts.replace(tzinfo=datetime.timezone.utc).timestamp(), r.chars)
    assert not got


def test_exact_repeats(spark, calls, tmp_path):
    """A key's first row of an hour and more stays; the state of old keys goes."""
    stream = windows.with_hash(replayed(spark, calls, tmp_path, parts=6))
    got, sizes = results(spark, windows.first_of_each(stream, ["user_id", "text_hash"], delay="1 hour"), "repeats", tmp_path)
    found = got.where("event_id >= 0").select("event_id", "user_id", "text_hash", "ts").collect()
    source = {r.event_id: r for r in windows.with_hash(calls).collect()}
    by = {}
    for r in found:
        assert source[r.event_id].text_hash == r.text_hash
        by.setdefault((r.user_id, r.text_hash), []).append(r.ts)
    assert set(by) == {(r.user_id, r.text_hash) for r in source.values()}
    # A row that is in time and further than the delay from all that stayed would have stayed, too.
    hour = datetime.timedelta(hours=1)
    for r in source.values():
        kept = by[r.user_id, r.text_hash]
        assert any(abs(t - r.ts) <= hour for t in kept) or len(kept) > 1
    assert max(sizes) > sizes[-1]
    once = windows.first_of_each(windows.with_hash(calls), ["user_id", "text_hash"])
    assert once.count() == len(by)


def test_sessions(spark, calls, tmp_path):
    batch = windows.sessions(calls, "user_id", F.sum("chars").alias("chars"), gap="10 minutes")
    stream = windows.sessions(replayed(spark, calls, tmp_path, parts=5), "user_id", F.sum("chars").alias("chars"), gap="10 minutes")
    got, sizes = results(spark, stream, "sessions", tmp_path)
    key = lambda df: sorted(map(tuple, df.where("began < timestamp '2099-01-01'").collect()))
    assert key(got) == key(batch) and len(key(got)) > 10 and max(sizes) > sizes[-1]
