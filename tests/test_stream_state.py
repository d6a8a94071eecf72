"""Streams that begin with a store, and views of what they keep, against the batch."""

import pytest

from mnemospark.operators import ledger, resume
from mnemospark.streaming import ledger as streaming

from .test_store_log import COMMANDS, sets, stream


def run_files(spark, tmp_path, parts, name, stored=None, settings=None):
    """Audit rows of a stream of these lists of commands, a file each, and its checkpoint."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    found = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    checkpoint = str(tmp_path / "checkpoint")
    query = streaming.audit(found, settings, stored).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name), checkpoint


@pytest.mark.parametrize("cap", [10000, 5])
def test_stream_begins_with_the_store(spark, tmp_path, cap):
    found, rules = stream(11, 260, users=4), ledger.Settings(memory_cap=cap)
    store = resume.open_store(spark, str(tmp_path / "store"), buckets=4)
    resume.advance(store, spark.createDataFrame(found[:130], COMMANDS), rules)
    stored = {t: store.read(t) for t in ("facts", "held", "conflicts")}
    got, checkpoint = run_files(spark, tmp_path, [found[130:200], found[200:]], f"resumed{cap}", stored, rules)
    whole = spark.createDataFrame(found, COMMANDS)
    want = ledger.run(whole, "audit", rules)
    assert sets(got) == sets(want.where("seq > 130"))
    for table in ("facts", "held", "conflicts"):
        last = ledger.run(whole, table, rules)
        assert sets(streaming.view(spark, checkpoint, table).select(last.columns)) == sets(last), table
    late = ledger.run(whole, "reviews", rules)
    before = store.read("reviews").select("user", "qid")
    assert sets(streaming.view(spark, checkpoint, "reviews").select(late.columns)) == sets(late.join(before, ["user", "qid"], "left_anti").select(late.columns))


def test_views_of_a_stream(spark, tmp_path):
    found = stream(12, 150, users=3)
    _, checkpoint = run_files(spark, tmp_path, [found[:60], found[60:]], "viewed")
    whole = spark.createDataFrame(found, COMMANDS)
    facts = ledger.run(whole, "facts")
    assert sets(streaming.view(spark, checkpoint, "live")) == sets(facts.where("tombstoned_by is null"))
    for table in ("held", "conflicts", "reviews"):
        want = ledger.run(whole, table)
        assert sets(streaming.view(spark, checkpoint, table).select(want.columns)) == sets(want), table
    from mnemospark.operators import lifecycle

    v = {t: streaming.view(spark, checkpoint, t) for t in ("facts", "held", "conflicts")}
    b = {t: ledger.run(whole, t) for t in v}
    assert sets(lifecycle.status(*v.values())) == sets(lifecycle.status(*b.values()))
