"""The store with a log of commits, and folds that go on from it: two writers, crashes at each step, touched buckets only."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import ledger, resume
from mnemospark.sources.log import Log, Refused

TABLES = {"notes": "id long, user string, text string", "marks": "n long, user string, by string"}


def rows(spark, found, schema="id long, user string, text string, gone boolean"):
    return spark.createDataFrame(found, schema)


def state(store, version=None, table="notes"):
    return sorted(map(tuple, store.read(table, version).collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return Log(spark, str(tmp_path / "store"), TABLES, buckets=8)


def test_commits(spark, store):
    assert store.version() == -1 and state(store) == [] and state(store, table="marks") == []
    assert store.commit({"notes": rows(spark, [(1, "a", "x", False), (2, "a", "y", None), (1, "b", "z", False)])}, -1) == 0
    more = rows(spark, [(2, "a", "Y", False), (1, "b", None, True), (9, "c", None, False)])
    assert store.commit({"notes": more, "marks": spark.createDataFrame([(0, "a", "me")], TABLES["marks"])}, 0) == 1
    now = [(1, "a", "x"), (2, "a", "Y"), (9, "c", None)]
    assert state(store) == now and state(store, 0) == [(1, "a", "x"), (1, "b", "z"), (2, "a", "y")] and state(store, table="marks") == [(0, "a", "me")]
    assert store.compact() == 2 and state(store) == now and state(store, 1) == now and len(store.entries()) == 1
    assert store.commit({"notes": rows(spark, [(1, "b", "back", False)])}, 2) == 3 and (1, "b", "back") in state(store)
    assert store.expire() == 3 and store.versions() == [2, 3] and len(state(store)) == 4 and state(store, table="marks") == [(0, "a", "me")]


def test_random_commits(spark, store):
    rng, want = random.Random(3), {}
    for v in range(6):
        change = {}
        for _ in range(25):
            change[rng.randrange(12), rng.choice("abcd")] = None if rng.random() < 0.3 else rng.choice(["x", "y", None, ""])
        gone = {k for k in change if rng.random() < 0.3}
        store.commit({"notes": rows(spark, [(*k, t, k in gone) for k, t in change.items()])}, v - 1 if v < 4 else store.version())
        want = {k: t for k, t in {**want, **change}.items() if k not in gone}
        if v == 3:
            store.compact()
        assert state(store) == sorted(((*k, t) for k, t in want.items()), key=repr)


def test_two_writers(spark, store):
    other = Log(spark, store.path, TABLES, buckets=8)
    assert store.version() == other.version() == -1
    store.commit({"notes": rows(spark, [(1, "a", "first", False)])}, -1)
    with pytest.raises(Refused):
        other.commit({"notes": rows(spark, [(1, "a", "second", False)])}, -1)
    # The same, where the other's entry appears after this writer looked.
    seen = other.version
    other.version = lambda: -1
    with pytest.raises(Refused):
        other.commit({"notes": rows(spark, [(1, "a", "second", False)])}, -1)
    other.version = seen
    assert state(store) == state(other) == [(1, "a", "first")] and store.expire() == 0


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["_written", "_publish", "rename"])
def test_crashes_leave_the_table(spark, store, step, monkeypatch):
    store.commit({"notes": rows(spark, [(1, "a", "x", False)])}, -1)
    broken = Log(spark, store.path, TABLES, buckets=8)
    whole = getattr(broken, step, None)

    def crash(*args):
        if step == "_written" and args[0] == "notes":
            return whole(*args)  # the second table isn't written any more
        raise Crash

    monkeypatch.setattr(broken, {"rename": "_spark_array"}.get(step, step), crash)
    with pytest.raises(Crash):
        broken.commit({"notes": rows(spark, [(1, "a", "never", False)]), "marks": spark.createDataFrame([(0, "a", "me")], TABLES["marks"])}, 0)
    assert state(store) == [(1, "a", "x")] and store.version() == 0
    assert store.commit({"notes": rows(spark, [(2, "a", "y", False)])}, 0) == 1 and state(store) == [(1, "a", "x"), (2, "a", "y")]
    assert store.expire(keep=2) == (1 if step == "_written" else 2) and len(state(store)) == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_bucket_is_read(spark, store):
    store.commit({"notes": rows(spark, [(i, f"u{i % 20}", f"t{i}", False) for i in range(200)])}, -1)
    store.commit({"notes": rows(spark, [(7, "u7", "new", False)])}, 0)
    shown, got = plan(store.get("notes", "u7", 7)), store.get("notes", "u7", 7)
    assert [tuple(r) for r in got.collect()] == [(7, "u7", "new")] and store.get("notes", "u8", 7).collect() == []
    assert shown.count("PartitionFilters: [isnotnull(bucket") == 2 and "EqualTo(id,7)" in shown and "EqualTo(user,u7)" in shown
    files = got.inputFiles()
    assert files and len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 8


# --- folds that go on ------------------------------------------------------------------------------------------------


def stream(seed, n, users=6):
    """Commands of all kinds, which refer to earlier ones of their user."""
    rng, out, made = random.Random(seed), [], {}
    for seq in range(1, n + 1):
        u = f"u{rng.randrange(users)}"
        p, h = rng.choice(["red fox", "blue owl", "grey cat"]), rng.randrange(3)
        text = rng.choice([f"the {p} slot is at {h}am", f"the {p} slot moved to {h}am", f"the {p} no longer meets at {h}am", f"the {p} slot is at {h}am now", f"the {p} deadline is not friday", f"{p} {h}", ""])
        op = rng.choices(["admit", "put", "supersede", "quarantine", "approve", "deny", "release", "restore", "tombstone", "mark_conflict", "retire", "odd"], [30, 20, 5, 6, 4, 3, 2, 5, 4, 4, 2, 1])[0]
        earlier = made.setdefault(u, [0])
        out.append((u, seq, op, text, "s", rng.choice(["STORE", "STORE", "QUARANTINE", "DROP"]), 3, "j", rng.choice(["why", None]), rng.choice(earlier), rng.choice(earlier)))
        earlier.append(seq)
    return out


COMMANDS = "user string, seq long, op string, text string, source string, gate_action string, importance int, judge string, reason string, target_id long, other_id long"


def sets(df):
    return sorted((repr(sorted(r.asDict().items())) for r in df.collect()))


@pytest.mark.parametrize("cap", [10000, 4])
def test_fold_goes_on_from_the_store(spark, tmp_path, cap):
    found, rules = stream(5, 400), ledger.Settings(memory_cap=cap)
    whole = spark.createDataFrame(found, COMMANDS)
    store = resume.open_store(spark, str(tmp_path / "store"), buckets=4)
    audit = []
    for a, b in ((0, 100), (100, 120), (120, 300), (300, 400)):
        audit += sets(resume.advance(store, spark.createDataFrame(found[a:b], COMMANDS), rules))
        if a == 120:
            store.compact()
    assert sorted(audit) == sets(ledger.run(whole, "audit", rules))
    for table in ("facts", "held", "conflicts", "reviews"):
        want = ledger.run(whole, table, rules)
        assert sets(store.read(table).select(want.columns)) == sets(want), table


def test_fold_reads_touched_buckets_only(spark, tmp_path):
    store = resume.open_store(spark, str(tmp_path / "store"), buckets=16)
    resume.advance(store, spark.createDataFrame(stream(6, 200, users=12), COMMANDS))
    before = state(store, table="facts")
    few = ledger.commands(spark.createDataFrame([("u3", 900, "put", "a new thing", "s", None, None, None, None, None, None), ("u3", None, "put", "x", "s", None, None, None, None, None, None)], COMMANDS))
    past = resume.stored(store, few, store.version())
    assert len({f.split("bucket=")[1].split("/")[0] for f in past["facts"].where("user = 'u3'").inputFiles()}) >= 1
    shown = plan(past["facts"])
    assert "PartitionFilters: [bucket" in shown or "PartitionFilters: [isnotnull(bucket" in shown
    assert {r.user for r in past["facts"].select("user").distinct().collect()} < {r[1] for r in before}
    audit = resume.advance(store, few)
    assert sorted((r.seq is None, r.outcome) for r in audit.collect()) == [(False, "insert"), (True, "error")]
    after = state(store, table="facts")
    assert [r for r in after if r[1] != "u3"] == [r for r in before if r[1] != "u3"] and len(after) == len(before) + 1
    entry = store.entries()[-1][1]
    assert spark.read.parquet(f"{store.path}/facts/{entry['tables']['facts']}").count() <= 3  # what changed


def test_refused_fold_leaves_the_store(spark, tmp_path):
    store = resume.open_store(spark, str(tmp_path / "store"), buckets=4)
    resume.advance(store, spark.createDataFrame(stream(7, 40), COMMANDS))
    slow = resume.open_store(spark, store.path, buckets=4)
    at = slow.version()
    more = spark.createDataFrame([("u1", 500, "put", "one more", "s", None, None, None, None, None, None)], COMMANDS)
    resume.advance(store, more)
    slow.version = lambda: at
    with pytest.raises(Refused):
        resume.advance(slow, more)
    assert store.version() == at + 1 and store.read("facts").where(F.col("id") == 500).count() == 1
