"""SQLite files: round trips, older and foreign files, filters that SQLite answers, ranges of rowids, failed writes."""

import json
import math
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text
from mnemospark.operators.ledger import FACTS
from mnemospark.sources import sqlite

SCHEMA = "id long, small int, name string, part double, raw binary, flag boolean"


def made(n, seed=1):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.2 else v
    return [(i, maybe(rng.randint(-9, 9)), maybe(rng.choice(["", "a", "B", "é", "a\x00b", "A", "zz" * 50])), maybe(rng.random()), maybe(bytes([0, i % 256])), maybe(rng.random() < 0.5)) for i in range(n)]


def plain(rows):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows)


def test_round_trip_and_filters(spark, tmp_path):
    df = spark.createDataFrame(made(500), SCHEMA).repartition(3)
    path = str(tmp_path / "t")
    sqlite.write(df, path, "t", index=("name",))
    back = sqlite.read(spark, f"file:{path}", "t")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, plain(back.collect()))) == sorted(map(repr, plain(df.collect())))
    given = [
        [("name", "=", "a")], [("name", ">", "a")], [("name", "!=", "a")], [("name", "in", ["a", "", None])], [("name", "in", ["a\x00b", "é"])], [("name", "=", "a\x00b")], [("name", "=", None)], [("small", ">=", 3), ("small", "<", 7)],
        [("small", "is null")], [("name", "is not null"), ("id", "<=", 20)], [("id", "in", [*range(100, 2000), None])], [("id", "in", [])], [("flag", "is null"), ("part", "is not null")],
    ]
    for where in given:
        want = df
        for column, sign, *value in where:
            c = F.col(column)
            if sign == "in":
                want = want.where(c.isin(value[0]))
            elif sign.startswith("is"):
                want = want.where(f"{column} {sign}")
            else:
                want = want.where({"=": c == F.lit(value[0]), "!=": c != F.lit(value[0]), ">": c > F.lit(value[0]), ">=": c >= F.lit(value[0]), "<": c < F.lit(value[0]), "<=": c <= F.lit(value[0])}[sign])
        assert sorted(r.id for r in sqlite.read(spark, path, "t", where=where).collect()) == sorted(r.id for r in want.collect()), where
    narrow = sqlite.read(spark, path, "t", "name string, more long", [("name", "=", "a")])
    assert {tuple(r) for r in narrow.collect()} == {("a", None)}
    both = back.where("name = 'a'").unionByName(back.where("name = 'B'"))  # filters of the plan are Spark's
    assert both.count() == df.where("name in ('a', 'B')").count() and back.count() == 500
    for wrong in [("none", "=", 1)], [("part", ">", 0.5)], [("id", "=", "1")], [("id", "like", 1)]:
        with pytest.raises(Exception, match="no condition|takes whole numbers"):
            sqlite.read(spark, path, "t", where=wrong).collect()


def test_conditions_use_the_index(spark, tmp_path):
    path = str(tmp_path / "t")
    sqlite.write(spark.range(1000).selectExpr("id", "concat('u', id % 50) as user").coalesce(1), path, "facts", index=("user",))
    schema = spark.range(0).selectExpr("id", "'' as user").schema
    reader = sqlite.Reader(schema, {"path": path, "where": json.dumps([("user", "=", "u7")])})
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 20
    with sqlite3.connect(part.file) as db:
        plan = db.execute("explain query plan select id from facts where \"user\" collate binary = ?", ["u7"]).fetchall()
    assert "by_user" in str(plan)


def test_ranges_of_rowids(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).coalesce(1)
    sqlite.write(df, path, "t")
    back = sqlite.read(spark, path, "t", splitBytes=20_000)
    assert back.rdd.getNumPartitions() > 5 and back.count() == 3000 == back.distinct().count()
    sparse = str(tmp_path / "sparse.db")
    with sqlite3.connect(sparse) as db:
        db.execute("create table t (id integer primary key, v text)")
        db.executemany("insert into t values (?, ?)", [(i, "x" * 900) for i in (-(2**63), -5, 0, 7, 2**62, 2**63 - 1)])
        db.execute("create table w (id text primary key, v text) without rowid")
        db.executemany("insert into w values (?, ?)", [(str(i), "y" * 900) for i in range(9)])
    assert sorted(r.id for r in sqlite.read(spark, sparse, "t", splitBytes=1000).collect()) == [-(2**63), -5, 0, 7, 2**62, 2**63 - 1]
    assert sqlite.read(spark, sparse, "w", splitBytes=1000).count() == 9


def test_older_file_of_facts(spark, tmp_path):
    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("create table facts (id integer primary key, user varchar(20), text text, tombstoned_by int)")
        db.executemany("insert into facts values (?, ?, ?, ?)", [(1, "a", "one  Two", None), (2, None, "b", 1)])
    got = sqlite.read_facts(spark, path)
    assert got.schema.simpleString() == spark.createDataFrame([], FACTS).schema.simpleString()
    want = {r.id: r.h for r in spark.createDataFrame([(1, "one  Two"), (2, "b")], "id long, text string").select("id", text.content_hash(F.col("text")).alias("h")).collect()}
    assert {(r.id, r.user, r.text_hash, r.tombstoned_by, r.gate_action) for r in got.collect()} == {(1, "a", want[1], None, None), (2, "local", want[2], 1, None)}


def test_values_of_other_types(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute('create table "a ""b" (v, "n ""x" text collate nocase)')
        db.executemany('insert into "a ""b" values (?, ?)', [(5, "a"), ("5", "A"), (None, "b")])
    names = 'v string, `n "x` string'
    assert sorted(r[1] for r in sqlite.read(spark, path, 'a "b', names, [("v", "=", "5")]).collect()) == ["A", "a"]
    assert sqlite.read(spark, path, 'a "b', names, [('n "x', "=", "a")]).count() == 1
    with pytest.raises(Exception, match="no table"):
        sqlite.read(spark, path, "none", "v string").collect()


def test_writes_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    sqlite.write(spark.range(10).repartition(2), path, "t")
    broken = F.udf(lambda i: 1 // (i - 7), "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        sqlite.write(spark.range(10).repartition(4).select(broken("id").alias("id")), path, "t")
    assert sorted(r.id for r in sqlite.read(spark, path, "t").collect()) == list(range(10))
    open(f"{path}/part-dead.db", "w").close()  # of a task that was lost
    assert sqlite.read(spark, path, "t").count() == 10
    sqlite.write(spark.range(10, 12), path, "t", mode="append")
    assert sqlite.read(spark, path, "t").count() == 12
    sqlite.write(spark.range(3), path, "t")
    assert sqlite.read(spark, path, "t").count() == 3
    named = json.load(open(f"{path}/manifest.json"))["files"]
    assert sorted(os.listdir(path)) == sorted([*named, "manifest.json"])


def test_empty_and_unfit(spark, tmp_path):
    path = str(tmp_path / "t")
    sqlite.write(spark.createDataFrame([], "id long"), path, "t")
    assert sqlite.read(spark, path, "t").collect() == []
    sqlite.write(spark.createDataFrame([(math.nan,)], "d double"), path, "t")
    assert [r.d for r in sqlite.read(spark, path, "t").collect()] == [None]
    for unfit in ("current_timestamp() as t", "array(1) as a"):
        with pytest.raises(Exception, match="have no"):
            sqlite.write(spark.range(1).selectExpr(unfit), path, "t")
    with pytest.raises(ValueError, match="opened by path"):
        sqlite.local("hdfs://there/x")
