import pytest
from pyspark.sql import functions as F

from mnemospark import cli
from mnemospark.operators import evaluation
from mnemospark.sources import cases as generator
from mnemospark.sources import tables


@pytest.fixture(scope="module")
def cases(spark):
    return evaluation.split_cases(generator.generate(spark, 8)).cache()


def test_generated_cases_hold(cases):
    scored = evaluation.predict(cases)
    assert [r.asDict() for r in scored.where("not ok").select("id", "got", "expect").collect()] == []
    assert {(r.suite, r.split): r.n for r in evaluation.report(scored, "split").collect()}[("admit", "train")] == 16
    assert evaluation.floors(scored, {"admit": 32, "rerank": 9}).collect()[0].suite == "rerank"
    assert evaluation.crosscheck_distinct(cases).count() == 0
    assert tables.validate_cases(cases, "synthetic-rule").count() == 0


def test_tuning_sees_the_training_half_only(cases):
    admit = cases.where("suite = 'admit'")
    with pytest.raises(evaluation.CalibrationError):
        evaluation.calibrate_gate(admit)
    found = evaluation.calibrate_gate(admit.where("split = 'train'"))
    assert found["train_n"] == 16 and found["thresholds"]["admit.durable"] == 0.7
    conf = evaluation.calibrate_confidence(admit.where("split = 'train'"))
    assert conf["thresholds"] == {"admit.min_conf": 0.0} and conf["report"]["coverage"] == 1.0
    with pytest.raises(evaluation.CalibrationError):
        evaluation.calibrate_confidence(admit.limit(0))


def test_label_changes_need_an_entry(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, expect string")
    got = evaluation.label_changes(make([("a", "X"), ("b", "Y"), ("c", "Z")]), make([("a", "X"), ("b", "X"), ("d", "Q")]), spark.createDataFrame([("d",)], "id string"))
    assert sorted(r.id for r in got.collect()) == ["b", "c"]


def test_agreement_and_conjunctions(spark):
    rows = spark.createDataFrame([("admit", "S", "S", "S"), ("admit", "S", "D", "D"), ("importance", "1", "2", "1")], "gate string, stub string, live string, label string")
    assert evaluation.agreement_lines(rows) == ["admit      stub-vs-live 1/2 = 50.0%; live-vs-label 2/2 = 100.0%", "importance stub-vs-live 0/1 = 0.0%; live-vs-label 0/1 = 0.0%"]
    df = spark.createDataFrame([(i % 2 == 0, i % 4 < 2, i % 2 == 0 and i % 4 < 2, i < 8) for i in range(16)], "a boolean, b boolean, y boolean, train boolean")
    best = evaluation.feature_conjunctions(df, ["a", "b"], "y", "train").head()
    assert (best.c, best.n, best.rate) == ("a&b", 8, 1.0)


def test_cooldown(spark):
    rows = spark.createDataFrame([("j", t, s) for t, s in [(0, 200), (10, 429), (20, 200), (39, 200), (40, 200)]], "scope string, at long, status int")
    assert [r.blocked for r in evaluation.blocked_calls(rows).orderBy("at").collect()] == [False, False, True, True, False]
    assert evaluation.wait_message(130) == "rate limited; again in about 2 minute(s)" and evaluation.wait_message(0) == "rate limited"


def test_attacks_are_refused(spark):
    assert all(good for _, good in cli.redteam(spark))


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["run"], spark) == 0
    assert "rerank" in capsys.readouterr().out
    out = str(tmp_path / "r.json")
    assert cli.main(["calibrate", "--out", out], spark) == 0 and tables.read_registry(out, "general")["train_n"] > 0
    db = str(tmp_path / "db")
    store = tables.Store(spark, db)
    store.write("facts", spark.createDataFrame([(1, "u", "blue bicycle"), (2, "u", "red lamp")], "id long, user string, text string"))
    store.write("quarantine", spark.createDataFrame([(7, "green door", "r", "s", "u", 1), (8, "odd", "r", "s", "u", 1)], tables.SCHEMAS["quarantine"]))
    assert cli.main(["override", "--db", db, "--action", "retire", "--fact-id", "1"], spark) == 2
    assert cli.main(["override", "--db", db, "--action", "retire", "--fact-id", "1", "--target-id", "2"], spark) == 0
    assert store.read("facts").where("tombstoned_by = 2").head().tombstone_reason == "human-retire"
    assert cli.main(["override", "--db", db, "--action", "restore", "--fact-id", "1"], spark) == 0
    assert cli.main(["approve", "--db", db, "--qid", "7", "--reason", "fine"], spark) == 0
    assert cli.main(["deny", "--db", db, "--qid", "8", "--reason", "no"], spark) == 0
    assert cli.main(["deny", "--db", db, "--qid", "8", "--reason", "no"], spark) == 2
    assert sorted(r.text for r in store.read("facts").where(F.col("tombstoned_by").isNull()).collect()) == ["blue bicycle", "green door", "red lamp"]
    assert [r.decision for r in store.read("reviews").orderBy("id").collect()] == ["approve", "deny"]
    assert cli.main(["review", "--db", db], spark) == 0


def test_records_of_a_live_run(spark, tmp_path):
    import json

    from mnemospark.sources import records

    rows = spark.createDataFrame([("admit", "a1", "STORE", "STORE", "STORE"), ("admit", "a2", "DROP", None, "DROP"), ("importance", "i1", "5", "4", "5")], "gate string, id string, stub string, live string, label string")
    path = records.write_calibration(str(tmp_path / "sub" / "record.md"), rows, "plain", "some-model", "20260101-000000", total=9)
    lines = open(path, encoding="utf-8").read().splitlines()
    assert lines[0] == "# Calibration 20260101-000000 (plain, some-model)" and "Halted at the judge's limit after 3 of 9 cases; the numbers are partial." in lines
    assert lines[-6:] == ["## admit", "- a1 stub=STORE live=STORE label=STORE agree", "- a2 stub=DROP live=none label=DROP differ", "", "## importance", "- i1 stub=5 live=4 label=5 differ"]
    votes = records.write_votes(str(tmp_path / "votes.json"), rows, "some-model", "2026-01-01")
    assert json.loads((tmp_path / "votes.json").read_text()) == votes and votes["agreement"] == "1/3 = 33.3%" and votes["votes"] == {"a1": "STORE", "a2": None, "i1": "4"}
    assert records.vote_summary(rows.limit(0)).head().agreement == "0/0 = 0.0%"


def test_halves_of_cases_that_share_an_id_meet_every_result(spark):
    scored = spark.createDataFrame([("a", "admit", True), ("a", "admit", False), ("b", "admit", True), ("a", "rerank", True)], "id string, suite string, ok boolean")
    halves = spark.createDataFrame([("a", "admit", "train"), ("a", "admit", "train"), ("b", "admit", "test"), ("a", "rerank", "test")], "id string, suite string, split string")
    got = {(r.suite, r.split): (r.n, r.ok, r.fail) for r in evaluation.report_by_half(scored, halves).collect()}
    assert got == {("admit", "train"): (4, 2, 2), ("admit", "test"): (1, 1, 0), ("rerank", "test"): (1, 1, 0)}


def test_crosscheck_of_pairs_that_share_an_id_is_by_their_texts(spark):
    rows = [("x", "dedupe", "DISTINCT", t, t if t == "a" else "other") for t in "hgfedcba"]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id string, suite string, expect string, text string, candidate string").coalesce(1)
        assert [r.id for r in evaluation.crosscheck_distinct(df).collect()] == ["x"]  # the first of eight is the one that is equal
