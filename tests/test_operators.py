import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text
from mnemospark.operators import contamination, ledger, lifecycle, limits, metrics, recall, similarity
from mnemospark.sources import tables


def texts(spark, rows, schema="doc_id long, lang string, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.85, 1.0])
def test_prefix_join_is_the_brute_join(spark, least):
    rng = random.Random(4)
    rows = [(i, rng.choice(["x", "y"]), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for i in range(120)]
    df = texts(spark, rows)
    want = sorted(map(tuple, similarity.near_pairs(df, least).collect()))
    assert want and sorted(map(tuple, similarity.near_pairs_prefix(df, least).collect())) == want


def test_threshold_is_met_exactly(spark):
    old, new = [f"w{i}" for i in range(20)], [f"w{i}" for i in range(17)]
    df = texts(spark, [(1, "x", " ".join(old)), (2, "x", " ".join(new)), (3, "x", " ".join(new[:-1]))])
    assert [tuple(r) for r in similarity.near_pairs_prefix(df).select("old_id", "new_id", "score").orderBy("new_id").collect()] == [(1, 2, 0.85), (2, 3, 16 / 17)]


def test_lookup_finds_copies_of_equal_parity(spark, tmp_path):
    from mnemospark.plans import catalogue

    rows = [(1, "x", "a b"), (3, "y", " a  b "), (4, "x", "c"), (6, "x", "c"), (7, "x", "a b"), (8, "x", None), (10, "x", None), (11, "x", "")]
    texts(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.known_id for r in catalogue.QUERIES["exact_dedupe_lookup_all"](spark, str(tmp_path)).collect()}
    assert found == {1: None, 3: 1, 4: None, 6: 4, 7: 1, 8: None, 10: None, 11: None}


def test_best_near_takes_the_lowest_id(spark):
    df = texts(spark, [(1, "x", "a b c"), (2, "x", "c b a"), (3, "x", "b a c"), (4, "y", "a b c")])
    assert sorted(map(tuple, similarity.best_near(df).collect())) == [("x", 2, 1, 1.0), ("x", 3, 1, 1.0)]


def plain_fold(rows, bridge=True, cap=None):
    """The ledger's rules again, as plainly as they can be put: every fact is looked at for every command."""
    facts, held, out = {}, [], []
    for seq, action, t in rows:
        if action != "STORE":
            out.append("drop" if action == "DROP" else "quarantine")
            continue
        norm = " ".join(t.split())
        same = [f for f in facts.values() if f["norm"] == norm]
        if same:
            out.append("exact" if same[0]["dead"] is None else "resurrect")
            same[0]["dead"] = None
            continue
        live = [f for f in facts.values() if f["dead"] is None]
        a = set(norm.split())
        scored = [(len(a & b) / len(a | b) if a | b else 1.0, -f["id"], f) for f in live for b in [set(f["norm"].split())]]
        best = max(scored, key=lambda x: x[:2], default=None)
        if best and best[0] >= 0.85:
            out.append("near")
            continue
        if cap is not None and len(live) >= cap:
            out.append("quarantine")
            held.append(seq)
            continue
        facts[seq] = {"id": seq, "norm": norm, "dead": None}
        out.append("insert")
        if not bridge:
            continue
        new = ledger.Reading(t)
        flagged = []
        for s, i, f in scored:
            old = ledger.Reading(f["norm"])
            if s >= 0.3 and (new.negation or new.strong or new.weak or old.content != new.content or old.numbers != new.numbers):
                flagged.append((-s, -i, f, old))
        for _, _, f, old in sorted(flagged, key=lambda x: x[:2])[:5]:
            if f["dead"] is None and ledger.committee(old, new, 2) == ("supersede", True, "TOMBSTONE"):
                f["dead"] = seq
    return out


@pytest.mark.parametrize(("bridge", "cap"), [(True, None), (False, None), (True, 12)])
def test_ledger_against_the_plain_fold(spark, bridge, cap):
    rng = random.Random(9)
    words = ["bike", "locker", "code", "bay", "demo", "room", "lamp", "moved", "not", "now", "2", "7am", "the", "is"]
    rows = [("u" + str(i % 3), i, rng.choice(["STORE"] * 8 + ["DROP", "QUARANTINE"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))) for i in range(400)]
    df = spark.createDataFrame(rows, "user string, seq long, gate_action string, text string")
    got = ledger.run(df, settings=ledger.Settings(bridge=bridge, memory_cap=cap)).select("user", "seq", "outcome").collect()
    for u in ("u0", "u1", "u2"):
        want = plain_fold([(s, a, t) for user, s, a, t in rows if user == u], bridge, cap)
        assert [r.outcome for r in sorted(got, key=lambda r: r.seq) if r.user == u] == want


def one(commands, **settings):
    book = ledger.Ledger("u", ledger.Settings(**settings))
    return book, [book.apply({"seq": i + 1, "op": op, "text": None, **c}) for i, (op, c) in enumerate(commands)]


def test_supersede_and_restore():
    book, rows = one([("put", {"text": "tea at four"}), ("supersede", {"text": "coffee by noon", "target_id": 1}), ("restore", {"target_id": 1}), ("supersede", {"text": "x", "target_id": 99}), ("nonsense", {})])
    assert [r["outcome"] for r in rows] == ["insert", "insert", "restore", "error", "error"]
    assert book.facts[1].tombstoned_by is None and book.live == 2


def test_greedy_leaders_are_not_components():
    base = [f"w{i}" for i in range(20)]
    a, b, c = base, base[:18] + ["x"], base[:16] + ["x", "y"]
    _, rows = one([("put", {"text": " ".join(t)}) for t in (a, b, c)], bridge=False)
    assert [r["outcome"] for r in rows] == ["insert", "near", "insert"]


def test_conflict_marks_are_cleared_on_both_sides():
    book, _ = one([("put", {"text": "a b"}), ("put", {"text": "c d"}), ("put", {"text": "e f"}), ("mark_conflict", {"target_id": 1, "other_id": 2}), ("mark_conflict", {"target_id": 3, "other_id": 2})], bridge=False)
    assert [book.facts[i].conflict_with for i in (1, 2, 3)] == [2, 3, 2]
    book.apply({"seq": 9, "op": "restore", "target_id": 1})
    assert [book.facts[i].conflict_with for i in (1, 2, 3)] == [None, 3, 2] and len(book.conflicts) == 1


def test_resurrection_takes_the_new_text_and_clears_marks():
    book, rows = one([("put", {"text": "a b", "gate_action": "STORE"}), ("put", {"text": "c d"}), ("retire", {"target_id": 1, "other_id": 2}), ("put", {"text": "a  b", "source": "s"})], bridge=False)
    assert rows[-1]["outcome"] == "resurrect" and book.facts[1].text == "a  b" and book.facts[1].gate_action is None
    assert book.facts[1].tombstone_reason is None


def test_review_of_held_lines():
    book, rows = one([("quarantine", {"text": "q one", "reason": "r"}), ("approve", {"target_id": 1, "reason": " "}), ("approve", {"target_id": 1, "reason": " fine "}), ("deny", {"target_id": 1, "reason": "x"}), ("quarantine", {"text": "q two"}), ("release", {"target_id": 5})])
    assert [r["outcome"] for r in rows] == ["quarantine", "error", "insert", "error", "quarantine", "insert"]
    assert book.reviews == [{"qid": 1, "decision": "approve", "reason": "fine", "actor": "human"}] and not book.held


def test_the_cap_keeps_held_lines_held():
    book, rows = one([("put", {"text": "a"}), ("quarantine", {"text": "b"}), ("approve", {"target_id": 2, "reason": "ok"}), ("put", {"text": "a"}), ("admit", {"text": "c", "gate_action": "STORE"})], memory_cap=1, bridge=False)
    assert [r["outcome"] for r in rows] == ["insert", "quarantine", "cap", "exact", "quarantine"]
    assert set(book.held) == {2, 5} and not book.reviews


def test_a_dumped_ledger_goes_on():
    book, _ = one([("put", {"text": "the blue bike is at bay 2"})])
    again = ledger.Ledger.load("u", json.loads(json.dumps(book.dump())), ledger.Settings())
    row = again.apply({"seq": 7, "op": "put", "text": "the blue bike moved to bay 4"})
    assert row["relations"] == "1:supersede:TOMBSTONE:supersede-auto-spot" and again.facts[1].tombstoned_by == 7


OLD, NEW = "the blue bike is at bay 2", "the blue bike moved to bay 4"


def asked(live, more=(), **settings):
    commands = [("put", {"text": t}) for t in (OLD, *more, NEW)]
    book, rows = one(commands, live=live, **settings)
    return book, rows[-1]["relations"]


def test_live_votes_must_agree_with_the_offline_ones():
    assert asked(lambda a, b: ("supersede", "supersede"))[1] == "1:supersede:TOMBSTONE:supersede-auto-spot"
    assert asked(lambda a, b: ("supersede", "same"))[1] == "1:supersede:KEEP:veto-keep"
    assert asked(lambda a, b: ("contradict", "contradict"))[1] == "1:conflict_unresolved:KEEP:veto-keep"
    assert asked(lambda a, b: ("odd", "odd"))[1] == "1:unrelated:KEEP:veto-keep"


def test_a_halted_judge_names_what_it_skipped():
    def refuse(a, b):
        raise ledger.JudgeRefused

    def fail(a, b):
        raise ledger.JudgeHalted

    other = "the blue bike key hangs at bay 9"
    for live, words in ((refuse, ("judge-rate-limited", "judge-halted-skipped")), (fail, ("judge-halted", "judge-halted-skipped"))):
        book, row = asked(live, [other], dedup_jaccard=0.99)
        assert tuple(x.split(":")[3] for x in row.split(",")) == words and book.live == 3
    book, row = asked(lambda a, b: ("supersede", "supersede"), budget=limits.Budget(chars=10))
    assert row.endswith("rate-budget-exhausted") and book.live == 2


def test_ledger_of_nothing(spark):
    empty = spark.createDataFrame([], "user string, seq long, text string")
    assert ledger.run(empty).count() == 0 and ledger.run(empty, "facts").count() == 0


def test_recall_selects_and_packs(spark):
    rows = [(1, i, t, s) for i, (t, s) in enumerate([("best", 0.9), ("tie", 0.8), ("tie2", 0.8), ("low", 0.49), ("under", 0.3)])]
    df = spark.createDataFrame(rows, "query_id long, id long, text string, score double")
    got = recall.select(df, gate=0.4).orderBy("rank").collect()
    assert [r.text for r in got] == ["best", "tie", "tie2"]
    assert [r.text for r in recall.select(df, gate=0.0, band=1.0, cap=2).orderBy("rank").collect()] == ["best", "tie"]
    assert recall.pack(recall.select(df, gate=0.4), 9).head()["packed"] == "best\ntie"
    again = df.unionByName(df.withColumns({"id": F.col("id") + 10, "score": F.col("score") - 0.01}))
    assert recall.inject(again).head()["packed"] == "best\ntie\ntie2\nlow\nunder"


def test_contamination_kinds(spark):
    p = spark.createDataFrame([("The Blue bike stands in bay four.",)], "text string")
    import hashlib

    h = hashlib.sha256(b"The Blue bike stands in bay four.").hexdigest()
    rows = [("a", "The Blue bike stands in bay four."), ("b", h), ("c", "the blue bike, stands in bay four"), ("d", "the blue bike stands in bay four today"), ("e", "blue bike"), ("f", None), ("g", h), ("g", "x")]
    got = {r.path: (r.check, r.score) for r in contamination.flags(spark.createDataFrame(rows, "path string, s string"), p).collect()}
    assert got == {"a": ("exact-text", 1.0), "b": ("content-hash", 1.0), "c": ("normalized-text", 1.0), "d": ("token-overlap", 7 / 8), "g": ("content-hash", 1.0)}


@pytest.mark.parametrize("bits", [6, contamination.MAP_BITS])
def test_contamination_against_every_pair(spark, monkeypatch, bits):
    """The map of protected tokens changes nothing, even if every token has a bit that is set."""
    monkeypatch.setattr(contamination, "MAP_BITS", bits)
    rng, words = random.Random(5), [f"w{i}" for i in range(60)]
    said = lambda pool, n: " ".join(rng.choices(pool, k=n))
    protected = [said(words[:30], rng.randint(1, 9)) for _ in range(25)] + ["", "...", None]
    rows = [(rng.randint(0, 150), said(words, rng.randint(0, 9))) for _ in range(200)] + [(1, None), (2, ""), (2, "!")]
    for _ in range(200):  # texts that are near to protected ones
        kept = [w for w in rng.choice(protected[:25]).split() if rng.random() < 0.95] + rng.choices(words, k=rng.randint(0, 1))
        rows += [(rng.randint(0, 150), rng.choice([" ".join(kept), "; ".join(kept).upper()]))] * rng.randint(1, 2)
    known = [p for p in protected if p is not None]
    form = lambda t: " ".join(re.sub("[^a-z0-9]", " ", t.lower()).split())
    want = {}
    for path, s in rows:
        if s is None:
            continue
        mine, kinds = set(form(s).split()), []
        best = max((len(mine & set(form(p).split())) / len(mine | set(form(p).split())) for p in known if form(p)), default=0) if len(mine) >= 3 else 0
        kinds = [(0, -1.0, s)] * (s in known) + [(2, -1.0, s)] * (form(s) != "" and form(s) in map(form, known)) + [(3, -best, s)] * (best >= 0.8)
        if kinds:
            want[path] = min(kinds + ([want[path]] if path in want else []))
    df = spark.createDataFrame(rows, "path long, s string").repartition(3)
    got = {r.path: (contamination.KINDS.index(r.check), -r.score, r.excerpt) for r in contamination.flags(df, spark.createDataFrame([(p,) for p in protected], "text string"), 0.8, 3).collect()}
    assert got == want and {k for k, _, _ in want.values()} == {0, 2, 3}


def test_artifacts_from_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: x\nsplit: 'test'\n")
    (tmp_path / "b.md").write_text("notes\n  the blue bike stands in bay four  \n")
    (tmp_path / "c.json").write_text(json.dumps({"deep": {"list": ["fine", {"z": "The blue bike stands in bay four!"}]}}))
    (tmp_path / "d.json").write_text(json.dumps({"tuned_on": "test"}))
    (tmp_path / "e.json").write_text(json.dumps({"inner": {"split": "test"}}))
    p = spark.createDataFrame([("the blue bike stands in bay four",)], "text string")
    found = {}
    for read in (tables.read_texts, tables.read_json):
        strings, bodies = read(spark, str(tmp_path))
        found |= {r.path.rsplit("/", 1)[1]: (r.check, r.excerpt) for r in contamination.scan(strings, bodies, p).collect()}
    assert found == {"a.yaml": ("split-field", "split=test"), "b.md": ("exact-text", "the blue bike stands in bay four"), "c.json": ("normalized-text", "The blue bike stands in bay four!"), "d.json": ("split-field", "tuned_on=test")}


def test_cases(spark, tmp_path):
    lines = [{"id": "1", "suite": "admit", "kind": "k", "provenance": "p", "text": "t", "expect": "STORE"}, {"id": "2", "suite": "odd", "kind": "k", "provenance": "p"}, {"id": "3", "suite": "rerank", "kind": "k", "provenance": "p", "candidates": [["c", 0.5]], "expect": ["c"]}]
    (tmp_path / "cases.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    cases = tables.read_cases(spark, str(tmp_path / "cases.jsonl"))
    assert [r.id for r in tables.validate_cases(cases, "p").collect()] == ["2"]
    assert {r.text for r in tables.case_strings(cases).collect()} == {"t", "c"}
    assert cases.where("id = '3'").select(F.col("candidates")[0][1].cast("double")).head()[0] == 0.5


def test_store(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "db"))
    assert store.read("facts").count() == 0
    store.write("facts", spark.createDataFrame([(1, "a  b", None)], "id long, text string, user string"))
    first = store.read("facts").head()
    assert first.user == "local" and len(first.text_hash) == 64 and first.judge is None
    store.write("facts", store.read("facts").withColumn("source", F.lit("s")))
    assert store.read("facts").head().source == "s"


def test_registry(tmp_path):
    path = str(tmp_path / "r" / "x.json")
    with pytest.raises(tables.RegistryError):
        tables.read_registry(path, "t")
    tables.write_registry(path, "t", {"admit.durable": 0.6})
    assert tables.threshold(tables.read_registry(path, "t"), "admit.durable", "t") == 0.6
    assert tables.threshold(None, "x", "t") == tables.threshold(tables.read_registry(path, "t"), "x", "t") == "UNCALIBRATED"
    with pytest.raises(tables.RegistryError):
        tables.read_registry(path, "other")


def test_sweeps(spark):
    df = spark.createDataFrame([(0.9, True), (0.65, True), (0.62, False), (0.2, False)], "score double, is_positive boolean")
    best = metrics.best_threshold(metrics.threshold_sweep(df)).head()
    assert (best.threshold, best.f1) == (0.3, 0.8)
    conf = df.select(F.col("score").alias("confidence"), F.col("is_positive").alias("is_correct"))
    assert metrics.best_cutoff(metrics.conformal_sweep(conf)).head().min_conf == 0.7
    assert metrics.best_cutoff(metrics.conformal_sweep(conf), 1.1).head().min_conf == 0.9


def test_percentile_split_and_samples(spark):
    df = spark.range(10).withColumn("g", F.lit("a"))
    p = metrics.percentile_by_index(df, "id", {"p50": 0.5, "p95": 0.95, "p100": 1.0}, "g").head()
    assert (p.p50, p.p95, p.p100) == (5, 9, 9)
    assert metrics.split(df.where("id < 9"), F.col("id"), "g").where("split = 'train'").count() == 4
    assert [r.id for r in metrics.every(df, 4, "id", "g").orderBy("id").collect()] == [0, 4, 8]
    assert [r.id for r in metrics.sample_evenly(df, 3, "id", "g").orderBy("id").collect()] == [0, 3, 6]


@pytest.mark.parametrize(("parts", "few"), [(1024, 10_000), (4, 10_000), (4, 2)])
def test_percentiles_in_rounds(spark, monkeypatch, parts, few):
    monkeypatch.setattr(metrics, "PARTS", parts)
    monkeypatch.setattr(metrics, "FEW", few)
    monkeypatch.setattr(metrics, "LAST", 50_000 if parts == 1024 else 0)
    rng = random.Random(parts + few)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, -1.5, 1e300, rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(5))]), rng.randrange(-(10**12), 10**12)) for _ in range(500)] + [("one", 3.25, 7)]
    df = spark.createDataFrame(rows, "g string, v double, k long")
    quantiles = {"least": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "most": 1.0}
    for column, i in (("v", 1), ("k", 2)):
        got = {r.g: r for r in metrics.percentile_by_index(df, column, quantiles, "g").collect()}
        assert set(got) == {"a", "b", None, "one"}
        for g, r in got.items():
            found = sorted(x[i] for x in rows if x[0] == g and x[i] is not None)
            assert r.n == len(found) and [r[q] for q in quantiles] == [found[min(len(found) - 1, int(q * len(found)))] for q in quantiles.values()]
    whole = metrics.percentile_by_index(df, "k", {"p50": 0.5}).collect()
    assert [tuple(r) for r in whole] == [(501, sorted(x[2] for x in rows)[250])]
    assert metrics.percentile_by_index(df.where("k is null"), "k", {"p50": 0.5}, "g").collect() == []


def test_train_hash_of_repeats_and_nulls(spark):
    import hashlib

    texts = ["b", "a", "b", None, "", "a"]
    got = metrics.train_hash(spark.createDataFrame([(t,) for t in texts], "text string")).head()
    hashes = sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts if t is not None)
    assert (got.train_hash, got.train_n) == (hashlib.sha256(",".join(hashes).encode()).hexdigest(), 6)


def test_budget():
    b = limits.Budget(calls=2, chars=100, seconds=60)
    assert [b.check(t, n) for t, n in [(0, 10), (15, 10), (30, 10), (61, 10), (62, 95)]] == [(True, 0), (True, 0), (False, 31), (True, 0), (False, 14)]
    assert limits.Budget(chars=5).check(0, 6) == (False, 61)


def test_admitted_load(spark):
    rows = [(i, i % 2, f"2024-01-01 00:00:{i:02d}", 1) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, chars long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.key: r.admitted for r in limits.admitted_load(df, calls=3).collect()}
    assert [k for k in sorted(got) if got[k]] == [0, 1, 2, 3, 4, 5]
    offered = {r.event_id: (r.calls, r.chars_used) for r in limits.offered_load(df, seconds=4).collect()}
    assert offered[11] == (2, 2) and offered[0] == (1, 1)


def test_restore_leaves_newer_marks(spark):
    facts = spark.createDataFrame([(1, "u", None, None, None, 2), (2, "u", None, None, None, 3), (3, "u", 9, "r", "a", 2)], "id long, user string, tombstoned_by long, tombstone_reason string, tombstone_actor string, conflict_with long")
    conflicts = spark.createDataFrame([(1, 2), (3, 2)], "old_id long, new_id long")
    f, c = lifecycle.restore(facts, conflicts, spark.createDataFrame([(1,)], "id long"))
    assert [r.conflict_with for r in f.orderBy("id").collect()] == [None, 3, 2] and c.count() == 1
    f, c = lifecycle.restore(facts, conflicts, spark.createDataFrame([(3,)], "id long"))
    assert [(r.tombstoned_by, r.conflict_with) for r in f.orderBy("id").collect()] == [(None, 2), (None, None), (None, None)]


def test_review_tables(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "qid long, text string")
    d = spark.createDataFrame([(1, "approve", "ok"), (2, "deny", " no "), (3, "deny", " "), (9, "approve", "x")], "qid long, decision string, reason string")
    held, approved, reviews = lifecycle.review(q, d)
    assert [r.qid for r in held.collect()] == [3] and [r.qid for r in approved.collect()] == [1]
    assert sorted((r.qid, r.reason) for r in reviews.collect()) == [(1, "ok"), (2, "no")]


def test_artifact_paths_and_whole_texts(spark, tmp_path):
    from mnemospark.sources import tables

    for name, body in {"thresholds/a.json": '{"x": ["deep", {"y": "er"}]}', "thresholds/b.txt": "\n one \r\n two\x0b\n", "eval/thresholds-1.yml": "k: v", "eval/other.txt": "no", "thresholds/c.png": "no", "thresholds/d.md": " \n\t", "thresholds/sub/e.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body.encode())
    found = tables.artifact_paths(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["thresholds-1.yml", "a.json", "b.txt", "d.md"]
    assert sorted(r.s for r in tables.read_texts(spark, found)[0].collect()) == ["k: v", "one", "one \r\n two", "two"]
    assert sorted(r.s for r in tables.read_json(spark, found)[0].collect()) == ["deep", "er"]


def test_near_sets_of_copies(spark):
    from mnemospark.operators import similarity

    rows = [(i, "a b c d e f g h i j", "en") for i in range(300)] + [(300, "a b c d e f g h i k", "en"), (301, "a b c d e f g h i j", "de"), (302, "", "en"), (303, " ", "en"), (304, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    members, pairs = similarity.near_sets(df, 0.8)
    assert [tuple(r) for r in pairs.collect()] == [("en", 0, 300, 9 / 11)]
    got = {(r.scope, r.rep): r.n for r in members.where("id = rep").collect()}
    assert got == {("en", 0): 300, ("en", 300): 1, ("de", 301): 1, ("en", 302): 2, (None, 304): 1} and members.count() == 305


def test_recall_matches_are_the_scores_above_the_gate(spark):
    import random

    from mnemospark.operators import recall

    rng = random.Random(3)
    say = lambda: " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 8)))
    queries = spark.createDataFrame([(f"u{i % 3}", i, say()) for i in range(40)], "user string, query_id long, query string")
    live = spark.createDataFrame([(f"u{i % 3}", i, say()) for i in range(90)], "user string, id long, text string")
    for gate in (0.2, 0.58, 1.0):
        want = sorted(map(tuple, recall.score(queries, live).where(f"score >= {gate}").collect()))
        assert want and sorted(map(tuple, recall.matches(queries, live, gate).collect())) == want


def test_shared_folder_asks_for_a_shared_one(spark):
    from mnemospark.sources import folders

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.shared_folder(Elsewhere())
    assert folders.own_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_numbered_over_slices(spark):
    from mnemospark.operators import metrics

    rows = [(i * 37 % 50_021, f"k{i % 3}" if i % 7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string")
    for order, text in ((F.col("id"), lambda i: i), (F.col("id").cast("string"), str), (F.struct((-F.col("id")).alias("a"), "id"), lambda i: -i)):
        got = {r.id: (r["__r"], r["__n"]) for r in metrics.numbered(df, order, "g").collect()}
        for g in {x[1] for x in rows}:
            mine = sorted((x[0] for x in rows if x[1] == g), key=text)
            assert [got[i] for i in mine] == [(k, len(mine)) for k in range(len(mine))]


def test_numbered_by_cut_points(spark):
    """Keys with one beginning, doubles, times and structs are ranked over many slices; null comes first, NaN last."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), f"admit-{rng.randint(0, 10**6):09d}" if i % 50 else None, rng.choice([rng.random(), -0.5, float("inf"), float("nan"), None]), rng.randint(0, 10**9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, name string, part double, t long").withColumn("at", F.timestamp_seconds("t"))
    double = lambda v: (v is not None, v is not None and v != v, 0.0 if v is None or v != v else v)
    orders = [
        (F.struct("name", "id"), lambda r: (r.name is not None, r.name or "", r.id)),
        (F.struct("part", "id"), lambda r: (double(r.part), r.id)),
        (F.struct("at", F.struct((-F.col("id")).alias("x")).alias("y")), lambda r: (r.t, -r.id)),
    ]
    for order, key in orders:
        ranked = metrics.numbered(df, order, "g").collect()
        for g in ("a", "b", None):
            mine = sorted((r for r in ranked if r.g == g), key=key)
            assert [r["__r"] for r in mine] == list(range(len(mine))) and {r["__n"] for r in mine} == {len(mine)}
    for order in ("name", "part", "at"):  # equal keys in any order
        ranked = metrics.numbered(df, F.col(order)).collect()
        assert sorted(r["__r"] for r in ranked) == list(range(3000))
        sliced = df.withColumn("__k", F.col(order)).withColumn("s", metrics._cut_slice(df.withColumn("__k", F.col(order))))
        sizes = [r["count"] for r in sliced.groupBy("s").count().collect()]
        assert len(sizes) > 5 and (order == "part" or max(sizes) < 3000 / 4)
    none = df.limit(0)
    assert metrics.numbered(none, F.col("name"), "g").collect() == []
    assert [r["__r"] for r in metrics.numbered(df.limit(1).withColumn("name", F.lit(None).cast("string")), F.col("name")).collect()] == [0]


def test_admitted_load_between_pauses(spark):
    """Pauses split the fold without changing what is admitted."""
    import random

    from mnemospark.operators import limits

    rng = random.Random(9)
    rows, t = [], 1_700_000_000.0
    for i in range(600):
        t += rng.choice([0.2, 1, 5, 59.9, 60, 60.1, 200])
        rows.append((i, rng.choice([1, 2, None]), t, rng.randint(0, 50)))
    df = spark.createDataFrame(rows, "event_id long, user_id long, t double, chars long").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = {r.key: (r.admitted, r.retry_after) for r in limits.admitted_load(df, calls=3, seconds=60).collect()}
    want = {}
    for scope in (1, 2, None):
        budget = limits.Budget(3, seconds=60)
        for i, s, at, n in rows:
            if s == scope:
                want[i] = budget.check(int(at * 1e6) / 1e6, n)
    assert got == want and len({v for v in want.values()}) > 3


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    """Blocks of a few rows each, so that what is chosen of one block must be chosen among all; rows come once for each pair."""
    from mnemospark.functions import text
    from mnemospark.operators import blocks

    monkeypatch.setattr(blocks, "TOKENS", 40)
    monkeypatch.setattr(blocks, "ROWS", 7)
    monkeypatch.setattr(blocks, "GIVEN", 5)
    rng = random.Random(3)
    said = lambda: rng.choice([None, "", " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))])
    queries = spark.createDataFrame([(rng.choice(["u", "v", None]), i, said()) for i in range(40)], "user string, query_id long, query string")
    live = spark.createDataFrame([(rng.choice(["u", "v", "w"]), i, said()) for i in range(90)], "user string, id long, text string")
    q = queries.select("user", "query_id", text.token_set(F.col("query")).alias("q"))
    plain = q.join(live, "user").select("query_id", "id", "text", text.set_jaccard(F.col("q"), text.token_set(F.col("text"))).alias("score"))
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert rows(recall.score(queries, live)) == rows(plain)
    assert rows(recall.matches(queries, live, 0.3)) == rows(plain.where("score >= 0.3"))
    assert rows(recall.selected(queries, live, 0.1, 0.4, 3)) == rows(recall.select(plain, 0.1, 0.4, 3).select("query_id", "id", "text", "score", "rank"))
    assert rows(recall.injected(queries, live, 30)) == rows(recall.inject(plain, 30))


def test_near_sets_hold_compact_rows_between_steps(spark):
    """The prefixes are written as numbers, one row a document, and of short sets and long ones none is missed."""
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.choice([1, 2, 3, 6, 7, 20, 40]))] for _ in range(25)]
    said = [" ".join(w if rng.random() > 0.06 else f"w{rng.randint(0, 60)}" for w in rng.choice(base)) for _ in range(150)]
    df = spark.createDataFrame([(i, rng.choice(["a", "b", None]), t) for i, t in enumerate([*said, "", "", None, None])], "doc_id long, lang string, text string")
    sets = {r.doc_id: (r.lang, set(r.text.split())) for r in df.where("text is not null and lang is not null").collect()}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = sorted((x, y) for x, (s, a) in sets.items() for y, (t, b) in sets.items() if x < y and s == t and near(a, b) >= 0.85)
    for got in (similarity.near_pairs(df), similarity.near_pairs_prefix(df)):
        assert sorted((r.old_id, r.new_id) for r in got.collect()) == want
    plan = similarity.near_sets(df)[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "prefix" in plan


def test_a_fold_over_many_live_facts_counts_them_at_once():
    """Suspects, their order and what they are merged into, against sets compared one by one; and in a time that the number of live facts hardly shows in."""
    rng, book, slow = random.Random(8), ledger.Ledger("u"), {}
    for seq in range(700):
        text = f"my {rng.choice(('blue', 'red'))} ring account number is {seq}" if rng.random() < 0.6 else " ".join(rng.choices(("slot", "no", "longer", "moved", "now", "bay", "7", "tray"), k=rng.randrange(1, 9)))
        new = ledger.Reading(text)
        live = {i: ledger.Reading(f.text) for i, f in book.facts.items() if f.tombstoned_by is None}
        alike = {i: len(new.tokens & r.tokens) / len(new.tokens | r.tokens) for i, r in live.items()}
        near = max(((s, -i) for i, s in alike.items() if s >= 0.85), default=None)
        signal = new.negation or new.strong or new.weak
        found = sorted((-s, i) for i, s in alike.items() if s >= 0.3 and live[i].norm != new.norm and (signal or live[i].content != new.content or live[i].numbers != new.numbers))
        done = book.apply({"seq": seq, "op": "put", "text": text, "source": "s"})
        if done["outcome"] == "near":
            assert (done["score"], -done["fact_id"]) == near
        if done["outcome"] == "insert":
            assert near is None and done["flagged"] == len(found) and [int(r.split(":")[0]) for r in done["relations"].split(",") if r] == [i for _, i in found[:5]]
        slow[done["outcome"]] = slow.get(done["outcome"], 0) + 1
        if seq % 9 == 4:
            book.apply({"seq": seq, "op": rng.choice(("retire", "restore")), "target_id": rng.choice(list(book.facts)), "other_id": 0})
    assert {"insert", "near", "exact"} <= set(slow)
    crowd, began = ledger.Live(), time.process_time()
    for i in range(4000):
        new = ledger.Reading(f"my blue ring account number is {i}")
        assert crowd.best(new, 0.85) is None and crowd.suspicious(new, 0.3, 5)[0] == i
        crowd.add(i, new)
    assert time.process_time() - began < 8  # 20 s and more where each is counted by itself


def test_conflicts_go_with_their_facts():
    found = ledger.Conflicts([{"old_id": i, "new_id": i + 1} for i in range(40_000)])
    for i in range(0, 39_990, 2):
        found.drop(i)
    assert [x["old_id"] for x in found] == list(range(39_989, 40_000)) and len(found) == 11


def test_items_that_nobody_asks_for_are_given_away(spark):
    """The fold keeps held items only for commands that ask for them, and gives all of them, one for each seq."""
    book = ledger.Ledger("u")
    for seq in range(100):
        book.apply({"seq": seq, "op": "quarantine", "text": f"t{seq}", "reason": "r", "asked": seq == 7})
    assert set(book.held) == {7} and len(book.flush(False)) == 98 and [x["qid"] for x in book.flush(True)] == [99] and not book.passed
    rows = [("u", i, "quarantine", f"t{i}", None, "why") for i in range(9000)] + [("u", 8999, "quarantine", "t8999", None, "why"), ("u", 9001, "approve", None, 4, "fine"), ("u", 9002, "deny", None, 5, "no"), ("u", 9003, "release", None, 5, None)]
    df = spark.createDataFrame(rows, "user string, seq long, op string, text string, target_id long, reason string")
    want = sorted(set(range(9000)) - {4, 5})
    assert sorted(r.qid for r in ledger.run(df, "held").collect()) == want
    done = ledger.advance(df).where("part = 'held'").select("held.*").collect()
    assert sorted(r.qid for r in done if not r.gone) == want and not [r for r in done if r.gone]
    audit = {r.seq: (r.outcome, r.reason) for r in ledger.run(df, columns=("seq", "outcome", "reason")).collect()}
    assert audit[9001][0] == "insert" and audit[9002][0] == "deny" and audit[9003] == ("error", "unknown-id")


def test_one_budget_is_folded_from_packs(spark):
    """Calls of one scope without pauses reach the task that folds them as sorted packs, not as rows to be sorted; the result is the same."""
    df = spark.range(30_000).selectExpr("0L AS user_id", "(id * 7919) % 30000 AS event_id", "timestamp_seconds(1700000000 + ((id * 7919) % 30000) DIV 3 * 40) AS ts", "id % 9 AS chars")
    got = limits.admitted_load(df, whole=100, calls=3, seconds=1800)
    assert "calls#" in got._jdf.queryExecution().executedPlan().toString()
    want = limits.admitted_load(df, whole=10**9, calls=3, seconds=1800)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_near_sets_compare_sketches_in_blocks(spark, monkeypatch):
    """Blocks of a few rows, sizes that fold a sketch for a smaller class, white space of all kinds: the pairs are those of sets compared one by one."""
    from mnemospark.operators import sketches

    monkeypatch.setattr(sketches, "ROWS", 8)
    rng, space = random.Random(8), [chr(c) for c in range(0x3100) if chr(c).isspace()]
    base = [[f"w{rng.randint(0, 900)}" for _ in range(rng.choice([5, 90, 120, 150, 300, 420]))] for _ in range(8)]
    said = []
    for _ in range(90):
        words = [w for w in rng.choice(base) if rng.random() > rng.choice([0.0, 0.03, 0.08, 0.2])]
        said.append("".join(w + rng.choice(space) for w in words))
    df = spark.createDataFrame([(i, rng.choice("ab"), t) for i, t in enumerate(said)], "doc_id long, lang string, text string")
    read = {r.doc_id: (r.lang, set(r.tokens)) for r in df.select("doc_id", "lang", text.token_set(F.col("text")).alias("tokens")).collect()}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = {(x, y): near(a, b) for x, (s, a) in read.items() for y, (t, b) in read.items() if x < y and s == t and near(a, b) >= 0.85}
    assert len(want) > 100 and {(r.old_id, r.new_id): r.score for r in similarity.near_pairs(df).collect()} == want
    assert {(r.x, r.y) for r in similarity.near_sets(df)[1].collect()} <= set(want)


def test_near_pairs_compare_no_tokens_of_sets_that_differ(spark):
    """Sets of tokens that are all frequent: what is compared on its tokens are near pairs and few others."""
    from mnemospark.operators import sketches

    rng = random.Random(9)
    df = texts(spark, [(i, "x", " ".join({f"w{rng.randint(0, 600)}" for _ in range(200)})) for i in range(300)])
    rows = sketches.sketched(df.selectExpr("lang AS scope", "doc_id AS id", "text"), 0.85)
    assert sketches.candidates(rows.drop("key"), 0.85).count() == 0
    assert "tokens" not in similarity.near_pairs(df)._jdf.queryExecution().optimizedPlan().toString()
