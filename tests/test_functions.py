import pytest
from pyspark.sql import functions as F

from mnemospark.functions import gate, judge, relation, text
from mnemospark.functions import thresholds as th


def values(spark, inputs, column):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("v", column(F.col("t"))).orderBy("i")
    return [r.v for r in df.collect()]


SPACES = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())


def test_white_space_is_pythons(spark):
    got = values(spark, [f"a{c}b" for c in SPACES] + ["a​b"], text.normalize)
    assert got == ["a b"] * len(SPACES) + ["a​b"]


def test_token_sets_and_similarity(spark):
    pairs = [("", "", 1.0), ("", "a", 0.0), ("a b", "b a", 1.0), ("a b c", "A b c", 0.5), ("x x y", "y", 0.5)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    got = df.select("want", text.set_jaccard(text.token_set(F.col("a")), text.token_set(F.col("b"))).alias("s"), text.overlap(text.compare_tokens(F.col("a")), text.compare_tokens(F.col("b"))).alias("o")).collect()
    assert [r.s for r in got] == [r.want for r in got]
    assert [r.o for r in got] == [0.0, 0.0, 1.0, 1.0, 0.5]


def test_compare_form_and_excerpt(spark):
    assert values(spark, ["Straße, 5!", "  A_b\tC "], text.compare_form) == ["strasse 5", "a_b c"]
    long = values(spark, ["x" * 120, "y" * 121], text.excerpt)
    assert long == ["x" * 120, "y" * 117 + "..."]


def test_content_and_number_tokens(spark):
    t = ["The demo at 4pm on the 3rd, seven rooms 12"]
    assert sorted(values(spark, t, text.content_tokens)[0]) == ["4pm", "demo", "rooms"]
    assert sorted(values(spark, t, text.number_tokens)[0]) == ["12", "3rd", "4pm", "seven"]


def test_markers_are_whole_words(spark):
    t = ["it is not", "knot", "énow", "is now", "renewed", "new one", None]
    assert values(spark, t, text.has_negation) == [True, False, False, False, False, False, None]
    assert values(spark, t, text.has_strong_update)[:6] == [False, False, False, True, False, False]
    assert values(spark, t, text.has_weak_update)[:6] == [False, False, False, True, False, True]


CLASSES = [
    ("ok", "filler"), ("", "filler"), (None, "filler"), ("hm", "filler"), ("that was fun lol", "play"), ("a lollipop for later", "uncertain"), ("I am Zorro", "play"), ("hahaha stop it", "play"),
    ("my account number is 12", "sensitive"), ("call 1234567", "sensitive"), ("token xxx here", "sensitive"), ("my account is closed", "uncertain"),
    ("she carries insulin", "vital"), ("take the pill or she faints", "vital"), ("take the pill daily", "routine"), ("stop-loss at 2%", "vital"), ("limit of 3 lots", "vital"), ("visa interview soon", "vital"),
    ("the deadline is friday", "vital"), ("the deadline poster hangs crooked", "uncertain"), ("we might evict them", "vital"), ("renewal in maybe a while", "vital"),
    ("i prefer tea", "routine"), ("every visit costs", "routine"), ("the shop opens at noon", "uncertain"), ("the shop opens on monday", "routine"), ("the van has seats", "routine"), ("keys hang behind it", "routine"),
    ("birthday in june", "routine"), ("the sky was pale", "uncertain"),
]


def test_classes(spark):
    assert values(spark, [t for t, _ in CLASSES], gate.classify) == [c for _, c in CLASSES]


def test_decisions_of_classes(spark):
    got = values(spark, ["ok", "lol", "my phone 1", "insulin", "i prefer tea", "the sky was pale"], gate.gate)
    assert [(r.action, r.reasons, r.importance) for r in got] == [
        ("DROP", ["not-durable-or-trivial"], 1), ("DROP", ["play>0.7"], 1), ("DROP", ["sensitive>0.7"], 2), ("STORE", ["durable+important"], 5), ("STORE", ["durable+important"], 4), ("QUARANTINE", ["uncertain-low-conf"], 2),
    ]


@pytest.mark.parametrize(
    ("vote", "action"),
    [
        ((0.9, 5, 0.0, 0.9, 0.9, 0.1), "QUARANTINE"), ((0.9, 5, 0.9, 0.9, 0.9, 0.6), "DROP"), ((0.9, 5, 0.9, 0.7, 0.71, 0.6), "DROP"), ((0.9, 5, 0.58, 0.7, 0.7, 0.6), "QUARANTINE"), ((0.58, 3, 0.579, 0.7, 0.7, 0.6), "STORE"),
        ((0.579, 3, 0.0, 0.0, 0.0, 1.0), "DROP"), ((0.9, 2, 0.0, 0.0, 0.0, 1.0), "DROP"),
    ],
)
def test_order_of_branches(spark, vote, action):
    assert spark.range(1).select(gate.decide(gate.vote_struct(vote))["action"]).head()[0] == action


def test_reasons_name_the_cutoffs(spark):
    c = th.Gate(play_drop=0.25, stop_block=0.1)
    assert spark.range(1).select(gate.decide(gate.vote_struct((0, 1, 0, 0.3, 0, 1)), c)["reasons"][0]).head()[0] == "play>0.25"
    assert spark.range(1).select(gate.decide(gate.vote_struct((0, 1, 0.1, 0, 0, 1)), c)["reasons"][0]).head()[0] == "stop>=0.1"


def decisions(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return [r.d for r in df.select("i", relation.offline_decision(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]


def test_committee_on_texts(spark):
    got = decisions(
        spark,
        [
            ("blue bike locker code", "blue bike locker  Code"), ("the blue bike is at bay 2", "the blue bike moved to bay 4"), ("the blue bike is at bay 2", "the blue bike is not there"), ("the blue bike is at bay 2", "the blue bike is at bay 3 now"),
            ("bay 2", "everything moved"), ("the blue bike is at bay 2", "the blue bike is at bay 3"),
        ],
    )
    assert [(d.relation, d.agreed, d.action) for d in got] == [
        ("same", True, "KEEP"), ("supersede", True, "TOMBSTONE"), ("conflict_unresolved", True, "CONFLICT"), ("unrelated", False, "KEEP"), ("unrelated", False, "KEEP"), ("unrelated", True, "KEEP"),
    ]


def test_committee_labels(spark):
    votes = [("contradict", "contradict"), ("supersede", "same"), ("odd", "odd"), (None, "same"), ("coexist", "coexist")]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(votes)], "i int, a string, b string")
    got = [r.d for r in df.select("i", relation.committee(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert [(d.relation, d.action, d.reasons[0]) for d in got] == [
        ("conflict_unresolved", "CONFLICT", "conflict-unresolved-never-tombstone"), ("supersede", "KEEP", "disagree-veto"), ("unrelated", "KEEP", "invalid-label-veto"), ("unrelated", "KEEP", "invalid-label-veto"), ("coexist", "KEEP", "coexist-agreed"),
    ]


def reply(dur='{"noul":0.9}', imp='{"choice":"s4"}', sens='{"noul":0.1}', stop='{"choice":"s1"}'):
    return f'{{"answers":{{"dur":{dur},"imp":{imp},"sens":{sens},"stop":{stop}}}}}'


def test_replies(spark):
    got = values(
        spark,
        [
            reply(), reply(dur='{"probability":0.9}', imp='{"choice":"4"}'), reply(dur='{"noul":1.2}'), reply(imp="{}"), "not json", reply(stop='{"choice":"s1","probabilities":{"s0":0.46,"s1":0.54}}'), reply(stop="{}"),
            reply(imp='{"choice":"s0"}'), '{"other":1}',
        ],
        judge.decide_reply,
    )
    assert [(d.action, d.reasons[0]) for d in got] == [
        ("STORE", "durable+important"), ("STORE", "durable+important"), ("QUARANTINE", "judge-halted"), ("QUARANTINE", "judge-halted"), ("QUARANTINE", "judge-halted"), ("QUARANTINE", "uncertain-low-conf"), ("QUARANTINE", "stop>=0.58"),
        ("DROP", "not-durable-or-trivial"), ("QUARANTINE", "judge-halted"),
    ]


def test_importance_labels(spark):
    assert values(spark, ["s0", " S4 ", "5", "0", "s5", "high", None], judge.importance_of) == [1, 5, 5, -1, -1, -1, -1]
