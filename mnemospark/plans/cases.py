"""Queries over cases: all suites, made from pairs of lines of the memory stream, with labels by remainders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import thresholds as th
from ..operators import evaluation, metrics
from ..sources import folders, records, tables
from . import oracle as o
from .base import query
from .memory_stream import memory_stream

_SUITES = ("admit", "importance", "dedupe", "contradict", "supersede", "rerank")
_LABELS = {
    "admit": ("STORE", "DROP", "QUARANTINE"), "importance": ("5", "4", "2"), "dedupe": ("DUP", "DISTINCT", "DISTINCT"), "contradict": ("CONFLICT", "KEEP", "KEEP"), "supersede": ("TOMBSTONE", "KEEP", "KEEP"),
}

_EXPECT = "CASE suite " + " ".join(f"WHEN '{s}' THEN {list(v)}[(r + 1)::INT]" for s, v in _LABELS.items()) + " ELSE '[\"' || b || '\"]' END"
#: A line and the one 200 further, which is about the same thing.
_CASES = f"""SELECT suite || '-' || lpad(seq::VARCHAR, 6, '0') AS id, CASE WHEN seq % 97 = 0 THEN 'unheard' ELSE suite END AS suite, CASE WHEN seq % 89 = 0 THEN '' ELSE 'kind' || r END AS kind, CASE WHEN seq % 83 = 0 THEN 'other' ELSE 'synthetic-rule' END AS provenance,
    CASE WHEN suite IN ('admit', 'importance', 'dedupe') THEN a END AS text, CASE WHEN suite = 'dedupe' THEN CASE WHEN r = 0 THEN '  ' || a ELSE b END END AS candidate, CASE WHEN suite IN ('contradict', 'supersede') THEN a END AS old, CASE WHEN suite IN ('contradict', 'supersede') THEN b END AS new,
    CASE WHEN suite = 'rerank' THEN [[a, '0.' || seq % 10], [b, '0.9'], [source, '0.6'], [b || ' again', '0.9']] END AS candidates, CASE WHEN suite = 'rerank' AND r = 0 THEN 0.3::DOUBLE END AS gate, {_EXPECT} AS expect
  FROM (SELECT x.seq, x.text AS a, y.text AS b, x.source, {list(_SUITES)}[(x.seq % 6 + 1)::INT] AS suite, x.seq // 6 % 3 AS r FROM ({o.MEMORY}) x JOIN ({o.MEMORY}) y ON y.seq = x.seq + 200)"""


def _cases(spark, sf_dir) -> DataFrame:
    m = memory_stream(spark, sf_dir)
    both = m.select("seq", F.col("text").alias("a"), "source").join(m.select((F.col("seq") - 200).alias("seq"), F.col("text").alias("b")), "seq")
    c = both.withColumns({"suite": F.get(F.array(*map(F.lit, _SUITES)), F.pmod("seq", F.lit(6)).cast("int")), "r": F.pmod(F.floor(F.col("seq") / 6), F.lit(3)).cast("int")})
    seq, suite, r, a, b = (F.col(x) for x in ("seq", "suite", "r", "a", "b"))
    expect = F.concat(F.lit('["'), b, F.lit('"]'))
    for name, labels in _LABELS.items():
        expect = F.when(suite == name, F.get(F.array(*map(F.lit, labels)), r)).otherwise(expect)
    single, pair = suite.isin("admit", "importance", "dedupe"), suite.isin("contradict", "supersede")
    offered = F.array(F.array(a, F.concat(F.lit("0."), (seq % 10).cast("string"))), F.array(b, F.lit("0.9")), F.array("source", F.lit("0.6")), F.array(F.concat(b, F.lit(" again")), F.lit("0.9")))
    return c.select(
        F.concat(suite, F.lit("-"), F.lpad(seq.cast("string"), 6, "0")).alias("id"), F.when(seq % 97 == 0, "unheard").otherwise(suite).alias("suite"), F.when(seq % 89 == 0, "").otherwise(F.concat(F.lit("kind"), r.cast("string"))).alias("kind"),
        F.when(seq % 83 == 0, "other").otherwise("synthetic-rule").alias("provenance"), F.when(single, a).alias("text"), F.when(suite == "dedupe", F.when(r == 0, F.concat(F.lit("  "), a)).otherwise(b)).alias("candidate"),
        F.when(pair, a).alias("old"), F.when(pair, b).alias("new"), F.when(suite == "rerank", offered).alias("candidates"), F.when((suite == "rerank") & (r == 0), 0.3).alias("gate"), expect.alias("expect"),
    )


_ACT = "CASE WHEN strict <> lenient THEN 'KEEP' WHEN strict = 'supersede' THEN 'TOMBSTONE' WHEN strict = 'conflict_unresolved' THEN 'CONFLICT' ELSE 'KEEP' END"
_KEPT = f"list_filter(list_transform(range(1, len(candidates) + 1), lambda i: struct_pack(less := -(candidates[i][2]::DOUBLE), i := i, t := candidates[i][1])), lambda x: -x.less >= coalesce(gate, {th.RECALL_GATE}))"
_RANKED = f"list_sort(list_filter(kept, lambda x: x.less <= list_min(list_transform(kept, lambda y: y.less)) * (1 - {th.RECALL_BAND}::DOUBLE)))[:{th.RECALL_CAP}]"
_SCORED = f"""{o.gated(_CASES)}, judged AS (SELECT *, {o.votes_on('old', 'new')}, {_KEPT} AS kept FROM gated),
  told AS (SELECT id, suite, kind, expect, CASE suite WHEN 'admit' THEN action WHEN 'importance' THEN importance::VARCHAR
      WHEN 'dedupe' THEN CASE WHEN norm = {o.norm('candidate')} OR {o.jaccard(o.tokens('text'), o.tokens('candidate'))} >= {th.DEDUP_JACCARD} THEN 'DUP' ELSE 'DISTINCT' END
      WHEN 'contradict' THEN {_ACT} WHEN 'supersede' THEN {_ACT} WHEN 'rerank' THEN '[' || array_to_string(list_transform({_RANKED}, lambda x: '"' || x.t || '"'), ',') || ']' END AS got FROM judged),
  scored AS (SELECT id, suite, kind, got, coalesce(got = expect, false) AS ok FROM told)"""


def _scored(spark, sf_dir) -> DataFrame:
    return evaluation.predict(_cases(spark, sf_dir))


@query(f"WITH {_SCORED} SELECT id, suite, kind, got, ok FROM scored")
def case_results(spark, sf_dir):
    """What each case of each suite gives, and whether that is its label."""
    return _scored(spark, sf_dir).select("id", "suite", "kind", "got", "ok")


@query(f"WITH {_SCORED} SELECT suite, kind, count(*) AS n, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail FROM scored GROUP BY ALL")
def suite_report(spark, sf_dir):
    return evaluation.report(_scored(spark, sf_dir), "kind")


@query(f"WITH {_SCORED} SELECT count(*) AS n, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail FROM scored")
def conformance_total(spark, sf_dir):
    return evaluation.totals(_scored(spark, sf_dir))


_FLOORS = {"admit": 10, "rerank": 10**6, "dedupe": 10**6, "nothing": 1}


@query(f"WITH c AS ({_CASES}) SELECT suite, least, coalesce(n, 0) AS n FROM (VALUES {', '.join(f'({o.quoted(k)}, {v}::BIGINT)' for k, v in _FLOORS.items())}) f(suite, least) LEFT JOIN (SELECT suite, count(*) AS n FROM c GROUP BY 1) USING (suite) WHERE coalesce(n, 0) < least")
def suite_floors(spark, sf_dir):
    return evaluation.floors(_cases(spark, sf_dir), _FLOORS)


@query(f"WITH c AS ({_CASES}) SELECT id, CASE WHEN suite NOT IN {_SUITES} THEN 'unknown suite ' || suite WHEN kind = '' THEN 'missing kind' ELSE 'provenance ' || provenance END AS problem FROM c WHERE suite NOT IN {_SUITES} OR kind = '' OR provenance <> 'synthetic-rule'")
def case_problems(spark, sf_dir):
    return tables.validate_cases(_cases(spark, sf_dir), "synthetic-rule")


@query(f"WITH c AS ({_CASES}) SELECT id, unnest(list_filter([text, candidate, old, new] || coalesce(list_transform(candidates, lambda x: x[1]), []), lambda t: t IS NOT NULL)) AS text FROM c")
def case_texts(spark, sf_dir):
    return tables.case_strings(_cases(spark, sf_dir))


def _json(name: str, value: str) -> str:
    return f"CASE WHEN {name} IS NOT NULL THEN '\"{name}\":' || {value} END"


_PARTS = [
    *[_json(n, f"to_json({n})") for n in ("suite", "kind", "provenance", "text", "candidate", "old", "new")],
    _json("candidates", "to_json(candidates)"), _json("gate", "gate::VARCHAR"), _json("expect", "to_json(expect)"),
]
_HASHED = f"(SELECT *, sha256('{{' || array_to_string(list_filter([{', '.join(_PARTS)}], lambda x: x IS NOT NULL), ',') || '}}') AS case_hash FROM ({_CASES}))"


@query(f"SELECT id, case_hash FROM {_HASHED}")
def case_hashes(spark, sf_dir):
    return evaluation.case_key(_cases(spark, sf_dir)).select("id", "case_hash")


_SPLIT = f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY suite, kind ORDER BY case_hash, id) <= count(*) OVER (PARTITION BY suite, kind) // 2 THEN 'train' ELSE 'test' END AS split FROM {_HASHED}"


@query(f"SELECT id, suite, kind, split FROM ({_SPLIT})")
def case_split(spark, sf_dir):
    return evaluation.split_cases(_cases(spark, sf_dir)).select("id", "suite", "kind", "split")


@query(f"WITH {_SCORED}, s AS ({_SPLIT}) SELECT suite, split, count(*) AS n, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS fail FROM scored JOIN s USING (id, suite) WHERE suite IN ('admit', 'rerank') GROUP BY ALL")
def suite_split_report(spark, sf_dir):
    """Two suites, by half."""
    chosen = _cases(spark, sf_dir).where(F.col("suite").isin("admit", "rerank"))
    return evaluation.report_by_half(evaluation.predict(chosen), evaluation.split_cases(chosen))


@query(f"SELECT id, suite, kind, text, candidate, old, new, candidates[1][1] AS first_candidate, gate, expect FROM ({_CASES})")
def cases_read(spark, sf_dir):
    """Cases written as a JSON object a line, and read back."""
    path = folders.own_folder(spark, "cases")
    _cases(spark, sf_dir).write.json(path)
    back = tables.read_cases(spark, path)
    return back.select("id", "suite", "kind", "text", "candidate", "old", "new", F.col("candidates")[0][0].alias("first_candidate"), "gate", "expect")


@query(
    f"""WITH c AS ({_CASES}), f AS (SELECT id, CASE WHEN substr(id, -1) = '3' THEN 'changed' ELSE expect END AS expect FROM c WHERE substr(id, -1) <> '7'), l AS (SELECT id FROM c WHERE substr(id, -2) IN ('13', '17', '29'))
    SELECT id, c.expect AS now, f.expect AS then FROM c FULL JOIN f USING (id) WHERE c.expect IS DISTINCT FROM f.expect AND id NOT IN (SELECT id FROM l)"""
)
def unlogged_labels(spark, sf_dir):
    """Labels that differ from the frozen ones, or are new, without an entry in the log."""
    c = _cases(spark, sf_dir)
    last = F.substring("id", -1, 1)
    frozen = c.where(last != "7").select("id", F.when(last == "3", "changed").otherwise(F.col("expect")).alias("expect"))
    return evaluation.label_changes(c, frozen, c.where(F.substring("id", -2, 2).isin("13", "17", "29")))


@query(f"WITH c AS ({_CASES}), r AS (SELECT id, text, candidate, row_number() OVER (ORDER BY id) - 1 AS r FROM c WHERE suite = 'dedupe' AND expect = 'DISTINCT') SELECT id FROM r WHERE r % 4 = 0 AND {o.norm('text')} = {o.norm('candidate')}")
def distinct_crosscheck(spark, sf_dir):
    return evaluation.crosscheck_distinct(_cases(spark, sf_dir))


_ADMIT = f"""{o.gated(_SPLIT)}, t AS (SELECT text, v.durable::DOUBLE AS durable, v.conf::DOUBLE AS conf, expect = 'STORE' AS good, gated.action = expect AS ok FROM gated JOIN {o.votes()} ON gated.class = v.class WHERE suite = 'admit' AND split = 'train')"""


@query(
    f"""WITH {_ADMIT}, c AS (SELECT threshold, count(*) FILTER (durable >= threshold AND good) AS tp, count(*) FILTER (durable >= threshold AND NOT good) AS fp, count(*) FILTER (durable < threshold AND good) AS fn FROM t, (VALUES {', '.join(f'({x}::DOUBLE)' for x in th.THRESHOLD_GRID)}) g(threshold) GROUP BY 1),
    p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM c),
    s AS (SELECT threshold, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p), b AS (SELECT * FROM s ORDER BY f1 DESC, threshold LIMIT 1)
    SELECT threshold, f1 AS train_f1, (SELECT count(*) FROM t) AS train_n, (SELECT sha256(string_agg(h, ',' ORDER BY h)) FROM (SELECT sha256(text) AS h FROM t)) AS train_hash FROM b"""
)
def calibrated_gate(spark, sf_dir):
    """The durable cutoff tuned on the training half of the admit suite, and what it was tuned on."""
    cases = evaluation.split_cases(_cases(spark, sf_dir)).where("suite = 'admit' and split = 'train'")
    found = evaluation.calibrate_gate(cases)
    return spark.createDataFrame([(found["thresholds"]["admit.durable"], found["train_f1"], found["train_n"], found["train_hash"])], "threshold double, train_f1 double, train_n long, train_hash string")


@query(
    f"""WITH {_ADMIT}, s AS (SELECT min_conf, count(*) FILTER (conf >= min_conf) AS kept, count(*) FILTER (conf >= min_conf AND ok) AS right_, count(*) AS n FROM t, (VALUES {', '.join(f'({x}::DOUBLE)' for x in th.CONFORMAL_GRID)}) g(min_conf) GROUP BY 1),
    c AS (SELECT min_conf, CASE WHEN kept = 0 THEN 1.0::DOUBLE ELSE right_::DOUBLE / kept END AS coverage, n FROM s)
    SELECT min_conf, n AS train_n FROM c ORDER BY coverage >= 0.5 DESC, CASE WHEN coverage >= 0.5 THEN min_conf ELSE -min_conf END LIMIT 1"""
)
def calibrated_confidence(spark, sf_dir):
    """The lowest confidence that keeps half of the kept training cases right."""
    cases = evaluation.split_cases(_cases(spark, sf_dir)).where("suite = 'admit' and split = 'train'")
    found = evaluation.calibrate_confidence(cases, coverage=0.5)
    return spark.createDataFrame([(found["thresholds"]["admit.min_conf"], found["train_n"])], "min_conf double, train_n long")


_FEATURES = {"slot": "slot", "stop": "no longer", "late": "deadline", "not": " not ", "now": "now", "bay": "bay"}
_FLAGS = ", ".join(f"contains(text, {o.quoted(v)}) AS \"{k}\"" for k, v in _FEATURES.items())
_PAIRS = [(a, b) for i, a in enumerate(_FEATURES) for b in list(_FEATURES)[i + 1 :]]


@query(
    f"""WITH {o.gated(o.MEMORY)}, f AS (SELECT importance AS label, seq % 2 = 0 AS train, {_FLAGS} FROM gated),
    e AS ({' UNION ALL '.join(f"SELECT '{a}&{b}' AS c, label, train, \"{a}\" AND \"{b}\" AS \"on\" FROM f" for a, b in _PAIRS)}),
    m AS (SELECT c, "on", label AS majority FROM (SELECT *, row_number() OVER (PARTITION BY c, "on" ORDER BY n DESC, label) AS r FROM (SELECT c, "on", label, count(*) AS n FROM e WHERE train GROUP BY 1, 2, 3)) WHERE r = 1),
    s AS (SELECT c, count(*) AS n, count(*) FILTER (label IS NOT DISTINCT FROM majority) AS "right" FROM e LEFT JOIN m USING (c, "on") WHERE NOT train GROUP BY 1) SELECT *, "right"::DOUBLE / n AS rate FROM s"""
)
def feature_pairs(spark, sf_dir):
    """How well each pair of words tells a line's importance."""
    from .catalogue import _decided

    m = _decided(memory_stream(spark, sf_dir)).select(F.col("importance").alias("label"), (F.col("seq") % 2 == 0).alias("train"), *[F.col("text").contains(v).alias(k) for k, v in _FEATURES.items()])
    return evaluation.feature_conjunctions(m, list(_FEATURES), "label", "train")


@query(f"WITH {_SCORED} SELECT suite, count(*) AS n, count(*) FILTER (ok) AS equal, count(*) FILTER (ok)::DOUBLE / count(*) AS rate FROM scored WHERE suite IN ('admit', 'importance') GROUP BY 1")
def label_agreement(spark, sf_dir):
    """How often the rules agree with the labels."""
    scored = _scored(spark, sf_dir).where(F.col("suite").isin("admit", "importance")).withColumn("right", F.lit(True))
    return metrics.agreement(scored, "ok", "right", "suite")


_JUDGED = f"{_SCORED}, j AS (SELECT suite AS gate, id, got AS stub, CASE WHEN substr(id, -1) = '4' THEN NULL WHEN substr(id, -1) = '8' THEN 'KEEP' ELSE got END AS live, expect AS label FROM told WHERE suite IN {records.JUDGED})"


def _judged(spark, sf_dir) -> DataFrame:
    """What the rules say beside a live judge that is silent on some cases and keeps on others."""
    last = F.substring("id", -1, 1)
    live = F.when(last == "4", None).when(last == "8", "KEEP").otherwise(F.col("got"))
    return _scored(spark, sf_dir).where(F.col("suite").isin(*records.JUDGED)).select(F.col("suite").alias("gate"), "id", F.col("got").alias("stub"), live.alias("live"), F.col("expect").alias("label"))


@query(f"WITH {_JUDGED} SELECT gate, id, '- ' || id || ' stub=' || coalesce(stub, 'none') || ' live=' || coalesce(live, 'none') || ' label=' || label || CASE WHEN stub IS NOT DISTINCT FROM live THEN ' agree' ELSE ' differ' END AS line FROM j")
def calibration_lines(spark, sf_dir):
    return records.case_lines(_judged(spark, sf_dir))


@query(f"WITH {_JUDGED}, c AS (SELECT count(*) FILTER (stub IS NOT DISTINCT FROM live) AS agree_count, count(*) AS total FROM j) SELECT *, printf('%d/%d = %.1f%%', agree_count, total, 100.0::DOUBLE * agree_count / total) AS agreement FROM c")
def vote_agreement(spark, sf_dir):
    return records.vote_summary(_judged(spark, sf_dir))
