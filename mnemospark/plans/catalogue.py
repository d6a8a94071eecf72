"""Every query of the engine by name, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import gate, judge, relation, text, words
from ..functions import thresholds as th
from ..operators import contamination, ledger, lifecycle, limits, metrics, recall, resume, similarity
from ..sources.folders import own_folder
from ..streaming import windows
from . import oracle as o
from .base import ORACLE_SQL, QUERIES, query, table, texts  # noqa: F401
from .memory_stream import memory_stream

def _decided(df: DataFrame, cutoffs: th.Gate | None = None) -> DataFrame:
    """df with the class of its text and the gate's decision."""
    d = df.withColumn("class", gate.classify(F.col("text"))).withColumn("__d", gate.decide_class(F.col("class"), cutoffs))
    return d.withColumns({"importance": F.col("__d.importance"), "action": F.col("__d.action"), "reason": F.array_join("__d.reasons", ";")}).drop("__d")


# --- Gate -----------------------------------------------------------------------------------------------------------


@query(f"WITH {o.gated('SELECT doc_id, text FROM documents')} SELECT doc_id, class, importance, action, reason FROM gated")
def gate_classify_docs(spark, sf_dir):
    return _decided(texts(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


_LINES = "SELECT doc_id, i - 1 AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


def _lines(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


@query(f"WITH {o.gated(_LINES)} SELECT doc_id, line::INT AS line, class, action FROM gated")
def gate_classify_lines(spark, sf_dir):
    return _decided(_lines(spark, sf_dir)).select("doc_id", "line", "class", "action")


@query(f"WITH {o.gated('SELECT conv_id, turn, text FROM conversations')} SELECT conv_id, turn, class, importance, action, reason FROM gated")
def gate_classify_conversations(spark, sf_dir):
    return _decided(texts(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).drop("text")


@query(f"WITH {o.gated('SELECT lang, text FROM documents')} SELECT lang, action, count(*) AS n FROM gated GROUP BY ALL")
def gate_actions_by_lang(spark, sf_dir):
    return _decided(texts(spark, sf_dir, "documents").select("lang", "text")).groupBy("lang", "action").agg(F.count("*").alias("n"))


@query(f"WITH {o.gated(o.MEMORY)} SELECT source, reason, count(*) AS n FROM gated GROUP BY ALL")
def gate_reasons_by_source(spark, sf_dir):
    return _decided(memory_stream(spark, sf_dir)).groupBy("source", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {o.gated(o.MEMORY)} SELECT class, importance, count(*) AS n FROM gated GROUP BY ALL")
def importance_histogram(spark, sf_dir):
    return _decided(memory_stream(spark, sf_dir)).groupBy("class", "importance").agg(F.count("*").alias("n"))


_ALTERED = th.Gate(min_conf=0.1, play_drop=0.9, sensitive_drop=0.95, stop_block=0.35, durable_min=0.25, importance_min=1)


@query(f"WITH {o.gated(o.MEMORY, _ALTERED)} SELECT user, seq, action, reason FROM gated")
def gate_override_cutoffs(spark, sf_dir):
    return _decided(memory_stream(spark, sf_dir), _ALTERED).select("user", "seq", "action", "reason")


@query(
    f"""WITH {o.gated(o.MEMORY)}, votes AS (SELECT * FROM {o.votes()})
    SELECT user, seq, CASE WHEN seq % 3 = 0 THEN 0.5::DOUBLE ELSE v.durable::DOUBLE END AS durable, CASE WHEN seq % 3 = 0 THEN 0.0::DOUBLE ELSE v.conf::DOUBLE END AS conf,
      CASE WHEN seq % 3 = 0 THEN 'QUARANTINE' ELSE action END AS action FROM gated JOIN votes v USING (class)"""
)
def recorded_votes(spark, sf_dir):
    """A judge that knows votes for two thirds of the lines; the others fail closed."""
    m = memory_stream(spark, sf_dir)
    known = m.where("seq % 3 != 0").select("user", "seq", gate.vote_of(gate.classify(F.col("text"))).alias("vote"))
    voted = m.select("user", "seq").join(known, ["user", "seq"], "left").withColumn("vote", gate.recorded_vote(F.col("vote")))
    return voted.select("user", "seq", "vote.durable", "vote.conf", gate.decide(F.col("vote"))["action"].alias("action"))


_REPLY = """'{"answers":{"dur":{"noul":' || (event_id % 11) || '.0e-1},"imp":{"choice":"' || CASE event_id % 4 WHEN 0 THEN 's' ELSE '' END || (event_id % 6) || '"},"sens":{"probability":' || (event_id % 5) || '.0e-1},"stop":{"choice":"s' || (event_id % 2) || '","probabilities":{"s0":' || (event_id % 8) || '.0e-1,"s1":' || (7 - event_id % 8) || '.0e-1}}}}'"""


@query(
    """WITH e AS (SELECT event_id, (event_id % 11) * 1.0::DOUBLE AS d10, event_id % 6 AS i, event_id % 4 = 0 AS s, CAST((event_id % 5) || '.0e-1' AS DOUBLE) AS sens, event_id % 2 AS stop,
        abs(CAST((7 - event_id % 8) || '.0e-1' AS DOUBLE) - CAST((event_id % 8) || '.0e-1' AS DOUBLE)) AS margin FROM events),
    v AS (SELECT event_id, CAST((event_id % 11) || '.0e-1' AS DOUBLE) AS durable, CASE WHEN s AND i <= 4 THEN i + 1 WHEN NOT s AND i BETWEEN 1 AND 5 THEN i ELSE -1 END::INT AS importance, sens AS sensitive,
        CASE WHEN stop = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS stop, margin FROM e),
    c AS (SELECT *, least(0.9::DOUBLE - abs(durable - 0.5::DOUBLE) * 0.05::DOUBLE, margin + 0.5::DOUBLE, 1.0::DOUBLE) AS conf FROM v)
    SELECT event_id, CASE WHEN importance > 0 THEN importance END AS importance, CASE WHEN importance > 0 THEN conf END AS conf,
      CASE WHEN importance < 0 THEN 'QUARANTINE' WHEN conf < 0.6 THEN 'QUARANTINE' WHEN sensitive > 0.7 THEN 'DROP' WHEN stop >= 0.58 THEN 'QUARANTINE' WHEN durable >= 0.58 AND importance >= 3 THEN 'STORE' ELSE 'DROP' END AS action,
      CASE WHEN importance < 0 THEN 'judge-halted' WHEN conf < 0.6 THEN 'uncertain-low-conf' WHEN sensitive > 0.7 THEN 'sensitive>0.7' WHEN stop >= 0.58 THEN 'stop>=0.58' WHEN durable >= 0.58 AND importance >= 3 THEN 'durable+important' ELSE 'not-durable-or-trivial' END AS reason
    FROM c"""
)
def judge_reply_parse(spark, sf_dir):
    """Replies of an external judge, one for each event, read and decided."""
    replies = texts(spark, sf_dir, "events").select("event_id", F.expr(_REPLY).alias("reply"))
    read = replies.withColumns({"vote": judge.read_reply(F.col("reply")), "d": judge.decide_reply(F.col("reply"))})
    return read.select("event_id", "vote.importance", "vote.conf", "d.action", F.array_join("d.reasons", ";").alias("reason"))


# --- Text -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length({o.norm('text')})::INT AS n_chars, sha256({o.norm('text')}) AS text_hash, len({o.tokens('text')})::INT AS n_tokens FROM documents")
def normalize_hash_docs(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir, "documents").select("doc_id", F.length(text.normalize(t)).alias("n_chars"), text.content_hash(t).alias("text_hash"), F.size(text.token_set(t)).alias("n_tokens"))


@query(f"SELECT conv_id, turn, {o.compare_form('text')} AS norm, {o.excerpt('text')} AS excerpt FROM conversations")
def compare_form_conversations(spark, sf_dir):
    return texts(spark, sf_dir, "conversations").select("conv_id", "turn", text.compare_form(F.col("text")).alias("norm"), text.excerpt(F.col("text")).alias("excerpt"))


@query(f"SELECT user, seq, array_to_string(list_sort({o.content('text')}), ' ') AS content, array_to_string(list_sort({o.numbers('text')}), ' ') AS numbers, {o.phrase('lower(text)', words.NEGATION)} AS negation, {o.phrase('lower(text)', words.STRONG)} AS strong, {o.phrase('lower(text)', words.WEAK)} AS weak FROM ({o.MEMORY})")
def content_tokens_memory(spark, sf_dir):
    t = F.col("text")
    listed = lambda c: F.array_join(F.array_sort(c), " ")
    return memory_stream(spark, sf_dir).select(
        "user", "seq", listed(text.content_tokens(t)).alias("content"), listed(text.number_tokens(t)).alias("numbers"), text.has_negation(t).alias("negation"), text.has_strong_update(t).alias("strong"), text.has_weak_update(t).alias("weak")
    )


# --- Duplicates and relations ---------------------------------------------------------------------------------------


@query(f"SELECT sha256({o.norm('text')}) AS text_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def exact_dup_groups(spark, sf_dir):
    return similarity.exact_groups(texts(spark, sf_dir, "documents"))


_LOOKUP = f"WITH k AS (SELECT doc_id, sha256({o.norm('text')}) AS h FROM documents), g AS (SELECT h, min(doc_id) AS first FROM k GROUP BY 1) SELECT doc_id, CASE WHEN first < doc_id THEN first END AS known_id FROM k LEFT JOIN g USING (h)"


@query(_LOOKUP)
def exact_dedupe_lookup(spark, sf_dir):
    """Every document looked up among those before it: known_id is the first earlier id of the same normal form."""
    docs = texts(spark, sf_dir, "documents").withColumn("user", F.lit("all"))
    known = docs.groupBy("user", text.normalize(F.col("text")).alias("text")).agg(F.min("doc_id").alias("id"))
    return similarity.exact_matches(docs, known).select("doc_id", F.when(F.col("known_id") < F.col("doc_id"), F.col("known_id")).alias("known_id"))


@query(_LOOKUP)
def exact_dedupe_lookup_all(spark, sf_dir):
    """The same under the name that it had beside a lookup of odd documents among even ones."""
    return exact_dedupe_lookup(spark, sf_dir)


_NEAR = f"""SELECT scope, old_id, new_id, score FROM (SELECT a.lang AS scope, a.doc_id AS old_id, b.doc_id AS new_id, {o.jaccard('a.t', 'b.t')} AS score
  FROM s a JOIN s b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.t), len(b.t)) >= 0.85 * greatest(len(a.t), len(b.t)) - 1e-9) WHERE score >= 0.85"""
_SETS = f"WITH s AS (SELECT doc_id, lang, {o.tokens('text')} AS t FROM documents)"


@query(f"{_SETS} {_NEAR}")
def near_dup_pairs(spark, sf_dir):
    return similarity.near_pairs(texts(spark, sf_dir, "documents"))


@query(f"{_SETS} {_NEAR}")
def near_dup_pairs_prefix(spark, sf_dir):
    return similarity.near_pairs_prefix(texts(spark, sf_dir, "documents"))


_REPS = f"WITH a AS (SELECT doc_id, lang, list_sort({o.tokens('text')}) AS t FROM documents), s AS (SELECT min(doc_id) AS doc_id, lang, t, count(*) AS n FROM a GROUP BY lang, t)"


@query(f"{_REPS}, p AS ({_NEAR}) SELECT scope, old_id AS x, new_id AS y, score, x.n AS x_n, y.n AS y_n FROM p JOIN s x ON x.lang = scope AND x.doc_id = old_id JOIN s y ON y.lang = scope AND y.doc_id = new_id")
def near_dup_sets(spark, sf_dir):
    """Near pairs between token sets, with how many documents have each: copies aren't expanded."""
    members, pairs = similarity.near_sets(texts(spark, sf_dir, "documents"))
    counts = lambda c: members.where("id = rep").select("scope", F.col("rep").alias(c), F.col("n").alias(f"{c}_n"))
    return pairs.join(counts("x"), ["scope", "x"]).join(counts("y"), ["scope", "y"]).select("scope", "x", "y", "score", "x_n", "y_n")


@query(f"{_SETS}, p AS ({_NEAR}) SELECT scope, new_id, old_id AS best_id, score FROM (SELECT *, row_number() OVER (PARTITION BY scope, new_id ORDER BY score DESC, old_id) AS r FROM p) WHERE r = 1")
def best_near_dup(spark, sf_dir):
    return similarity.best_near(texts(spark, sf_dir, "documents"))


def _admitted(spark, sf_dir) -> DataFrame:
    """The first row of each distinct admitted text of a user."""
    stored = _decided(memory_stream(spark, sf_dir)).where("action = 'STORE'").withColumn("norm", text.normalize(F.col("text")))
    return stored.groupBy("user", "norm").agg(F.min_by("text", "seq").alias("text"), F.min("seq").alias("seq")).drop("norm")


def _suspicious(spark, sf_dir) -> DataFrame:
    return similarity.suspicious_pairs(_admitted(spark, sf_dir))


@query(f"WITH {o.SUSPICIOUS} SELECT scope, old_id, new_id, score, rank FROM top")
def suspicion_pairs_top5(spark, sf_dir):
    return _suspicious(spark, sf_dir).where(F.col("rank") <= th.SCREEN_PAIRS).select("scope", "old_id", "new_id", "score", "rank")


@query(f"WITH {o.SUSPICIOUS} SELECT scope, new_id, count(*) AS flagged, greatest(count(*) - {th.SCREEN_PAIRS}, 0) AS cut FROM ranked GROUP BY ALL")
def suspicion_cut_audit(spark, sf_dir):
    return _suspicious(spark, sf_dir).groupBy("scope", "new_id").agg(F.count("*").alias("flagged")).withColumn("cut", F.greatest(F.col("flagged") - th.SCREEN_PAIRS, F.lit(0)))


@query(f"WITH {o.SUSPICIOUS} SELECT scope, old_id, new_id, strict, lenient FROM voted")
def committee_votes(spark, sf_dir):
    top = _suspicious(spark, sf_dir).where(F.col("rank") <= th.SCREEN_PAIRS)
    return similarity.committee_outcomes(top).select("scope", "old_id", "new_id", "strict", "lenient")


_ACT = "CASE {r} WHEN 'supersede' THEN 'TOMBSTONE' WHEN 'conflict_unresolved' THEN 'CONFLICT' ELSE 'KEEP' END"


@query(
    f"""WITH {o.SUSPICIOUS} SELECT scope, old_id, new_id, strict AS relation, strict = lenient AS agreed, CASE WHEN strict = lenient THEN {_ACT.format(r='strict')} ELSE 'KEEP' END AS action,
    CASE WHEN strict <> lenient THEN 'disagree-veto' WHEN strict = 'conflict_unresolved' THEN 'conflict-unresolved-never-tombstone' ELSE strict || '-agreed' END AS reasons FROM voted"""
)
def committee_outcomes(spark, sf_dir):
    top = _suspicious(spark, sf_dir).where(F.col("rank") <= th.SCREEN_PAIRS)
    return similarity.committee_outcomes(top).select("scope", "old_id", "new_id", "relation", "agreed", "action", "reasons")


_LIVE_VOTES = ["supersede", "contradict", "conflict_unresolved", "coexist", "unrelated", "same", "nonsense"]


@query(
    f"""WITH {o.SUSPICIOUS}, four AS (SELECT *, {_LIVE_VOTES}[(old_id % 7 + 1)::INT] AS la, {_LIVE_VOTES}[((old_id + (CASE WHEN new_id % 3 = 0 THEN 1 ELSE 0 END)) % 7 + 1)::INT] AS lb FROM voted),
    canon AS (SELECT *, CASE WHEN la = 'contradict' THEN 'conflict_unresolved' ELSE la END AS live FROM four)
    SELECT scope, old_id, new_id,
      CASE WHEN la = 'nonsense' OR lb = 'nonsense' THEN 'unrelated' WHEN la <> lb THEN la WHEN strict <> lenient THEN strict ELSE live END AS relation,
      la <> 'nonsense' AND lb <> 'nonsense' AND la = lb AND strict = lenient AND live = strict AS agreed,
      CASE WHEN la <> 'nonsense' AND la = lb AND strict = lenient AND live = strict THEN {_ACT.format(r='live')} ELSE 'KEEP' END AS action,
      CASE WHEN la = 'nonsense' OR lb = 'nonsense' THEN 'invalid-label-veto' WHEN la <> lb THEN 'disagree-veto;live-pair-disagree' WHEN strict <> lenient THEN 'disagree-veto;offline-pair-disagree'
        WHEN live <> strict THEN 'disagree-veto;live-offline-disagree' WHEN live = 'conflict_unresolved' THEN 'conflict-unresolved-never-tombstone;live-plus-offline-agreed' ELSE live || '-agreed;live-plus-offline-agreed' END AS reasons
    FROM canon"""
)
def four_voter_outcomes(spark, sf_dir):
    """Live votes by the ids' remainders beside the offline ones."""
    v = similarity.committee_outcomes(_suspicious(spark, sf_dir).where(F.col("rank") <= th.SCREEN_PAIRS))
    labels = F.array(*map(F.lit, _LIVE_VOTES))
    a = F.element_at(labels, (F.col("old_id") % 7 + 1).cast("int"))
    b = F.element_at(labels, ((F.col("old_id") + F.when(F.col("new_id") % 3 == 0, 1).otherwise(0)) % 7 + 1).cast("int"))
    voted = v.select("scope", "old_id", "new_id", "strict", "lenient", a.alias("la"), b.alias("lb"))
    d = voted.withColumn("d", relation.committee_of_four(F.col("la"), F.col("lb"), F.col("strict"), F.col("lenient")))
    return d.select("scope", "old_id", "new_id", "d.relation", "d.agreed", "d.action", F.array_join("d.reasons", ";").alias("reasons"))


@query("SELECT a.conv_id, a.turn AS old_id, b.turn AS new_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def candidate_pairs_turns(spark, sf_dir):
    return similarity.candidate_pairs(table(spark, sf_dir, "conversations"), "turn", "conv_id", "text").select("conv_id", "old_id", "new_id")


# --- The ledger -----------------------------------------------------------------------------------------------------


def _commands(spark, sf_dir) -> DataFrame:
    return ledger.gated(memory_stream(spark, sf_dir))


@query(f"WITH RECURSIVE {o.folded()} SELECT * FROM audit")
def put_fold_bridge(spark, sf_dir):
    return ledger.run(_commands(spark, sf_dir))


@query(f"WITH RECURSIVE {o.folded(bridge=False)} SELECT user, seq, outcome, fact_id, merged_into, score FROM audit")
def leader_fold(spark, sf_dir):
    """Admission without the bridge: greedy leaders in the order of arrival."""
    return ledger.run(_commands(spark, sf_dir), settings=ledger.Settings(bridge=False)).select("user", "seq", "outcome", "fact_id", "merged_into", "score")


@query(f"WITH RECURSIVE {o.folded(cap=100)} SELECT user, outcome, count(*) AS n FROM audit GROUP BY ALL")
def cap_enforcement(spark, sf_dir):
    return ledger.run(_commands(spark, sf_dir), settings=ledger.Settings(memory_cap=100)).groupBy("user", "outcome").agg(F.count("*").alias("n"))


_LAST = f"""SELECT f.id AS id, user, f.text AS text, sha256({o.norm('f.text')}) AS text_hash, f.source AS source, f.created AS created, f.heir AS tombstoned_by, CASE WHEN NOT f.live THEN 'supersede-auto-spot' END AS tombstone_reason,
  CASE WHEN NOT f.live THEN 'auto-spot' END AS tombstone_actor, f.other AS conflict_with, 'STORE' AS gate_action, f.importance AS importance, 'stub:RuleJudge' AS judge, f.decided AS decided_at FROM last"""


@query(f"WITH RECURSIVE {o.folded()} {_LAST}")
def ledger_facts(spark, sf_dir):
    return ledger.run(_commands(spark, sf_dir), "facts")


@query(
    f"""WITH RECURSIVE {o.folded()}, shown AS (SELECT user, seq, unnest(string_split(relations, ',')) AS r FROM audit WHERE relations <> ''),
    marked AS (SELECT user, seq AS new_id, split_part(r, ':', 1)::BIGINT AS old_id FROM shown WHERE split_part(r, ':', 3) = 'CONFLICT'),
    open AS (SELECT user, count(*) AS conflicts FROM marked m WHERE NOT EXISTS (SELECT 1 FROM audit a WHERE a.user = m.user AND a.outcome = 'resurrect' AND a.seq > m.new_id AND a.fact_id IN (m.old_id, m.new_id)) GROUP BY 1),
    l AS (SELECT user, count(*) FILTER (f.live) AS live FROM last GROUP BY 1), q AS (SELECT user, count(*) AS quarantined FROM audit WHERE outcome = 'quarantine' GROUP BY 1)
    SELECT user, coalesce(live, 0) AS live, coalesce(quarantined, 0) AS quarantined, coalesce(conflicts, 0) AS conflicts FROM l FULL JOIN q USING (user) FULL JOIN open USING (user)"""
)
def ledger_status(spark, sf_dir):
    """One fold, committed to a store, and counts of what the store has."""
    store = resume.open_store(spark, own_folder(spark, "store"))
    resume.advance(store, _commands(spark, sf_dir))
    return lifecycle.status(store.read("facts"), store.read("held"), store.read("conflicts"))


@query(f"WITH RECURSIVE {o.folded()} {_LAST}")
def ledger_resumed(spark, sf_dir):
    """The stream in two parts by seq: the first is folded into a store, the second goes on from there."""
    c = _commands(spark, sf_dir)
    half = c.agg(F.floor((F.min("seq") + F.max("seq")) / 2)).first()[0] or 0
    store = resume.open_store(spark, own_folder(spark, "store"))
    for part in (F.col("seq") <= half, F.col("seq") > half):
        resume.advance(store, c.where(part))
    return store.read("facts")


@query(f"WITH {o.gated(o.MEMORY)} SELECT user, action, count(*) AS n FROM gated GROUP BY ALL")
def admit_partition(spark, sf_dir):
    """What admission does with each user's lines before the fold."""
    return _commands(spark, sf_dir).groupBy("user", F.col("gate_action").alias("action")).agg(F.count("*").alias("n"))


# --- Views and keyed updates, on facts made from the stream by remainders -------------------------------------------

_FACTS = f"""SELECT seq AS id, user, text, source, CASE WHEN seq % 7 = 3 THEN seq + 1 END AS tombstoned_by, CASE WHEN seq % 7 = 3 THEN 'supersede' END AS tombstone_reason, CASE WHEN seq % 7 = 3 THEN 'code' END AS tombstone_actor,
  CASE WHEN seq % 10 = 4 THEN seq + 1 WHEN seq % 10 = 5 THEN seq - 1 WHEN seq % 10 = 8 THEN seq + 1 END AS conflict_with, CASE WHEN seq % 2 = 0 THEN 'STORE' END AS gate_action,
  CASE WHEN seq % 2 = 0 THEN (seq % 5 + 1)::INT END AS importance, CASE WHEN seq % 2 = 0 THEN 'stub' END AS judge, CASE WHEN seq % 2 = 0 THEN seq END AS decided_at FROM ({o.MEMORY})"""
_CONFLICTS = "SELECT id AS old_id, id + 1 AS new_id FROM facts WHERE id % 10 = 4"


def _facts(spark, sf_dir) -> DataFrame:
    s, r = F.col("seq"), F.col("seq") % 10
    dead, even = s % 7 == 3, s % 2 == 0
    return memory_stream(spark, sf_dir).select(
        s.alias("id"), "user", "text", "source", F.when(dead, s + 1).alias("tombstoned_by"), F.when(dead, "supersede").alias("tombstone_reason"), F.when(dead, "code").alias("tombstone_actor"),
        F.when(r == 4, s + 1).when(r == 5, s - 1).when(r == 8, s + 1).alias("conflict_with"), F.when(even, "STORE").alias("gate_action"), F.when(even, (s % 5 + 1).cast("int")).alias("importance"),
        F.when(even, "stub").alias("judge"), F.when(even, s).alias("decided_at"),
    )


def _conflicts(facts: DataFrame) -> DataFrame:
    return facts.where("id % 10 = 4").select(F.col("id").alias("old_id"), (F.col("id") + 1).alias("new_id"))


@query(f"WITH facts AS ({_FACTS}) SELECT id, user, text, source, gate_action, importance, judge, decided_at FROM facts WHERE tombstoned_by IS NULL")
def live_view(spark, sf_dir):
    return lifecycle.live(_facts(spark, sf_dir)).select("id", "user", "text", "source", "gate_action", "importance", "judge", "decided_at")


@query(f"WITH facts AS ({_FACTS}) SELECT id, text, source, tombstoned_by FROM facts WHERE tombstoned_by IS NOT NULL")
def tombstoned_view(spark, sf_dir):
    return lifecycle.tombstoned(_facts(spark, sf_dir)).select("id", "text", "source", "tombstoned_by")


@query(f"WITH facts AS ({_FACTS}), c AS ({_CONFLICTS}) SELECT old_id, new_id, a.user FROM c JOIN facts a ON a.id = old_id JOIN facts b ON b.id = new_id UNION SELECT old_id, new_id, b.user FROM c JOIN facts a ON a.id = old_id JOIN facts b ON b.id = new_id")
def conflicts_either_side(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return lifecycle.conflicts_of_users(_conflicts(f), f)


@query(f"WITH {o.gated(o.MEMORY)} SELECT user, seq AS qid, text, reason FROM gated WHERE action = 'QUARANTINE'")
def quarantine_queue(spark, sf_dir):
    return _decided(memory_stream(spark, sf_dir)).where("action = 'QUARANTINE'").select("user", F.col("seq").alias("qid"), "text", "reason")


@query(
    f"""WITH facts AS ({_FACTS}), c AS ({_CONFLICTS}), cu AS (SELECT old_id, new_id, a.user FROM c JOIN facts a ON a.id = old_id JOIN facts b ON b.id = new_id UNION SELECT old_id, new_id, b.user FROM c JOIN facts a ON a.id = old_id JOIN facts b ON b.id = new_id),
    l AS (SELECT user, count(*) FILTER (tombstoned_by IS NULL) AS live FROM facts GROUP BY 1), q AS (SELECT user, count(*) AS quarantined FROM facts WHERE id % 13 = 0 GROUP BY 1), n AS (SELECT user, count(*) AS conflicts FROM cu GROUP BY 1)
    SELECT l.user, live, coalesce(quarantined, 0) AS quarantined, coalesce(conflicts, 0) AS conflicts FROM l LEFT JOIN q USING (user) LEFT JOIN n USING (user)"""
)
def status_counts(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return lifecycle.status(f, f.where("id % 13 = 0").select("user"), _conflicts(f))


_MARKS = "id, tombstoned_by, tombstone_reason, tombstone_actor, conflict_with"


@query(
    f"""WITH facts AS ({_FACTS}), m AS (SELECT DISTINCT id // 3 * 3 AS id, max(id) OVER (PARTITION BY id // 3) AS last FROM facts)
    SELECT f.id, CASE WHEN m.id IS NOT NULL THEN m.last ELSE tombstoned_by END AS tombstoned_by, CASE WHEN m.id IS NOT NULL THEN 'human-retire' ELSE tombstone_reason END AS tombstone_reason,
      CASE WHEN m.id IS NOT NULL THEN 'human' ELSE tombstone_actor END AS tombstone_actor, conflict_with FROM facts f LEFT JOIN m ON m.id = f.id"""
)
def tombstone_marks(spark, sf_dir):
    """Each fact retires the first of its three; the last to do so stands."""
    f = _facts(spark, sf_dir)
    marks = f.select((F.floor(F.col("id") / 3) * 3).alias("id"), F.col("id").alias("by"), F.lit("human-retire").alias("reason"), F.lit("human").alias("actor"), F.col("id").alias("seq"))
    return lifecycle.tombstone(f, marks).select(*_MARKS.split(", "))


@query(
    f"""WITH facts AS ({_FACTS}), p AS (SELECT id AS old_id, id + 2 AS new_id, id AS seq FROM facts WHERE id % 4 = 1), e AS (SELECT old_id AS id, new_id AS w, seq FROM p UNION ALL SELECT new_id, old_id, seq FROM p), l AS (SELECT id, arg_max(w, seq) AS w FROM e GROUP BY 1)
    SELECT f.id, coalesce(l.w, f.conflict_with) AS conflict_with FROM facts f LEFT JOIN l USING (id)"""
)
def conflict_marks(spark, sf_dir):
    f = _facts(spark, sf_dir)
    pairs = f.where("id % 4 = 1").select(F.col("id").alias("old_id"), (F.col("id") + 2).alias("new_id"), F.col("id").alias("seq"))
    return lifecycle.mark_conflicts(f, pairs).select("id", "conflict_with")


@query(
    f"""WITH facts AS ({_FACTS}), r AS (SELECT id, conflict_with FROM facts WHERE id % 6 = 0 OR id % 10 = 4)
    SELECT f.id, CASE WHEN r.id IS NULL THEN f.tombstoned_by END AS tombstoned_by, CASE WHEN r.id IS NULL THEN f.tombstone_reason END AS tombstone_reason, CASE WHEN r.id IS NULL THEN f.tombstone_actor END AS tombstone_actor,
      CASE WHEN r.id IS NULL AND NOT EXISTS (SELECT 1 FROM r b WHERE b.conflict_with = f.id AND f.conflict_with = b.id) THEN f.conflict_with END AS conflict_with FROM facts f LEFT JOIN r ON r.id = f.id"""
)
def restore_marks(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return lifecycle.restore(f, _conflicts(f), f.where("id % 6 = 0 or id % 10 = 4").select("id"))[0].select(*_MARKS.split(", "))


@query(f"WITH facts AS ({_FACTS}) SELECT id, CASE WHEN id % 3 = 0 THEN 'STORE' ELSE gate_action END AS gate_action, CASE WHEN id % 3 = 0 THEN 5 ELSE importance END::INT AS importance, judge, CASE WHEN id % 3 = 0 THEN id + 1 ELSE decided_at END AS decided_at FROM facts")
def provenance_merge(spark, sf_dir):
    f = _facts(spark, sf_dir)
    again = f.where("id % 3 = 0").select("id", F.lit("STORE").alias("gate_action"), F.lit(5).alias("importance"), F.lit(None).cast("string").alias("judge"), (F.col("id") + 1).alias("decided_at"))
    return lifecycle.merge_provenance(f, again).select("id", "gate_action", "importance", "judge", "decided_at")


@query(f"WITH {o.gated(o.MEMORY)}, q AS (SELECT seq AS qid, text FROM gated WHERE action = 'QUARANTINE') SELECT qid, CASE WHEN qid % 3 = 0 THEN 'deny' ELSE 'approve' END AS decision, 'checked' AS reason, 'human' AS actor FROM q WHERE qid % 4 <> 0")
def review_decisions(spark, sf_dir):
    """Held lines approved or denied, those with a blank reason not at all."""
    q = _decided(memory_stream(spark, sf_dir)).where("action = 'QUARANTINE'").select(F.col("seq").alias("qid"), "text")
    decisions = q.select("qid", F.when(F.col("qid") % 3 == 0, "deny").otherwise("approve").alias("decision"), F.when(F.col("qid") % 4 == 0, " ").otherwise(" checked ").alias("reason"))
    return lifecycle.review(q, decisions)[2]


# --- Recall ---------------------------------------------------------------------------------------------------------

_SCORED = f"""q AS (SELECT conv_id % 20 AS user, conv_id AS query_id, {o.tokens('text')} AS t FROM conversations WHERE turn = (SELECT min(turn) FROM conversations)),
  f AS (SELECT conv_id % 20 AS user, conv_id * 1000 + turn AS id, text, {o.tokens('text')} AS t FROM conversations WHERE turn > (SELECT min(turn) FROM conversations)),
  scored AS (SELECT query_id, id, text, {o.jaccard('q.t', 'f.t')} AS score FROM q JOIN f USING (user))"""
_RECALL_GATE, _BUDGET = 0.02, 1500
_SELECTED = f"""best AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM scored WHERE score >= {_RECALL_GATE}),
  selected AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM best WHERE score >= best * (1 - 0.45::DOUBLE)) WHERE rank <= 8)"""


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The first turn of each conversation as a query over the other turns of its twentieth."""
    c = texts(spark, sf_dir, "conversations").withColumn("user", F.col("conv_id") % 20)
    first = c.agg(F.min("turn").alias("first"))
    both = c.join(F.broadcast(first))  # a single row
    queries = both.where("turn = first").select("user", F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    return queries, both.where("turn > first").select("user", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


@query(f"WITH {_SCORED} SELECT query_id, id, score FROM scored")
def recall_scores(spark, sf_dir):
    return recall.score(*_asked(spark, sf_dir), with_text=False)


@query(f"WITH {_SCORED}, {_SELECTED} SELECT query_id, id, score, rank FROM selected")
def recall_select(spark, sf_dir):
    return recall.selected(*_asked(spark, sf_dir), gate=_RECALL_GATE).select("query_id", "id", "score", "rank")


@query(f"WITH {_SCORED} SELECT query_id, id, score FROM scored WHERE score >= 0.05")
def recall_matches(spark, sf_dir):
    """The facts that pass a gate, through blocks' indexes of tokens."""
    return recall.matches(*_asked(spark, sf_dir), gate=0.05, with_text=False)


_PACKED = "SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS packed, count(*) AS n FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM {rows}) WHERE used <= {budget} GROUP BY 1"


@query(f"WITH {_SCORED}, {_SELECTED} {_PACKED.format(rows='selected', budget=_BUDGET)}")
def recall_pack(spark, sf_dir):
    return recall.pack(recall.selected(*_asked(spark, sf_dir), gate=_RECALL_GATE), _BUDGET)


@query(
    f"""WITH {_SCORED}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, id) AS n FROM scored) WHERE n = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM once) {_PACKED.format(rows='ranked', budget=4000)}"""
)
def inject_pack(spark, sf_dir):
    return recall.injected(*_asked(spark, sf_dir))


# --- Contamination --------------------------------------------------------------------------------------------------


@query(
    f"""WITH s AS (SELECT DISTINCT path, s FROM (SELECT doc_id::VARCHAR AS path, trim(s) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents UNION ALL SELECT doc_id, text FROM documents)) WHERE s <> ''),
    p AS (SELECT DISTINCT text FROM benchmark), pn AS (SELECT DISTINCT {o.compare_form('text')} AS n FROM p),
    pt AS (SELECT DISTINCT list_distinct(string_split(n, ' ')) AS t FROM pn WHERE n <> ''), sn AS (SELECT path, s, {o.compare_form('s')} AS n FROM s),
    st AS (SELECT path, s, list_distinct(string_split(n, ' ')) AS t FROM sn WHERE n <> ''),
    ov AS (SELECT path, s, max({o.jaccard('st.t', 'pt.t')}) AS score FROM st, pt WHERE len(st.t) >= 3 AND least(len(st.t), len(pt.t)) >= 0.8 * greatest(len(st.t), len(pt.t)) - 1e-9 GROUP BY 1, 2),
    found AS (SELECT path, s, 0 AS kind, 1.0::DOUBLE AS score FROM s WHERE s IN (SELECT text FROM p) UNION ALL SELECT path, s, 1, 1.0 FROM s WHERE s IN (SELECT sha256(text) FROM p)
      UNION ALL SELECT path, s, 2, 1.0 FROM sn WHERE n <> '' AND n IN (SELECT n FROM pn) UNION ALL SELECT path, s, 3, score FROM ov WHERE score >= 0.8),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY kind, score DESC, s) AS k FROM found)
    SELECT path, ['exact-text', 'content-hash', 'normalized-text', 'token-overlap'][kind + 1] AS "check", score, {o.excerpt('s')} AS excerpt FROM r WHERE k = 1"""
)
def contamination_flags(spark, sf_dir):
    """Documents, whole and by line, that hold texts of the benchmark."""
    d = texts(spark, sf_dir, "documents")
    strings = d.select(F.col("doc_id").cast("string").alias("path"), F.explode(F.concat(F.split("text", "\n"), F.array("text"))).alias("s")).select("path", F.trim("s").alias("s")).where("s != ''")
    return contamination.flags(strings, table(spark, sf_dir, "benchmark"))


_CLAIMS = ["split: test", "tuned_on = \"test\"", "splitter: test", "split: testing", "notes\\nTrained_On: 'test'", "fitted on test"]
_BODY = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {o.quoted(c.replace(chr(92) + 'n', ' '))}" for i, c in enumerate(_CLAIMS)) + " END"


@query(
    f"""WITH b AS (SELECT event_id::VARCHAR AS path, regexp_extract({_BODY}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(split|tuned_on|trained_on|train_on|fitted_on)\\s*[:=]\\s*[''"]?\\s*test\\s*[''"]?($|[^\\p{{L}}\\p{{N}}_])', 2) AS f FROM events)
    SELECT path, lower(f) || '=test' AS excerpt FROM b WHERE f <> ''"""
)
def split_field_claims(spark, sf_dir):
    body = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.expr(_BODY.replace("''", "\\'")).alias("body"), F.lit(False).alias("is_json"))
    return contamination.split_field(body)


@query(f"WITH l AS ({_LINES}), n AS (SELECT doc_id % 2 AS half, {o.compare_form('text')} AS norm FROM l), k AS (SELECT * FROM n WHERE norm <> '' AND len(string_split(norm, ' ')) >= 3) SELECT norm FROM k WHERE half = 0 INTERSECT SELECT norm FROM k WHERE half = 1")
def cross_split_overlap(spark, sf_dir):
    """Lines of three words or more that stand in even and odd documents."""
    lines = _lines(spark, sf_dir)
    return contamination.shared_strings(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1"), 3)


# --- Evaluation -----------------------------------------------------------------------------------------------------

_BY_HASH = "sha256(doc_id::VARCHAR)"


@query(f"SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY {_BY_HASH}) <= count(*) OVER (PARTITION BY lang) // 2 THEN 'train' ELSE 'test' END AS split FROM documents")
def split_stratified(spark, sf_dir):
    return metrics.split(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.sha2(F.col("doc_id").cast("string"), 256), "lang")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE (r - 1) % 4 = 0")
def sample_stride(spark, sf_dir):
    return metrics.every(table(spark, sf_dir, "documents").select("doc_id", "lang"), 4, "doc_id", "lang")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY source) // 10) AS step FROM documents) WHERE r % step = 0 AND r // step < 10")
def sample_even(spark, sf_dir):
    return metrics.sample_evenly(table(spark, sf_dir, "documents").select("doc_id", "source"), 10, "doc_id", "source")


_LABELLED = "SELECT doc_id, quality = 1 AS good, toxic = 1 AS toxic, length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::DOUBLE / length(text) AS score FROM documents JOIN labels USING (doc_id) WHERE length(text) > 0"


def _labelled(spark, sf_dir) -> DataFrame:
    """Labelled documents with the share of letters in their text."""
    both = texts(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id").where(F.length("text") > 0)
    share = F.length(F.regexp_replace("text", r"[^\p{L}]", "")) / F.length("text")
    return both.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), share.alias("score"))


_PRF = "CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall"
_F1 = "CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1"


@query(f"WITH l AS ({_LABELLED}), c AS (SELECT toxic, count(*) FILTER (score >= 0.8 AND good) AS tp, count(*) FILTER (score >= 0.8 AND NOT good) AS fp, count(*) FILTER (score < 0.8 AND good) AS fn FROM l GROUP BY 1), p AS (SELECT *, {_PRF} FROM c) SELECT *, {_F1} FROM p")
def prf_labels(spark, sf_dir):
    return metrics.prf(_labelled(spark, sf_dir), F.col("score") >= 0.8, F.col("good"), "toxic")


def _values(grid: tuple[float, ...]) -> str:
    return ", ".join(f"({x}::DOUBLE)" for x in grid)


_SWEEP = f"l AS ({_LABELLED}), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND good) AS tp, count(*) FILTER (score >= threshold AND NOT good) AS fp, count(*) FILTER (score < threshold AND good) AS fn FROM l, (VALUES {_values(th.THRESHOLD_GRID)}) g(threshold) GROUP BY 1), p AS (SELECT *, {_PRF} FROM c), s AS (SELECT *, {_F1} FROM p)"


@query(f"WITH {_SWEEP} SELECT * FROM s")
def threshold_sweep(spark, sf_dir):
    return metrics.threshold_sweep(_labelled(spark, sf_dir).withColumnRenamed("good", "is_positive"))


@query(f"WITH {_SWEEP} SELECT * FROM s ORDER BY f1 DESC, threshold LIMIT 1")
def threshold_best(spark, sf_dir):
    return metrics.best_threshold(threshold_sweep(spark, sf_dir))


_CONFORMAL = f"l AS ({_LABELLED}), c AS (SELECT min_conf, count(*) FILTER (score >= min_conf) AS kept, count(*) FILTER (score >= min_conf AND good) AS right_, count(*) AS n FROM l, (VALUES {_values(th.CONFORMAL_GRID)}) g(min_conf) GROUP BY 1), s AS (SELECT min_conf, CASE WHEN kept = 0 THEN 1.0::DOUBLE ELSE right_::DOUBLE / kept END AS coverage, (n - kept)::DOUBLE / n AS abstention, kept, n - kept AS abstained, n FROM c)"


@query(f"WITH {_CONFORMAL} SELECT * FROM s")
def conformal_sweep(spark, sf_dir):
    return metrics.conformal_sweep(_labelled(spark, sf_dir).select(F.col("score").alias("confidence"), F.col("good").alias("is_correct")))


@query(f"WITH {_CONFORMAL} SELECT * FROM s ORDER BY coverage >= 0.9 DESC, CASE WHEN coverage >= 0.9 THEN min_conf ELSE -min_conf END LIMIT 1")
def conformal_best(spark, sf_dir):
    return metrics.best_cutoff(conformal_sweep(spark, sf_dir))


@query("SELECT event_type, len(v) AS n, v[least(len(v) - 1, floor(0.5 * len(v)))::INT + 1] AS p50, v[least(len(v) - 1, floor(0.95 * len(v)))::INT + 1] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)")
def latency_pct(spark, sf_dir):
    return metrics.percentile_by_index(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")


@query(f"WITH {o.gated('SELECT role, text FROM conversations')} SELECT role, count(*) AS n, count(*) FILTER ((action = 'QUARANTINE') = (length(text) > 200)) AS equal, count(*) FILTER ((action = 'QUARANTINE') = (length(text) > 200))::DOUBLE / count(*) AS rate FROM gated GROUP BY 1")
def agreement_rates(spark, sf_dir):
    """How often the gate's quarantine agrees with a rule on length."""
    c = _decided(table(spark, sf_dir, "conversations")).select("role", (F.col("action") == "QUARANTINE").alias("a"), (F.length("text") > 200).alias("b"))
    return metrics.agreement(c, "a", "b", "role")


@query("SELECT source, lang AS majority, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1")
def majority_label(spark, sf_dir):
    return metrics.majority(table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT sha256(string_agg(h, ',' ORDER BY h)) AS train_hash, count(*) AS train_n FROM (SELECT sha256(text) AS h FROM benchmark)")
def train_hash(spark, sf_dir):
    return metrics.train_hash(table(spark, sf_dir, "benchmark"))


@query("SELECT sha256(string_agg(h, ',' ORDER BY h)) AS train_hash, count(*) AS train_n FROM (SELECT sha256(text) AS h FROM documents)")
def train_hash_documents(spark, sf_dir):
    return metrics.train_hash(texts(spark, sf_dir, "documents"))


# --- Limits and requests --------------------------------------------------------------------------------------------


def _calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.length("props").cast("long").alias("chars"))


@query("SELECT event_id, user_id, count(*) OVER w AS calls, CAST(sum(length(props)) OVER w AS BIGINT) AS chars_used FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def rate_offered_60s(spark, sf_dir):
    return limits.offered_load(_calls(spark, sf_dir)).select("event_id", "user_id", "calls", "chars_used")


@query(f"WITH RECURSIVE {o.admitted('user_id', 2, 3600)}")
def rate_admitted(spark, sf_dir):
    """At most two calls of a user in an hour."""
    return limits.admitted_load(_calls(spark, sf_dir), calls=2, seconds=3600)


@query(
    """WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM f)
    SELECT user_id, epoch_us(min(ts)) AS began_us, epoch_us(max(ts)) + 1800000000 AS ended_us, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS chars FROM g GROUP BY user_id, s"""
)
def user_sessions(spark, sf_dir):
    """Runs of a user's calls with less than half an hour between them, by the function that streams use."""
    found = windows.sessions(_calls(spark, sf_dir), "user_id", F.sum("chars").alias("chars"))
    return found.select("user_id", F.unix_micros("began").alias("began_us"), F.unix_micros("ended").alias("ended_us"), "n", "chars")


@query(f"WITH RECURSIVE {o.admitted('0', 3, 1800)}")
def rate_admitted_all(spark, sf_dir):
    """One budget for all users together: at most three calls in half an hour."""
    return limits.admitted_load(_calls(spark, sf_dir).withColumn("user_id", F.lit(0)), calls=3, seconds=1800)


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 503 WHEN user_id % 10 = 0 THEN 400 WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 400 WHEN event_id % 7 = 0 THEN 429 ELSE 200 END::INT AS status FROM events")
def request_status(spark, sf_dir):
    """The order in which requests are refused: switched off, without user, unknown, over budget."""
    from ..facade import status_of

    e = table(spark, sf_dir, "events")
    user = F.when(F.col("user_id") % 10 == 0, " ").otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", status_of(F.col("event_id") % 50 == 0, user, F.col("event_type"), F.col("event_id") % 7 == 0, ("click", "view", "purchase")).alias("status"))


@query(o.MEMORY)
def memory_stream_rows(spark, sf_dir):
    return memory_stream(spark, sf_dir)


@query(f"SELECT user, count(*) AS n, count(DISTINCT {o.norm('text')}) AS distinct_texts FROM ({o.MEMORY}) GROUP BY 1")
def distinct_texts_by_user(spark, sf_dir):
    m = memory_stream(spark, sf_dir).withColumn("norm", text.normalize(F.col("text")))
    return m.groupBy("user").agg(F.count("*").alias("n"), F.count_distinct("norm").alias("distinct_texts"))


@query(f"SELECT user, seq, text FROM (SELECT *, max(seq) OVER (PARTITION BY user, {o.norm('text')}) AS m FROM ({o.MEMORY})) WHERE seq = m")
def latest_of_each_text(spark, sf_dir):
    """The last row of each user's text."""
    w = Window.partitionBy("user", text.normalize(F.col("text")))
    return memory_stream(spark, sf_dir).withColumn("m", F.max("seq").over(w)).where("seq = m").select("user", "seq", "text")


from . import cases, commands  # noqa: E402, F401  (they register their queries)
