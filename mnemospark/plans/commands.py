"""Queries over a stream of all kinds of commands, and over stored facts and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation, ledger, lifecycle, redteam
from ..sources import folders, sqlite, tables
from . import oracle as o
from .base import query, table, texts
from .catalogue import _FACTS, _facts
from .memory_stream import memory_stream

#: One command for each line of the memory stream: puts, and what is done to facts and held lines before it.
_OPS = {8: "supersede", 9: "quarantine", 10: "restore", 11: "retire", 13: "tombstone", 14: "mark_conflict", 15: "quarantine", 16: "release", 17: "approve", 18: "deny", 19: "supersede"}
_OP = "CASE seq % 20 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _OPS.items()) + " ELSE 'put' END"
_TARGET = """CASE WHEN op = 'put' OR op = 'quarantine' THEN NULL WHEN op IN ('release', 'approve', 'deny') THEN max(CASE WHEN op = 'quarantine' THEN seq END) OVER (PARTITION BY user ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  WHEN seq % 3 = 0 THEN lag(seq, 1) OVER (PARTITION BY user ORDER BY seq) WHEN seq % 3 = 1 THEN lag(seq, 4) OVER (PARTITION BY user ORDER BY seq) ELSE lag(seq, 11) OVER (PARTITION BY user ORDER BY seq) END"""
_COMMANDS = f"""SELECT user, seq, op, text, source, {_TARGET} AS target_id, CASE WHEN seq % 7 > 0 AND op IN ('retire', 'tombstone', 'mark_conflict') THEN lag(seq, 2) OVER (PARTITION BY user ORDER BY seq) END AS other_id
  FROM (SELECT *, {_OP} AS op FROM ({o.MEMORY}))"""


def _commands(spark, sf_dir) -> DataFrame:
    w, op, seq = Window.partitionBy("user").orderBy("seq"), F.col("op"), F.col("seq")
    kind = F.lit("put")
    for k, v in _OPS.items():
        kind = F.when(seq % 20 == k, v).otherwise(kind)
    m = memory_stream(spark, sf_dir).withColumn("op", kind)
    held = F.max(F.when(op == "quarantine", seq)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    target = F.when(op.isin("put", "quarantine"), None).when(op.isin("release", "approve", "deny"), held).when(seq % 3 == 0, F.lag("seq", 1).over(w)).when(seq % 3 == 1, F.lag("seq", 4).over(w)).otherwise(F.lag("seq", 11).over(w))
    other = F.when((seq % 7 > 0) & op.isin("retire", "tombstone", "mark_conflict"), F.lag("seq", 2).over(w))
    reason = F.when(op.isin("approve", "deny"), "checked")
    return m.select("user", "seq", "op", "text", "source", target.alias("target_id"), other.alias("other_id"), reason.alias("reason"))


@query(f"WITH RECURSIVE {o.folded(commands=_COMMANDS)} SELECT * FROM audit")
def ledger_commands(spark, sf_dir):
    """put, supersede, restore, retire, tombstone, mark_conflict, quarantine, release, approve and deny in one fold."""
    return ledger.run(_commands(spark, sf_dir))


@query(f"WITH RECURSIVE {o.folded(commands=_COMMANDS)} SELECT f.id AS id, user, f.text AS text, f.source AS source, f.created AS created, f.heir AS tombstoned_by, f.other AS conflict_with FROM last")
def ledger_commands_facts(spark, sf_dir):
    return ledger.run(_commands(spark, sf_dir), "facts").select("id", "user", "text", "source", "created", "tombstoned_by", "conflict_with")


@query(f"WITH RECURSIVE {o.folded(commands=_COMMANDS)} SELECT user, count(*) AS n, count(*) FILTER (outcome = 'error') AS errors FROM audit GROUP BY user")
def error_counts(spark, sf_dir):
    """How many commands of each user were refused as errors."""
    return lifecycle.errors(ledger.run(_commands(spark, sf_dir)))


@query(f"WITH facts AS ({_FACTS}) SELECT a.id AS asked, f.id, f.user, f.text, f.tombstoned_by, f.conflict_with FROM (SELECT DISTINCT tombstoned_by AS id FROM facts WHERE tombstoned_by IS NOT NULL) a LEFT JOIN facts f USING (id)")
def fact_lookup(spark, sf_dir):
    """Facts by id: those that others were tombstoned by; an unknown id has no fact."""
    f = _facts(spark, sf_dir)
    return lifecycle.get(f, f.select(F.col("tombstoned_by").alias("id"))).select("asked", "id", "user", "text", "tombstoned_by", "conflict_with")


@query(f"WITH facts AS ({_FACTS}) SELECT id, CASE WHEN id % 9 = 0 THEN 'local' ELSE user END AS user, text, sha256({o.norm('text')}) AS text_hash, tombstoned_by, NULL::VARCHAR AS gate_action FROM facts")
def stored_facts(spark, sf_dir):
    """Facts of an older table, without some columns and users, written to a store, read back and written again from there."""
    store = tables.Store(spark, folders.own_folder(spark, "store"))
    f = _facts(spark, sf_dir)
    store.write("facts", f.select("id", F.when(F.col("id") % 9 != 0, F.col("user")).alias("user"), "text", "tombstoned_by"))
    store.write("facts", store.read("facts"))
    return store.read("facts").select("id", "user", "text", "text_hash", "tombstoned_by", "gate_action")


@query(f"WITH facts AS ({_FACTS}) SELECT id, CASE WHEN id % 9 = 0 THEN 'local' ELSE user END AS user, text, sha256({o.norm('text')}) AS text_hash, importance, decided_at FROM facts WHERE tombstoned_by IS NULL AND gate_action = 'STORE'")
def facts_from_sqlite(spark, sf_dir):
    """Live facts that the gate let in, read by condition from SQLite files of an older table that lacks columns and some users."""
    folder = folders.own_folder(spark, "sqlite")
    f = _facts(spark, sf_dir).repartition("user")
    sqlite.write(f.select("id", F.when(F.col("id") % 9 != 0, F.col("user")).alias("user"), "text", "tombstoned_by", "gate_action", "importance", "decided_at"), folder, index=("gate_action",))
    return sqlite.read_facts(spark, folder, where=[("tombstoned_by", "is null"), ("gate_action", "=", "STORE")]).select("id", "user", "text", "text_hash", "importance", "decided_at")


@query(f"SELECT source, count(*) AS writes, count(*) * {evaluation.th.COST_PER_1000_WRITES / 1000!r}::DOUBLE AS cost FROM ({o.MEMORY}) GROUP BY source")
def write_costs(spark, sf_dir):
    return evaluation.write_costs(memory_stream(spark, sf_dir), "source")


@query(
    """SELECT event_id, coalesce(t < max(CASE WHEN status = 429 THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 7200, false) AS blocked
    FROM (SELECT event_id, user_id, epoch_us(ts) / 1e6::DOUBLE AS t, CASE WHEN event_id % 3 = 0 THEN 429 ELSE 200 END AS status FROM events)"""
)
def blocked_calls(spark, sf_dir):
    """Calls that come less than two hours after a refusal of the same user."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    calls = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("scope"), at.alias("at"), F.when(F.col("event_id") % 3 == 0, 429).otherwise(200).alias("status"))
    return evaluation.blocked_calls(calls, seconds=7200, order="event_id").select("event_id", "blocked")


# --- Artifacts ------------------------------------------------------------------------------------------------------


def _artifacts(spark, sf_dir) -> list[str]:
    """The texts of the benchmark as files: a JSON object and a text file for each, in one folder, beside one that isn't looked at."""
    path = folders.own_folder(spark, "artifacts")
    b = table(spark, sf_dir, "benchmark")
    nested = b.select(F.col("item_id").alias("n"), F.array(F.struct("text"), F.struct(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("text"))).alias("items"))
    nested.write.option("maxRecordsPerFile", 1).json(f"{path}/thresholds")
    lines = b.select(F.concat(F.lit(" first "), F.col("item_id").cast("string"), F.lit(" \r\n\r\n"), F.col("text")))
    lines.write.option("maxRecordsPerFile", 1).mode("append").text(f"{path}/thresholds")
    lines.write.text(f"{path}/eval")  # of these names none is one of thresholds
    return tables.artifact_paths(spark, path)


@query("SELECT s FROM (SELECT text AS s FROM benchmark UNION ALL SELECT 'item ' || item_id FROM benchmark)")
def json_strings(spark, sf_dir):
    """Every string of JSON artifacts, at any depth; text files in the same folder are passed over."""
    return tables.read_json(spark, _artifacts(spark, sf_dir))[0].select("s")


@query("SELECT unnest(list_distinct(list_filter(['first ' || item_id, 'first ' || item_id || ' ' || chr(13) || chr(10) || chr(13) || chr(10) || rtrim(text, ' ' || chr(10))] || list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS s FROM benchmark")
def text_strings(spark, sf_dir):
    """Each text artifact as a whole and by line; JSON files in the same folder are passed over."""
    return tables.read_texts(spark, _artifacts(spark, sf_dir))[0].select("s")


# --- Whole sessions and attacks --------------------------------------------------------------------------------------

_SAID = "SELECT 'c' || conv_id AS user, turn::BIGINT AS seq, text, role AS source FROM conversations"


@query(f"WITH RECURSIVE {o.folded(lines=_SAID)} SELECT a.user, a.seq, g.action, a.outcome, a.fact_id, a.reason FROM audit a JOIN gated g ON g.user = a.user AND g.seq = a.seq")
def demo_session(spark, sf_dir):
    """Each conversation as a session from end to end: its turns gated, and stored or held or dropped in their order."""
    turns = texts(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("user"), F.col("turn").cast("long").alias("seq"), "text", F.col("role").alias("source"))
    said = ledger.gated(turns)
    done = ledger.run(said).select("user", "seq", "outcome", "fact_id", "reason")
    return said.select("user", "seq", F.col("gate_action").alias("action")).join(done, ["user", "seq"])


_ATTACKED = " UNION ALL ".join(f"SELECT conv_id, turn, {k} AS k, '{a} ' || text AS text FROM conversations" for k, a in enumerate(redteam.LINES))
_COPY = "'  ' || upper(text) || ' !!'"


@query(
    f"""WITH RECURSIVE {o.folded()}, shown AS (SELECT unnest(string_split(relations, ',')) AS r FROM audit WHERE relations <> '')
    SELECT 'injection' AS attack, count(*) AS attempts, count(*) FILTER (action <> 'STORE') AS refused FROM (WITH {o.gated(_ATTACKED)} SELECT action FROM gated)
    UNION ALL SELECT 'paraphrase', count(*), count(*) FILTER ({o.compare_form(_COPY)} = {o.compare_form('text')} AND {o.compare_form('text')} <> '') FROM benchmark
    UNION ALL SELECT 'vague update', count(*), count(*) FILTER (r LIKE '%:KEEP:veto-keep') FROM shown WHERE r LIKE '%:veto-keep'
    UNION ALL SELECT 'another user', count(*), count(*) FROM ({o.MEMORY})"""
)
def redteam_attacks(spark, sf_dir):
    """Attacks made from conversations, benchmark texts and the stream: how many were tried, and how many refused."""
    turns = texts(spark, sf_dir, "conversations").select("text")
    return redteam.attacks(turns, table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("path"), "text"), ledger.gated(memory_stream(spark, sf_dir)))
