"""A short session from end to end: lines are gated and stored, recalled, packed, and reported line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ledger, lifecycle, recall

USER, QUERY = "ada", "kiln every tuesday"
#: What is said, one line for each way that a line can go, and one that comes again.
LINES = (
    "kiln firing every tuesday", "the landlord contract renewal deadline is friday", "ok", "haha that glaze was a riot haha", "the new clay looked rather pleasant", "my account number is 90210077", "kiln firing  every tuesday ",
)


def lines(spark: SparkSession, said: tuple[str, ...] = LINES) -> DataFrame:
    return spark.createDataFrame([(USER, i + 1, t, "chat") for i, t in enumerate(said)], "user string, seq long, text string, source string")


def transcript(spark: SparkSession, said: tuple[str, ...] = LINES, query: str = QUERY) -> list[str]:
    """What happens to each line, what a query recalls of it, and how things stand."""
    commands = ledger.gated(lines(spark, said)).withColumn("op", F.lit("admit"))
    gates = {r.seq: r for r in commands.collect()}
    audit = sorted(ledger.run(commands).collect(), key=lambda r: r.seq)
    facts, held = ledger.run(commands, "facts"), sorted(ledger.run(commands, "held").collect(), key=lambda r: r.qid)
    out = []
    for r in audit:
        g = gates[r.seq]
        stored = {"drop": "DROP", "quarantine": "QUARANTINE"}.get(r.outcome, "STORE")
        out += [f"IN     {g.text!r}", f"GATE   action={g.gate_action} reasons={g.reason.replace(';', ',')}", f"STORE  action={stored} outcome={r.outcome}"]
    live = lifecycle.live(facts, USER)
    asked = spark.createDataFrame([(USER, 1, query)], "user string, query_id long, query string")
    chosen = recall.select(recall.matches(asked, live, recall.th.RECALL_GATE))
    texts = [r.text for r in sorted(chosen.collect(), key=lambda r: r["rank"])]
    packed = recall.pack(chosen).head()
    out += [f"RECALL query={query!r} texts={texts!r}", f"INJECT context={packed.packed if packed else ''!r}", f"REVIEW quarantined={len(held)}"]
    out += [f"HELD   qid={h.qid} reason={h.reason} text={h.text!r}" for h in held]
    status = lifecycle.status(facts, ledger.run(commands, "held"), ledger.run(commands, "conflicts")).head()
    return [*out, f"STATUS live={status.live} quarantined={status.quarantined} conflicts={status.conflicts}"]
