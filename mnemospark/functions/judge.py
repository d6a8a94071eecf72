"""Replies of an external judge, read into votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import thresholds as th
from .gate import decide, vote_struct

ANSWER = "struct<noul:double,probability:double,choice:string,probabilities:map<string,double>,score:double,level:double>"
REPLY = f"struct<answers:map<string,{ANSWER}>>"
PASS, BLOCK = "s1", "s0"


def importance_of(choice: Column) -> Column:
    """1 to 5 from s0..s4 or 1..5; -1 from anything else."""
    label = F.lower(F.trim(choice))
    return F.when(label.rlike("^[1-5]$"), label.cast("int")).when(label.rlike("^s[+]?0*[0-4]$"), F.regexp_extract(label, "([0-4])$", 1).cast("int") + 1).otherwise(F.lit(-1))


def stop_cap(probabilities: Column) -> Column:
    """0.5 plus how far the two answers to the stop question lie apart; 1 if that can't be read."""
    margin = F.abs(F.coalesce(F.try_element_at(probabilities, F.lit(PASS)), F.lit(0.0)) - F.coalesce(F.try_element_at(probabilities, F.lit(BLOCK)), F.lit(0.0)))
    return F.when(probabilities.isNull() | F.isnan(margin) | (margin > 1), 1.0).otherwise(margin + th.STOP_CAP)


def durable_confidence(durable: Column) -> Column:
    top, slope = th.CONFIDENCE
    return F.lit(top) - F.abs(durable - 0.5) * slope


def read_reply(reply: Column) -> Column:
    """The vote in a reply's JSON text; null if the reply is malformed or out of range."""
    answers = F.from_json(reply, REPLY)["answers"]
    dur, imp, sens, stop = (F.try_element_at(answers, F.lit(q)) for q in ("dur", "imp", "sens", "stop"))
    durable, sensitive = (F.coalesce(a["noul"], a["probability"], F.lit(-1.0)) for a in (dur, sens))
    importance = importance_of(imp["choice"])
    good = answers.isNotNull() & durable.between(0, 1) & sensitive.between(0, 1) & (importance > 0)
    vote = F.struct(
        durable.alias("durable"), importance.alias("importance"), F.when(stop["choice"] == PASS, 0.0).otherwise(1.0).alias("stop"), F.lit(0.0).alias("play"), sensitive.alias("sensitive"),
        F.least(durable_confidence(durable), stop_cap(stop["probabilities"]), F.lit(1.0)).alias("conf"),
    )
    return F.when(good, vote)


def decide_reply(reply: Column, cutoffs: th.Gate | None = None, judge: str = "recorded") -> Column:
    """The gate's decision on a reply; one that can't be read is quarantined as judge-halted."""
    vote = read_reply(reply)
    halted = F.struct(F.lit("QUARANTINE").alias("action"), F.array(F.lit("judge-halted")).alias("reasons"), F.lit(None).cast("int").alias("importance"), F.lit("").alias("judge"))
    return F.when(vote.isNull(), halted).otherwise(decide(F.coalesce(vote, vote_struct(th.FAIL_CLOSED)), cutoffs, judge))


def read_relation(reply: Column, question: str = "rel") -> Column:
    """The relation chosen in a reply."""
    return F.try_element_at(F.from_json(reply, REPLY)["answers"], F.lit(question))["choice"]
