"""Views and keyed updates of the tables of facts, quarantine, conflicts and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .metrics import count_if


def live(facts: DataFrame, user: str | None = None) -> DataFrame:
    out = facts.where(F.col("tombstoned_by").isNull())
    return out.where(F.col("user") == user) if user is not None else out


def tombstoned(facts: DataFrame, user: str | None = None) -> DataFrame:
    out = facts.where(F.col("tombstoned_by").isNotNull())
    return out.where(F.col("user") == user) if user is not None else out


def get(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """The facts with these ids (id), a row for each distinct id: asked, and the fact's columns, null if there is none."""
    asked = ids.where("id is not null").select(F.col("id").alias("asked")).distinct()
    return asked.join(facts, F.col("asked") == facts["id"], "left")


def errors(audit: DataFrame) -> DataFrame:
    """user, n, errors: commands of each user, and those refused as errors."""
    return audit.groupBy("user").agg(F.count("*").alias("n"), count_if(F.col("outcome") == "error").alias("errors"))


def conflicts_of_users(conflicts: DataFrame, facts: DataFrame) -> DataFrame:
    """A row for each conflict and each user on either side of it; a pair within one user's facts comes once."""
    owner = lambda c: facts.select(F.col("id").alias(c), F.col("user").alias(f"{c}_user"))
    both = conflicts.join(owner("old_id"), "old_id").join(owner("new_id"), "new_id")
    return both.select("old_id", "new_id", F.explode(F.array_distinct(F.array("old_id_user", "new_id_user"))).alias("user"))


def status(facts: DataFrame, quarantine: DataFrame, conflicts: DataFrame) -> DataFrame:
    """user, live, quarantined, conflicts."""
    a = facts.groupBy("user").agg(count_if(F.col("tombstoned_by").isNull()).alias("live"))
    b = quarantine.groupBy("user").agg(F.count("*").alias("quarantined"))
    c = conflicts_of_users(conflicts, facts).groupBy("user").agg(F.count("*").alias("conflicts"))
    return a.join(b, "user", "full").join(c, "user", "full").select("user", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("live", "quarantined", "conflicts")])


def tombstone(facts: DataFrame, marks: DataFrame) -> DataFrame:
    """facts with marks (id, by, reason, actor, seq) set; of several marks of one fact, the last."""
    last = marks.groupBy("id").agg(F.max_by(F.struct("by", "reason", "actor"), "seq").alias("m"))
    hit = F.col("m").isNotNull()
    return facts.join(last, "id", "left").select(
        *[{"tombstoned_by": F.when(hit, F.col("m.by")).otherwise(F.col(c)), "tombstone_reason": F.when(hit, F.col("m.reason")).otherwise(F.col(c)), "tombstone_actor": F.when(hit, F.col("m.actor")).otherwise(F.col(c))}.get(c, F.col(c)).alias(c) for c in facts.columns]
    )


def mark_conflicts(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """facts with conflict_with set on both sides of pairs (old_id, new_id, seq), the last pair of a fact winning."""
    sides = pairs.select(F.explode(F.array(F.struct(F.col("old_id").alias("id"), F.col("new_id").alias("w"), "seq"), F.struct(F.col("new_id").alias("id"), F.col("old_id").alias("w"), "seq"))).alias("e")).select("e.*")
    last = sides.groupBy("id").agg(F.max_by("w", "seq").alias("w"))
    return facts.join(last, "id", "left").select(*[(F.coalesce("w", "conflict_with") if c == "conflict_with" else F.col(c)).alias(c) for c in facts.columns])


def restore(facts: DataFrame, conflicts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts and conflicts after restoring ids (id): own marks cleared, a counterpart's where it points back."""
    hit = ids.select("id").distinct()
    own = facts.join(hit.withColumn("__own", F.lit(True)), "id", "left")
    back = facts.join(hit, "id").where("conflict_with is not null").select(F.col("conflict_with").alias("id"), F.col("id").alias("__from")).distinct()
    pointed = facts.select("id", "conflict_with").join(back, "id").where("conflict_with = __from").select("id", F.lit(True).alias("__back")).distinct()
    both = own.join(pointed, "id", "left")
    cleared = F.coalesce("__own", F.lit(False))
    new = {c: F.when(cleared, None).otherwise(F.col(c)) for c in ("tombstoned_by", "tombstone_reason", "tombstone_actor")}
    new["conflict_with"] = F.when(cleared | F.coalesce("__back", F.lit(False)), None).otherwise(F.col("conflict_with"))
    left = conflicts.join(hit.withColumnRenamed("id", "old_id"), "old_id", "left_anti").join(hit.withColumnRenamed("id", "new_id"), "new_id", "left_anti").select(conflicts.columns)
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in facts.columns]), left


def merge_provenance(facts: DataFrame, repeats: DataFrame) -> DataFrame:
    """facts with the provenance of repeats (id, gate_action, importance, judge, decided_at) where that isn't null."""
    names = ("gate_action", "importance", "judge", "decided_at")
    given = repeats.select("id", *[F.col(n).alias(f"__{n}") for n in names])
    return facts.join(given, "id", "left").select(*[(F.coalesce(f"__{c}", c) if c in names else F.col(c)).alias(c) for c in facts.columns])


def review(quarantine: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(still held, approved items to put, reviews) from decisions (qid, decision, reason); a blank reason decides nothing."""
    valid = decisions.where((F.trim("reason") != "") & F.col("decision").isin("approve", "deny"))
    known = valid.join(quarantine.select("qid"), "qid", "left_semi")
    held = quarantine.join(known.select("qid"), "qid", "left_anti")
    approved = quarantine.join(known.where("decision = 'approve'").select("qid"), "qid", "left_semi")
    return held, approved, known.select("qid", "decision", F.trim("reason").alias("reason"), F.lit("human").alias("actor"))


def migrate(facts: DataFrame, full: DataFrame) -> DataFrame:
    """An older table of facts with all columns: missing ones null, user local, hashes made."""
    out = full.limit(0).unionByName(facts, allowMissingColumns=True)
    return out.withColumns({"user": F.coalesce("user", F.lit("local")), "text_hash": F.coalesce("text_hash", text.content_hash(F.col("text")))})
