"""The fold over a store that grows: new commands go on from what is stored of their users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import own_folder
from ..sources.log import Log
from . import ledger


def open_store(spark: SparkSession, path: str, buckets: int = 64) -> Log:
    """The facts, held items, conflicts and reviews of all users."""
    return Log(spark, path, ledger.STATE, buckets)


def stored(store: Log, known: DataFrame, version: int) -> dict[str, DataFrame]:
    """What a fold of these commands needs of the store. Only the buckets of their users are read; their numbers are collected, as many as there are buckets at most."""
    touched = [r[0] for r in known.select(store.bucket(F.col("user")).alias("b")).distinct().collect()]
    return {t: store.read(t, version, touched) for t in ("facts", "held", "conflicts")}


def advance(store: Log, commands: DataFrame, settings: ledger.Settings | None = None) -> DataFrame:
    """Folds commands (user, seq, op, ...) from the stored state and commits what changed; the audit rows.

    The fold runs once and is written; audit and changes are read from that. If another writer was faster, sources.log.Refused
    is raised and the store is as that writer left it: the same commands may be folded again, from there.
    """
    version = store.version()
    known = ledger.commands(commands)
    done = ledger.advance(known, settings, stored(store, known, version))
    path = own_folder(store.spark, "fold")
    done.write.parquet(path)
    done = store.spark.read.schema(done.schema).parquet(path)
    store.commit({t: done.where(F.col("part") == t).select(f"{t}.*") for t in ledger.STATE}, version)
    return done.where("part = 'audit'").select("audit.*")
