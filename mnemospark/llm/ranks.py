"""Places of rows in the order of their group, without ranking a group in one task; ids for rows that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of monotonically_increasing_id that number the rows of one partition.
ROW_BITS = 33


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with gid (one number for each group, nulls are a group), at (place from 0 in its group) and n (rows of the group).

    Rows are sorted by range, each range in its task, and written with their running number; a group's ranges are
    then added up from counts of (range, group). Rows that are equal in group and order come in any order, and so may
    be dealt to several ranges: a key that repeats without end doesn't make a range longer. An empty table stays empty.
    """
    keys = [*[F.col(c).asc_nulls_first() for c in group], *order]
    tie = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tie.repartitionByRange(*keys, F.col("__tie").asc()).sortWithinPartitions(*keys, F.col("__tie").asc()).drop("__tie")
    ranged = common.materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), name)
    part = F.shiftright("__id", ROW_BITS).alias("__part")
    runs = ranged.groupBy(part, *group).agg(F.min("__id").alias("__first"), F.count("*").alias("__c"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("__c").over(whole.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        F.col("__part").alias("__p"),
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)],
        F.min("__first").over(whole).alias("gid"),
        (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__c").over(whole).alias("n"),
    )
    same = F.shiftright("__id", ROW_BITS) == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return ranged.join(runs, same).select(*rows.columns, "gid", (F.col("__id") + F.col("__shift")).alias("at"), "n")


def own_ids(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, int] | None:
    """None if no two rows share an id but not the text. Else df with a key of its own for each (id, text), and what the keys stand for.

    Keys ascend with the ids, and key >> shift is one number for each id: (df with the new keys, own and id of each, shift). Texts are
    told by 128 bits within an id. Rows that are equal in both keep one key; rows without id have none. The usual case
    reads and counts the ids alone.
    """
    rows = df.withColumn("__version", F.when(F.col(text).isNull(), "").otherwise(F.md5(F.col(text).cast("binary"))))
    ids = rows.select(F.col(key).cast("long").alias("id"), F.col("__version").alias("version")).where("id is not null")
    twice = ids.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1")
    if twice.isEmpty() or ids.join(twice.select("id"), "id", "left_semi").distinct().groupBy("id").count().where("count > 1").isEmpty():
        return None
    known = common.materialize(ids.distinct(), "versions")
    place = placed(known, ["id"], [F.col("version").asc()], "versions").select("id", "version", F.col("at").alias("j"), "n")
    number = placed(known.select("id").distinct(), [], [F.col("id").asc()], "ids").select(F.col("id"), F.col("at").alias("number"))
    shift = max(0, int(place.agg(F.max("n")).first()[0]) - 1).bit_length()
    if known.count() >= 1 << max(0, 63 - shift):
        raise ValueError("too many texts share one id to be told apart by whole numbers")
    keys = common.materialize(place.join(number, "id").select("id", "version", F.shiftleft("number", shift).bitwiseOR(F.col("j")).alias("own")), "keys")
    same = (F.col(f"__r.{key}").cast("long") == F.col("__k.id")) & (F.col("__r.__version") == F.col("__k.version"))
    named = rows.alias("__r").join(keys.alias("__k"), same, "left")
    columns = [F.col("__k.own").alias(c) if c == key else F.col(f"__r.`{c}`") for c in df.columns]
    return named.select(columns), keys.select("own", "id"), shift


def with_ids(found: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """found with the ids that the keys in these columns stand for."""
    for c in columns:
        names = [F.col("__i.id").alias(x) if x == c else F.col(f"__f.`{x}`") for x in found.columns]
        found = found.alias("__f").join(keys.alias("__i"), F.col(f"__f.`{c}`") == F.col("__i.own"), "left").select(names)
    return found
