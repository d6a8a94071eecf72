"""A stream of memory texts made from orders and parts: twelve kinds of lines, dealt by the order's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import texts


def memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, seq, text, source of every order."""
    orders = texts(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name").where("p_partkey < 200")
    both = orders.join(part, F.col("p_partkey") == F.col("o_orderkey") % 200)
    p, h = F.col("p_name"), (F.col("o_custkey") % 9 + 1).cast("string")
    lines = [
        F.concat(F.lit("the "), p, F.lit(" standup slot is at "), h, F.lit("am")),
        F.concat(F.lit("the "), p, F.lit(" standup slot moved to "), h, F.lit("am")),
        F.concat(F.lit("the "), p, F.lit(" standup no longer meets in the morning")),
        F.concat(F.lit("the "), p, F.lit(" standup slot is at "), h, F.lit("am now")),
        F.concat(F.lit("the "), p, F.lit(" deadline is friday")),
        F.lit("ok"),
        F.concat(F.lit("the "), p, F.lit(" demo was fun lol")),
        F.concat(F.lit("my "), p, F.lit(" account number is "), (F.col("o_orderkey") + 100000).cast("string")),
        F.concat(F.lit("the "), p, F.lit(" looked pleasant to me")),
        F.concat(F.lit("  slot standup "), p, F.lit("  the is at "), h, F.lit("am ")),
        F.concat(F.lit("the "), p, F.lit(" deadline is not friday")),
        F.concat(F.lit("i always prefer the "), p, F.lit(" in bay "), (F.col("o_custkey") % 5).cast("string")),
    ]
    kind = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 12
    text = lines[11]
    for i in range(10, -1, -1):
        text = F.when(kind == i, lines[i]).otherwise(text)
    return both.select(F.concat(F.lit("u"), (F.col("o_custkey") % 20).cast("string")).alias("user"), F.col("o_orderkey").alias("seq"), text.alias("text"), F.col("o_orderpriority").alias("source"))


SQL = """
SELECT 'u' || (o_custkey % 20) AS user, o_orderkey AS seq,
  CASE (o_orderkey * 7 + o_custkey) % 12
    WHEN 0 THEN 'the ' || p_name || ' standup slot is at ' || (o_custkey % 9 + 1) || 'am'
    WHEN 1 THEN 'the ' || p_name || ' standup slot moved to ' || (o_custkey % 9 + 1) || 'am'
    WHEN 2 THEN 'the ' || p_name || ' standup no longer meets in the morning'
    WHEN 3 THEN 'the ' || p_name || ' standup slot is at ' || (o_custkey % 9 + 1) || 'am now'
    WHEN 4 THEN 'the ' || p_name || ' deadline is friday'
    WHEN 5 THEN 'ok'
    WHEN 6 THEN 'the ' || p_name || ' demo was fun lol'
    WHEN 7 THEN 'my ' || p_name || ' account number is ' || (o_orderkey + 100000)
    WHEN 8 THEN 'the ' || p_name || ' looked pleasant to me'
    WHEN 9 THEN '  slot standup ' || p_name || '  the is at ' || (o_custkey % 9 + 1) || 'am '
    WHEN 10 THEN 'the ' || p_name || ' deadline is not friday'
    ELSE 'i always prefer the ' || p_name || ' in bay ' || (o_custkey % 5) END AS text,
  o_orderpriority AS source
FROM orders JOIN part ON p_partkey = o_orderkey % 200
"""
