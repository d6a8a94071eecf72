"""URL filters over dated lists: an as-of join of captures with the entries active when they were fetched.

A list entry names a key (a host or a domain above it), a category, a date, and whether it is added or removed then.
Entries of one key and category, ordered by date, become validity intervals: an addition holds until the next entry. A
capture is tried with its host and each domain above it, an equality join on the key with the interval as its
condition; of the intervals that hold at its fetch time, that of the longest key decides, ties by category.

Additions of the same key, category and date count once; a removal on the date of an addition wins. Entries with a null
key, category or date, and captures without host or fetch time, match nothing. Hosts are compared in lower case
without user, port and final dot. Each capture comes back once, repeated ones as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """key, category, valid_from, valid_to (null: still) from entries (key, category, action, day)."""
    known = entries.where("key is not null and category is not null and day is not null")
    last = known.groupBy("key", "category", "day").agg(F.max(F.col("action") == "remove").alias("removed"))
    order = Window.partitionBy("key", "category").orderBy("day")
    held = last.withColumn("valid_to", F.lead("day").over(order)).where(~F.col("removed"))
    return held.select("key", "category", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "fetch_day") -> DataFrame:
    """key, host, fetch_day, blocked, matched_key, category, valid_from of each capture."""
    hosts = captures.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), F.col(day).alias("fetch_day"))
    # Each distinct (host, day) is judged once, so a host with most captures isn't joined row by row.
    asked = hosts.where("host is not null and fetch_day is not null").groupBy("host", "fetch_day").agg(F.lit(1).alias("__one")).drop("__one")
    labels = F.split("host", r"\.")
    keys = asked.select("host", "fetch_day", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("key"))
    held = intervals(entries)
    active = (F.col("fetch_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_day") < F.col("valid_to")))
    best = F.min(F.struct((-F.length("key")).alias("o"), F.col("category"), F.col("key"), F.col("valid_from")))
    judged = keys.join(held, "key").where(active).groupBy("host", "fetch_day").agg(best.alias("b"))
    return hosts.join(judged, ["host", "fetch_day"], "left").select(
        "page_id", "host", "fetch_day", F.col("b").isNotNull().alias("blocked"), F.col("b.key").alias("matched_key"), F.col("b.category").alias("category"), F.col("b.valid_from").alias("valid_from")
    )


# --- The query: days and list of the pages table, which has none of its own --------------------------------------------

#: Listed domains with dates as days since the first; fixed values of the query.
LISTED = [
    ("spam-farm.example.org", "spam", "add", 20), ("spam-farm.example.org", "spam", "remove", 120), ("spam-farm.example.org", "spam", "add", 200),
    ("cheap-pills.example.com", "drugs", "add", 0), ("example.net", "parked", "add", 300), ("example.net", "parked", "remove", 330),
]
DAYS = 365


def query(pages: DataFrame) -> DataFrame:
    """Pages fetched on day (page_id * 37) mod 365, against LISTED and entries dated by the hash of each host."""
    captures = pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(DAYS)).alias("fetch_day"))
    hosts = captures.select(host_of(F.col("url")).alias("key")).where("key is not null").distinct()
    v = hosts.withColumn("v", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("long"))
    start = F.col("v") % 180
    kind = F.element_at(F.array(*map(F.lit, ("adult", "malware", "spam"))), (F.col("v") % 7 % 3 + 1).cast("int"))
    dated = v.where("v % 3 = 0").select(
        "key",
        kind.alias("category"),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("add").alias("action"), start.alias("day"), F.lit(True).alias("on")),
                    F.struct(F.lit("remove").alias("action"), (start + 30 + F.col("v") % 90).alias("day"), (F.col("v") % 2 == 0).alias("on")),
                    F.struct(F.lit("add").alias("action"), (start + 200).alias("day"), (F.col("v") % 5 == 0).alias("on")),
                ),
                lambda e: e["on"],
            )
        ).alias("e"),
    )
    fixed = pages.sparkSession.createDataFrame(LISTED, "key string, category string, action string, day long")
    entries = dated.select("key", "category", "e.action", "e.day").unionByName(fixed)
    return filter_captures(captures, entries)


_ENTRIES = ", ".join(f"('{k}', '{c}', '{a}', {d})" for k, c, a, d in LISTED)
ORACLE_SQL = f"""
WITH captures AS (
  SELECT page_id, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.'), '') AS host, CAST(page_id * 37 % {DAYS} AS BIGINT) AS fetch_day FROM pages),
hosts AS (SELECT DISTINCT host AS key, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS v FROM captures WHERE host IS NOT NULL),
dated AS (SELECT key, v, ['adult', 'malware', 'spam'][CAST(v % 7 % 3 + 1 AS INT)] AS category FROM hosts WHERE v % 3 = 0),
entries AS (
  SELECT key, category, 'add' AS action, v % 180 AS day FROM dated
  UNION ALL SELECT key, category, 'remove', v % 180 + 30 + v % 90 FROM dated WHERE v % 2 = 0
  UNION ALL SELECT key, category, 'add', v % 180 + 200 FROM dated WHERE v % 5 = 0
  UNION ALL SELECT * FROM (VALUES {_ENTRIES})),
last AS (SELECT key, category, day, bool_or(action = 'remove') AS removed FROM entries GROUP BY ALL),
held AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY key, category ORDER BY day) AS valid_to FROM last) WHERE NOT removed),
found AS (
  SELECT c.page_id, c.host, c.fetch_day, h.key, h.category, h.day, row_number() OVER (PARTITION BY c.page_id ORDER BY length(h.key) DESC, h.category, h.key, h.day) AS r
  FROM captures c JOIN held h ON (c.host = h.key OR c.host LIKE '%.' || h.key) AND c.fetch_day >= h.day AND (h.valid_to IS NULL OR c.fetch_day < h.valid_to))
SELECT c.page_id, c.host, c.fetch_day, f.key IS NOT NULL AS blocked, f.key AS matched_key, f.category, CAST(f.day AS BIGINT) AS valid_from
FROM captures c LEFT JOIN (SELECT * FROM found WHERE r = 1) f USING (page_id)
"""
