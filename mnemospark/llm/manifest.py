"""A Merkle manifest of a dataset: a digest for each document, one for each source, one for all, and proofs.

A leaf is the digest of doc_id, source, lang, n_chars and text, each "-" if null and else its length in bytes, a colon and
the value. Leaves of one source ascend by doc_id; every three nodes in a row (the last run may have fewer, even one) give
the digest of their hex digests until one is left, the source's. Sources, null first and then by their bytes, give the root
in the same way. Digests are SHA-256; what they are taken of is written as lower-case hex.

Each level is one window: nodes of a run, which is one partition by group and parent's place, collect all digests of the
run in order, which gives the parent's preimage and each node's siblings; the first node of the run goes on as the parent.
Levels shrink by three, and each is written. On the way down a parent's path meets its run again, so no join
is larger than a third of the leaves. Places come from ranks.placed, so the leaves of one source are never in one task.

* A null doc_id comes before all others. Rows with one doc_id are leaves of their own, in the order of their digests;
  equal rows are leaves of their own, too, and have rows of their own in the result.
* A null or empty text, a very long one and columns beside the five are no special case; columns beside the five are dropped.
* A null doc_id isn't tampered with. A lone leaf is its source's digest; a lone source's digest is the root.
* An empty table has no root and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, ranks

#: Nodes of one run.
FAN = 3


def encoded(value: Column) -> Column:
    """A value in the preimage of a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """The digest of a document's fields as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)), 256))


def shown(digests: Column) -> Column:
    """Digests as lower-case hex."""
    return F.lower(F.hex(digests))


def parents(nodes: DataFrame) -> DataFrame:
    """One row for each run of FAN nodes: gid, group, at and n of the next level, item (the nodes in order) and its digest.

    nodes: gid, group, at, n and item, a struct whose `digest` is the node's. A node that is alone in its group is its
    own parent, without another digest.
    """
    run = Window.partitionBy("gid", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    items = nodes.withColumn("up", F.floor(F.col("at") / FAN)).withColumn("items", F.collect_list("item").over(run))
    first = items.where(F.col("at") % FAN == 0)
    joined = F.array_join(F.transform("items", lambda x: shown(x["digest"])), "")
    own = F.when(F.col("n") == 1, F.col("items")[0]["digest"]).otherwise(F.unhex(F.sha2(joined, 256)))
    return first.select("gid", "group", F.col("up").alias("at"), F.ceil(F.col("n") / FAN).alias("n"), (F.col("n") == 1).alias("lone"), "items", own.alias("digest"))


def climb(leaves: DataFrame, name: str) -> list[DataFrame]:
    """All levels of parents, from the lowest one up, until each group has one node."""
    levels = [common.materialize(parents(leaves), name)]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes = levels[-1].where("n > 1").select("gid", "group", "at", "n", F.struct("digest").alias("item"))
        levels.append(common.materialize(parents(nodes), name))
        most = -(-most // FAN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """The last node of each group: gid, group, level, digest."""
    found = [x.where("n = 1").select("gid", "group", F.lit(i).alias("level"), "digest") for i, x in enumerate(levels)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Each leaf's item with its path, an array of (left, right): the digests beside it in its run, level by level to the root.

    above: for the last node of each group, gid, level, digest as subroot, and its own path.
    """
    known = None
    for i in reversed(range(len(levels))):
        here = above.where(F.col("level") == i).select("gid", F.lit(0).cast("long").alias("at"), "subroot", "path")
        known = here if known is None else known.unionByName(here)
        runs = levels[i].select("gid", "at", "lone", "items").join(known, ["gid", "at"])
        place = F.col("pos")
        beside = lambda start, length: F.aggregate(F.slice("items", start, length), F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
        step = F.struct(beside(F.lit(1), place).alias("left"), beside(place + 2, F.lit(FAN)).alias("right"))
        path = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
        known = runs.select("*", F.posexplode("items").alias("pos", "item")).select("gid", (F.col("at") * FAN + place).alias("at"), "subroot", path.alias("path"), "item")
        if i:
            known = known.drop("item")
    return known


def folded(leaf: Column, path: Column) -> Column:
    """The hex digest that a leaf's hex digest and its path lead to."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(shown(s["left"]), a, shown(s["right"])), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each document.

    proof_sha256 is the digest of all siblings from leaf to root. Where crc32 of the decimal doc_id is even, a copy of
    the text without its newlines is checked against the proof, else the document itself.
    """
    touched = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    without = F.replace("text", F.lit("\n"), F.lit(""))
    hashed = docs.select("doc_id", "source", digest(*fields, F.col("text")).alias("digest"), F.when(touched, digest(*fields, without)).alias("tampered"))
    by_id = [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    leaves = ranks.placed(common.materialize(hashed, "digests"), ["source"], by_id, "leaves")
    levels = climb(leaves.select("gid", F.col("source").alias("group"), "at", "n", F.struct("digest", "doc_id", "tampered").alias("item")), "level")

    subroots = common.materialize(tops(levels).withColumnRenamed("gid", "of"), "subroots")
    sources = ranks.placed(subroots, [], [F.col("group").asc_nulls_first()], "sources")
    upper = climb(sources.select("gid", F.lit("all").alias("group"), "at", "n", F.struct("digest", "of", "level").alias("item")), "upper")
    root = tops(upper).select(shown(F.col("digest"))).first()
    start = tops(upper).select("gid", "level", F.col("digest").alias("subroot"), F.array().cast("array<struct<left: binary, right: binary>>").alias("path"))
    proofs = descend(upper, start).select(F.col("item.of").alias("gid"), F.col("item.level").alias("level"), F.col("item.digest").alias("subroot"), "path")

    path = descend(levels, common.materialize(proofs, "proofs")).select("item.*", "subroot", "path", F.lit(root[0] if root else None).cast("string").alias("root"))
    beside = F.array_join(F.transform("path", lambda s: F.concat(shown(s["left"]), shown(s["right"]))), "")
    checked = path.select(
        "doc_id",
        shown(F.col("digest")).alias("leaf"),
        shown(F.col("subroot")).alias("subroot"),
        "root",
        F.sha2(beside, 256).alias("proof_sha256"),
        folded(shown(F.coalesce("tampered", "digest")), F.col("path")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 is spelled out: eight steps of one bit for each byte of the decimal id.
ORACLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS id, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head
  FROM documents),
summed AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(id) + 1), lambda i: ascii(substr(id, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM fields),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM summed),
sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS s FROM (SELECT DISTINCT source FROM documents)),
leaves AS (
  SELECT h.*, s.s, row_number() OVER (PARTITION BY s.s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s.s) AS n
  FROM hashed h JOIN sources s ON h.source IS NOT DISTINCT FROM s.source),
lower(level, s, pos, h, n) AS (
  SELECT 0, s, pos, leaf, n FROM leaves
  UNION ALL
  SELECT level + 1, s, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), CAST(ceil(n / 3.0) AS BIGINT) FROM lower WHERE n > 1 GROUP BY level, s, pos // 3, n),
subroots AS (SELECT s, h FROM lower WHERE n = 1),
higher(level, pos, h, n) AS (
  SELECT 0, s - 1, h, (SELECT count(*) FROM sources) FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), CAST(ceil(n / 3.0) AS BIGINT) FROM higher WHERE n > 1 GROUP BY level, pos // 3, n),
root AS (SELECT h FROM higher WHERE n = 1),
climbs AS (
  SELECT l.s, l.pos AS leaf_pos, x.level, x.pos, x.n FROM leaves l JOIN (SELECT DISTINCT level, s, n FROM lower WHERE n > 1) g ON g.s = l.s
    JOIN lower x ON x.s = l.s AND x.level = g.level AND x.pos = l.pos // CAST(pow(3, g.level) AS BIGINT)
  UNION ALL
  SELECT l.s, l.pos, 1000 + x.level, x.pos, x.n FROM leaves l JOIN (SELECT DISTINCT level FROM higher WHERE n > 1) g ON true
    JOIN higher x ON x.level = g.level AND x.pos = (l.s - 1) // CAST(pow(3, g.level) AS BIGINT)),
nodes AS (SELECT level, s, pos, h FROM lower UNION ALL SELECT 1000 + level, NULL, pos, h FROM higher),
steps AS (
  SELECT c.s, c.leaf_pos, c.level, row_number() OVER (PARTITION BY c.s, c.leaf_pos ORDER BY c.level) AS step,
    coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < c.pos), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > c.pos), '') AS r
  FROM climbs c JOIN nodes x ON x.level = c.level AND (x.s = c.s OR x.s IS NULL) AND x.pos // 3 = c.pos // 3 GROUP BY c.s, c.leaf_pos, c.level, c.pos),
proofs AS (SELECT s, leaf_pos, sha256(string_agg(l || r, '' ORDER BY step)) AS proof FROM steps GROUP BY s, leaf_pos),
fold(s, pos, step, h) AS (
  SELECT s, pos, 0, coalesce(tampered, leaf) FROM leaves
  UNION ALL
  SELECT f.s, f.pos, f.step + 1, sha256(t.l || f.h || t.r) FROM fold f JOIN steps t ON t.s = f.s AND t.leaf_pos = f.pos AND t.step = f.step + 1),
ends AS (SELECT s, pos, h FROM (SELECT *, row_number() OVER (PARTITION BY s, pos ORDER BY step DESC) AS back FROM fold) WHERE back = 1)
SELECT l.doc_id, l.leaf, b.h AS subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM leaves l JOIN subroots b ON b.s = l.s CROSS JOIN root t LEFT JOIN proofs p ON p.s = l.s AND p.leaf_pos = l.pos JOIN ends e ON e.s = l.s AND e.pos = l.pos
"""
