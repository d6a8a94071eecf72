"""Protected texts in artifacts: equal, hashed, equal in normal form, or alike in tokens.

An artifact's strings are compared with all protected texts by joins on the text, its hash, and its normal form, and by
an index of tokens for similarity, so no pair is looked at that shares nothing. Strings with too few protected tokens go
where they are read, by a map of bits of bounded size. Of an artifact's findings, the first kind in the order
above is kept, and of that kind the lowest string (of similar ones, the most alike, then the lowest).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, words
from ..functions import thresholds as th
from ..sources.folders import own_folder

KINDS = ("exact-text", "content-hash", "normalized-text", "token-overlap", "split-field")


#: Bits of the map of protected tokens at most, as a power of two: 128 KB, however many tokens there are.
MAP_BITS = 20


def _token_map(tokens: DataFrame) -> Callable[[Column], Column]:
    """Whether a token may be one of the tokens (t): never false for those, rarely true for others.

    A bit of the token's hash, in a map of longs of which there are 64 at least and 16 bits for each token up to MAP_BITS.
    """
    place = F.xxhash64("t").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    longs = tokens.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).collect()
    bits = min(12, MAP_BITS)
    while bits < MAP_BITS and 1 << bits < 16 * sum((r.b & (1 << 64) - 1).bit_count() for r in longs):
        bits += 1
    folded = [0] * (1 << bits - 6)
    for r in longs:
        folded[r.w % len(folded)] |= r.b
    found = F.split(F.lit(",".join(map(str, folded))), ",").cast("array<long>")
    at = lambda t: F.xxhash64(t).bitwiseAND(F.lit((1 << bits) - 1))
    return lambda t: F.getbit(F.get(found, F.shiftright(at(t), 6).cast("int")), at(t).bitwiseAND(F.lit(63)).cast("int")) == 1


def _fitting(strings: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """path, s, norm, tokens of strings that have the part `least` of their tokens, one at least, in common with all protected texts together.

    That is tested where strings are read, by the map, before anything is exploded or shuffled; what passes is written, so that
    forms are made once. The form is made in an array of one, which keeps it from being made again for the test.
    """
    known = _token_map(tokens)
    read = F.transform(F.array(text.compare_form(F.col("s"))), lambda n: F.struct(n.alias("norm"), text.form_tokens(n).alias("tokens")))
    fit = lambda x: (F.size(x["tokens"]) > 0) & (F.size(F.filter(x["tokens"], known)) >= _needed(F.size(x["tokens"]), least))
    path = own_folder(strings.sparkSession, "fitting")
    found = strings.select("path", "s", F.inline(F.filter(read, fit)))
    found.write.parquet(path)
    return strings.sparkSession.read.schema(found.schema).parquet(path)


def _needed(size: Column, least: float) -> Column:
    return F.ceil(size * F.lit(least) - 1e-9)


def _overlaps(fitting: DataFrame, p: DataFrame, rarity: DataFrame, least: float, least_tokens: int) -> DataFrame:
    """path, s, score of strings that are similar to a protected text, by prefix filtering on tokens.

    Rarity among the protected texts orders tokens; those that none of them has come first and match nothing. So a string is
    looked at by the rarest of the tokens that it must share. Sets of tokens are called by 128 bits of their hash.
    """
    s = fitting.where(F.size("tokens") >= least_tokens).select("path", "s", "tokens", _called("tokens").alias("sid"))
    one = s.groupBy("sid").agg(F.first("tokens").alias("tokens"))

    def prefix(df: DataFrame, key: str, tokens: str) -> DataFrame:
        need = _needed(F.col("n"), least)
        known = df.select(key, F.size(tokens).alias("n"), F.explode(tokens).alias("t")).join(rarity, "t").groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("known"))
        first = F.slice("known", F.lit(1), (F.size("known") - need + 1).cast("int"))
        return known.where(F.size("known") >= need).select(key, F.explode(F.transform(first, lambda x: x["t"])).alias("t"))

    candidates = prefix(one, "sid", "tokens").join(prefix(p, "pid", "other"), "t").select("sid", "pid").distinct()
    scored = candidates.join(one, "sid").join(p, "pid").withColumn("score", text.overlap(F.col("tokens"), F.col("other"))).where(F.col("score") >= least)
    best = scored.groupBy("sid").agg(F.max("score").alias("score"))
    return s.select("path", "s", "sid").join(best, "sid").select("path", "s", "score")


def _called(tokens: str) -> Column:
    return F.md5(F.concat_ws("\x01", F.array_sort(tokens)))


def flags(strings: DataFrame, protected: DataFrame, least: float = th.CONTAMINATION_SIMILARITY, least_tokens: int = th.CONTAMINATION_TOKENS) -> DataFrame:
    """path, check, score, excerpt: at most one row for each path of (path, s); protected has text."""
    s = strings.select("path", "s").where("s is not null")  # repeated strings change nothing: the first finding is a minimum
    p = protected.select("text").where("text is not null").distinct()
    sets = p.select(text.compare_tokens(F.col("text")).alias("other")).where(F.size("other") > 0).withColumn("pid", _called("other")).dropDuplicates(["pid"])
    rarity = sets.select(F.explode("other").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    fitting = _fitting(s, rarity, least)
    told = p.select(F.explode(F.array(F.struct("text", F.lit(0).alias("kind")), F.struct(F.sha2("text", 256).alias("text"), F.lit(1).alias("kind")))).alias("k")).select(F.col("k.text").alias("s"), "k.kind")
    equal = s.join(told, "s").select("path", "s", "kind", F.lit(1.0).alias("score"))
    forms = p.select(text.compare_form(F.col("text")).alias("norm")).where("norm != ''").distinct()
    normal = fitting.join(forms, "norm", "left_semi").select("path", "s", F.lit(2).alias("kind"), F.lit(1.0).alias("score"))
    similar = _overlaps(fitting, sets, rarity, least, least_tokens).select("path", "s", F.lit(3).alias("kind"), "score")
    found = equal.unionByName(normal).unionByName(similar)
    first = found.groupBy("path").agg(F.min(F.struct("kind", (-F.col("score")).alias("less"), "s")).alias("b"))
    kinds = F.array(*map(F.lit, KINDS))
    return first.select("path", F.element_at(kinds, F.col("b.kind") + 1).alias("check"), (-F.col("b.less")).alias("score"), text.excerpt(F.col("b.s")).alias("excerpt"))


def split_field(body: DataFrame) -> DataFrame:
    """path, excerpt of artifacts (path, body, is_json) that claim to be fitted on the test split.

    In JSON the top-level field counts; in other text an assignment anywhere.
    """
    fields = "|".join(words.SPLIT_FIELDS)
    in_text = F.lower(F.regexp_extract("body", rf"(?i)(?<!{text.WORD})({fields})\s*[:=]\s*['\"]?\s*test\s*['\"]?(?!{text.WORD})", 1))
    in_json = F.coalesce(*[F.when(F.get_json_object("body", f"$.{f}") == "test", F.lit(f)) for f in words.SPLIT_FIELDS])
    hit = F.when(F.col("is_json"), in_json).otherwise(F.nullif(in_text, F.lit("")))
    return body.select("path", hit.alias("f")).where("f is not null").select("path", F.concat("f", F.lit("=test")).alias("excerpt"))


def scan(strings: DataFrame, bodies: DataFrame, protected: DataFrame, **options) -> DataFrame:
    """flags, and for paths without one the split-field claim."""
    found = flags(strings, protected, **options)
    claims = split_field(bodies).join(found.select("path"), "path", "left_anti").select("path", F.lit(KINDS[4]).alias("check"), F.lit(None).cast("double").alias("score"), "excerpt")
    return found.unionByName(claims)


def shared_strings(a: DataFrame, b: DataFrame, least_tokens: int = 1) -> DataFrame:
    """Normal forms of at least so many tokens that stand in both tables (text)."""
    forms = [d.select(text.compare_form(F.col("text")).alias("norm")).where((F.col("norm") != "") & (F.size(F.split("norm", " ")) >= least_tokens)) for d in (a, b)]
    return forms[0].intersect(forms[1])
