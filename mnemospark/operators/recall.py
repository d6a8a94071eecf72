"""The read path: live facts scored against a query, selected, and packed into a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..functions import thresholds as th
from . import blocks


def _tokens(queries: DataFrame, live: DataFrame, scope: str, *more: str) -> tuple[DataFrame, DataFrame]:
    return queries.select(scope, "query_id", text.token_set(F.col("query")).alias("tokens")), live.select(scope, "id", "text", text.token_set(F.col("text")).alias("tokens"), *more)


def score(queries: DataFrame, live: DataFrame, scope: str = "user", with_text: bool = True) -> DataFrame:
    """(query_id, id, text, score) of every live fact (scope, id, text) of a query's (scope, query_id, query) scope.

    Token sets are made once for each query and each fact, and compared block by block.
    """
    return blocks.compare(*_tokens(queries, live, scope), scope, with_text=with_text)


def matches(queries: DataFrame, live: DataFrame, gate: float = th.RECALL_GATE, scope: str = "user", with_text: bool = True) -> DataFrame:
    """The rows of score at or above the gate, through blocks' indexes of tokens: no other pair is written."""
    return blocks.compare(*_tokens(queries, live, scope), scope, blocks.at_least(gate), with_text)


def selected(queries: DataFrame, live: DataFrame, gate: float = th.RECALL_GATE, band: float = th.RECALL_BAND, cap: int = th.RECALL_CAP, scope: str = "user") -> DataFrame:
    """The rows of select(score): of each block only those are written that can be among them."""
    return select(blocks.compare(*_tokens(queries, live, scope), scope, blocks.top(gate, band, cap)), gate, band, cap)


def injected(queries: DataFrame, live: DataFrame, budget: int = th.BUDGET_CHARS, scope: str = "user") -> DataFrame:
    """The rows of inject(score): of each block only those are written that can fit. A text that a scope repeats is its first id's."""
    once = live.groupBy(scope, "text").agg(F.min("id").alias("id")).withColumn("size", F.length("text") + 1)
    return inject(blocks.compare(*_tokens(queries, once, scope, "size"), scope, blocks.within(budget)).repartition("query_id"), budget)


def select(scored: DataFrame, gate: float = th.RECALL_GATE, band: float = th.RECALL_BAND, cap: int = th.RECALL_CAP, query: str = "query_id", order: str = "id") -> DataFrame:
    """Rows at or above the gate and within the band below the best, best first, at most cap; adds rank from 1."""
    kept = scored.where(F.col("score") >= gate).withColumn("__best", F.max("score").over(Window.partitionBy(query)))
    inside = kept.where(F.col("score") >= F.col("__best") * (1 - band)).drop("__best")
    return inside.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), order))).where(F.col("rank") <= cap)


def pack(ranked: DataFrame, budget: int = th.BUDGET_CHARS, query: str = "query_id", order: str = "rank") -> DataFrame:
    """query, packed text, and how many texts fit: in order, up to the first that would exceed the budget."""
    used = F.sum(F.length("text") + 1).over(Window.partitionBy(query).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    fits = ranked.withColumn("__used", used).where(F.col("__used") <= budget)
    listed = F.array_sort(F.collect_list(F.struct(order, "text")))
    return fits.groupBy(query).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("packed"), F.count("*").alias("n"))


def inject(cards: DataFrame, budget: int = th.BUDGET_CHARS, query: str = "query_id", order: str = "id") -> DataFrame:
    """As pack, of all cards best first, a repeated text counting once."""
    first = Window.partitionBy(query, "text").orderBy(F.desc("score"), order)
    once = cards.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), order)))
    return pack(ranked, budget, query)
