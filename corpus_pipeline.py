"""A corpus from raw documents to packed sequences: language, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again for the next. All stages but the last return the columns of documents.

1. language: documents whose language can't be told (null, or without a letter) go. Where no row has a label to learn
   from, the same documents go, by their text alone.
2. near_dedup: one document of each group of near copies stays.
3. substring_dedup: passages of 13 words or more that an earlier document has go from the text; a document of which
   nothing stays goes.
4. packing: pieces of at most 1024 tokens and their place in sequences.

An empty table gives an empty result at each stage; columns beside those of documents are carried through the first
two stages and dropped by the third. There is no SQL for these rows: encoders and filters are beyond it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import common, language, minhash, packing, windows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter. Without a label among the rows learned from, every prediction is `und`, so it isn't asked."""
    # `lang` only teaches the filter; the documents that stay keep the label they came with.
    fitted = language.learn(docs.where(~F.coalesce(language.held_out("doc_id"), F.lit(False))))
    if not fitted.names:
        return language.lettered(docs)
    return language.predict(docs, fitted).where("lang_pred != 'und'").drop("lang_pred", "score")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.first_of_each(docs).select(docs.columns)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = windows.remove_repeats(docs, carry=["lang", "source", "n_chars"])
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("near_dedup", near_dedup_stage), ("substring_dedup", substring_dedup_stage), ("packing", packing_stage)]

#: Language identification, near copies and token ids can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
