"""The corpus pipeline: five stages, each the work of one operator, over the documents table.

Stage by stage the rows are written as Parquet and read again, so a lost executor costs a stage at
most. All stages but the last return the columns of `documents`.

- language_id drops documents without a language (no text or no letter).
- exact_dedup keeps one row of each group of equal texts.
- near_dedup keeps one row of each component of the join on 5-word shingles at a similarity of 0.8;
  texts without words are in no component and stay.
- mixing replicates documents to equal shares of bytes by source and shuffles them.
- sentencepiece returns doc_id, ids, n_ids and the decoded text.

Decisions are attached to rows by id and text, so rows with null or repeated ids are decided on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_codec
from quern.llm.queries import PIECES
from quern.session import cut

#: Set to a DuckDB query where SQL can express every stage.
ORACLE_SQL = None


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have a language: `und` goes, which is null texts and texts without a letter.

    Where no language can be learned (no labels), documents with a letter stay as well. Ties, repeated
    rows and very long texts are decided like others; an empty table stays empty.
    """
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    if not model.labels:
        return docs.filter(F.coalesce(F.col("text").rlike(language_id.LETTER), F.lit(False)))
    found = language_id.identify(docs, model, keep=docs.columns)
    return found.filter(F.col("lang_pred") != language_id.UNDETERMINED).select(*docs.columns)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest, then the one with the smallest id.

    Null and empty texts are one group; of rows that repeat an id and a text one stays.
    """
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.sha2(exact_dedup.normalise(F.col("text")), 256).alias("digest"))
    rows = packed.join(kept, packed["id"].eqNullSafe(kept["id"]) & (packed["digest"] == kept["digest"]), "left_semi")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        # Rows that repeat an id and a text: the longest original stays.
        rows = rows.groupBy("id", "digest").agg(F.max_by("row", F.coalesce(F.length("row.text"), F.lit(-1))).alias("row"))
    return rows.select("row.*")


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5 words, similarity 0.8), the one with the smallest id.

    Texts without words stay; repeated ids are decided by their own texts.
    """
    return ngram_join.near_dedup(docs, words=5, percent=80)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source (null is one) replicated to an equal share of bytes, in random order; a copy has its document's columns."""
    return mixing.mix(docs, by="bytes").select(*docs.columns)


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and decoded of every row; null texts give nulls."""
    return sentencepiece_codec.encode_decode(docs, sentencepiece_codec.load(PIECES))


STAGES = [
    ("language_id", stage_language),
    ("exact_dedup", stage_exact),
    ("near_dedup", stage_near),
    ("mixing", stage_mixing),
    ("sentencepiece", stage_sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
