"""Echo detection: which documents repeat passages of indexed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import words
from quern.session import bounded, cut


def shingles(rows: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id_col, pos (of the first word, from 1), hash and gram of every word shingle."""
    w = rows.select(id_col, words(F.col(text_col)).alias("w")).filter(F.size("w") >= size)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.array_join(F.slice("w", i, size), " "))
    return w.select(id_col, F.posexplode(grams).alias("pos", "gram")).select(id_col, (F.col("pos") + 1).alias("pos"), F.xxhash64("gram").alias("hash"), "gram")


def _met(docs: DataFrame, blocks: DataFrame, size: int, doc_id: str, block_id: str, text_col: str) -> DataFrame:
    """doc_id, pos, block_id, at: shingles of documents that blocks have. Hashes of the blocks sort out the documents' shingles first, the words decide."""
    index = cut(shingles(blocks, block_id, text_col, size).withColumnRenamed("pos", "at"))
    known = index.select("hash").distinct()
    some = shingles(docs, doc_id, text_col, size).join(bounded(known, known.count(), 24), "hash", "left_semi")
    return some.join(index, ["hash", "gram"])


def echoes(docs: DataFrame, blocks: DataFrame, size: int = 8, doc_id: str = "doc_id", block_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, block_id, shared: how many distinct shingles a document has of a block."""
    return _met(docs, blocks, size, doc_id, block_id, text_col).groupBy(doc_id, block_id).agg(F.countDistinct("gram").alias("shared"))


def echo_spans(docs: DataFrame, blocks: DataFrame, size: int = 8, least_bytes: int = 200, doc_id: str = "doc_id", block_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, block_id, start, block_start, words, bytes: the longest runs of words that a document has of a block, of least_bytes or more.

    Shingles that follow each other in both, gaps and islands over their common offset. bytes counts the words with one blank between.
    """
    met = _met(docs, blocks, size, doc_id, block_id, text_col).select(doc_id, block_id, "pos", "at", (F.col("at") - F.col("pos")).alias("offset"), "gram")
    of = Window.partitionBy(doc_id, block_id, "offset").orderBy("pos")
    island = met.withColumn("run", F.col("pos") - F.row_number().over(of))
    # The first word of every shingle, and the rest of the last one.
    head = F.octet_length(F.substring_index("gram", " ", 1)) + 1
    rest = F.octet_length("gram") - F.octet_length(F.substring_index("gram", " ", 1)) - 1
    runs = island.groupBy(doc_id, block_id, "offset", "run").agg(
        F.min("pos").alias("start"), F.min("at").alias("block_start"), (F.count(F.lit(1)) + (size - 1)).alias("words"), (F.sum(head) + F.max_by(rest, "pos")).cast("long").alias("bytes")
    )
    return runs.filter(F.col("bytes") >= least_bytes).select(doc_id, block_id, "start", "block_start", "words", "bytes")
