"""Bounded samples of labelled rows for fitting classifiers.

The bound is a parameter of every caller. A sample is the rows with the smallest hashes of their id,
so it is the same on every run and spread over the whole table.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import attach, cut, hot_keys

#: Rows of a sample over all labels, but for one row of each label.
TOTAL_ROWS = 64_000
#: Bytes of the texts of a sample.
TOTAL_BYTES = 256 << 20


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def sample_ids(labelled: DataFrame, id_col: str, label_col: str, per_label: int) -> list[tuple]:
    """(id, label) of at most per_label rows of each label, however many labels there are.

    Beyond TOTAL_ROWS // per_label labels every label gives fewer rows (at least 1), so that the sample
    stays near TOTAL_ROWS; no label is dropped. `labelled` is narrow (id and label). The rows of a label
    are counted, so the hash below which its smallest ones lie is known up to chance (a wide margin is
    added); what lies below is bounded and is ranked on the driver. Repeated rows of an id count once
    in a sample; a label whose ids repeat gives fewer.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).alias("h")).filter("id is not null and label is not null")
    counts = cut(rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")))
    per_label = max(1, min(per_label, TOTAL_ROWS // max(1, counts.count())))
    most = per_label + 6 * per_label**0.5 + 6
    below = F.when(F.col("rows") <= most, F.lit(2.0)).otherwise(F.lit(most) / F.col("rows"))
    near = attach(rows, counts.select("label", below.alias("below")), "label", hot_keys(counts, "label")).filter((F.col("h") / F.lit(float(1 << 64)) + 0.5) < F.col("below"))
    by: dict = {}
    for r in near.select("id", "label", "h").distinct().collect():
        by.setdefault(r["label"], []).append((r["h"], r["id"]))
    ordered = sorted(by.items(), key=lambda x: (-min(len(x[1]), per_label), str(x[0])))
    return [(i, label) for label, found in ordered for _, i in sorted(found)[:per_label]]


def sample_texts(docs: DataFrame, picked: list[tuple], id_col: str, text_col: str, total_bytes: int = TOTAL_BYTES) -> list[tuple]:
    """(label, text) of the picked ids, in the order of `picked`; the id list is the broadcast side.

    The texts of a label are taken in that order while they are within its equal share of total_bytes;
    sizes are known before a text is read.
    """
    if not picked:
        return []
    kind = docs.schema[id_col].dataType.simpleString()
    ids = docs.sparkSession.createDataFrame([(i, n) for n, (i, _) in enumerate(picked)], f"id {kind}, n long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(ids), "id")
    share, used, fits = total_bytes / len({label for _, label in picked}), Counter(), set()
    # A repeated id has a row for each of its texts: all or none of them.
    for n, size in sorted((r["n"], r["size"]) for r in rows.groupBy("n").agg(F.sum(F.octet_length("text")).alias("size")).collect()):
        used[picked[n][1]] += size
        if used[picked[n][1]] <= share:
            fits.add(n)
        else:
            used[picked[n][1]] -= size
    if len(fits) < len(picked):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(n,) for n in sorted(fits)], "n long")), "n", "left_semi")
    found = sorted((r["n"], r["text"]) for r in rows.select("n", "text").collect())
    return [(picked[n][1], text) for n, text in found]
