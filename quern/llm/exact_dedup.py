"""Exact deduplication by skew-safe combining.

Texts are equal when their normalised forms (every character of [\\x20\\x09-\\x0D] deleted) are
identical. Three stages, each grouping on the normalised text itself beside its digest, so that
equality is always decided on full content:

1. map side: every task merges the copies that it reads (partial aggregation);
2. the partial groups meet under (digest, salt, text), the salt spreading a hot group's rows;
3. the salt winners, at most SALTS rows per text, meet under (digest, text).

The decision for each row is attached by digest. Groups above a size that at most HOT_GROUPS groups
can have are attached by a broadcast of that proven bound, so no hot key enters the shuffled join.
Digests that two different texts share (counted after stage 3) would be attached by text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import attach, cut, hot_keys

SALTS = 32
#: At most this many groups are larger than rows / HOT_GROUPS.
HOT_GROUPS = 4096

# The characters that do not count in a comparison.
BLANKS = " \t\n\x0b\f\r"

#: Room for any doc_id below a code point count in one sortable decimal.
_ID_SPAN = str(1 << 65)
_ID_SHIFT = str(1 << 63)


def normalise(text: Column) -> Column:
    """`text` without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _rank(text: Column, doc_id: Column) -> Column:
    """Larger is better: more code points in the original text, then the smaller doc_id."""
    length = F.length(F.coalesce(text, F.lit(""))).cast("decimal(38,0)")
    return length * F.lit(_ID_SPAN).cast("decimal(25,0)") + (F.lit(_ID_SHIFT).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"))


def _rank_id(rank: Column) -> Column:
    """The doc_id inside a rank."""
    low = rank % F.lit(_ID_SPAN).cast("decimal(25,0)")
    return (F.lit(_ID_SHIFT).cast("decimal(20,0)") - low).cast("long")


def fingerprint(norm: Column) -> list[Column]:
    """What stands for a text once its group is known: two digests and the length."""
    return [F.sha2(norm, 256).alias("sha"), F.md5(norm).alias("md5"), F.length(norm).alias("chars")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], list[Column]] = fingerprint) -> DataFrame:
    """One row per distinct normalised text: sha, md5, chars, norm, keep_id, group_size."""
    t = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), normalise(t).alias("norm"), _rank(t, F.col(id_col).cast("long")).cast("decimal(38,0)").alias("rank"))
    keyed = base.select(digest(F.col("norm"))[0], F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "norm", "rank")
    salted = keyed.groupBy("sha", "salt", "norm").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    merged = salted.groupBy("sha", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
    return merged.select(*digest(F.col("norm")), "norm", _rank_id(F.col("rank")).alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], list[Column]] = fingerprint) -> DataFrame:
    """One row per row of `docs`: id_col, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other and to texts of white space only. Ties in length go
    to the smaller id. Rows with a null id never stay unless their whole group has null ids, and then
    one of them does (keep_id null). Rows that repeat the winning id inside a group count as members,
    and exactly one of them is kept, the longest. Very long texts are compared as a whole. Ids are cast to
    long: strings that are no numbers are an error of the cast. An empty table gives an empty result;
    other columns of `docs`, whatever their names, are not read.
    """
    key = ["sha", "md5", "chars"]
    groups = exact_groups(docs, id_col, text_col, salts, digest)
    winners = cut(groups.select(*key, "keep_id", "group_size"))
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), normalise(t).alias("norm"), F.length(t).alias("len"))
    members = texts.select("id", "len", *digest(F.col("norm")))
    if not winners.groupBy(*key).count().filter("count > 1").isEmpty():
        # Different texts share digests and length: only their content tells them apart.
        out = texts.select("id", "len", "norm", *digest(F.col("norm"))).join(groups, [*key, "norm"]).drop("norm")
    else:
        total = winners.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
        hot_size = max(1000, -(-total // HOT_GROUPS))
        hot = F.broadcast(winners.filter(F.col("group_size") > hot_size))
        found = members.join(hot, key)
        rest = members.join(hot.select(*key), key, "left_anti").join(winners.filter(F.col("group_size") <= hot_size), key)
        out = found.unionByName(rest)
    wins = F.col("id").eqNullSafe(F.col("keep_id"))
    if docs.groupBy(F.col(id_col).cast("long").alias("id")).count().filter("count > 1").isEmpty():
        kept = out.withColumn("kept", wins)
    else:
        # Several rows of a group have the winning id: the longest stays, of equal ones any. Combined, so no hot id is one task.
        group = F.struct("sha", F.coalesce("keep_id", F.lit(0)).alias("keep"), F.col("keep_id").isNull().alias("none"))
        tagged = cut(out.withColumn("wins", wins).withColumn("group", group).withColumn("tag", F.struct("len", F.monotonically_increasing_id().alias("row"))))
        best = tagged.filter("wins").groupBy("group").agg(F.max("tag").alias("best"), F.count(F.lit(1)).alias("rows"))
        chosen = attach(tagged.filter("wins"), best.select("group", "best"), "group", hot_keys(best, "group")).withColumn("kept", F.col("tag") == F.col("best"))
        kept = tagged.filter("not wins").withColumn("kept", F.lit(False)).unionByName(chosen.select(*tagged.columns, "kept"))
    return kept.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
