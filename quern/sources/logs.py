"""JSON-lines logs and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums

ENVELOPE = "type string, ts timestamp, payload string"


def read_envelopes(spark: SparkSession, path: str, kind: str | None = None, since: str | None = None) -> DataFrame:
    """type, ts, payload (JSON text) of well-formed lines; malformed ones are dropped. A folder of days (dt=...) is pruned by `since`."""
    rows = spark.read.text(path)
    parsed = rows.select(F.from_json("value", "type string, ts timestamp").alias("e"), F.get_json_object("value", "$.payload").alias("payload"), *[c for c in rows.columns if c == "dt"])
    out = parsed.select("e.type", "e.ts", "payload", *[c for c in rows.columns if c == "dt"]).filter("type is not null")
    if since is not None and "dt" in rows.columns:
        out = out.filter(F.col("dt") >= F.lit(since))
    return out.filter(F.col("type") == kind) if kind else out


def write_envelopes(events: DataFrame, path: str) -> None:
    """Append events (type, ts, payload struct or string) as daily JSON lines."""
    events.withColumn("dt", F.to_date("ts")).write.mode("append").partitionBy("dt").json(path)


def replay(lines: DataFrame, key: str = "req_id", value: str = "value", order: str = "line") -> DataFrame:
    """The newest line of each key at the place of its first one; lines without a key are dropped."""
    keyed = lines.withColumn(key, F.get_json_object(value, f"$.{key}")).filter(F.coalesce(F.col(key), F.lit("")) != "")
    return keyed.groupBy(key).agg(F.min(order).alias("first_line"), F.max_by(value, order).alias(value))


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """Per file: lines that are not blank and bytes."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), "value")
    return rows.groupBy("file").agg(F.count_if(F.trim("value") != "").alias("lines"), F.max("bytes").alias("bytes"))


def with_columns(table: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns (name -> type) of a table whose schema isn't known beforehand; absent ones are empty strings or nulls."""
    have = set(table.columns)
    return table.select(*[F.col(c).cast(t) if c in have else F.lit("" if t == "string" else None).cast(t).alias(c) for c, t in wanted.items()])


def archive(rows: DataFrame, text: str, order: str, budget: int) -> DataFrame:
    """Content-addressed archive: one row per distinct text (id, text, bytes), newest first within a byte budget.

    The running sum is over the archive's narrow rows (id, order, bytes), in ranges of the order.
    """
    once = rows.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("id")).agg(F.max(order).alias("newest"), F.first(text).alias("text"))
    sized = once.withColumn("bytes", F.octet_length("text").cast("long"))
    used = prefix_sums(sized.select("id", "newest", "bytes"), [], [F.desc("newest"), F.col("id")], {"used": F.col("bytes")})
    return sized.join(used.filter(F.col("used") <= budget).select("id"), "id", "left_semi")


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)
