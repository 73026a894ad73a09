"""Aggregations of event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums


def percentiles(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """Three percentiles by group: interpolated, at the floored index, and by nearest rank.

    Equal values are counted first; ranks are prefix sums over ranges of (group, value) of those counts, so
    a group of any size, or one with a single value, is spread, and a group keeps four values, not all of them.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = prefix_sums(counted, [by], [F.col(value)], {"__end": F.col("__n")}).withColumnRenamed("__end_all", "n")
    place = (F.col("n") - 1) * p
    at = lambda i: F.max(F.when((F.col("__end") - F.col("__n") <= i) & (F.col("__end") > i), F.col(value)))
    found = ranked.groupBy(by).agg(
        at(F.floor(place)).alias("floored"), at(F.ceil(place)).alias("__above"), F.max(place - F.floor(place)).alias("__share"), at(F.greatest(F.ceil(F.col("n") * p) - 1, F.lit(0))).alias("nearest")
    )
    return found.select(by, (F.col("floored") + (F.col("__above") - F.col("floored")) * F.col("__share")).alias("interpolated"), "floored", "nearest")


def last_n(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n newest rows."""
    return rows.orderBy(F.desc(order)).limit(n)


def sessionise(rows: DataFrame, key: str, time: str, gap_seconds: int, tie: str) -> DataFrame:
    """Sessions of a key, cut where nothing comes for gap_seconds: key, session, n, seconds."""
    at = Window.partitionBy(key).orderBy("__t", tie)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    timed = rows.withColumn("__t", t)
    new = F.coalesce(F.col("__t") - F.lag("__t").over(at) > gap_seconds * 1_000_000, F.lit(True)).cast("int")
    cut = timed.withColumn("session", F.sum(new).over(at))
    return cut.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), ((F.max("__t") - F.min("__t")) / 1_000_000).alias("seconds"))


def gates(rows: DataFrame, by: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """by and failures: the names of the checks that the row fails, in their order."""
    return rows.select(by, F.array_join(F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in checks])), ",").alias("failures"))
