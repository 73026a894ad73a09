"""Running sums and ranks over keys of any size, without a task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut


def prefix_sums(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """rows with `name` (sum over the rows of its key up to this one) and `name`_all (over all of its key) for each of sums.

    Rows are dealt by ranges of key and order, so a key with most of the rows is many partitions. Only
    keys that a range boundary splits need the totals of other partitions: at most one key a boundary,
    so the broadcast totals are at most two rows a partition. Rows that tie in `order` are taken in any
    order; give a tie-breaker. by may be empty. No rows give no rows.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    key = [*by, "__part"]
    inside = Window.partitionBy(*key)
    running = placed.select(
        "*",
        *[F.sum(c).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias(f"__{name}") for name, c in sums.items()],
        *[F.sum(c).over(inside).alias(f"__{name}_all") for name, c in sums.items()],
    )
    totals = placed.groupBy(*key).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    of_key = Window.partitionBy(*by)
    before = of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    split = totals.withColumn("__parts", F.count(F.lit(1)).over(of_key)).filter("__parts > 1")
    offsets = split.select(
        *[F.col(c).alias(f"__key_{c}") for c in by],
        F.col("__part").alias("__at"),
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__{name}_before") for name in sums],
        *[F.sum(name).over(of_key).alias(f"__{name}_total") for name in sums],
    )
    on = F.col("__part") == F.col("__at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    found = running.join(F.broadcast(offsets), on, "left")
    return found.select(
        *rows.columns,
        *[(F.coalesce(F.col(f"__{name}"), F.lit(0)) + F.coalesce(F.col(f"__{name}_before"), F.lit(0))).alias(name) for name in sums],
        *[F.coalesce(F.col(f"__{name}_total"), F.col(f"__{name}_all"), F.lit(0)).alias(f"{name}_all") for name in sums],
    )


def previous(rows: DataFrame, by: list[str], order: list[Column], columns: list[str], partitions: int | None = None) -> DataFrame:
    """rows with prev_<column> of the row before in its key, and has_prev, for keys of any size.

    As prefix_sums: rows are dealt by ranges of key and order, and only the first row of a key in a range
    looks at another range, whose last rows are broadcast: at most two rows a partition. Give narrow
    columns. Rows that tie in `order` are taken in any order; give a tie-breaker.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id()))
    key = [*by, "__part"]
    inside = Window.partitionBy(*key).orderBy(*order)
    row = F.struct(*columns)
    lagged = placed.withColumn("__prev", F.lag(row).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    last = lagged.withColumn("__last", F.lead(F.lit(1)).over(inside).isNull()).filter("__last").select(*key, row.alias("__row"))
    of_key = Window.partitionBy(*by)
    split = last.withColumn("__parts", F.count(F.lit(1)).over(of_key)).filter("__parts > 1")
    before = split.select(*[F.col(c).alias(f"__key_{c}") for c in by], F.col("__part").alias("__at"), F.lag("__row").over(of_key.orderBy("__part")).alias("__before"))
    on = F.col("__part") == F.col("__at")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    found = lagged.join(F.broadcast(before), on, "left")
    prev = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__prev"))
    return found.select(*rows.columns, *[prev[c].alias(f"prev_{c}") for c in columns], prev.isNotNull().alias("has_prev"))
