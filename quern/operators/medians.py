"""Running medians of all earlier values of a key, and what failed requests cost against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import prefix_sums
from quern.session import cut

#: Bits of a value that a step of the descent settles.
DIGIT = 4
#: Seconds after an error in which a request counts as its retry.
RETRY = 120


def running_select(values: DataFrame, asked: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """asked with `value`: the rank-th smallest (from 1) of the values of its key that stand before it.

    values: by, order, value (whole numbers, not negative). asked: by, order, rank, and columns of its own.
    A value is found digit by digit from the top: at each digit the values that share the digits so far
    are counted up to the row by prefix sums, which deal a key of any size to many partitions. Nothing is
    collected by key. A rank beyond the number of values gives null. A value at the same place as a
    question isn't before it.
    """
    most = values.agg(F.max("value")).first()[0]
    if most is None:
        return asked.withColumn("value", F.lit(None).cast("long"))
    shift = -(-max(int(most).bit_length(), 1) // DIGIT) * DIGIT
    size = 1 << DIGIT
    own = [c for c in asked.columns if c not in [*by, *order, "rank"]]
    open_ = asked.withColumn("__node", F.lit(0).cast("long")).withColumn("__rank", F.col("rank").cast("long"))
    while shift:
        shift -= DIGIT
        digit = F.shiftright("value", shift).bitwiseAND(F.lit(size - 1))
        elements = values.select(*by, *order, F.lit(1).alias("__kind"), F.shiftright("value", shift + DIGIT).alias("__node"), digit.alias("__digit"))
        both = elements.unionByName(open_.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
        counted = prefix_sums(both, [*by, "__node"], [*[F.col(c) for c in order], F.col("__kind")], {f"__c{d}": (F.coalesce(F.col("__digit"), F.lit(-1)) <= d).cast("long") * F.col("__kind") for d in range(size)})
        here = counted.filter("__kind = 0")
        step, before = F.lit(None).cast("long"), F.lit(0).cast("long")
        for d in range(size - 1, -1, -1):
            enough = F.col(f"__c{d}") >= F.col("__rank")
            step = F.when(enough, F.lit(d).cast("long")).otherwise(step)
            before = F.when(enough, F.col(f"__c{d - 1}") if d else F.lit(0).cast("long")).otherwise(before)
        open_ = cut(here.select(*by, *order, "rank", *own, (F.col("__node") * size + step).alias("__node"), (F.col("__rank") - before).alias("__rank")))
    return open_.select(*by, *order, "rank", *own, F.col("__node").alias("value"))


def running_medians(rows: DataFrame, by: list[str], order: list[str], value: Column, ask: Column) -> DataFrame:
    """by, order and median of the rows where `ask` holds: the median of the values before it in its key.

    Rows whose value is null don't count. Of an even number it is the mean of the two middle values,
    without its fraction; without earlier values it is null. (by, order) has to be unique.
    """
    named = rows.select(*by, *order, value.cast("long").alias("value"), F.coalesce(ask, F.lit(False)).alias("__ask"))
    counted = prefix_sums(named, by, [F.col(c) for c in order], {"__n": F.col("value").isNotNull().cast("long")})
    before = cut(counted.filter("__ask").select(*by, *order, (F.col("__n") - F.col("value").isNotNull().cast("long")).alias("__n")))
    ranks = F.array((F.col("__n") + 1).cast("long"), F.col("__n") + 2)
    asked = before.filter("__n > 0").select(*by, *order, F.explode(F.transform(ranks, lambda r: F.floor(r / 2))).alias("rank"))
    found = running_select(named.filter("value is not null").select(*by, *order, "value"), asked.distinct(), by, order)
    medians = found.groupBy(*by, *order).agg(F.floor(F.avg("value")).cast("long").alias("median"))
    return before.select(*by, *order).join(medians, [*by, *order], "left")


def negative_events(requests: DataFrame, seconds: int = RETRY) -> DataFrame:
    """session, events and tokens: what retries after failed requests took more than a usual request.

    requests: session, ts, id, original, failed, usual. A usual request isn't a failed one and has a
    positive size. A failed request costs what its retry, the next request of the session with a size,
    has over the median of the usual requests before, if that retry comes within `seconds`. Sessions
    without such costs have zeros. Rows are in order of ts, then id; a session of any size is many
    partitions.
    """
    order = ["ts", "id"]
    rows = requests.select("session", *order, "original", F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("usual", F.lit(False)).alias("usual"))
    usual = F.when(F.col("usual") & ~F.col("failed") & (F.col("original") > 0), F.col("original"))
    medians = running_medians(rows, ["session"], order, usual, F.col("failed"))
    able = F.coalesce(F.col("ts").isNotNull() & (F.col("original") > 0), F.lit(False)).cast("long")
    ranked = cut(prefix_sums(rows.withColumn("able", able), ["session"], [F.col(c) for c in order], {"rank": F.col("able")}))
    after = ranked.filter("able = 1").select("session", F.col("rank").alias("next"), F.col("ts").alias("retry_ts"), F.col("original").alias("retry"))
    failed = ranked.filter("failed").select("session", *order, (F.col("rank") + 1).alias("next"))
    late = F.unix_micros(F.col("retry_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    met = failed.join(after, ["session", "next"]).filter(F.coalesce(late < seconds * 1_000_000, F.lit(True)))
    costs = met.join(medians, ["session", *order]).select("session", (F.col("retry") - F.col("median")).alias("extra")).filter("extra > 0")
    sums = costs.groupBy("session").agg(F.count(F.lit(1)).alias("events"), F.sum("extra").cast("long").alias("tokens"))
    every = rows.select("session").distinct().join(sums, "session", "left")
    return every.select("session", F.coalesce("events", F.lit(0)).cast("long").alias("events"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
