"""Mixing sources to target weights by Poisson replication.

A document of source s gets K copies, K Poisson with mean rate(s) = weight(s) * total / size(s), where
sizes count documents or bytes. K comes from inverting the Poisson distribution at a uniform number
that is hashed from the seed and the document's id, so runs and retries agree. Copies are exploded and
dealt by a hash of (seed, id, copy): the row order inside and across partitions is a random
permutation of the mixture.

A source's probabilities are a closed expression of the count, from far below the mean to far above
it, so a table has some 24 square roots of the rate as entries and is built in one pass; it is joined by
source, and a document adds up probabilities until they exceed its number. Documents of small sources in
large mixtures get very many copies: such counts are exploded in slices that are dealt out first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import BROADCAST_BYTES, cut

#: Where the distribution's tails are cut: beyond mean +- (TAIL * sqrt(mean) + TAIL) no double is left.
TAIL = 12
#: Copies of a document that one task makes.
SLICE = 1000


def number(seed: str, digits: int, *cols: Column) -> Column:
    """The first hexadecimal digits of md5(seed:cols) as a long."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def uniform(seed: str, *cols: Column) -> Column:
    """A double in [0, 1) of 52 hashed bits."""
    return number(seed, 13, *cols) / F.lit(float(1 << 52))


def log_factorial(k: Column) -> Column:
    """ln(k!) by Stirling's series, for small k by the product."""
    x = k.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    return F.when(k < 16, F.element_at(small, F.least(k, F.lit(15)).cast("int") + 1)).otherwise(series)


def poisson_table(rate: Column) -> Column:
    """struct<low, p>: P(K = low), P(K = low + 1), ... of a Poisson variable, without tails that no double shows."""
    reach = TAIL * F.sqrt(rate) + TAIL
    low = F.greatest(F.lit(0), F.floor(rate - reach)).cast("long")
    counts = F.sequence(low, F.ceil(rate + reach).cast("long"))
    return F.struct(low.alias("low"), F.transform(counts, lambda k: F.exp(k * F.ln(rate) - rate - log_factorial(k))).alias("p"))


def invert(table: Column, u: Column) -> Column:
    """The count at which the cumulative probabilities exceed u."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))
    return table["low"] + F.aggregate(
        table["p"],
        start,
        lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a["n"] + F.when(a["sum"] + p <= u, 1).otherwise(0)).alias("n")),
        lambda a: a["n"],
    )


def source_rates(docs: DataFrame, weights: dict[str, float] | None, by: str, source_col: str, text_col: str) -> DataFrame:
    """One row per source: src, n_docs, size, weight (scaled to a sum of 1), rate.

    weights None: all sources weigh the same. Sources without a weight get 0, weights without a
    source don't count. Null is a source of its own, named by the key None.
    """
    unit = F.lit(1) if by == "docs" else F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1
    sizes = docs.groupBy(F.col(source_col).alias("src")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(unit).cast("long").alias("size"))
    if weights is None:
        raw = F.lit(1.0)
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
    weighed = cut(sizes.withColumn("raw", raw))
    sums = weighed.agg(F.sum("raw").alias("raw"), F.sum("size").alias("size")).first()
    share = F.col("raw") / F.lit(sums["raw"]) if sums["raw"] else F.lit(0.0)
    return weighed.select("src", "n_docs", "size", share.alias("weight"), (share * F.lit(float(sums["size"] or 0)) / F.col("size")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, by: str = "docs", epochs: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The mixture: `columns` of docs (all by default), then mix_copy (0, 1, ...) and mix_key (long), shuffled globally.

    epochs scales the mixture against the size of `docs`. A source of weight 0 leaves no copies; with
    no positive weight the mixture is empty, and so it is for an empty table. Rows that repeat an id
    get the same number of copies each; rows with a null id are told apart by their text. Null, empty and
    very long texts are mixed like others (by="bytes" counts the size of the first two as 1). Columns of
    `docs` called mix_copy or mix_key are replaced; any other name may occur.
    """
    spark = docs.sparkSession
    kept = [c for c in (columns or docs.columns) if c not in ("mix_copy", "mix_key")]
    rates = source_rates(docs, weights, by, source_col, text_col).select("src", (F.col("rate") * epochs).alias("rate"))
    facts = rates.agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("top"), F.sum(F.sqrt("rate")).alias("roots"), F.sum(F.length("src")).alias("names")).first()
    width = 16 * TAIL * ((facts["roots"] or 0) + 2 * facts["n"]) + (facts["names"] or 0) * 4 + 64 * facts["n"]
    table = rates.filter("rate > 0").select("src", poisson_table(F.col("rate")).alias("table"))
    side = F.broadcast(table) if width <= BROADCAST_BYTES else table
    name = F.when(F.col(id_col).isNotNull(), F.col(id_col).cast("string")).otherwise(F.concat(F.lit("null"), F.coalesce(F.md5(F.col(text_col).cast("string")), F.lit(""))))
    packed = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), name.alias("name"), F.col(source_col).alias("source"))
    drawn = packed.join(side, packed["source"].eqNullSafe(side["src"])).select("row", "name", invert(F.col("table"), uniform(seed, F.col("name"))).alias("n")).filter("n > 0")
    copies = F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("copy")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if (facts["top"] or 0) + TAIL * ((facts["top"] or 0) ** 0.5 + 1) <= SLICE:
        rows = drawn.select("row", "name", copies)
    else:
        slices = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLICE).cast("long"))).alias("first")
        dealt = drawn.filter(F.col("n") > SLICE).select("row", "name", "n", slices).repartition(n, "name", "first")
        inside = F.explode(F.transform(F.sequence(F.col("first"), F.least(F.col("first") + SLICE, F.col("n")) - 1), lambda k: k.cast("int"))).alias("copy")
        rows = drawn.filter(F.col("n") <= SLICE).select("row", "name", copies).unionByName(dealt.select("row", "name", inside))
    # The hash deals rows evenly whatever their source; equal names and copies tie only when rows repeat.
    keyed = rows.select("row.*", F.col("copy").alias("mix_copy"), number(seed, 15, F.col("name"), F.col("copy")).alias("mix_key"))
    return keyed.repartition(n, "mix_key").sortWithinPartitions("mix_key")
