"""Embedding whitening: covariance from upper-triangle column aggregates, decomposed with LAPACK.

Spark SQL expressions are generated for every pair of dimensions i <= j: the sum of the centred products
(x_i - mean_i) * (x_j - mean_j). All of them are sums of one aggregation over the table, combined before
they are shuffled, so what moves is a row of sums per task. The matrix (its size follows from the
dimensions, never from the rows) is decomposed on the driver by numpy's `eigh`, which is LAPACK's.
Projections are generated expressions again. No Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
#: Sums of one aggregation; the triangle of over 90 dimensions is summed in several.
PAIRS = 4096
#: A component with a smaller share of the variance than this is rounding, not a direction of the data.
RANK = 1e-10
LONG = 1 << 63


@dataclass
class Whitening:
    """n rows with the exact sums of their dimensions, the principal axes (a column each) and variances, falling."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def scale(self, k: int) -> float | None:
        """The standard deviation along component k, None where the data has no such direction."""
        return float(np.sqrt(self.variances[k])) if self.variances[k] > RANK * self.trace else None


def finite(vector: str) -> Column:
    """Whether a vector is there and holds neither nulls nor entries that aren't finite (false for null)."""
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False))


def dimensions(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, the greater of equally frequent ones; 0 without rows."""
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return sizes[0]["d"] if sizes else 0


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a column of vectors of whole numbers (array<bigint>) of one length; None without rows.

    Nulls, vectors of another length than `dimensions` and entries that aren't finite have to be left out
    before (`finite`). Repeated rows count as often as they occur; ties don't matter, as sums don't depend
    on an order. Equal variances leave their axes undetermined inside their plane. Axes are turned so that
    their largest entry is positive.
    """
    d = dimensions(rows, vector)
    if not d:
        return None
    entries = [F.get(vector, F.lit(i)) for i in range(d)]
    exact = rows.agg(F.count(F.lit(1)), *[F.sum(e.cast("decimal(20,0)")) for e in entries]).first()
    n, sums = exact[0], [int(s) for s in exact[1:]]
    centred = rows.select(*[(e.cast("double") - F.lit(s / n)).alias(f"c{i}") for i, (e, s) in enumerate(zip(entries, sums))])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    cov = np.zeros((d, d))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        for (i, j), s in zip(some, centred.selectExpr(*[f"sum(c{i} * c{j})" for i, j in some]).first()):
            cov[i, j] = cov[j, i] = s / n
    e, axes = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")[:components]
    axes = axes[:, order]
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(len(order))] < 0, -1, 1)
    return Whitening(n, sums, axes, e[order], float(np.trace(cov)))


def whiten(rows: DataFrame, vector: str, model: Whitening, column: str = "whitened") -> DataFrame:
    """rows with `column`: array<double>, the centred vector along each component over its standard deviation.

    A component without variance (constant columns, fewer rows than dimensions) gives null entries. Null
    vectors give null entries; an empty table stays empty. Columns of other names are kept as they are.
    """

    def along(k: int) -> Column:
        scale = model.scale(k)
        if scale is None:
            return F.lit(None).cast("double")
        return reduce(Column.__add__, [(F.get(vector, F.lit(i)).cast("double") - F.lit(m)) * F.lit(float(w)) for i, (m, w) in enumerate(zip(model.means, model.axes[:, k]))]) / F.lit(scale)

    return rows.withColumn(column, F.array(*[along(k) for k in range(len(model.variances))]))


def identity_error(whitened: DataFrame, model: Whitening, column: str = "whitened") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    some = [k for k in range(len(model.variances)) if model.scale(k) is not None]
    pairs = [(i, j) for i in some for j in some if i <= j]
    if not pairs:
        return 0.0
    sums = whitened.agg(*[F.covar_pop(F.col(column)[i], F.col(column)[j]) for i, j in pairs]).first()
    return max(abs(s - (i == j)) for (i, j), s in zip(pairs, sums))


def deviation(vector: str, model: Whitening) -> Column:
    """The sum of (n * x - S)^2 over the dimensions, exact; null where a term or the sum is no bigint."""
    if any(abs(s) >= LONG for s in model.sums):
        return F.lit(None).cast("bigint")
    off = [f"try_subtract(try_multiply({model.n}L, get({vector}, {i})), cast('{s}' as bigint))" for i, s in enumerate(model.sums)]
    return F.expr(reduce(lambda a, b: f"try_add({a}, {b})", [f"try_multiply({o}, {o})" for o in off]))


def whitened_components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: id_col, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries go, and so do vectors of another length than
    most (the greater length of equally many), as no covariance joins them. Each entry c becomes the whole
    number floor(scale * c) + shift; entries beyond 2^52 / scale are taken as that bound. Rows that tie or
    repeat, and null ids, are rows like others. explained is null for a table without variance, whitened
    for a component without. Empty tables, and vectors of no entries, give no rows. Other columns aren't
    read, whatever their names; vectors are no texts, so there are no long ones.
    """
    bound = float(1 << 52)
    x = F.transform(F.col(vector_col), lambda e: F.floor(F.least(F.greatest(e.cast("double") * scale, F.lit(-bound)), F.lit(bound))) + F.lit(shift).cast("bigint"))
    usable = rows.filter(finite(vector_col)).select(F.col(id_col).alias("id"), x.alias("x"))
    d = dimensions(usable, "x")
    usable = usable.filter(F.size("x") == d)
    model = fit(usable, "x", components) if d else None
    if model is None:
        return rows.sparkSession.createDataFrame([], f"{id_col} {rows.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    white = whiten(usable, "x", model)
    explained = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else None).cast("double") for e in model.variances])
    error = identity_error(white, model)
    out = white.select("id", deviation("x", model).alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        F.col("id").alias(id_col),
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("k")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
