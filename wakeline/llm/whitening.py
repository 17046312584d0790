"""Operator 11: embeddings on the principal axes of their covariance, scaled to variance one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Pairs of dimensions that one aggregation sums: all pairs of up to 76 dimensions; more take further aggregations.
PAIRS = 3_000
#: An axis whose variance is at most this share of the greatest is flat: what doubles leave of it isn't told from nothing.
FLAT = 1e-10


@dataclass(frozen=True)
class Whitening:
    """A fit: number of vectors, sums by dimension, and axes (rows) by falling variance, flat ones left out."""

    n: int
    sums: list[int]
    variances: np.ndarray
    axes: np.ndarray
    trace: float


def scaled(vector: str) -> Column:
    """Entries as whole numbers, floor(1024 c) + 100000."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def _finite(vector: str) -> Column:
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    # NaN is greater than any number here
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (c.cast("double") > low) & (c.cast("double") < high))


def _usual_length(rows: DataFrame, vector: str) -> int:
    found = rows.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).where("size > 0")
    best = found.agg(F.max_by("size", F.struct("n", "size")).alias("size")).first()
    return best["size"] or 0


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows ``(key, x)`` of whole numbers, without vectors that are null or hold a null or non-finite entry, and the number of dimensions.

    Vectors of another length than the commonest (of ties the greatest) have
    no place in the space and go, too; so do empty ones.
    """
    rows = vectors.select(F.col(key), F.col(vector).alias("x")).where(_finite("x"))
    size = _usual_length(rows, "x")
    return rows.where(F.size("x") == size).select(key, scaled("x").alias("x")), size


def _centred(size: int, n: int, sums: list[int]) -> Column:
    """n x - S by dimension, exact."""
    return F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in sums)), lambda x, s: x * F.lit(n).cast("long") - s) if size else F.col("x")


def fit(rows: DataFrame, size: int) -> Whitening | None:
    """Axes of the covariance (divisor n) of rows ``x``; nothing where there are no rows.

    Two aggregations: sums by dimension, exact; then the sums of products of
    centred entries for the upper triangle of all pairs of dimensions, written
    as one SQL expression each. A task keeps the sums, whatever its rows, and
    the driver gets one row of them for LAPACK.
    """
    if not size:
        return None
    found = rows.agg(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size))).first()
    n, sums = found.n, [found[f"s{i}"] for i in range(size)]
    # y/n is x - S/n
    flat = rows.select(_centred(size, n, sums).alias("y")).selectExpr(*(f"coalesce(y[{i}] / {n}D, 0D) AS d{i}" for i in range(size)))
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    covariance = np.zeros((size, size))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        products = flat.selectExpr(*(f"sum(d{i} * d{j}) AS p{i}_{j}" for i, j in some)).first()
        for (i, j), value in zip(some, products, strict=True):
            covariance[i, j] = covariance[j, i] = value / n
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > max(values.max(), 0.0) * FLAT]
    return Whitening(n, sums, values[order], columns[:, order].T, float(np.trace(covariance)))


def project(rows: DataFrame, model: Whitening, key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """Rows ``(key, deviation, w1, w2, ...)``: the exact sum of (n x - S)^2, null where it exceeds a long, and the whitened entries."""
    size, count = len(model.sums), min(most, len(model.variances))
    centred = rows.select(key, _centred(size, model.n, model.sums).alias("y"))
    deviation = F.aggregate("y", F.lit(0).cast("long"), lambda total, y: F.try_add(total, F.try_multiply(y, y))).alias("deviation")
    flat = centred.select(key, deviation, *(F.expr(f"y[{i}] / {model.n}D").alias(f"d{i}") for i in range(size)))
    weights = model.axes[:count] / np.sqrt(model.variances[:count, None])
    return flat.select(key, "deviation", *(F.expr(" + ".join(f"d{i} * {float(a)!r}D" for i, a in enumerate(row))).alias(f"w{k + 1}") for k, row in enumerate(weights)))


def identity_error(projected: DataFrame, count: int) -> float:
    """The largest absolute entry of the whitened covariance minus the identity, from one aggregation over all rows."""
    pairs = [(i, j) for i in range(1, count + 1) for j in range(i, count + 1)]
    found = projected.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, found, strict=True))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for every usable vector and each of its first ``most`` components.

    ``component`` counts from 1 by falling variance, ``whitened`` is the
    centred vector on that axis over the root of its variance, ``explained``
    the variance's share of all, ``deviation`` the exact sum of (n x - S)^2
    over dimensions (null beyond a long), ``n`` the vectors of the fit and
    ``identity_error`` how far the whitened covariance is from the identity.

    See :func:`usable` for what goes. Repeated rows count and return each, null
    keys stay, other columns are ignored, whatever their names. Axes of no
    variance have no component: fewer than ``most`` come from fewer dimensions
    or flat data, and none from equal vectors or an empty table. An entry
    beyond what n x can hold as a long raises. No row is shuffled: sums only.
    """
    rows, size = usable(vectors, key, vector)
    model = fit(rows, size)
    out = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], out)
    found = project(rows, model, key, most)
    count = min(most, len(model.variances))
    error = identity_error(found, count)
    parts = [F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k + 1}").alias("whitened"), F.lit(float(model.variances[k] / model.trace)).alias("explained")) for k in range(count)]
    return found.select(key, "deviation", F.inline(F.array(*parts))).select(key, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
