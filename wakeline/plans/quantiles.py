"""Exact percentiles by selection, without a task that holds all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .materialize import drop_materialized, materialize

#: Pieces of a range in one pass; a range of at most so many values is sorted; ranges up to this many are broadcast.
BINS, SORTED, BROADCAST_RANGES = 2_048, 100_000, 100_000


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, n, share, value)``: percentiles between neighbouring values, as SQL's ``percentile_cont`` gives them.

    Each share needs the values of two ranks. All ranks of all groups are
    narrowed together: a pass counts the values of every range that still holds
    a rank in ``BINS`` pieces (a partial aggregate), and keeps the piece with
    the rank. Once a range has at most ``SORTED`` values, or equal ones only,
    it is settled. Passes grow with the logarithm of a range's values, or for
    very uneven ones of their spread, and each reads one column.

    Nulls and NaN are left out. A group without values has no rows; null
    groups are groups; repeated values count.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("a share lies between 0 and 1")
    names = [f"_g{k}" for k in range(len(by))]
    kept = rows.select(*(F.col(c).alias(g) for c, g in zip(by, names, strict=True)), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    # negative zero equals zero; groups are told apart by one key that is never null
    key = F.to_json(F.struct(*(F.col(g).cast("string") for g in names)), {"ignoreNullFields": "false"}) if names else F.lit("")
    base = materialize(kept.withColumns({"v": F.col("v") + 0.0, "key": key}), "values")
    ends = materialize(base.groupBy("key", *names).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "ends")
    place = F.col("share") * (F.col("n") - 1)
    wanted = ends.select("key", *names, "n", "low", "high", F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")).withColumns({"below": F.floor(place), "above": F.ceil(place), "place": place})
    # a rank counts the values before it in its range, which has n of them
    ranks = wanted.select("key", "low", "high", "n", F.explode(F.array("below", "above")).alias("rank")).distinct().withColumn("left", F.col("rank"))
    ranks = materialize(ranks, "ranks")
    while ranks.where(_open()).limit(1).count():
        after = materialize(ranks.where(~_open()).unionByName(_narrowed(base, ranks.where(_open()))), "ranks")
        drop_materialized(ranks)
        ranks = after
    small = ranks.where("low < high")
    order = Window.partitionBy("key", "low", "high").orderBy("v")
    sorted_ = _within(base, small).withColumn("left", (F.row_number().over(order) - 1).cast("long"))
    found = small.join(sorted_, ["key", "low", "high", "left"]).select("key", "rank", "v").unionByName(ranks.where("low = high").select("key", "rank", F.col("low").alias("v")))
    found = materialize(found, "found")
    at = lambda rank: found.select("key", F.col("rank").alias(rank), F.col("v").alias(f"{rank}_v"))
    both = wanted.join(at("below"), ["key", "below"]).join(at("above"), ["key", "above"])
    between = F.when(F.col("below") == F.col("above"), F.col("below_v")).otherwise((F.col("above") - F.col("place")) * F.col("below_v") + (F.col("place") - F.col("below")) * F.col("above_v"))
    return both.select(*(F.col(g).alias(c) for c, g in zip(by, names, strict=True)), "n", "share", between.alias("value"))


def _open():
    return (F.col("low") < F.col("high")) & (F.col("n") > SORTED)


def _within(base: DataFrame, ranks: DataFrame) -> DataFrame:
    """Values with each range that holds them; the ranges of a group are equal or apart."""
    ranges = ranks.select("key", "low", "high").distinct()
    ranges = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
    return base.select("key", "v").join(ranges, "key").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))


def _narrowed(base: DataFrame, ranks: DataFrame) -> DataFrame:
    """The piece of its range that each rank lies in; pieces have their own least and greatest values as ends."""
    width, v = F.col("high") - F.col("low"), F.col("v")
    # a range of nearly all doubles has no width as a double, but half of it has
    share = F.when(width < float("inf"), (v - F.col("low")) / width).otherwise((v / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2))
    pieces = _within(base, ranks).groupBy("key", "low", "high", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("piece")).agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
    upto = F.sum("n").over(Window.partitionBy("key", "low", "high").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.withColumn("upto", upto)
    met = ranks.drop("n").join(pieces, ["key", "low", "high"]).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
    return met.select("key", F.col("first").alias("low"), F.col("last").alias("high"), "n", "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))


def percentile_columns(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row with a percentile in each named column; nulls where there are no values."""
    found = percentiles(rows, value, sorted(set(shares.values())))
    return found.agg(*(F.max(F.when(F.col("share") == float(s), F.col("value"))).alias(name) for name, s in shares.items()))
