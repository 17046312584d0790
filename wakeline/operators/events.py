"""Events, frames and histograms over fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import number
from ..plans import percentile_columns, percentiles


def switch_events(positions: DataFrame) -> DataFrame:
    """Where a vessel's voyage starts (-1 to an id), ends (an id to -1) or switches (an id to another)."""
    order = Window.partitionBy("ship_id").orderBy("seq")
    rows = positions.select("ship_id", "seq", "timestamp", "track_id", F.lag("track_id").over(order).alias("before"))
    kind = F.when((F.col("before") < 0) & (F.col("track_id") >= 0), "start").when((F.col("before") >= 0) & (F.col("track_id") < 0), "end").when(F.col("before") != F.col("track_id"), "switch")
    return rows.withColumn("kind", kind).where("kind is not null")


def keep_max_zoom(rows: DataFrame) -> DataFrame:
    """One row per vessel: the highest zoom, the first to arrive of equals; ``first_seq`` is the vessel's first."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col("tile_z"), -F.col("seq")))
    return rows.groupBy("ship_id").agg(best.alias("_best"), F.min("seq").alias("first_seq")).select("_best.*", "first_seq")


def last_rows(positions: DataFrame, n: int) -> DataFrame:
    """For each fix, the count and mean speed of the vessel's last n fixes up to it."""
    order = Window.partitionBy("ship_id").orderBy("seq").rowsBetween(-(n - 1), 0)
    return positions.select("ship_id", "seq", F.count("*").over(order).alias("n_rows"), F.avg("speed").over(order).alias("mean_speed"))


def frames(positions: DataFrame, start: int, end: int, step: int, back: int) -> DataFrame:
    """Fixes of sliding frames: at each step t those of [max(t - back, start), t + step).

    Each fix is dealt to its frames by arithmetic, without a range join.
    """
    rows = positions.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    first = F.floor((F.col("timestamp") - start) / step)
    last = F.least(F.floor((F.col("timestamp") - start + back) / step), F.lit((end - start - 1) // step))
    rows = rows.withColumn("frame", F.explode(F.sequence(first, last)))
    return rows.withColumn("frame_ts", (F.lit(start) + F.col("frame") * step).cast("long"))


def interpolate(positions: DataFrame, k: int) -> DataFrame:
    """k steps from each fix to the vessel's next, the fix itself the first of them."""
    order = Window.partitionBy("ship_id").orderBy("timestamp", "seq")
    rows = positions.select("ship_id", "seq", *(F.col(c).cast("double").alias(c) for c in ("timestamp", "lat", "lon")), *(F.lead(number(c)).over(order).alias(f"next_{c}") for c in ("timestamp", "lat", "lon")))
    rows = rows.where("next_lat is not null").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    at = lambda c: (F.col(c) + (F.col(f"next_{c}") - F.col(c)) * F.col("step") / k).alias(c)
    return rows.select("ship_id", "seq", "step", at("timestamp"), at("lat"), at("lon"))


def tumbling_days(rows: DataFrame, day: str, start: str, n: int) -> DataFrame:
    """Rows per range of n days from a day on."""
    part = F.floor(F.datediff(F.col(day), F.lit(start).cast("date")) / n)
    return rows.groupBy(part.alias("part")).agg(F.count("*").alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of values held within limits, in bins of even width; ``peak`` marks the fullest bin."""
    held = F.greatest(F.lit(float(low)), F.least(number(value), F.lit(float(high))))
    cell = F.least(F.floor((held - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col(value).isNotNull()).groupBy(cell.alias("bin")).agg(F.count("*").alias("n_rows"))
    top = counts.agg(F.max_by("bin", F.struct("n_rows", -F.col("bin"))).alias("_peak"))
    return counts.join(F.broadcast(top)).withColumn("peak", F.col("bin") == F.col("_peak")).drop("_peak")


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """Mean and exact percentiles of a column."""
    found = percentile_columns(rows, value, {f"p{round(s * 100)}": s for s in (0.5, 0.9, 0.95, 0.99)})
    return rows.agg(F.count(value).alias("n_rows"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).join(F.broadcast(found))


def describe(rows: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of a column, a row."""
    v, quarters = number(value), ("q25", "q50", "q75")
    found = percentile_columns(rows, value, {q: int(q[1:]) / 100 for q in quarters})
    whole = rows.agg(F.count(value).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return whole.join(F.broadcast(found)).select("count", "mean", "std", "min", *quarters, "max")


def median_steps(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The median difference between neighbouring distinct values of each group."""
    order = Window.partitionBy(by).orderBy(value)
    steps = rows.select(by, value).distinct().withColumn("step", F.col(value) - F.lag(value).over(order))
    found = percentiles(steps, "step", [0.5], [by])
    return found.select(by, F.col("value").alias("median_step"), F.col("n").alias("n_steps"))


def slice_stats(positions: DataFrame, by: str = "ship_id") -> DataFrame:
    """Speeds of a slice and what its last fix says."""
    last = [F.max_by(c, "seq").alias(f"last_{c}") for c in ("speed", "heading", "course", "rot", "destination")]
    return positions.groupBy(by).agg(*last, F.avg("speed").alias("mean_speed"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"))
