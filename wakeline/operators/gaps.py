"""Gaps along voyages, their segments and fragments, as windows by voyage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Pieces
from ..functions.geo import haversine_m
from ..plans import percentiles



def _by_voyage():
    return Window.partitionBy("track_id").orderBy("timestamp", "seq")


def steps(positions: DataFrame) -> DataFrame:
    """Add seconds and metres since the fix before on the same voyage (null on its first)."""
    before = {n: F.lag(n).over(_by_voyage()) for n in ("timestamp", "lat", "lon")}
    return positions.withColumns({"dt": F.col("timestamp") - before["timestamp"], "dist": haversine_m(before["lat"], before["lon"], "lat", "lon")})


def gap_metrics(positions: DataFrame) -> DataFrame:
    """Fixes, longest time and longest distance between fixes of each voyage; a distance is kept as a float."""
    held = F.when(F.col("dt").isNotNull(), F.greatest(F.lit(0), F.least(F.col("dt"), F.lit(2**31 - 1))))
    return steps(positions).groupBy("track_id").agg(
        F.count("*").alias("points_seen"), F.coalesce(F.max(held), F.lit(0)).cast("long").alias("max_gap_sec"), F.coalesce(F.max("dist"), F.lit(0.0)).cast("float").cast("double").alias("max_gap_dist_m")
    )


def gap_list(positions: DataFrame, min_sec: int, min_m: float) -> DataFrame:
    """Gaps of at least so many seconds or metres, with both ends."""
    after = {f"next_{n}": F.lead(n).over(_by_voyage()) for n in ("timestamp", "lat", "lon")}
    rows = positions.select("track_id", "seq", "timestamp", "lat", "lon").withColumns(after)
    rows = rows.withColumns({"gap_sec": F.col("next_timestamp") - F.col("timestamp"), "gap_m": haversine_m("lat", "lon", "next_lat", "next_lon")})
    return rows.where((F.col("gap_sec") >= min_sec) | (F.col("gap_m") >= min_m))


def gap_quality(positions: DataFrame, min_sec: int, min_m: float) -> DataFrame:
    """Per voyage: how many gaps, the longest of each kind, and whether there is none."""
    far = (F.col("dt") > min_sec) | (F.col("dist") > min_m)
    out = steps(positions).groupBy("track_id").agg(F.count_if(far).alias("gaps"), F.max("dt").alias("longest_sec"), F.max("dist").alias("longest_m"))
    return out.withColumn("good", F.col("gaps") == 0)


def segments(positions: DataFrame, max_sec: int, max_m: float) -> DataFrame:
    """Number the parts of each voyage between gaps above either limit; add the place in the voyage."""
    cut = F.when((F.col("dt") > max_sec) | (F.col("dist") > max_m), 1).otherwise(0)
    return steps(positions).withColumns({"segment": F.sum(cut).over(_by_voyage().rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(_by_voyage()) - 1})


def fragments(positions: DataFrame, rules: Pieces = Pieces()) -> DataFrame:
    """Segments of enough fixes that go far enough from where they start, as slices [s, e) with their box."""
    parts = segments(positions, *rules.cut)
    whole = Window.partitionBy("track_id", "segment").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, 0)
    away = haversine_m(F.first("lat").over(whole), F.first("lon").over(whole), "lat", "lon")
    out = parts.withColumn("away", away).groupBy("track_id", "segment").agg(
        F.min("place").cast("int").alias("s"), (F.max("place") + 1).cast("int").alias("e"), F.count("*").cast("int").alias("points"), F.min("timestamp").cast("long").alias("t0"), F.max("timestamp").cast("long").alias("t1"),
        *(f(F.col(c).cast("double")).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")), F.max("away").alias("away"),
    )
    return out.where((F.col("points") >= rules.fixes) & (F.col("away") >= rules.away)).select("track_id", "s", "e", "points", "t0", "t1", "min_lat", "min_lon", "max_lat", "max_lon")


def fragment_stats(frags: DataFrame, shares=(0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles of fragments' fixes and seconds, one row per share."""
    rows = frags.select("points", (F.col("t1") - F.col("t0")).alias("seconds"))
    points, seconds = (percentiles(rows, c, shares).select("share", F.col("value").alias(c)) for c in ("points", "seconds"))
    return points.join(seconds, "share")


def split_fragments(frags: DataFrame, fraction: float = 0.02, seed: int = 42) -> DataFrame:
    """Train or validation by a hash of the voyage, so that all its fragments stay together at any size."""
    key = F.concat_ws(":", F.lit(seed), "track_id").cast("binary")
    chance = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / (1 << 32)
    return frags.withColumn("split", F.when(chance < fraction, "val").otherwise("train"))


def slice_of(positions: DataFrame, frags: DataFrame) -> DataFrame:
    """The fixes of each fragment: voyages joined, then places between s and e."""
    placed = positions.withColumn("place", F.row_number().over(_by_voyage()) - 1)
    return placed.join(frags.select("track_id", "s", "e"), "track_id").where((F.col("place") >= F.col("s")) & (F.col("place") < F.col("e")))


def merged_intervals(intervals: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Intervals that touch or overlap, joined into one."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(F.col(start) > reach, 1).otherwise(0)
    parts = intervals.withColumn("_part", cut)
    parts = parts.withColumn("_part", F.sum("_part").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*by, "_part").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_part")
