"""Choosing voyages by place, quality, vessel and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import flat_distance_m, haversine_m, in_box, in_radius_box
from .proximity import near


def _near(end: str, point: tuple[float, float], radius_m: float) -> Column:
    return flat_distance_m(f"{end}_lat", f"{end}_lon", *point) <= radius_m


def from_to(tracks: DataFrame, a: tuple[float, float], b: tuple[float, float] | None, radius_m: float, extent=None, min_points: int = 0) -> DataFrame:
    """Voyages that start near ``a`` and, where given, end near ``b`` (points as latitude, longitude)."""
    rows = tracks.where(F.col("points_count") >= min_points)
    if extent is not None:
        rows = rows.where(in_box("start_lat", "start_lon", extent) & in_box("end_lat", "end_lon", extent))
    rows = rows.where(_near("start", a, radius_m))
    return rows if b is None else rows.where(_near("end", b, radius_m))


def both_ways(tracks: DataFrame, a: tuple[float, float], b: tuple[float, float], radius_m: float) -> DataFrame:
    """Voyages from a to b and back in one pass, a row for each direction that fits, with the first start and last end of all of them."""
    ways = F.array_compact(F.array(F.when(_near("start", a, radius_m) & _near("end", b, radius_m), "AB"), F.when(_near("start", b, radius_m) & _near("end", a, radius_m), "BA")))
    rows = tracks.withColumn("direction", F.explode(ways))
    span = rows.agg(F.min("start_timestamp").alias("min_ts"), F.max("end_timestamp").alias("max_ts"))
    return rows.join(F.broadcast(span))


def within_time(tracks: DataFrame, from_ts: int | None = None, to_ts: int | None = None, max_sec: int | None = None, min_points: int = 0) -> DataFrame:
    """Voyages of enough fixes that begin and end within a time window and last at most so long."""
    rows = tracks.where(F.col("points_count") >= min_points)
    if from_ts is not None:
        rows = rows.where(F.col("start_timestamp") >= from_ts)
    if to_ts is not None:
        rows = rows.where(F.col("end_timestamp") <= to_ts)
    return rows if max_sec is None else rows.where(F.col("end_timestamp") - F.col("start_timestamp") <= max_sec)


def time_range(tracks: DataFrame) -> DataFrame:
    return tracks.agg(F.min("start_timestamp").alias("min_ts"), F.max("end_timestamp").alias("max_ts"))


def to_ports(tracks: DataFrame, ports: DataFrame, radius_m: float) -> DataFrame:
    """Voyages that start within a radius of any row (port, lat, lon) of a table of places, on a flat map."""
    return near(tracks, ports, radius_m, "start_lat", "start_lon", "start_m", round_earth=False)


def within_radius(tracks: DataFrame, start: tuple[float, float], end: tuple[float, float], radius_m: float) -> DataFrame:
    """Voyages whose ends lie within exact circles; boxes come first, so that files are skipped by them."""
    rows = tracks
    for name, point in (("start", start), ("end", end)):
        rows = rows.where(in_radius_box(f"{name}_lat", f"{name}_lon", *point, radius_m))
        rows = rows.withColumn(f"{name}_m", haversine_m(f"{name}_lat", f"{name}_lon", *point)).where(F.col(f"{name}_m") <= radius_m)
    return rows.orderBy(F.desc("points_count"), "start_m", "end_m", "track_id")


def good_tracks(quality: DataFrame, max_sec: int, max_m: float, most: int) -> DataFrame:
    """The voyages of most fixes whose gaps stay within both limits."""
    return quality.where((F.col("max_gap_sec") <= max_sec) & (F.col("max_gap_dist_m") <= max_m)).orderBy(F.desc("points_seen"), "track_id").limit(most)


def of_ship(tracks: DataFrame, ship_id: int) -> DataFrame:
    return tracks.where(F.col("ship_id") == ship_id).orderBy("start_timestamp", "track_id")


def find_ship(ships: DataFrame, by: str, value) -> DataFrame:
    """The first vessel, by id, with a value."""
    return ships.where(F.col(by) == value).orderBy("ship_id").limit(1)


def representative(tracks: DataFrame, first: int, low: int, high: int) -> DataFrame:
    """Of the first voyages, the one of most fixes within limits, or of all voyages the one of most fixes."""
    head = tracks.orderBy("track_ord").limit(first).where(F.col("points_count").between(low, high))
    pick = lambda rows, rank: rows.groupBy().agg(F.max_by("track_id", F.struct("points_count", -F.col("track_ord"))).alias("track_id")).withColumn("_rank", F.lit(rank))
    return pick(head, 0).unionByName(pick(tracks, 1)).where("track_id is not null").orderBy("_rank").limit(1).select("track_id")


def labelled_top(pois: DataFrame, least: int, most: int) -> DataFrame:
    return pois.where(F.col("count_total") >= least).orderBy(F.desc("count_total"), "poi_id").limit(most)


def page(rows: DataFrame, order: list[str], offset: int, count: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(count)


def shuffled_head(rows: DataFrame, key: str, seed: int, count: int) -> DataFrame:
    """A fixed sample of rows: the least by a hash of their key."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(count)


def latest_per(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    place = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most)
