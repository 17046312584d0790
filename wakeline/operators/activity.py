"""Vessel activity: counts per vessel and the vessels and fixes that stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vessel ids (8 bytes each) up to this many are broadcast to the fixes; above it the semi-join shuffles.
BROADCAST_IDS = 4_000_000


#: Tenths of a knot, fixed values: speeds are held to the first before they count, and from the second on a vessel moves.
CLIP, MOVING = 800, 10


def clipped_speed() -> Column:
    """Speeds held within 0 and a limit; excess is clipped, not dropped."""
    return F.greatest(F.lit(0), F.least(F.col("speed"), F.lit(CLIP)))


def ship_stats(positions: DataFrame) -> DataFrame:
    """Fixes, moving fixes and top speed of each vessel: one partial and one final aggregate."""
    speed = clipped_speed()
    return positions.groupBy("ship_id").agg(F.count("*").alias("total_points"), F.count_if(speed >= MOVING).alias("moving_points"), F.max(speed).cast("long").alias("max_speed"))


def active_ships(positions: DataFrame, fixes: int = 50, moving: int = 5, top: int = 20) -> DataFrame:
    """Vessels with so many fixes, so many of them moving, and such a top speed at least."""
    return ship_stats(positions).where((F.col("total_points") >= fixes) & (F.col("moving_points") >= moving) & (F.col("max_speed") >= top))


def keep_ships(rows: DataFrame, ships: DataFrame, known_count: int | None = None) -> DataFrame:
    """Rows of the given vessels, unchanged. With a known, small count the ids are broadcast."""
    ids = ships.select("ship_id")
    return rows.join(F.broadcast(ids) if known_count is not None and known_count <= BROADCAST_IDS else ids, "ship_id", "left_semi")
