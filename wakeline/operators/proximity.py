"""Joins by distance: points with all places within a radius, without comparing all with all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, METRES_PER_DEGREE, finite, flat_distance_m, haversine_m, number

#: A cell with more places than this is cut into four, and those again; cells are cut up to ``DEEPEST`` times.
CROWD, DEEPEST = 64, 6
#: Places in cells, and crowded cells, are broadcast up to this many rows; beyond it they are joined by a shuffle.
BROADCAST_PLACES = 1_000_000


class _Grid:
    """Cells as high as the radius and, at their row's latitude, about as wide."""

    def __init__(self, radius_m: float, round_earth: bool):
        self.round, self.radius = round_earth, radius_m
        self.angle = radius_m / EARTH_RADIUS_M
        # a little more than the radius, so that rounding loses nothing
        self.high = (math.degrees(self.angle) if round_earth else radius_m / METRES_PER_DEGREE) * (1 + 1e-9) + 1e-9

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.high)

    def columns(self, row: Column) -> Column:
        """How many cells go round the earth in a row."""
        edge = F.greatest(F.abs(row * self.high - 90), F.abs((row + 1) * self.high - 90))
        return F.greatest(F.lit(1), F.floor(180 / F.degrees(self._half_width(F.cos(F.radians(F.least(edge, F.lit(90.0))))))))

    def _half_width(self, cosine: Column) -> Column:
        """Half the angle of longitude within which a radius may lie, where the cosines of both latitudes have this mean."""
        return F.asin(F.least(F.lit(1.0), math.sin(min(self.angle, math.pi) / 2) / F.greatest(cosine, F.lit(1e-12))))

    def reach(self, lat: Column, row: Column) -> Column:
        """Degrees of longitude from a place within which points of a row may be near it."""
        if not self.round:
            return self.radius / (METRES_PER_DEGREE * F.greatest(F.abs(F.cos(F.radians(lat))), F.lit(1e-12))) * (1 + 1e-9) + 1e-9
        edge = F.greatest(F.abs(row * self.high - 90), F.abs((row + 1) * self.high - 90))
        mean = F.sqrt(F.greatest(F.cos(F.radians(lat)), F.lit(0.0)) * F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(0.0)))
        return 2 * F.degrees(self._half_width(mean)) * (1 + 1e-9) + 1e-9


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_PLACES else table


def candidates(points: DataFrame, places: DataFrame, radius_m: float, lat: str, lon: str, round_earth: bool = True) -> DataFrame:
    """Points with the places of their cell: all that may be within the radius, and few others. See :func:`near`."""
    grid = _Grid(radius_m, round_earth)
    y, x = number("port_lat"), number("port_lon")
    spread = places.select("port", F.col("lat").alias("port_lat"), F.col("lon").alias("port_lon")).where(finite("port_lat") & finite("port_lon"))
    spread = spread.withColumn("_row", F.explode(F.sequence(grid.row(y - grid.high), grid.row(y + grid.high))))
    spread = spread.withColumns({"_n": grid.columns(F.col("_row")), "_reach": grid.reach(y, F.col("_row"))})
    spread = spread.withColumns({"_x0": (x - F.col("_reach") + 180) * F.col("_n") / 360, "_x1": (x + F.col("_reach") + 180) * F.col("_n") / 360})
    if round_earth:
        # once round at most
        first, last = F.floor("_x0"), F.least(F.floor("_x1"), F.floor("_x0") + F.col("_n") - 1)
        round_ = F.col("_x1") - F.col("_x0") >= F.col("_n") - 1
    else:
        # no point is further round than one and a half turns
        first, last, round_ = F.greatest(F.floor("_x0"), -F.col("_n")), F.least(F.floor("_x1"), 2 * F.col("_n")), F.lit(False)
    spread = spread.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    column = F.pmod("_k", "_n") if round_earth else F.col("_k")
    # which part of the cell the circle's box takes
    part = {"_u0": (y - grid.high + 90) / grid.high - F.col("_row"), "_u1": (y + grid.high + 90) / grid.high - F.col("_row"), "_v0": F.when(round_, 0.0).otherwise(F.col("_x0") - F.col("_k")), "_v1": F.when(round_, 1.0).otherwise(F.col("_x1") - F.col("_k"))}
    spread = spread.withColumns({"_col": column, **part}).select("port", "port_lat", "port_lon", "_row", "_col", *part)
    depth = F.least(F.ceil(F.log2(F.col("_places") / CROWD) / 2), F.lit(DEEPEST)).cast("int")
    crowded = spread.groupBy("_row", "_col").agg(F.count("*").alias("_places")).where(F.col("_places") > CROWD).select("_row", "_col", depth.alias("_depth"))
    crowded = _bounded(crowded)
    cut = lambda rows: rows.join(crowded, ["_row", "_col"], "left").withColumn("_parts", F.expr("shiftleft(1, coalesce(_depth, 0))")).drop("_depth")
    held = lambda v: F.greatest(F.lit(0), F.least(F.floor(v * F.col("_parts")), F.col("_parts") - 1))
    spread = cut(spread).withColumn("_i", F.explode(F.sequence(held(F.col("_u0")), held(F.col("_u1"))))).withColumn("_j", F.explode(F.sequence(held(F.col("_v0")), held(F.col("_v1")))))
    spread = spread.select("port", "port_lat", "port_lon", "_row", "_col", "_i", "_j")
    rows = points.where(finite(lat) & finite(lon)).withColumn("_row", grid.row(number(lat))).withColumn("_n", grid.columns(F.col("_row"))).withColumn("_x", (number(lon) + 180) * F.col("_n") / 360)
    rows = rows.withColumn("_col", F.pmod(F.floor("_x"), "_n") if round_earth else F.floor("_x"))
    rows = cut(rows).withColumns({"_i": held((number(lat) + 90) / grid.high - F.col("_row")), "_j": held(F.col("_x") - F.floor("_x"))})
    return rows.join(_bounded(spread), ["_row", "_col", "_i", "_j"]).select(*points.columns, "port", "port_lat", "port_lon")


def near(points: DataFrame, places: DataFrame, radius_m: float, lat: str = "lat", lon: str = "lon", out: str = "metres", round_earth: bool = True) -> DataFrame:
    """A row for each point and each place (port, lat, lon) within the radius, with the distance in ``out``.

    The earth is cut into rows as high as the radius and cells about as wide at
    their row's latitude. A place is dealt to the cells that its circle may
    touch, over the line at 180 degrees and over poles, and a point meets the
    places of its own cell. Cells with many places are cut in four, and again,
    so that the pairs tried stay near the pairs found, and a crowd of places
    and points is many keys. ``round_earth`` off takes distances on a flat map
    at the place's latitude, without a way round at 180 degrees.

    Points or places without finite coordinates are near nothing; repeated rows
    pair each; a point at exactly the radius is near.
    """
    if radius_m <= 0:
        raise ValueError("a radius above 0 is needed")
    distance = (haversine_m if round_earth else flat_distance_m)(lat, lon, "port_lat", "port_lon")
    return candidates(points, places, radius_m, lat, lon, round_earth).withColumn(out, distance).where(F.col(out) <= radius_m)
