"""Geodesy and grids as column expressions; floats are widened to doubles first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def number(x) -> Column:
    """A name, number or column as a double."""
    return (F.lit(x) if isinstance(x, int | float) else F.col(x) if isinstance(x, str) else x).cast("double")


def haversine_m(lat_a, lon_a, lat_b, lon_b) -> Column:
    """Great-circle distance in metres between points in degrees; null where a coordinate is."""
    a, b, c, d = (number(x) for x in (lat_a, lon_a, lat_b, lon_b))
    half_lat, half_lon = F.radians(c - a) / 2, F.radians(d - b) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(half_lon), 2)
    # least() would take 1 where the root is null
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def metres_per_degree_lon(lat) -> Column:
    return F.lit(METRES_PER_DEGREE) * F.cos(F.radians(number(lat)))


def flat_distance_m(lat, lon, lat0, lon0) -> Column:
    """Equirectangular distance with the scale of the second point."""
    return F.sqrt(F.pow((number(lon) - number(lon0)) * metres_per_degree_lon(lat0), 2) + F.pow((number(lat) - number(lat0)) * METRES_PER_DEGREE, 2))


def radius_box(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float]:
    """Least and greatest longitude, then latitude, of a box that holds the circle on a round earth; all longitudes where it reaches a pole."""
    angle = radius_m / EARTH_RADIUS_M
    # a little more than the circle, so that rounding loses nothing
    high = math.degrees(angle) * (1 + 1e-9) + 1e-9
    wide = 180.0 if abs(lat) + high >= 90 else math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(lat)))) * (1 + 1e-9) + 1e-9
    return lon - wide, lon + wide, lat - high, lat + high


def in_radius_box(lat, lon, lat0: float, lon0: float, radius_m: float) -> Column:
    """Whether a point lies in the box around a circle, also a turn of longitude away."""
    x0, x1, y0, y1 = radius_box(lat0, lon0, radius_m)
    lat, lon = number(lat), number(lon)
    return lat.between(y0, y1) & (lon.between(x0, x1) | lon.between(x0 - 360, x1 - 360) | lon.between(x0 + 360, x1 + 360))


def finite(x) -> Column:
    return ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf"))


def in_box(lat, lon, extent, half_open: bool = False) -> Column:
    """Whether a point lies in (min lon, max lon, min lat, max lat); the far edges belong to it unless half open."""
    lat, lon, (x0, x1, y0, y1) = number(lat), number(lon), extent
    upper = (lon < x1) & (lat < y1) if half_open else (lon <= x1) & (lat <= y1)
    return finite(lat) & finite(lon) & (lon >= x0) & (lat >= y0) & upper


def _held(cell: Column, n: int) -> Column:
    return F.greatest(F.lit(0), F.least(cell.cast("int"), F.lit(n - 1)))


def grid_cell(x, low: float, high: float, n: int) -> Column:
    """floor((x - low) * n / (high - low)), held within 0 and n - 1."""
    return _held(F.floor((number(x) - low) * (n / (high - low))), n)


def edge_cell(x, low: float, high: float, n: int) -> Column:
    """The bin of evenly spaced edges that holds x; values on an edge go right, but those on the last."""
    x, step = number(x), (high - low) / n
    guess = F.floor((x - low) * (n / (high - low)))
    up = F.when(x >= F.lit(low) + (guess + 1) * step, 1).otherwise(0)
    down = F.when(x < F.lit(low) + guess * step, 1).otherwise(0)
    return _held(guess + up - down, n)


def cell_centre(cell, low: float, high: float, n: int) -> Column:
    return F.lit(low) + ((number(cell) + 0.5) / n) * (high - low)


def heading_vector(heading) -> tuple[Column, Column]:
    """East and north parts of a heading in degrees, null unless it is from 0 to below 360 (511: not known)."""
    h = F.when((F.col(heading) >= 0) & (F.col(heading) < 360), number(heading))
    return F.sin(F.radians(h)), F.cos(F.radians(h))


def in_circle_degrees(lat, lon, lat0: float, lon0: float, radius: float) -> Column:
    return F.pow(number(lat) - lat0, 2) + F.pow(number(lon) - lon0, 2) <= radius * radius


def envelope_contains(lat, lon, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Containment in a rectangle without its boundary."""
    return (number(lon) > x0) & (number(lon) < x1) & (number(lat) > y0) & (number(lat) < y1)


def fragment_window(min_lat, max_lat, min_lon, max_lon, grid_size: int, cell_m: float, pad_cells: int = 32) -> dict[str, Column]:
    """A square around a box, at least as large as the grid, with a margin; scaled at the middle latitude."""
    a, b, c, d = (number(x) for x in (min_lat, max_lat, min_lon, max_lon))
    mid_lat, mid_lon = (a + b) * 0.5, (c + d) * 0.5
    per_lon = F.greatest(F.lit(1e-6), metres_per_degree_lon(mid_lat))
    half = F.greatest(F.lit(grid_size * cell_m / 2), F.greatest((b - a) * METRES_PER_DEGREE, (d - c) * per_lon) * 0.5) + pad_cells * cell_m
    return {"win_min_lon": mid_lon - half / per_lon, "win_max_lon": mid_lon + half / per_lon, "win_min_lat": mid_lat - half / METRES_PER_DEGREE, "win_max_lat": mid_lat + half / METRES_PER_DEGREE}


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.exp(-number(x)) + 1.0)
