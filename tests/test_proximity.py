"""Joins by distance against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import proximity, selection

R = 6_371_000.0


def far(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def flat(a, b):
    return math.hypot((a[1] - b[1]) * 111_320.0 * math.cos(math.radians(b[0])), (a[0] - b[0]) * 111_320.0)


def drawn(seed, n, kind):
    draw = random.Random(seed)
    spots = {
        "world": lambda: (math.degrees(math.asin(draw.uniform(-1, 1))), draw.uniform(-180, 180)),
        "line": lambda: (draw.uniform(-70, 70), draw.choice((-1, 1)) * draw.uniform(177, 180)),
        "pole": lambda: (draw.choice((-1, 1)) * draw.uniform(84, 90), draw.uniform(-180, 180)),
        "crowd": lambda: (35 + draw.gauss(0, 0.2), 135 + draw.gauss(0, 0.2)),
    }
    return [spots[kind]() for _ in range(n)] + ([(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0)] if kind != "crowd" else [])


def tables(spark, points, places):
    # columns that the join has inside, too
    return spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id int, lat double, lon double").withColumn("port_row", F.lit(1)), spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "port int, lat double, lon double")


@pytest.mark.parametrize(("kind", "radius"), [("world", 900_000), ("world", 7_000_000), ("world", 19_000_000), ("line", 150_000), ("pole", 200_000), ("crowd", 5_000)])
@pytest.mark.parametrize("round_earth", [True, False])
def test_all_pairs_within_the_radius(spark, kind, radius, round_earth, monkeypatch):
    monkeypatch.setattr(proximity, "CROWD", 4)
    points, places = drawn(1, 150, kind), drawn(2, 120, kind)
    measure = far if round_earth else flat
    want = {(i, j) for i, a in enumerate(points) for j, b in enumerate(places) if measure(a, b) <= radius}
    close = {(i, j) for i, a in enumerate(points) for j, b in enumerate(places) if abs(measure(a, b) - radius) < 1e-3}
    found = [(r.id, r.port) for r in proximity.near(*tables(spark, points, places), radius, round_earth=round_earth).collect()]
    assert len(found) == len(set(found)) and set(found) - close == want - close and len(want) > 20


def test_crowds_are_cut_so_that_few_pairs_are_tried(spark, monkeypatch):
    points, places = tables(spark, drawn(3, 400, "crowd"), drawn(4, 3000, "crowd"))
    found = proximity.near(points, places, 20_000, round_earth=True).count()
    tried = proximity.candidates(points, places, 20_000, "lat", "lon").count()
    monkeypatch.setattr(proximity, "CROWD", 10**6)
    assert found <= tried < 1.7 * found and tried < 0.75 * proximity.candidates(points, places, 20_000, "lat", "lon").count()
    # with places too many for a broadcast the result is the same
    monkeypatch.setattr(proximity, "BROADCAST_PLACES", 0)
    assert proximity.near(points, places, 20_000, round_earth=True).count() == found


def test_missing_coordinates_and_empty_tables(spark):
    points, places = tables(spark, [(1.0, 1.0), (None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))], [(1.0, 1.0), (1.0, None), (1.0, 1.0)])
    assert sorted((r.id, r.port, r.metres) for r in proximity.near(points, places, 10).collect()) == [(0, 0, 0.0), (0, 2, 0.0)]
    assert proximity.near(points.where("false"), places, 10).count() == 0 == proximity.near(points, places.where("false"), 10).count()
    with pytest.raises(ValueError):
        proximity.near(points, places, 0)


@pytest.mark.parametrize(("centre", "radius"), [((33.5, 128.5), 200_000), ((70.0, 179.5), 300_000), ((-88.0, -170.0), 400_000), ((0.0, 0.0), 12_000_000)])
def test_circles_are_whole_up_to_their_edge(spark, centre, radius):
    """Points on a circle's rim, a little inside and outside of it: a box around it that is too small cuts its edges."""
    a, (lat0, lon0), rows = radius / R, map(math.radians, centre), []
    for k in range(720):
        turn = math.radians(k / 2)
        for share in (0.9985, 0.99999, 1.00001):
            d = a * share
            lat = math.asin(math.sin(lat0) * math.cos(d) + math.cos(lat0) * math.sin(d) * math.cos(turn))
            lon = lon0 + math.atan2(math.sin(turn) * math.sin(d) * math.cos(lat0), math.cos(d) - math.sin(lat0) * math.sin(lat))
            rows.append((len(rows), math.degrees(lat), (math.degrees(lon) + 180) % 360 - 180))
    want = {k for k, *at in rows if far(centre, at) <= radius}
    table = spark.createDataFrame(rows, "track_id long, start_lat double, start_lon double").withColumns({"end_lat": F.lit(centre[0]), "end_lon": F.lit(centre[1]), "points_count": F.lit(1)})
    assert {r.track_id for r in selection.within_radius(table, centre, centre, radius).collect()} == want and len(want) == 1440
