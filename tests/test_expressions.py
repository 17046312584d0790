import math

import pytest
from pyspark.sql import functions as F

from wakeline.functions import dates, geo, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_haversine_and_nulls(spark):
    degree = math.pi * geo.EARTH_RADIUS_M / 180
    a, b, c = one(spark, geo.haversine_m(0, 0, 0, 1), geo.haversine_m(0, 0, F.lit(None), 1), geo.haversine_m(0, 0, 0, 180))
    assert a == pytest.approx(degree) and b is None and c == pytest.approx(180 * degree)


def test_boxes_keep_their_edges_apart(spark):
    extent = (0.0, 10.0, 0.0, 5.0)
    assert tuple(one(spark, geo.in_box(5.0, 10.0, extent), geo.in_box(5.0, 10.0, extent, half_open=True), geo.in_box(float("nan"), 1.0, extent))) == (True, False, False)
    assert tuple(one(spark, geo.envelope_contains(50, 50, 49.9, 49.9, 50.1, 50.1), geo.envelope_contains(49.9, 50, 49.9, 49.9, 50.1, 50.1))) == (True, False)


def test_cells(spark):
    assert tuple(one(spark, geo.grid_cell(-1, 0, 10, 5), geo.grid_cell(10, 0, 10, 5), geo.edge_cell(10, 0, 10, 5), geo.edge_cell(4, 0, 10, 5), geo.edge_cell(3.999, 0, 10, 5))) == (0, 4, 4, 2, 1)


def test_edge_cells_follow_the_edges(spark):
    import numpy as np

    low, high, n = 17.0, 60.0, 900
    edges = np.linspace(low, high, n + 1).astype(np.float32).astype(float)
    rows = spark.createDataFrame([(float(x),) for x in edges if low <= x <= high], "x double")
    step = (high - low) / n
    for x, cell in rows.select("x", geo.edge_cell("x", low, high, n)).collect():
        assert cell == n - 1 or low + cell * step <= x < low + (cell + 1) * step


def test_integers_from_json(spark):
    rows = spark.createDataFrame([("12",), ('"12"',), ('"12.5"',), ("12.9",), ("-3.9",), ("null",), (None,), ("x",)], "v string")
    assert [r[0] for r in rows.select(text.json_int("v")).collect()] == [12, 12, -1, 12, -3, -1, -1, -1]
    assert [r[0] for r in rows.select(text.safe_int("v", 0)).collect()] == [12, 0, 0, 0, 0, 0, 0, 0]


def test_bytes_are_cut_at_characters(spark):
    cut, none = one(spark, text.byte_text(F.lit("é" * 40), 63), text.byte_text(F.lit(None), 64))
    assert cut == "é" * 31 and none == "null"


def test_destinations(spark):
    rows = spark.createDataFrame([(" new_york-city ",), ("\x00",), (None,), ("class b",), ("unknown",), ("A  B",)], "d string")
    found = rows.select(text.normal_destination("d").alias("n")).withColumn("bad", text.bad_destination("n")).collect()
    assert [tuple(r) for r in found] == [("NEW YORK CITY", False), ("", True), ("", True), ("CLASS B", True), ("UNKNOWN", True), ("A B", False)]


def test_labels(spark):
    assert tuple(one(spark, text.range_label(F.lit(0), F.lit(99999)), text.pair_key(F.lit(1), F.lit(2)), text.group_name(F.lit("Sea 12")), text.short_label(F.lit("abcdef"), 4), text.human_bytes(F.lit(2048)))) == ("00000000-00099999", "1->2", "Sea", "abc…", "2.00 KB")


def test_days(spark):
    day, name, bad = one(spark, dates.utc_day(F.lit(86_399)).cast("string"), dates.file_day(F.lit("05.03.2025_10_00.json")).cast("string"), dates.file_day(F.lit("notes.json")))
    assert (day, name, bad) == ("1970-01-01", "2025-03-05", None)
    assert spark.range(1).select(dates.days_between("30.01.2025", "02.02.2025")).count() == 4


def test_tiles_and_headings(spark):
    rows = spark.createDataFrame([("https://x/z:7/X:12/Y:34/get",)], "p string")
    assert tuple(rows.select(*(c.alias(n) for n, c in text.tile_of("p").items())).first()) == (7, 12, 34)
    east, north = geo.heading_vector("h")
    found = spark.createDataFrame([(90,), (511,)], "h int").select(east.alias("e"), north.alias("n")).collect()
    assert found[0].e == pytest.approx(1) and found[1].e is None
