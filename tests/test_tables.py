import json

import pytest
from pyspark.sql import functions as F

from wakeline import config, schema
from wakeline.functions import dates
from wakeline.operators import activity, events, gaps, layout, metrics, ports, rasters, relational, selection
from wakeline.sources import archive, artifacts, dataset


def test_activity_edges(spark):
    rows = [(s, v) for s, n, moving, top in ((1, 50, 5, 20), (2, 49, 5, 20), (3, 50, 4, 20), (4, 50, 5, 19), (5, 50, 50, 900)) for v in [top] * 1 + [10] * (moving - 1) + [0] * (n - moving)]
    table = spark.createDataFrame(rows, "ship_id long, speed int")
    kept = activity.active_ships(table)
    assert {r.ship_id: r.max_speed for r in kept.collect()} == {1: 20, 5: 800}
    assert activity.keep_ships(table, kept, 2).count() == 100 and activity.keep_ships(table, kept).count() == 100


def test_ingest(spark, tmp_path):
    day = tmp_path / "2025" / "03" / "05"
    day.mkdir(parents=True)
    base = {"LAT": "35.5", "LON": 139.1, "SPEED": 12.9, "LENGTH": "12.5", "FLAG": None, "TIMESTAMP": 1741132800}
    (day / "05.03.2025_10_00.json").write_text(json.dumps({"b": base | {"SHIPNAME": "BEE"}, "a": base | {"TIMESTAMP": None}}))
    (day / "05.03.2025_11_00.json").write_text(json.dumps({"a": base | {"TIMESTAMP": 1741136400.7, "DESTINATION": "é" * 40}, "c": base}))
    (day / "09.03.2025_11_00.json").write_text("{}")
    (day / "other.json").write_text("{}")
    found = archive.ingest(spark, str(tmp_path), "01.03.2025", "08.03.2025")
    ships = {r.mt_id: r for r in found["ships"].collect()}
    assert {k: v.ship_id for k, v in ships.items()} == {"b": 1, "a": 2, "c": 3} and ships["b"].length == -1 and ships["b"].flag == "null" and ships["a"].name == "null"
    fixes = sorted((r.file_id, r.ord_in_file, r.ship_id, r.timestamp, r.speed) for r in found["positions"].collect())
    assert fixes == [(0, 0, 1, 1741132800, 12), (1, 0, 2, 1741136400, 12), (1, 1, 3, 1741132800, 12)]
    assert found["meta"].first()[0] == 1 and [r.positions_count for r in found["files"].orderBy("file_id").collect()] == [1, 2]
    assert found["positions"].where("ship_id = 2").first().destination == "é" * 32


def test_dataset_round_trip(spark, tmp_path):
    path, out = str(tmp_path / "a"), str(tmp_path / "b")
    dataset.create(spark, path, author="me")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        dataset.create(spark, path)
    rows = spark.range(200).select(
        (F.col("id") % 2 + 1).alias("ship_id"), (F.col("id") * 600 + 86_400).cast("int").alias("timestamp"), F.lit(30.0).cast("float").alias("lat"), F.lit(130.0).cast("float").alias("lon"), F.when(F.col("id") % 2 == 0, 50).otherwise(0).alias("speed"),
        *(F.lit(0).alias(c) for c in ("course", "heading", "rot", "elapsed")), F.lit("X").alias("destination"), F.lit(1).alias("tile_z"), F.lit(0).alias("file_id"), F.lit(-1).cast("long").alias("track_id"), F.lit(None).cast("date").alias("dt"), F.col("id").cast("int").alias("ord_in_file"),
    )
    dataset.write(rows.withColumn("dt", F.to_date(F.timestamp_seconds("timestamp"))), path, "positions")
    dataset.filtered_copy(spark, path, out)
    kept = dataset.read(spark, out, "positions")
    assert kept.select("ship_id").distinct().collect()[0][0] == 1 and "filter_rules" in dataset.read_meta(spark, out)
    assert "PartitionFilters: [isnotnull(dt" in dataset.positions_between(kept, 90_000, 95_000)._jdf.queryExecution().toString()
    dataset.tracked_copy(spark, out, str(tmp_path / "c"), config.Breaks())
    assert dataset.read(spark, str(tmp_path / "c"), "tracks").count() >= 1 and len(dataset.fingerprint(spark, path)) == 64
    assert {r.table: r.rows for r in dataset.info(spark, out).collect()}["positions"] == 100
    assert dataset.folder_stats(spark, path).first().files > 0 and dataset.structure(spark, path).count() == sum(len(t) for t in dataset.TABLES.values())


def test_zones(spark, tmp_path):
    (tmp_path / "z.json").write_text(json.dumps([{"zone": "Bay 1", "lon": 1.0, "lat": 2.0, "zoom": 8}, {"zone": "Bad", "lon": 1.0, "lat": 334.0, "zoom": 8}, {"zone": "World", "lon": 0, "lat": 0, "zoom": 1}]))
    zones = dataset.import_zones(spark, str(tmp_path / "z.json"), str(tmp_path / "d"))
    assert [r.zone_id for r in zones.orderBy("zone_id").collect()] == [0, 1, 2] and dataset.clean_zones(zones).count() == 1
    box = dataset.zone_rectangles(zones.where("zone_id = 0"), {8: 3.2}).first()
    assert (box.min_lon, box.max_lat) == (pytest.approx(-0.6), pytest.approx(3.0))


def test_tiles_keep_the_highest_zoom(spark):
    body = json.dumps({"data": {"rows": [{"SHIP_ID": "s", "ELAPSED": "5"}]}})
    rows = [(f"/z:{z}/X:1/Y:1/get_data_json_4", body, t) for z, t in ((3, 100), (9, 200), (9, 300))]
    found = archive.tile_rows(spark.createDataFrame(rows, "path string, body string, response_ts long")).collect()
    assert [(r.tile_z, r.timestamp, r.first_seen[0]) for r in found] == [(9, 195, 100)]


def test_components_both_ways(spark):
    cells = [(0, 0), (1, 1), (0, 5), (0, 6), (5, 5), (5, 6), (6, 5), (9, 0)]
    table = spark.createDataFrame(cells, "iy int, ix int")
    want = {(0, 0): 0, (1, 1): 0, (0, 5): 1, (0, 6): 1, (5, 5): 2, (5, 6): 2, (6, 5): 2}
    for tile in (1, 2, 5, 512):
        assert {(r.iy, r.ix): r.poi_id for r in rasters.components(table, 2, tile).collect()} == want
    assert rasters.components(table.where("false"), 2).count() == 0


def test_components_cross_many_tiles(spark):
    """A spiral that passes nearly all tiles, and specks, against a flood fill."""
    import random

    draw, cells = random.Random(6), set()
    for ring in range(0, 20, 2):
        for k in range(ring, 40 - ring):
            cells |= {(ring, k), (39 - ring, k), (k, 39 - ring)} | ({(k, ring)} if k > ring + 1 else set())
        cells.add((ring + 2, ring + 1))
    cells |= {(draw.randrange(45, 90), draw.randrange(0, 90)) for _ in range(900)}
    left, sizes = set(cells), {}
    for first in sorted(cells):
        if first in left:
            todo, mine = [first], []
            left.discard(first)
            while todo:
                y, x = todo.pop()
                mine.append((y, x))
                near = [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (y + a, x + b) in left]
                left.difference_update(near)
                todo += near
            if len(mine) >= 3:
                sizes[first] = mine
    want = {(*c, k, len(mine)) for k, mine in enumerate(sizes.values()) for c in mine}
    # cells that come twice are one
    table = spark.createDataFrame(sorted(cells) + sorted(cells)[:50], "iy int, ix int")
    for tile in (3, 7, 64):
        assert {tuple(r) for r in rasters.components(table, 3, tile).collect()} == want


def test_dense_cells(spark):
    cells = spark.createDataFrame([(0, k, c) for k, c in enumerate((1, 2, 3, 10))], "iy int, ix int, cnt long")
    found = rasters.dense_cells(cells, "percentile", 96).collect()
    assert [r.cnt for r in found] == [10] and found[0].threshold == pytest.approx(9.16)
    with pytest.raises(ValueError, match="empty"):
        rasters.dense_cells(cells, "absolute", 0)


def test_ports_end_to_end(spark, tmp_path):
    tracks = [(k, 1, 0, 100 + k, 0.5, 0.5, 5.5, 5.5, 3, k) for k in range(4)] + [(9, 1, 0, 50, 5.5, 5.5, 0.5, 0.5, 3, 9)]
    table = spark.createDataFrame([(*t[:4], *map(float, t[4:8]), *t[8:]) for t in tracks], "track_id long, ship_id long, start_timestamp int, end_timestamp int, start_lat double, start_lon double, end_lat double, end_lon double, points_count int, track_ord long")
    fixes = spark.createDataFrame([(k, t[0], 10 * n, 0.5 + n, 0.5 + n, d) for k, (t, n, d) in enumerate((t, n, d) for t in tracks for n, d in enumerate(("none", "osaka_bay")))], "seq long, track_id long, timestamp long, lat double, lon double, destination string")
    setup = {"grid": config.Grid((0.0, 10.0, 0.0, 10.0), (10, 10)), "dense": ("absolute", 1.0), "cells": 1}
    found = ports.extract(table, fixes, **setup)
    assert {r.pair: r.track_ids for r in found["poi_pairs"].collect()} == {"0->1": [0, 1, 2, 3], "1->0": [9]}
    where = ports.write_document(found, str(tmp_path / "set.h5"), **setup)
    assert where.endswith("set_poi.json") and {r.track_id for r in ports.document_track_ids(spark, where).collect()} == {0, 1, 2, 3, 9}
    assert ports.read_quality(spark, where).count() == found["track_quality"].count() == 5
    body = json.loads(ports.document(found, "x", **setup))
    assert body["stats"] == {"pois_count": 2, "pairs_count": 2, "tracks_count": 5} and body["pois"][1]["top_destinations"] == [{"name": "OSAKA BAY", "count": 4}]


def test_destination_ties(spark):
    counts = spark.createDataFrame([(1, "UNKNOWN", 9, 0), (1, "B", 2, 5), (1, "A", 2, 7), (1, "C", 1, 1)], "end_poi int, name string, count long, first_ord long")
    assert [r.name for r in ports.top_destinations(counts, 4).orderBy("place").collect()] == ["B", "A", "C", "UNKNOWN"]


def test_gap_limits(spark):
    rows = spark.createDataFrame([(k, 1, t, 30.0, 130.0) for k, t in enumerate((0, 100, 201))], "seq long, track_id long, timestamp long, lat double, lon double")
    assert gaps.gap_list(rows, 100, 1e9).count() == 2
    assert [r.segment for r in gaps.segments(rows, 100, 1e9).orderBy("seq").collect()] == [0, 0, 1]
    assert gaps.gap_metrics(rows).first()[1:] == (3, 101, 0.0) and gaps.gap_quality(rows, 100, 1e9).first().gaps == 1


def test_fragment_limits(spark):
    def count(points, metres):
        rows = [(k, 1, 60 * k, 30.0 + metres * k / (points - 1) / 111_194.93, 130.0) for k in range(points)]
        return gaps.fragments(spark.createDataFrame(rows, "seq long, track_id long, timestamp long, lat double, lon double")).count()

    assert (count(32, 10_050), count(31, 10_050), count(32, 9_950)) == (1, 0, 0)


def test_buckets(spark):
    rows = spark.createDataFrame([(t,) for t in (-1, 0, 999, 1000, 99_999, 100_000)], "track_id long")
    found = rows.select(*(c.alias(n) for n, c in layout.buckets().items())).collect()
    assert [(r.track_group, r.subrange) for r in found] == [(-100_000, -1000), (0, 0), (0, 0), (0, 1000), (0, 99_000), (100_000, 100_000)]


def test_layout_files(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 7, 100 - k) for k in range(70)], "seq long, track_id long, timestamp long")
    layout.write_track_sorted(rows, str(tmp_path / "t"), rows.where("track_id < 5").select("track_id").distinct())
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 50 and [r.timestamp for r in layout.track_points(table, 3, 2, 5).collect()] == [48, 55, 62]


def test_both_directions_of_one_voyage(spark):
    row = spark.createDataFrame([(1, 30.0, 130.0, 30.0, 130.0, 5, 9), (2, 30.0, 130.0, 30.0, 130.0, 3, 4), (3, 0.0, 0.0, 0.0, 0.0, 1, 99)], "track_id long, start_lat double, start_lon double, end_lat double, end_lon double, start_timestamp long, end_timestamp long")
    found = selection.both_ways(row, (30.0, 130.0), (30.01, 130.0), 5000).collect()
    assert sorted((r.track_id, r.direction) for r in found) == [(1, "AB"), (1, "BA"), (2, "AB"), (2, "BA")] and {(r.min_ts, r.max_ts) for r in found} == {(3, 9)}


def test_things_that_queries_do_not_reach(spark):
    """Seeded samples, scraped strings, times of a fixed offset, means over samples."""
    rows = spark.range(100).withColumnRenamed("id", "track_id")
    one, other = ([r.track_id for r in selection.shuffled_head(rows.repartition(n), "track_id", 7, 10).collect()] for n in (1, 5))
    assert one == other != sorted(one) and len(set(one)) == 10 and one != [r.track_id for r in selection.shuffled_head(rows, "track_id", 8, 10).collect()]
    raw = spark.createDataFrame([("12", "1.5", "--", "86400", "x")], "SHIP_ID string, LAT string, FLAG string, TIMESTAMP string, SPEED string")
    clean = relational.clean_legacy(raw).first()
    assert (clean.SHIP_ID, clean.LAT, clean.FLAG, clean.SPEED) == (12, 1.5, None, None) and str(clean.TIMESTAMP) == "1970-01-02 00:00:00"
    assert str(spark.createDataFrame([(0,)], "at long").select(dates.local_time("at").alias("t")).first().t) == "1970-01-01 10:00:00"
    cells = spark.createDataFrame([(1, 0.9, 1.0), (1, 0.2, 0.0), (2, 0.9, 0.0), (2, 0.9, 1.0)], "sample int, logit double, target double").withColumn("logit", F.col("logit") - 0.5)
    one, two = (r.iou for r in metrics.sample_metrics(cells).orderBy("sample").collect())
    assert metrics.mean_metrics(cells).first().iou == pytest.approx((one + two) / 2) and (round(one, 6), round(two, 6)) == (1.0, 0.5)


def test_missing_rows_go_to_a_relational_mirror_with_ids(spark):
    at = {"url": "jdbc:derby:memory:mirror;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    artifacts.write_jdbc(spark.createDataFrame([(3, "a"), (7, "b")], "id long, mt_id string"), table="ships", **at)
    found = spark.createDataFrame([("b",), ("d",), ("c",), ("d",), (None,)], "mt_id string")
    given = {r.mt_id: r.id for r in artifacts.insert_jdbc(found, table="ships", key="mt_id", id_name="id", **at).collect()}
    assert given == {"a": 3, "b": 7, "c": 8, "d": 9} == {r.mt_id: r.id for r in artifacts.read_jdbc(spark, table="ships", **at).collect()}
    artifacts.insert_jdbc(found, table="ships", key="mt_id", id_name="id", **at)
    assert artifacts.read_jdbc(spark, table="ships", **at).count() == 4


def test_ports_documents_lie_beside_their_dataset():
    assert [ports.default_path(p) for p in ("/a/b/data.h5", "/a/b/data/", "data")] == ["/a/b/data_poi.json", "/a/b/data_poi.json", "data_poi.json"]


def test_frames(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 5, 10, 25)], "ship_id long, timestamp long")
    found = {}
    for r in events.frames(rows, 0, 30, 10, 10).collect():
        found.setdefault(r.frame, []).append(r.timestamp)
    assert {k: sorted(v) for k, v in found.items()} == {0: [0, 5], 1: [0, 5, 10], 2: [10, 25]}


def test_constraints(spark):
    ships = spark.createDataFrame([(1, "a", 1, 1, 5, 1, 1), (2, "a", None, 1, -5, 1, 1)], "ship_id long, mt_id string, ship_type int, gt_ship_type int, length int, width int, dwt int")
    fixes = spark.createDataFrame([(1, 7, 5, 0, 0, 0, 1.0, 1.0), (3, -1, -1, 0, 0, 0, None, 1.0)], "ship_id long, track_id long, speed int, course int, heading int, elapsed int, lat double, lon double")
    tracks = spark.createDataFrame([(7, 2)], "track_id long, ship_id long")
    found = {r.rule: r.bad_rows for r in relational.violations(ships, fixes, tracks).collect()}
    assert found == {"ships_mt_id_unique": 1, "ships_type_required": 1, "ships_sizes_positive": 1, "positions_ship_known": 1, "positions_values_positive": 1, "positions_place_required": 1, "tracks_ship_known": 0, "positions_track_same_ship": 1}


def test_history(spark):
    rows = spark.createDataFrame([("2", "0.5"), ("1", "0.5"), (None, "0.9"), ("x", "1")], "epoch string, val_iou string")
    clean = metrics.clean_history(rows)
    assert [r.epoch for r in clean.collect()] == [1, 2] and metrics.best_epoch(clean).first().best_epoch == 1


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(k, k // 50, 60 * k, 30.0 + 0.01 * k, 130.0) for k in range(200)], "seq long, track_id long, timestamp long, lat double, lon double")
    artifacts.build(rows, gaps.gap_metrics(rows), (129.0, 131.0, 29.0, 33.0), str(tmp_path / "art"))
    art = str(tmp_path / "art")
    assert artifacts.load_frags(spark, art).count() == 4 and artifacts.load(spark, art, "meta").first().fragments == 4
    held_out = {r.track_id for r in artifacts.load(spark, art, "split").collect()}
    assert {r.track_id for r in artifacts.load_frags(spark, art, "val").collect()} == held_out and artifacts.load_config(spark, art) == config.Pieces()
    cells, corner, shape_ = artifacts.load_density(spark, art)
    assert corner[:2] == (129.0, 29.0) and cells.agg(F.max("iy")).first()[0] < shape_[0] and cells.agg(F.max("ix")).first()[0] < shape_[1]
    spark.range(1).write.mode("overwrite").parquet(f"{art}-odd/frags")
    with pytest.raises(ValueError, match="fragments without track_id"):
        artifacts.load_frags(spark, f"{art}-odd")
    artifacts.save_csv(artifacts.load(spark, str(tmp_path / "art"), "frags").drop("split"), str(tmp_path / "csv"))
    kind = "track_id long, s int, e int, points int, t0 long, t1 long, min_lat double, min_lon double, max_lat double, max_lon double"
    assert artifacts.load_csv(spark, str(tmp_path / "csv"), kind).count() == 4 and len(schema.FRAGMENTS) == 10


def test_config_round_trip():
    one = config.Grid(bins=(5, 6))
    assert config.from_json(config.Grid, config.to_json(one)) == one
    with pytest.raises(ValueError, match="nope"):
        config.from_json(config.Grid, '{"nope": 1}')


def test_a_step_leaves_its_own_table_alone(spark):
    from pathlib import Path

    from wakeline.plans import materialize, materialize_alone, scratch_root

    there = lambda: {p.name.rpartition("-")[0] for p in Path(scratch_root(spark).removeprefix("file:")).iterdir()}
    kept = materialize(spark.range(3), "kept")
    out = materialize_alone(spark, lambda: materialize(materialize(spark.range(5), "inner_one").where("id > 1"), "inner_two"), "outer")
    assert out.count() == 3 == kept.count() and {"kept", "outer"} <= there() and not there() & {"inner_one", "inner_two"}
