"""What look-ups and joins read, by the scans' own counts of files and partitions."""

import pytest
from pyspark.sql import functions as F

from wakeline import schema
from wakeline.config import LayoutConfig
from wakeline.operators import layout
from wakeline.sources import dataset


def scans(table, path):
    """Files and partitions that each scan below a path read, after the plan ran."""
    table = table.select("*")
    table.collect()
    found, todo = [], [table._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "FileSourceScanExec" and f"{path}/" in node.relation().location().rootPaths().mkString("/", ",", "/"):
            metrics = node.metrics()
            found.append({k: metrics.apply(k).value() for k in ("numFiles", "numPartitions") if metrics.contains(k)})
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Forty days of fixes of 60 voyages, each within two days."""
    path = str(tmp_path_factory.mktemp("pruning"))
    rows = spark.range(2400).select((F.col("id") % 60).alias("track_id"), (F.col("id") % 60 * 57_600 + F.floor(F.col("id") / 60) * 2000).cast("int").alias("timestamp"), F.col("id").cast("int").alias("ord_in_file"))
    rows = rows.withColumns({"ship_id": F.col("track_id") % 7, "dt": F.to_date(F.timestamp_seconds("timestamp"))})
    full = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit("0")).cast(f.dataType).alias(f.name) for f in schema.POSITIONS))
    dataset.write(full, path, "positions")
    return path


def test_days_of_wanted_voyages_alone_are_read(spark, stored):
    table = dataset.read(spark, stored, "positions")
    wanted = table.groupBy("track_id").agg(F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp")).where("track_id in (3, 4)")
    wanted = spark.createDataFrame(wanted.collect(), "track_id long, start_timestamp int, end_timestamp int")
    found = dataset.positions_of(table, wanted)
    days = {r.dt for r in table.where("track_id in (3, 4)").select("dt").distinct().collect()}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, table.where("track_id in (3, 4)").collect())) and found.count() == 80
    [read] = [s for s in scans(found, stored) if "numPartitions" in s]
    assert read["numPartitions"] == len(days) < 5 < table.select("dt").distinct().count()
    assert dataset.positions_of(table, wanted.where("false")).count() == 0


def test_a_range_of_days_reads_its_folders(spark, stored):
    [read] = scans(dataset.positions_between(dataset.read(spark, stored, "positions"), 86_400 * 5 + 10, 86_400 * 7 + 10), stored)
    assert read["numPartitions"] == 3


@pytest.fixture(scope="module")
def laid(spark, stored, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "t")
    rows = dataset.read(spark, stored, "positions").withColumn("seq", F.col("ord_in_file"))
    layout.write_track_sorted(rows, path, config=LayoutConfig(group=20, parts=5))
    layout.index_layout(spark, path)
    return path


def test_rows_of_a_voyage_lie_in_order_in_one_file(spark, laid):
    table = spark.read.parquet(laid).select("track_id", "timestamp", F.col("_metadata.row_index").alias("row"), F.col("_metadata.file_path").alias("f"))
    by = {}
    for r in sorted(table.collect(), key=lambda r: (r.f, r.row)):
        by.setdefault(r.track_id, []).append((r.f, r.row, r.timestamp))
    index = {r.track_id: r for r in layout.offsets(spark, laid).collect()}
    assert len(by) == len(index) == 60
    for track, rows in by.items():
        assert len({f for f, _, _ in rows}) == 1 and [t for _, _, t in rows] == sorted(t for _, _, t in rows)
        assert [row for _, row, _ in rows] == list(range(index[track].start, index[track].end)) and rows[0][0].endswith(index[track].leaf)
    leaves = spark.read.parquet(f"{laid}_index/leaves").collect()
    assert sum(r.n_rows for r in leaves) == 2400 and all(r.low <= r.high for r in leaves)


def test_many_voyages_open_their_files_only(spark, laid):
    wanted = spark.createDataFrame([(5,), (6,), (41,), (999,)], "track_id long")
    files = {r.leaf for r in layout.offsets(spark, laid).where("track_id in (5, 6, 41)").collect()}
    found = layout.points_of(spark, laid, wanted)
    assert sorted((r.track_id, r.place) for r in found.collect()) == [(t, k) for t in (5, 6, 41) for k in range(40)]
    assert max(s["numFiles"] for s in scans(found, laid)) <= len(files) < layout.offsets(spark, laid).select("leaf").distinct().count()
    slices = spark.createDataFrame([(5, 2, 4), (6, None, 1), (41, 38, None)], "track_id long, s int, e int")
    assert sorted((r.track_id, r.place) for r in layout.points_of(spark, laid, slices).collect()) == [(5, 2), (5, 3), (6, 0), (41, 38), (41, 39)]
    assert layout.points_of(spark, laid, wanted.where("track_id = 999")).count() == 0


def test_beyond_a_number_of_files_the_table_is_joined(spark, laid, monkeypatch):
    monkeypatch.setattr(layout, "MOST_LEAVES", 1)
    assert layout.points_of(spark, laid, layout.offsets(spark, laid)).count() == 2400


def test_torn_voyages_raise(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (2, 0)], "track_id long, track_group long")
    for _ in range(2):
        rows.coalesce(1).write.partitionBy("track_group").mode("append").parquet(str(tmp_path / "two"))
    with pytest.raises(ValueError, match="lies in 2 files"):
        layout.index_layout(spark, str(tmp_path / "two"))
    rows.union(rows).coalesce(1).write.partitionBy("track_group").parquet(str(tmp_path / "mixed"))
    with pytest.raises(Exception, match="other rows between"):
        layout.index_layout(spark, str(tmp_path / "mixed"))
