import random
import pytest

from wakeline.config import Breaks
from wakeline.operators import voyages

POSITION = "seq long, ship_id long, timestamp long, lat double, lon double, speed int, destination string"
METRE = 1 / 111_194.93


def ids(spark, fixes, rules=Breaks()):
    rows = [(k, 1, *f) for k, f in enumerate(fixes)]
    placed, tracks = voyages.detect(spark.createDataFrame(rows, POSITION), rules)
    # numbered from 0 here
    return [r.track_id - (r.track_id > 0) for r in placed.orderBy("seq").collect()], [(r.track_id - 1, r.points_count) for r in tracks.orderBy("track_ord").collect()]


@pytest.mark.parametrize(
    ("gap", "metres", "dest", "splits"),
    [
        (36_000, 0, "A", False), (36_001, 0, "A", True),
        (18_001, 149_000, "A", False), (18_001, 151_000, "A", True),
        (60, 249_000, "A", False), (60, 251_000, "A", True),
        (14_400, 0, "B", False), (14_401, 0, "B", True),
        (60, 49_000, "B", False), (60, 51_000, "B", True),
    ],
)
def test_breaks(spark, gap, metres, dest, splits):
    found, _ = ids(spark, [(1000, 30.0, 130.0, 100, "A"), (1000 + gap, 30.0 + metres * METRE, 130.0, 100, dest)])
    assert found == [0, 1 if splits else 0]


def test_destination_after_rest_and_back_in_time(spark):
    assert ids(spark, [(0, 30.0, 130.0, 0, "A"), (60, 30.0, 130.0, 100, "B")])[0] == [0, 1]
    assert ids(spark, [(100_000, 30.0, 130.0, 100, "A"), (0, 30.0, 130.0, 100, "A")])[0] == [0, 0]


@pytest.mark.parametrize(("speed", "metres", "dest", "leaves"), [(100, 0, "A", False), (100, 300, "A", True), (100, 0, "B", True), (0, 300, "B", True), (0, 300, "A", False), (0, 0, "B", False)])
def test_dwell_and_exits(spark, speed, metres, dest, leaves):
    rest = [(600 * k, 30.0, 130.0, 0, "A") for k in range(5)]
    found, tracks = ids(spark, [*rest, (3600, 30.0 + metres * METRE, 130.0, speed, dest)])
    assert found == [0, 0, 0, -1, -1, 1 if leaves else -1]
    assert tracks == [(0, 3)]


def test_drift_never_idles(spark):
    found, _ = ids(spark, [(600 * k, 30.0 + 260 * k * METRE, 130.0, 0, "A") for k in range(12)])
    assert found == [0] * 12


def test_ids_follow_first_fixes_and_tables_closing(spark):
    random.seed(3)
    rules = Breaks(silence=((500, -1.0), (18_000, 150_000.0)))
    rows, now = [], [0] * 4
    for k in range(400):
        ship = random.randrange(4)
        now[ship] += random.choice((60, 100, 400, 600))
        rows.append((k, ship, now[ship], 30.0, 130.0, 100, "A"))
    open_, next_id, want, counts, closed = {}, 1, [], {}, []
    last = {}
    for seq, ship, ts, *_ in rows:
        if ship not in open_ or ts - last[ship] > 500:
            if ship in open_:
                closed.append(open_[ship])
            open_[ship], next_id = next_id, next_id + 1
        last[ship] = ts
        want.append(open_[ship])
        counts[open_[ship]] = counts.get(open_[ship], 0) + 1
    closed += [open_[s] for s in dict.fromkeys(r[1] for r in rows)]
    placed, tracks = voyages.detect(spark.createDataFrame(rows, POSITION), rules)
    assert [r.track_id for r in placed.orderBy("seq").collect()] == want
    assert [(r.track_id, r.points_count) for r in tracks.orderBy("track_ord").collect()] == [(t, counts[t]) for t in closed if counts[t] > 1]


def test_empty(spark):
    placed, tracks = voyages.detect(spark.createDataFrame([], POSITION))
    assert placed.count() == tracks.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from wakeline.streaming.voyages import read_snapshots, stream_voyages

    random.seed(5)
    rows = [(k, k % 3, 400 * k, 30.0 + random.random(), 130.0, random.choice((0, 100)), random.choice("AB")) for k in range(90)]
    for part in range(3):
        spark.createDataFrame(rows[30 * part : 30 * part + 30], POSITION).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_voyages(read_snapshots(spark, str(tmp_path / "in"), POSITION, 1))
    run = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    got = {r.seq: r.local_no for r in spark.table("found").collect()}
    state = {s: voyages.Vessel() for s in range(3)}
    assert got == {r[0]: state[r[1]].take(tuple(r[2:]))[0] for r in rows}


def _drawn(n, ships, seed):
    draw, now, rows = random.Random(seed), {}, []
    for k in range(n):
        ship = draw.choice(ships)
        now[ship] = now.get(ship, 0) + draw.choice((60, 100, 400, 600))
        # arrival numbers beyond what a double holds
        rows.append(((1 << 62) + 3 * k, ship, now[ship], 30.0 + draw.random() / 7, 130.0, draw.choice((0, 5, 100)), draw.choice("AAAB")))
    return rows


@pytest.mark.parametrize("cuts", [(0.5,), (0.1, 0.2, 0.9), (0.4, 0.4, 0.41)])
def test_portions_give_what_all_fixes_give(spark, cuts):
    rules = Breaks(silence=((500, -1.0),), rest=(250.0, 600))
    rows = [r for r in _drawn(300, range(6), 8) if not (r[1] == 2 and r[0] > (1 << 62) + 300)]
    whole = [spark.createDataFrame(rows, POSITION)]
    placed, tracks = voyages.detect(*whole, rules)
    wanted = sorted(map(tuple, placed.collect())), [tuple(r) for r in tracks.orderBy("track_ord").collect()]
    at = [0, *(int(c * len(rows)) for c in cuts), len(rows)]
    carried, found, closed = None, [], []
    for a, b in zip(at, at[1:], strict=False):
        some, ended, carried = voyages.carry_on(spark.createDataFrame(rows[a:b], POSITION), carried, rules)
        found += map(tuple, some.collect())
        closed += [tuple(r) for r in ended.orderBy("track_ord").collect()]
    closed += [tuple(r) for r in voyages.still_open(carried).orderBy("track_ord").collect()]
    assert (sorted(found), closed) == wanted
    assert carried.vessels.count() == 6


def test_datasets_grow_by_days(spark, tmp_path):
    from pyspark.sql import functions as F

    from wakeline import schema
    from wakeline.sources import dataset

    rules = Breaks(silence=((4000, -1.0),), rest=(250.0, 600))
    source, whole, grown = (str(tmp_path / x) for x in ("s", "w", "g"))
    dataset.create(spark, source)
    raw = [(ship, 1_700_000_000 + 600 * k, lat, lon, speed, to) for k, (_, ship, _, lat, lon, speed, to) in enumerate(_drawn(600, range(4), 9))]
    rows = spark.createDataFrame(raw, "ship_id long, timestamp long, lat double, lon double, speed int, destination string").withColumn("dt", F.to_date(F.timestamp_seconds("timestamp")))
    rows = rows.withColumns({"ord_in_file": F.floor(F.col("timestamp") / 600) % 1000, "file_id": F.lit(1), "track_id": F.lit(-1), **{c: F.lit(0) for c in ("course", "heading", "rot", "elapsed", "tile_z")}})
    dataset.write(rows.select(*(F.col(f.name).cast(f.dataType) for f in schema.POSITIONS)), source, "positions")
    dataset.tracked_copy(spark, source, whole, rules)
    days = [str(r.dt) for r in rows.select("dt").distinct().orderBy("dt").collect()]
    assert len(days) > 4
    dataset.tracked_days(spark, source, grown, days[0], days[1], rules)
    # a call that failed before its state was whole is made again
    dataset.tracked_days(spark, source, grown, days[2], days[2], rules)
    state = tmp_path / "g" / "voyage_state" / days[2] / "counters" / "_SUCCESS"
    state.unlink()
    dataset.tracked_days(spark, source, grown, days[2], days[2], rules)
    dataset.tracked_days(spark, source, grown, days[3], days[-1], rules)
    with pytest.raises(ValueError):
        dataset.tracked_days(spark, source, grown, days[-1], days[-1], rules)
    listed = lambda table: sorted(map(tuple, table.collect()))
    assert listed(dataset.read(spark, grown, "positions")) == listed(dataset.read(spark, whole, "positions"))
    assert listed(dataset.tracks_so_far(spark, grown)) == listed(dataset.read(spark, whole, "tracks")) != []


def test_days_have_files_of_even_size(spark, tmp_path):
    from pyspark.sql import functions as F

    from wakeline.sources import dataset

    # one day has 99 of 100 rows, one vessel a third of them
    rows = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("ship_id"), F.col("id").alias("timestamp"), F.when(F.col("id") % 100 == 0, "2024-01-02").otherwise("2024-01-01").cast("date").alias("dt"))
    dataset.spread(rows, 10_000).write.partitionBy("dt").parquet(str(tmp_path / "p"))
    found = spark.read.parquet(str(tmp_path / "p"))
    sizes = found.groupBy("dt", F.col("_metadata.file_path").alias("f")).count().collect()
    busy = [r["count"] for r in sizes if str(r.dt) == "2024-01-01"]
    assert len(sizes) == 11 and len(busy) == 10 and max(busy) < 2 * min(busy) and sum(r["count"] for r in sizes) == 100_000
