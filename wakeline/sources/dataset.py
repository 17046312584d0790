"""A dataset: a folder of Parquet tables with provenance, its writers, scans and facts."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.dates import utc_day
from ..functions.text import byte_text
from ..plans import materialize

TABLES = {"positions": schema.POSITIONS, "ships": schema.SHIPS, "tracks": schema.TRACKS, "files": schema.FILES, "zones": schema.ZONES}
PARTITIONS = {"positions": ["dt"]}


def create(spark: SparkSession, path: str, overwrite: bool = False, **attributes: str) -> None:
    """Empty tables of fixed schemas and a one-row ``dataset_meta``; raises where they exist, unless overwritten."""
    for name, kind in TABLES.items():
        write(spark.createDataFrame([], kind), path, name, "overwrite" if overwrite else "errorifexists")
    write_meta(spark, path, {"created_at": datetime.now(UTC).isoformat(), **attributes}, overwrite)


def write_meta(spark: SparkSession, path: str, attributes: dict[str, str], overwrite: bool = True) -> None:
    rows = spark.range(1).select(F.create_map(*(F.lit(str(x)) for kv in sorted(attributes.items()) for x in kv)).alias("attributes"))
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/dataset_meta")


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    return dict(spark.read.parquet(f"{path}/dataset_meta").first()[0])


#: Fixes of a file of positions, about; and ranges of vessels whose rows are counted by day, to deal them to files.
FILE_ROWS, RANGES = 2_000_000, 1024
#: Counts up to this many are broadcast to the rows; beyond it they are joined by a shuffle.
BROADCAST_COUNTS = 1_000_000


def spread(rows: DataFrame, file_rows: int | None = None) -> DataFrame:
    """Positions dealt to tasks so that each day is written as files of even size, of about ``file_rows``, or one.

    Rows are counted by day and range of hashed vessels first. A range's rows
    fill the day's files from where the ranges before it end, and a range (or
    one busy vessel) that is larger than a file is spread by time. So a day
    with nearly all rows has nearly all tasks, and a quiet one has one.
    """
    most, names = file_rows or FILE_ROWS, rows.columns
    place = F.pmod(F.xxhash64("ship_id"), F.lit(RANGES)).cast("int")
    counts = materialize(rows.groupBy(F.col("dt").alias("_day"), place.alias("_range")).agg(F.count("*").alias("_n")), "counts")
    days = counts.groupBy("_day").agg(F.sum("_n").alias("_total")).withColumn("_files", F.greatest(F.lit(1), F.round(F.col("_total") / most)).cast("long"))
    # a row per day
    before = F.sum("_files").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = materialize(days.withColumn("_first", F.coalesce(before, F.lit(0))), "days")
    upto = F.sum("_n").over(Window.partitionBy("_day").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    slots = counts.withColumn("_before", F.coalesce(upto, F.lit(0))).withColumnRenamed("_day", "_d")
    slots = slots.join(F.broadcast(days), F.col("_d").eqNullSafe(F.col("_day"))).drop("_d")
    slots = F.broadcast(slots) if counts.count() <= BROADCAST_COUNTS else slots
    dealt = rows.withColumn("_place", place).join(slots, (F.col("_place") == F.col("_range")) & F.col("dt").eqNullSafe(F.col("_day")))
    within = F.pmod(F.xxhash64("ship_id", "timestamp"), F.lit(1 << 20)) / float(1 << 20)
    file = F.least(F.floor((F.col("_before") + within * F.col("_n")) * F.col("_files") / F.col("_total")), F.col("_files") - 1)
    total = days.agg(F.sum("_files")).first()[0] or 1
    return dealt.select(*names, (F.col("_first") + file).cast("int").alias("_file")).repartitionById(total, F.col("_file")).sortWithinPartitions("dt", "ship_id", "timestamp").drop("_file")


def write(rows: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Append or overwrite a table; positions go to a folder per UTC day, in files of even size, by vessel and time."""
    out = (spread(rows) if table in PARTITIONS else rows).write.mode(mode)
    (out.partitionBy(*PARTITIONS[table]) if table in PARTITIONS else out).parquet(f"{path}/{table}")


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{path}/{table}")


def positions_between(positions: DataFrame, start_ts: int, end_ts: int) -> DataFrame:
    """Whole UTC days that hold a time range: a partition filter on ``dt``."""
    day = lambda t: utc_day(F.lit(t).cast("long"))
    return positions.where(F.col("dt").between(day(start_ts), day(end_ts)))


def positions_of(positions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Fixes of the wanted voyages (track_id, start_timestamp, end_timestamp), from the folders of their days only.

    Their days, a row each of the calendar, are known once the table of
    voyages is read; the scan then takes these partitions and no other.
    """
    times = F.least("start_timestamp", "end_timestamp"), F.greatest("start_timestamp", "end_timestamp")
    days = wanted.select(F.explode(F.sequence(*(utc_day(t) for t in times))).alias("dt")).distinct()
    # a comparison, even one that all days pass, lets the optimiser prune by this side
    days = days.where(F.col("dt") >= F.lit("0001-01-01").cast("date"))
    rows = positions.join(F.broadcast(days), "dt", "left_semi")
    return rows.join(wanted.select("track_id").distinct(), "track_id", "left_semi").select(*positions.columns)


def filtered_copy(spark: SparkSession, source: str, out: str, overwrite: bool = False, **limits: int) -> None:
    """A dataset of active vessels only, by the limits of :func:`active_ships`: positions and ships semi-joined, files and zones copied, no voyages."""
    from ..operators.activity import active_ships, keep_ships

    create(spark, out, overwrite, **read_meta(spark, source) | {"filtered_at": datetime.now(UTC).isoformat(), "filter_rules": json.dumps(limits, sort_keys=True)})
    positions = read(spark, source, "positions")
    kept = active_ships(positions, **limits).select("ship_id").persist()
    n = kept.count()
    write(keep_ships(positions, kept, n), out, "positions")
    write(keep_ships(read(spark, source, "ships"), kept, n), out, "ships")
    for table in ("files", "zones"):
        write(read(spark, source, table), out, table)
    kept.unpersist()


def arrival(day: str, file_id: str, ord_in_file: str) -> Column:
    """Fixes in their order of arrival as one number, from its parts, so that nothing is sorted for it: 15 bits of the day, 24 of the file and 24 of the place in it. More than these hold raise."""
    parts = [(F.unix_date(day), 15), (F.col(file_id), 24), (F.col(ord_in_file), 24)]
    out = F.lit(0).cast("long")
    for value, bits in parts:
        fits = (value >= 0) & (value < 1 << bits)
        out = F.shiftleft(out, bits).bitwiseOR(F.when(fits, value.cast("long")).otherwise(F.raise_error(F.lit("a day, file or place beyond its bits")).cast("long")))
    return out


def tracked_copy(spark: SparkSession, source: str, out: str, config, overwrite: bool = False) -> None:
    """A dataset with voyages: positions get their ids, the table of voyages is written, the rest is copied."""
    from ..config import to_json
    from ..operators.voyages import detect

    create(spark, out, overwrite, **read_meta(spark, source) | {"tracks_at": datetime.now(UTC).isoformat(), "track_rules": to_json(config)})
    rows = read(spark, source, "positions").withColumn("seq", arrival("dt", "file_id", "ord_in_file"))
    placed, tracks = detect(rows, config)
    named = rows.drop("track_id").join(placed.select("seq", "track_id"), "seq")
    write(named.select(*schema.POSITIONS.names), out, "positions")
    write(tracks.select(*schema.TRACKS.names), out, "tracks")
    for table in ("ships", "files", "zones"):
        write(read(spark, source, table), out, table)


def _folders(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _carried(spark: SparkSession, out: str):
    """The day up to which voyages were found, and what was carried from it; a state counts once its last table is whole."""
    from ..operators.voyages import Carried

    days = [d for d in _folders(spark, f"{out}/voyage_state") if "_SUCCESS" in _folders(spark, f"{out}/voyage_state/{d}/counters")]
    if not days:
        return None, None
    counts = spark.read.parquet(f"{out}/voyage_state/{days[-1]}/counters").first()
    return days[-1], Carried(spark.read.parquet(f"{out}/voyage_state/{days[-1]}/vessels"), counts.next_id, counts.next_ord)


def tracked_days(spark: SparkSession, source: str, out: str, start: str, end: str, config) -> None:
    """Voyages of more days (closed range, YYYY-MM-DD) of a dataset, in order, without the days before.

    Reads these days' folders and the state that the last call left, a row per
    vessel; appends positions with ids, and the voyages that these days closed,
    and leaves the next state in ``voyage_state``. Days that are done are
    refused. What a call wrote before it failed is overwritten when it is made
    again, as state comes last: positions by day, voyages by the call's end.
    Calls for all days give what :func:`tracked_copy` gives of the whole.
    """
    from ..operators.voyages import carry_on

    done, before = _carried(spark, out)
    if done is not None and done >= start:
        raise ValueError(f"days up to {done} are done")
    rows = read(spark, source, "positions").where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).withColumn("seq", arrival("dt", "file_id", "ord_in_file"))
    placed, closed, after = carry_on(rows, before, config)
    named = rows.drop("track_id").join(placed.select("seq", "track_id"), "seq").select(*schema.POSITIONS.names)
    spread(named).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(f"{out}/positions")
    closed.write.mode("overwrite").parquet(f"{out}/tracks_closed/{end}")
    for table in ("ships", "files", "zones"):
        write(read(spark, source, table), out, table, "overwrite")
    after.vessels.write.mode("overwrite").parquet(f"{out}/voyage_state/{end}/vessels")
    counts = spark.range(1).select(F.lit(after.next_id).cast("long").alias("next_id"), F.lit(after.next_ord).cast("long").alias("next_ord"))
    counts.write.mode("overwrite").parquet(f"{out}/voyage_state/{end}/counters")


def tracks_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Voyages that :func:`tracked_days` closed, and those open at the end of its last day."""
    from ..operators.voyages import still_open

    done, carried = _carried(spark, out)
    folders = [f"{out}/tracks_closed/{d}" for d in _folders(spark, f"{out}/tracks_closed") if done is not None and d <= done]
    if not folders:
        return spark.createDataFrame([], schema.TRACKS)
    return spark.read.schema(schema.TRACKS).parquet(*folders).unionByName(still_open(carried).select(*schema.TRACKS.names))


def ship_extract(spark: SparkSession, source: str, out: str, ship_id: int) -> None:
    """A dataset of one vessel; only its days have folders."""
    create(spark, out, **read_meta(spark, source) | {"ship_id": str(ship_id)})
    for table in ("positions", "ships", "tracks"):
        write(read(spark, source, table).where(F.col("ship_id") == ship_id), out, table)
    write(read(spark, source, "files"), out, "files")


def import_zones(spark: SparkSession, json_path: str, out: str | None = None) -> DataFrame:
    """Zones of a JSON list (zone, lat, lon, zoom), numbered from 0 by place in each import; writing appends to the table."""
    raw = spark.read.schema("value string").text(json_path, wholetext=True)
    rows = raw.select(F.posexplode(F.from_json("value", "array<struct<zone:string,lon:double,lat:double,zoom:int>>")).alias("place", "z"))
    zones = rows.select(F.col("place").cast("long").alias("zone_id"), byte_text("z.zone", 256).alias("name"), F.col("z.lat").cast("float").alias("lat"), F.col("z.lon").cast("float").alias("lon"), F.col("z.zoom").alias("zoom"))
    if out:
        write(zones, out, "zones")
    return zones


def clean_zones(zones: DataFrame) -> DataFrame:
    return zones.where("zoom <> 1 and lat < 300")


def zone_rectangles(zones: DataFrame, widths: dict[int, float], default: float = 1.0) -> DataFrame:
    """The rectangle that the map shows around each zone; heights are 10/16 of widths."""
    width = F.coalesce(F.create_map(*(F.lit(x) for kv in widths.items() for x in kv))[F.col("zoom")], F.lit(float(default))) if widths else F.lit(float(default))
    half_w, half_h = width / 2, width * 10 / 32
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    return zones.select("zone_id", "name", (lon - half_w).alias("min_lon"), (lon + half_w).alias("max_lon"), (lat - half_h).alias("min_lat"), (lat + half_h).alias("max_lat"))


def folder_stats(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def info(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every table, days of positions, and in ``value`` the first and last file and the attributes."""
    out = None
    for table in TABLES:
        one = read(spark, path, table).agg(F.lit(table).alias("table"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    days = read(spark, path, "positions").agg(F.lit("days").alias("table"), F.count_distinct("dt").alias("rows"))
    files = read(spark, path, "files")
    ends = [files.agg(F.lit(f"{n} file").alias("table"), F.lit(1).cast("long").alias("rows"), f("name", "file_id").cast("string").alias("value")) for n, f in (("first", F.min_by), ("last", F.max_by))]
    attributes = spark.read.parquet(f"{path}/dataset_meta").select(F.explode("attributes")).select(F.concat(F.lit("attribute "), "key").alias("table"), F.lit(1).cast("long").alias("rows"), "value")
    out = out.unionByName(days).withColumn("value", F.lit(None).cast("string"))
    for one in (*ends, attributes):
        out = out.unionByName(one)
    return out


def structure(spark: SparkSession, path: str) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString()) for t in TABLES for f in read(spark, path, t).schema]
    return spark.createDataFrame(rows, "table string, column string, type string")


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 of the path and its attributes as canonical JSON."""
    return hashlib.sha256(json.dumps({"path": path, "attrs": read_meta(spark, path)}, sort_keys=True).encode()).hexdigest()
