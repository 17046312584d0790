"""Joins, missing rows, checks and parameterised SQL over the relational mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import running_total


def missing(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Values that the known table lacks, each once."""
    return found.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def insert_missing(found: DataFrame, known: DataFrame, key: str, id_name: str) -> DataFrame:
    """The known rows and the missing ones with the next ids, in order of their key."""
    fresh = running_total(missing(found, known, key).withColumn("_one", F.lit(1).cast("long")), [key], "_one", "_rank")
    top = known.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("_top"))
    added = fresh.join(F.broadcast(top)).select((F.col("_top") + F.col("_rank") + 1).cast("long").alias(id_name), key)
    return known.select(F.col(id_name).cast("long").alias(id_name), key).unionByName(added)


def first_seen_ids(rows: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Ids from 1 by first appearance."""
    firsts = rows.groupBy(key).agg(F.min(order).alias("_first")).withColumn("_one", F.lit(1).cast("long"))
    return running_total(firsts, ["_first", key], "_one", "_rank").select(key, (F.col("_rank") + 1).alias(out))


def area_query(spark: SparkSession, positions: DataFrame, ships: DataFrame, **at) -> DataFrame:
    """Fixes of a box with their vessels, by name pattern, speed, width and time; parameters are bound, not pasted."""
    text = """
        select p.ship_id, s.name, p.timestamp, p.lat, p.lon, p.speed
        from {positions} p join {ships} s on s.ship_id = p.ship_id
        where p.lat between :min_lat and :max_lat and p.lon between :min_lon and :max_lon
          and p.speed >= :min_speed and s.width between :min_width and :max_width and s.name like :name and p.timestamp >= :from_ts and p.timestamp < :to_ts
        order by p.ship_id, p.timestamp, p.lat
    """
    return spark.sql(text, args=at, positions=positions, ships=ships)


def ship_query(spark: SparkSession, positions: DataFrame, ships: DataFrame, mt_id: str) -> DataFrame:
    """All fixes of the vessel of an external id, by a scalar subquery."""
    text = "select timestamp, lat, lon, speed from {positions} where ship_id = (select min(ship_id) from {ships} where mt_id = :mt_id) order by timestamp, seq"
    return spark.sql(text, args={"mt_id": mt_id}, positions=positions, ships=ships)


def parse_event(rows: DataFrame, description: str = "UNKNOWN") -> DataFrame:
    """The row that registers a parse: its first and last time, and what it is."""
    return rows.agg(F.min("timestamp").alias("parse_start"), F.max("timestamp").alias("parse_end")).withColumn("description", F.lit(description))


def violations(ships: DataFrame, positions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows that break a constraint of the mirror, counted by rule; every rule has a row."""
    rules = [
        ("ships_mt_id_unique", ships.groupBy("mt_id").count().where("count > 1 and mt_id is not null")),
        ("ships_type_required", ships.where("ship_type is null or gt_ship_type is null")),
        ("ships_sizes_positive", ships.where("length < 0 or width < 0 or dwt < 0")),
        ("positions_ship_known", positions.join(ships, "ship_id", "left_anti")),
        ("positions_values_positive", positions.where("speed < 0 or course < 0 or heading < 0 or elapsed < 0")),
        ("positions_place_required", positions.where("lat is null or lon is null")),
        ("tracks_ship_known", tracks.join(ships, "ship_id", "left_anti")),
        ("positions_track_same_ship", positions.where("track_id >= 0").select("track_id", F.col("ship_id").alias("_ship")).join(tracks, "track_id").where("_ship <> ship_id")),
    ]
    counts = [rows.agg(F.lit(name).alias("rule"), F.count("*").alias("bad_rows")) for name, rows in rules]
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out


def clean_legacy(rows: DataFrame) -> DataFrame:
    """Scraped strings as numbers, '--' flags as null, epochs as timestamps."""
    numbers = {c: F.expr(f"try_cast({c} as bigint)") for c in ("SHIP_ID", "SHIPTYPE", "LENGTH", "WIDTH", "SPEED", "COURSE", "HEADING", "ELAPSED") if c in rows.columns}
    places = {c: F.expr(f"try_cast({c} as double)") for c in ("LAT", "LON") if c in rows.columns}
    other = {"FLAG": F.nullif("FLAG", F.lit("--"))} if "FLAG" in rows.columns else {}
    times = {"TIMESTAMP": F.timestamp_seconds(F.expr("try_cast(TIMESTAMP as double)").cast("long"))} if "TIMESTAMP" in rows.columns else {}
    return rows.withColumns(numbers | places | other | times)
