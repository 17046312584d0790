"""Driver tables seen as vessel data: ``events`` plays the fixes, and its time is pressed together sixty times.

Every view exists twice, as a DataFrame and as SQL text for the reference run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000

POS_SQL = f"""pos as (select *, case when seq%11=0 then -1 else ship_id*10+cast(floor(timestamp/8640.0) as bigint) end track_id from (
 select event_id seq, user_id ship_id, cast(floor((epoch_us(ts)-{EPOCH_US})/60000000) as bigint) "timestamp", cast(ts as date) dt,
  cast(cast(30+(user_id%15)+((event_id*37)%1000)/cast(1000 as double) as float) as double) lat,
  cast(cast(125+(user_id%17)+((event_id*53)%1000)/cast(1000 as double) as float) as double) lon,
  cast(floor(value) as int) speed, cast((event_id*7)%360 as int) course, cast((event_id*11)%520 as int) heading, cast(event_id%41-20 as int) rot, cast(event_id%15 as int) tile_z,
  concat('PORT ', cast((user_id+cast(floor((epoch_us(ts)-{EPOCH_US})/432000000000) as bigint))%7 as varchar)) destination
 from events))"""

TRK_SQL = """trk as (select track_id, ship_id, arg_min("timestamp", seq) start_timestamp, arg_max("timestamp", seq) end_timestamp, arg_min(lat, seq) start_lat, arg_min(lon, seq) start_lon,
  arg_max(lat, seq) end_lat, arg_max(lon, seq) end_lon, count(*) points_count, min(seq) track_ord from pos where track_id>=0 group by track_id, ship_id)"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    near = lambda base, n, by: (base + F.col("user_id") % n + ((F.col("event_id") * by) % 1000) / F.lit(1000.0)).cast("float").cast("double")
    rows = events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("ship_id"), F.floor(micros / 60_000_000).alias("timestamp"), F.to_date("ts").alias("dt"), near(30, 15, 37).alias("lat"), near(125, 17, 53).alias("lon"),
        F.floor("value").cast("int").alias("speed"), ((F.col("event_id") * 7) % 360).cast("int").alias("course"), ((F.col("event_id") * 11) % 520).cast("int").alias("heading"), (F.col("event_id") % 41 - 20).cast("int").alias("rot"),
        (F.col("event_id") % 15).cast("int").alias("tile_z"), F.concat(F.lit("PORT "), ((F.col("user_id") + F.floor(micros / 432_000_000_000)) % 7).cast("string")).alias("destination"),
    )
    voyage = F.when(F.col("seq") % 11 == 0, F.lit(-1)).otherwise(F.col("ship_id") * 10 + F.floor(F.col("timestamp") / 8640))
    return rows.withColumn("track_id", voyage.cast("long"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voyages of the view, by its own ids; real ones come from the voyage detector."""
    first, last = (lambda c, n: F.min_by(c, "seq").alias(n)), (lambda c, n: F.max_by(c, "seq").alias(n))
    return positions(spark, sf_dir).where("track_id >= 0").groupBy("track_id", "ship_id").agg(
        first("timestamp", "start_timestamp"), last("timestamp", "end_timestamp"), first("lat", "start_lat"), first("lon", "start_lon"), last("lat", "end_lat"), last("lon", "end_lon"), F.count("*").alias("points_count"), F.min("seq").alias("track_ord")
    )
