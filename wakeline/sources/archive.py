"""Ingest of JSON snapshots, one file per scraper run, into positions, ships and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import file_day, utc_day
from ..functions.text import byte_text, json_int
from ..plans import materialize, running_total

#: Fields of a record; values come as strings, numbers or null and are kept raw until cast.
FIELDS = ("SHIPNAME", "FLAG", "SHIPTYPE", "GT_SHIPTYPE", "LENGTH", "WIDTH", "DWT", "LAT", "LON", "SPEED", "COURSE", "HEADING", "ROT", "ELAPSED", "DESTINATION", "TILE_Z", "TIMESTAMP")


def list_files(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """Archive files by their name's day within a closed range (DD.MM.YYYY), numbered by day and name.

    Reads names and sizes only; files of another form of name are left out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select("path", "length")
    found = found.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("file_dt", file_day("name"))
    kept = found.where(F.col("file_dt").between(F.to_date(F.lit(start), "dd.MM.yyyy"), F.to_date(F.lit(end), "dd.MM.yyyy")))
    return running_total(kept.withColumn("_one", F.lit(1).cast("long")), ["file_dt", "name", "path"], "_one", "_n").select("path", "name", "file_dt", "length", F.col("_n").cast("int").alias("file_id"))


def records(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """One row per record, with its place in the file; a file is one JSON object by external vessel id."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    tidy = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = text.withColumn("path", tidy("path")).join(files.withColumn("path", tidy("path")), "path")
    raw = F.from_json("value", "map<string,string>")
    rows = rows.select("file_id", "name", "file_dt", F.posexplode(F.map_entries(raw)).alias("ord_in_file", "entry"))
    quoted = [F.get_json_object("entry.value", f"$.{f}").alias(f) for f in FIELDS]
    return rows.select("file_id", "name", "file_dt", "ord_in_file", F.col("entry.key").alias("mt_id"), *quoted, F.col("entry.value").alias("_json"))


def _whole(field: str, default: int = -1):
    """Whole number of a field; a quoted decimal is no number, a JSON one is cut."""
    quoted = F.col("_json").rlike(rf'"{field}"\s*:\s*"')
    return json_int(F.when(quoted, F.concat(F.lit('"'), F.col(field), F.lit('"'))).otherwise(F.col(field)), default)


def ingest(spark: SparkSession, root: str, start: str, end: str) -> dict[str, DataFrame]:
    """Tables ``positions``, ``ships`` and ``files`` of an archive, and ``meta`` with the number of bad times.

    Vessels are numbered from 1 by first appearance, even where that record's
    time is bad; its first attributes stay. A record without a positive time is
    dropped and counted; one without a place raises.
    """
    return _tables(spark, root, materialize(list_files(spark, root, start, end), "files"))


def _tables(spark: SparkSession, root: str, files: DataFrame, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of some files; ``ships`` has the vessels that ``known`` (ship_id, mt_id) lacks, numbered after its last."""
    rows = materialize(records(spark, files, root), "records")
    order = F.struct("file_id", "ord_in_file")
    ship = F.struct(byte_text("mt_id", 128).alias("mt_id_text"), byte_text("SHIPNAME", 128).alias("name"), byte_text("FLAG", 4).alias("flag"), *(_whole(f).alias(n) for f, n in (("SHIPTYPE", "ship_type"), ("GT_SHIPTYPE", "gt_ship_type"), ("LENGTH", "length"), ("WIDTH", "width"), ("DWT", "dwt"))))
    firsts = rows.groupBy("mt_id").agg(F.min(order).alias("o"), F.min_by(ship, order).alias("x")).select("mt_id", "o.file_id", "o.ord_in_file", "x", F.lit(1).cast("long").alias("_one"))
    last = 0
    if known is not None:
        known = known.select("ship_id", F.col("mt_id").alias("_text"))
        last = known.agg(F.max("ship_id")).first()[0] or 0
        firsts = firsts.join(known, F.col("x.mt_id_text") == F.col("_text"), "left_anti")
    numbered = materialize(running_total(firsts, ["file_id", "ord_in_file"], "_one", "_n").withColumn("ship_id", F.col("_n") + last + 1), "ships")
    ships = numbered.select("ship_id", F.col("x.mt_id_text").alias("mt_id"), "x.name", "x.flag", "x.ship_type", "x.gt_ship_type", "x.length", "x.width", "x.dwt")
    timed = rows.withColumn("timestamp", _whole("TIMESTAMP", 0))
    good = timed.where("timestamp > 0")
    if known is None:
        good = good.join(numbered.select("mt_id", "ship_id"), "mt_id")
    else:
        good = good.withColumn("_text", byte_text("mt_id", 128)).join(known.unionByName(ships.select("ship_id", F.col("mt_id").alias("_text"))), "_text")
    place = lambda f: F.when(F.col(f).isNull(), F.raise_error(F.lit(f"a record has no {f}"))).otherwise(F.col(f).cast("float"))
    positions = good.select(
        "ship_id", "timestamp", place("LAT").cast("float").alias("lat"), place("LON").cast("float").alias("lon"), _whole("SPEED").alias("speed"), _whole("COURSE").alias("course"), _whole("HEADING").alias("heading"), _whole("ROT", 0).alias("rot"),
        _whole("ELAPSED", 0).alias("elapsed"), byte_text("DESTINATION", 64).alias("destination"), _whole("TILE_Z").alias("tile_z"), "file_id", F.lit(-1).cast("long").alias("track_id"), utc_day("timestamp").alias("dt"), "ord_in_file",
    )
    counts = good.groupBy("file_id").agg(F.count("*").cast("int").alias("positions_count"))
    table = files.join(counts, "file_id", "left").select("file_id", "name", F.coalesce("positions_count", F.lit(0)).alias("positions_count"), F.unix_timestamp().cast("int").alias("timestamp"))
    bad = timed.where("timestamp <= 0").agg(F.count("*").alias("invalid_timestamps"))
    return {"positions": positions, "ships": ships, "files": table, "meta": bad}


def ingest_more(spark: SparkSession, root: str, out: str, start: str, end: str, most: int | None = None) -> int:
    """Take files of an archive that a dataset lacks, by day and name, at most ``most`` of them; gives how many.

    The dataset's table of files is the ledger, and is written last: a file
    named there is done and never read again, so a call that is repeated writes
    nothing. A call that failed before may have left positions of files that
    the ledger lacks; each of their Parquet files holds that call's rows only
    and is deleted first. Vessels it numbered keep their numbers. Files and
    vessels are numbered on from the last, so calls in the order of days give
    the tables of one :func:`ingest`; a file that comes late is numbered late.
    """
    from . import dataset

    if not dataset._folders(spark, f"{out}/files"):
        dataset.create(spark, out, overwrite=True, archive=root)
    done = materialize(dataset.read(spark, out, "files"), "ledger")
    last = done.agg(F.max("file_id")).first()[0]
    last = -1 if last is None else last
    left = dataset.read(spark, out, "positions").where(F.col("file_id") > last).select(F.col("_metadata.file_path").alias("path")).distinct()
    for row in left.collect():
        dataset.delete(spark, row.path)
    todo = list_files(spark, root, start, end).join(done.select("name"), "name", "left_anti")
    todo = todo.orderBy("file_dt", "name", "path").limit(most) if most is not None else todo
    todo = running_total(todo.drop("file_id").withColumn("_one", F.lit(1).cast("long")), ["file_dt", "name", "path"], "_one", "_n").withColumn("file_id", (F.col("_n") + last + 1).cast("int"))
    todo = materialize(todo.select("path", "name", "file_dt", "length", "file_id"), "files")
    count = todo.count()
    if count:
        found = _tables(spark, root, todo, materialize(dataset.read(spark, out, "ships"), "known"))
        for table in ("positions", "ships", "files"):
            dataset.write(found[table].select(*dataset.TABLES[table].names), out, table)
    return count


def tile_rows(responses: DataFrame) -> DataFrame:
    """Records of map-tile responses (path, body, response_ts), one per vessel: the highest zoom, its first place kept."""
    from ..functions.text import event_time, tile_of

    schema = "struct<data:struct<rows:array<map<string,string>>>>"
    rows = responses.where(F.col("path").contains("get_data_json_4")).withColumns(tile_of("path")).withColumn("body", F.from_json("body", schema))
    rows = rows.select("response_ts", "tile_z", "tile_x", "tile_y", F.posexplode("body.data.rows").alias("place", "r"))
    rows = rows.withColumns({"ship": F.col("r")["SHIP_ID"], "timestamp": event_time("response_ts", F.col("r")["ELAPSED"].try_cast("int"))})
    order = Window.partitionBy("ship").orderBy(F.desc("tile_z"), "response_ts", "place")
    return rows.withColumns({"_n": F.row_number().over(order), "first_seen": F.min(F.struct("response_ts", "place")).over(Window.partitionBy("ship"))}).where("_n = 1").drop("_n")
