"""The voyage-sorted layout: buckets of voyage ids, range partitions and sorted files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LayoutConfig
from ..functions.text import range_label
from ..plans import materialize
from ..schema import LAYOUT_FIELDS


def buckets(config: LayoutConfig = LayoutConfig()) -> dict[str, Column]:
    """Group and sub-range of a voyage id; floors, so that idle rows (-1) get a group of their own."""
    size, tid = config.group, F.col("track_id")
    width = -(-size // config.parts)
    group = F.floor(tid / size).cast("long") * size
    sub = group + F.floor((tid - group) / width).cast("long") * width
    return {"track_group": group, "group_label": range_label(group, group + (size - 1)), "subrange": sub, "subrange_label": range_label(sub, F.least(sub + (width - 1), group + (size - 1)))}


#: Tasks that share a sub-range of voyages: a voyage's rows stay together, and a busy range is spread.
SPREAD = 8


def track_sorted(positions: DataFrame, wanted: DataFrame | None = None, config: LayoutConfig = LayoutConfig(), fields=LAYOUT_FIELDS) -> DataFrame:
    """Chosen fields of the wanted voyages, dealt by sub-range and sorted by time within a voyage; ``seq`` settles ties.

    Sub-ranges are arithmetic, so nothing is sampled and what lies before runs
    once. The voyages of a sub-range go to ``SPREAD`` tasks.
    """
    rows = positions.select(*(f for f in fields if f in positions.columns), "seq")
    if wanted is not None:
        rows = rows.join(wanted.select("track_id"), "track_id", "left_semi")
    made = buckets(config)
    rows = rows.withColumns({"track_group": made["track_group"], "_part": made["subrange"]})
    return rows.repartition("_part", F.pmod(F.xxhash64("track_id"), F.lit(SPREAD))).sortWithinPartitions("track_group", "track_id", "timestamp", "seq").drop("_part")


def write_track_sorted(positions: DataFrame, path: str, wanted: DataFrame | None = None, config: LayoutConfig = LayoutConfig(), mode: str = "errorifexists") -> None:
    track_sorted(positions, wanted, config).write.partitionBy("track_group").mode(mode).parquet(path)


#: A look-up that needs more files than this reads the table with a join instead.
MOST_LEAVES = 10_000


def index_layout(spark: SparkSession, path: str) -> None:
    """Where each voyage lies in the files of a written layout, in ``<path>_index``.

    ``runs`` has the file, first row and end of each voyage's rows, from the
    files' own row numbers; ``leaves`` has each file's rows and its least and
    greatest voyage. Reads one column. Raises where a voyage has rows in two
    files, or others between its own; rows without a voyage (-1) may have.
    """
    rows = spark.read.parquet(path).where("track_id >= 0").select("track_id", "track_group", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    found = rows.groupBy("file", "track_group", "track_id").agg(F.min("row").alias("start"), (F.max("row") + 1).alias("end"), F.count("*").alias("n"))
    torn = F.raise_error(F.concat(F.lit("other rows between those of voyage "), F.col("track_id"))).cast("long")
    leaf = F.regexp_extract("file", r"([^/]+/[^/]+)$", 1)
    runs = found.select(leaf.alias("leaf"), "track_group", "track_id", "start", F.when(F.col("end") - F.col("start") == F.col("n"), F.col("end")).otherwise(torn).alias("end"))
    runs.repartitionByRange("track_id").sortWithinPartitions("track_id").write.mode("overwrite").parquet(f"{path}_index/runs")
    runs = spark.read.parquet(f"{path}_index/runs")
    if twice := runs.groupBy("track_id").count().where("count > 1").head():
        raise ValueError(f"voyage {twice.track_id} lies in {twice['count']} files")
    runs.groupBy("leaf", "track_group").agg(F.min("track_id").alias("low"), F.max("track_id").alias("high"), F.max("end").alias("n_rows")).write.mode("overwrite").parquet(f"{path}_index/leaves")


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """``leaf``, ``track_id``, ``start`` and ``end`` of all voyages of an indexed layout."""
    return spark.read.parquet(f"{path}_index/runs").select("leaf", "track_id", "start", "end")


def points_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of many voyages of an indexed layout, or of their slices [s, e) where ``wanted`` has these, with their ``place`` in the voyage.

    The index says which files hold the voyages, and no other is opened; within
    them the least and greatest id skip row groups. What isn't there gives no
    rows. Above ``MOST_LEAVES`` files the whole table is joined instead.
    """
    cuts = [F.col(c) for c in ("s", "e") if c in wanted.columns]
    hits = offsets(spark, path).join(wanted.select("track_id", *cuts), "track_id")
    hits = materialize(hits, "hits")
    files = [r.leaf for r in hits.select("leaf").distinct().limit(MOST_LEAVES + 1).collect()]
    table = spark.read.option("basePath", path)
    if not files:
        return table.parquet(path).where("false").withColumn("place", F.lit(0).cast("long"))
    rows = table.parquet(*(f"{path}/{x}" for x in files)) if len(files) <= MOST_LEAVES else table.parquet(path)
    ends = hits.agg(F.min("track_id").alias("low"), F.max("track_id").alias("high")).first()
    rows = rows.where(F.col("track_id").between(ends.low, ends.high))
    rows = rows.withColumn("_row", F.col("_metadata.row_index")).join(hits.drop("leaf", "end"), "track_id").withColumn("place", F.col("_row") - F.col("start"))
    if cuts:
        rows = rows.where((F.col("place") >= F.coalesce("s", F.lit(0))) & (F.col("e").isNull() | (F.col("place") < F.col("e")))).drop("s", "e")
    return rows.drop("_row", "start")


def track_points(table: DataFrame, track_id: int, s: int | None = None, e: int | None = None, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """One voyage of the layout, or its slice [s, e): the group prunes folders, sorted files skip row groups."""
    size = config.group
    rows = table.where((F.col("track_group") == track_id // size * size) & (F.col("track_id") == track_id))
    if s is None:
        return rows.orderBy("timestamp", "seq")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("track_id").orderBy("timestamp", "seq")) - 1)
    return placed.where(F.col("place").between(s, e - 1)).orderBy("place")


def track_offsets(positions: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """First and last place of each voyage among the rows of its sub-range."""
    sub = buckets(config)["subrange_label"]
    counts = positions.withColumn("leaf", sub).groupBy("leaf", "track_id").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("leaf").orderBy("track_id").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("end", upto).select("leaf", "track_id", (F.col("end") - F.col("n")).alias("start"), "end")
