"""Ports mined from where voyages start and end, the pairs between them and their names."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Grid
from ..functions.geo import grid_cell, in_box
from ..functions.text import bad_destination, normal_destination, pair_key
from ..plans import materialize
from . import rasters
from .gaps import gap_metrics

#: Dense cells up to this many are broadcast to the voyages; they are a few hundredths of the grid.
BROADCAST_CELLS = 2_000_000


def summarise(labelled: DataFrame, heat: DataFrame, extent, bins) -> DataFrame:
    """Weighted centre, box, sums and size of each component."""
    x0, x1, y0, y1 = extent
    nx, ny = bins
    dx, dy = (x1 - x0) / nx, (y1 - y0) / ny
    rows = labelled.select("iy", "ix", "poi_id").join(heat, ["iy", "ix"])
    lon, lat = F.lit(x0) + (F.col("ix") + 0.5) * dx, F.lit(y0) + (F.col("iy") + 0.5) * dy
    return rows.groupBy("poi_id").agg(
        (F.sum(lat * F.col("cnt")) / F.sum("cnt")).alias("center_lat"), (F.sum(lon * F.col("cnt")) / F.sum("cnt")).alias("center_lon"),
        (F.lit(x0) + F.min("ix") * dx).alias("min_lon"), (F.lit(y0) + F.min("iy") * dy).alias("min_lat"), (F.lit(x0) + (F.max("ix") + 1) * dx).alias("max_lon"), (F.lit(y0) + (F.max("iy") + 1) * dy).alias("max_lat"),
        F.count("*").alias("cells_count"), F.sum("cnt_start").alias("count_start"), F.sum("cnt_end").alias("count_end"), F.sum("cnt").alias("count_total"),
    )


def by_popularity(pois: DataFrame) -> DataFrame:
    """The same ports numbered from the busiest."""
    order = Window.orderBy(F.desc("count_total"), F.col("poi_id"))
    return pois.withColumn("rank_id", (F.row_number().over(order) - 1).cast("int"))


def assign(tracks: DataFrame, labelled: DataFrame, grid: Grid = Grid(), cells: int | None = None, both: bool = True, min_points: int | None = None) -> DataFrame:
    """Start and end port of each voyage of enough fixes within the extent, -1 for none; both and different where ``both`` are required."""
    x0, x1, y0, y1 = grid.extent
    nx, ny = grid.bins
    rows = tracks if min_points is None else tracks.where(F.col("points_count") >= min_points)
    rows = rows.where(in_box("start_lat", "start_lon", grid.extent) & in_box("end_lat", "end_lon", grid.extent))
    table = labelled.select("iy", "ix", "poi_id")
    table = F.broadcast(table) if cells is not None and cells <= BROADCAST_CELLS else table
    for end in ("start", "end"):
        rows = rows.withColumns({f"{end}_iy": grid_cell(f"{end}_lat", y0, y1, ny), f"{end}_ix": grid_cell(f"{end}_lon", x0, x1, nx)})
        named = table.select(*(F.col(c).alias(f"{end}_{c}") for c in ("iy", "ix")), F.col("poi_id").alias(f"{end}_poi"))
        rows = rows.join(named, [f"{end}_iy", f"{end}_ix"], "left").withColumn(f"{end}_poi", F.coalesce(f"{end}_poi", F.lit(-1)))
    if both:
        rows = rows.where("start_poi >= 0 and end_poi >= 0 and start_poi <> end_poi")
    return rows.drop("start_iy", "start_ix", "end_iy", "end_ix")


def pair_counts(assigned: DataFrame) -> DataFrame:
    """How many voyages run between each pair of ports; a partial aggregate, however busy a pair is."""
    found = assigned.groupBy("start_poi", "end_poi").agg(F.count("*").alias("tracks_count"))
    return found.select(pair_key("start_poi", "end_poi").alias("pair"), "start_poi", "end_poi", "tracks_count")


def pair_tracks(assigned: DataFrame) -> DataFrame:
    """A row per voyage with its pair, in whose order of closing they are listed: what :func:`pairs` lists, at any size."""
    return assigned.select(pair_key("start_poi", "end_poi").alias("pair"), "start_poi", "end_poi", "track_ord", "track_id")


def pairs(assigned: DataFrame) -> DataFrame:
    """Voyages between each pair of ports, listed by their order of closing. A list is one value: for documents of one extract."""
    found = assigned.groupBy("start_poi", "end_poi").agg(F.count("*").alias("tracks_count"), F.array_sort(F.collect_list(F.struct("track_ord", "track_id"))).alias("_t"))
    return found.select(pair_key("start_poi", "end_poi").alias("pair"), "start_poi", "end_poi", "tracks_count", F.col("_t.track_id").alias("track_ids"))


def port_tracks(assigned: DataFrame) -> DataFrame:
    """A row for each end of a voyage at a port: ``port_end`` says whether it starts or ends there."""
    ends = F.array(*(F.struct(F.lit(end).alias("port_end"), F.col(f"{end}_poi").alias("poi_id")) for end in ("start", "end")))
    return assigned.select("track_id", "track_ord", F.explode(ends).alias("x")).select("x.poi_id", "x.port_end", "track_ord", "track_id").where("poi_id >= 0")


def last_destination(positions: DataFrame) -> DataFrame:
    """The destination of each voyage's latest fix; the first to arrive wins a tie."""
    return positions.groupBy("track_id").agg(F.max_by("destination", F.struct(F.col("timestamp"), -F.col("seq"))).alias("destination"))


def destinations(assigned: DataFrame, last: DataFrame, least: int = 3) -> DataFrame:
    """How many voyages that end in a port name each destination; short names don't count."""
    rows = assigned.select("track_id", "track_ord", "end_poi").join(last, "track_id").withColumn("name", normal_destination("destination"))
    return rows.where(F.length("name") >= least).groupBy("end_poi", "name").agg(F.count("*").alias("count"), F.min("track_ord").alias("first_ord"))


def top_destinations(counts: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent names of each port: telling ones first, then the others; ties by first seen."""
    order = Window.partitionBy("end_poi").orderBy(bad_destination("name"), F.desc("count"), "first_ord", "name")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


#: What makes a cell of starts and ends dense, as :func:`rasters.dense_cells` takes it, and the cells of a port at least.
DENSE, CELLS = ("percentile", 96.0), 3


def extract(tracks: DataFrame, positions: DataFrame, grid: Grid = Grid(), dense: tuple[str, float] = DENSE, cells: int = CELLS, min_points: int | None = None) -> dict[str, DataFrame]:
    """All tables of the port document: ``pois``, ``poi_pairs``, ``track_quality``, ``assigned`` and ``cells``."""
    heat = materialize(rasters.start_end_heatmap(tracks, grid.extent, grid.bins, min_points), "heat")
    full = rasters.dense_cells(heat, *dense)
    labelled = rasters.components(full, cells)
    assigned = materialize(assign(tracks, labelled, grid, min_points=min_points), "assigned")
    on_voyages = positions.join(assigned.select("track_id"), "track_id", "left_semi")
    named = top_destinations(destinations(assigned, last_destination(on_voyages)))
    listed = named.groupBy(F.col("end_poi").alias("poi_id")).agg(F.array_sort(F.collect_list(F.struct("place", "name", "count"))).alias("_n"))
    listed = listed.select("poi_id", F.transform("_n", lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("top_destinations"))
    pois = summarise(labelled, heat, grid.extent, grid.bins).join(listed, "poi_id", "left")
    return {"pois": pois, "poi_pairs": pairs(assigned), "track_quality": gap_metrics(on_voyages), "assigned": assigned, "cells": full.select("iy", "ix", "cnt", "threshold")}


def document(found: dict[str, DataFrame], source: str, grid: Grid = Grid(), dense: tuple[str, float] = DENSE, cells: int = CELLS) -> str:
    """The port document as JSON; it holds the ports and pairs of one extract, gathered on the driver. The qualities of voyages are a table, see :func:`write_document`."""
    pois = [r.asDict(recursive=True) for r in found["pois"].orderBy("poi_id").collect()]
    links = [r.asDict() for r in found["poi_pairs"].orderBy("start_poi", "end_poi").collect()]
    limit = found["cells"].agg(F.max("threshold")).first()[0]
    body = {
        "source_dataset": source, "extent": list(grid.extent), "bins": list(grid.bins),
        "threshold": {"mode": dense[0], "value": dense[1], "dense_thr": limit or 0.0, "min_cluster_cells": cells},
        "stats": {"pois_count": len(pois), "pairs_count": len(links), "tracks_count": sum(x["tracks_count"] for x in links)},
        "pois": [{k: v for k, v in p.items() if k not in ("min_lon", "min_lat", "max_lon", "max_lat")} | {"bbox": [p["min_lon"], p["min_lat"], p["max_lon"], p["max_lat"]], "top_destinations": p["top_destinations"] or []} for p in pois],
        "pairs": {x.pop("pair"): x for x in links},
    }
    return json.dumps(body, ensure_ascii=False)


def default_path(dataset: str) -> str:
    """Where a dataset's port document lies: beside it, by its name."""
    folder, _, name = dataset.rstrip("/").rpartition("/")
    return f"{folder}/{name.rpartition('.')[0] or name}_poi.json" if folder else f"{name.rpartition('.')[0] or name}_poi.json"


def write_document(found: dict[str, DataFrame], source: str, path: str | None = None, **made: object) -> str:
    """Write the document, with what it was ``made`` with, as one file and its qualities, a row per voyage, as a table beside it; gives the file's path."""
    path = path or default_path(source)
    spark = found["pois"].sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(document(found, source, **made).encode()))
    finally:
        out.close()
    found["track_quality"].write.mode("overwrite").parquet(path.removesuffix(".json") + "_quality")
    return path


def read_quality(spark, path: str) -> DataFrame:
    """The qualities beside a port document."""
    return spark.read.parquet(path.removesuffix(".json") + "_quality")


def document_track_ids(spark, path: str) -> DataFrame:
    """The voyages that a port document's pairs list."""
    schema = "pairs map<string,struct<start_poi:int,end_poi:int,tracks_count:bigint,track_ids:array<bigint>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode(F.map_values("pairs")).alias("p")).select(F.explode("p.track_ids").alias("track_id")).distinct()
