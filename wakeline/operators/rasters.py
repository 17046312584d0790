"""Sparse rasters: rows (iy, ix, count) instead of dense arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, edge_cell, in_box
from ..plans import connected_components, materialize, running_total


def density(points: DataFrame, extent, nx: int, ny: int) -> DataFrame:
    """Fixes per cell of a half-open box, bins of even width."""
    x0, x1, y0, y1 = extent
    inside = points.where(in_box("lat", "lon", extent, half_open=True))
    ix = F.floor((F.col("lon").cast("double") - x0) * (nx / (x1 - x0))).cast("int")
    iy = F.floor((F.col("lat").cast("double") - y0) * (ny / (y1 - y0))).cast("int")
    return inside.groupBy(F.least(iy, F.lit(ny - 1)).alias("iy"), F.least(ix, F.lit(nx - 1)).alias("ix")).agg(F.count("*").alias("cnt"))


def step_density(points: DataFrame, extent, step: float) -> DataFrame:
    """Fixes per cell of a fixed step in degrees."""
    x0, x1, y0, y1 = extent
    return density(points, extent, round((x1 - x0) / step), round((y1 - y0) / step))


def pyramid(points: DataFrame, extent, nx: int, ny: int, levels: int, time: str, span: int) -> DataFrame:
    """Rows (level, span_no, iy, ix, cnt): fixes per cell and tumbling range of ``span`` of ``time``, at each zoom level.

    Level 0 has the cells of :func:`density`; a cell of each level covers four
    of the one below. Fixes are read once, for level 0; each level is summed
    from the one below, which has a row per filled cell and range, so all
    levels together move little more than the first.
    """
    x0, x1, y0, y1 = extent
    inside = points.where(in_box("lat", "lon", extent, half_open=True) & F.col(time).isNotNull())
    iy, ix = (F.least(F.floor((F.col(v).cast("double") - low) * (n / (high - low))).cast("int"), F.lit(n - 1)) for v, low, high, n in (("lat", y0, y1, ny), ("lon", x0, x1, nx)))
    table = inside.groupBy(F.floor(F.col(time) / span).cast("long").alias("span_no"), iy.alias("iy"), ix.alias("ix")).agg(F.count("*").alias("cnt"))
    out = None
    for level in range(levels):
        if level:
            table = table.groupBy("span_no", F.shiftright("iy", 1).alias("iy"), F.shiftright("ix", 1).alias("ix")).agg(F.sum("cnt").alias("cnt"))
        table = materialize(table, "level")
        rows = table.select(F.lit(level).alias("level"), "span_no", "iy", "ix", "cnt")
        out = rows if out is None else out.unionByName(rows)
    return out


def metric_shape(extent, cell_m: float) -> tuple[int, int, float, float]:
    """Columns, rows and degrees per cell of a grid of metres, scaled at the middle latitude."""
    import math

    x0, x1, y0, y1 = extent
    d_lat, d_lon = cell_m / METRES_PER_DEGREE, cell_m / max(1e-6, METRES_PER_DEGREE * math.cos(math.radians((y0 + y1) / 2)))
    return max(1, math.ceil((x1 - x0) / d_lon)), max(1, math.ceil((y1 - y0) / d_lat)), d_lon, d_lat


def metric_density(points: DataFrame, extent, cell_m: float, most: int | None = None) -> DataFrame:
    """Fixes per cell of ``cell_m`` metres in a closed box; ``most`` caps the fixes only where it is given."""
    nx, ny, d_lon, d_lat = metric_shape(extent, cell_m)
    x0, _, y0, _ = extent
    inside = points.where(in_box("lat", "lon", extent))
    inside = inside.limit(most) if most else inside
    held = lambda v, low, step, n: F.greatest(F.lit(0), F.least(F.floor((F.col(v).cast("double") - low) / step).cast("int"), F.lit(n - 1)))
    return inside.groupBy(held("lat", y0, d_lat, ny).alias("iy"), held("lon", x0, d_lon, nx).alias("ix")).agg(F.count("*").alias("cnt"))


def start_end_heatmap(tracks: DataFrame, extent, bins, min_points: int | None = None) -> DataFrame:
    """Voyages that start, that end, and both together, per cell."""
    x0, x1, y0, y1 = extent
    nx, ny = bins
    rows = tracks if min_points is None else tracks.where(F.col("points_count") >= min_points)
    end = lambda name, s, e: F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.col(f"{name}_lat").alias("lat"), F.col(f"{name}_lon").alias("lon"))
    ends = rows.select(F.explode(F.array(end("start", 1, 0), end("end", 0, 1))).alias("p")).select("p.*")
    ends = ends.where(in_box("lat", "lon", extent))
    return ends.groupBy(edge_cell("lat", y0, y1, ny).alias("iy"), edge_cell("lon", x0, x1, nx).alias("ix")).agg(F.sum("s").alias("cnt_start"), F.sum("e").alias("cnt_end"), F.count("*").alias("cnt"))


def dense_cells(cells: DataFrame, mode: str = "percentile", value: float = 96.0) -> DataFrame:
    """Cells at or above an exact percentile of the non-empty ones, or above a number; adds ``threshold``."""
    if mode == "percentile":
        limit = cells.where("cnt > 0").agg(F.percentile("cnt", value / 100).alias("threshold"))
    elif mode == "absolute":
        if value <= 0:
            raise ValueError("a threshold of 0 or less would take empty cells, which a sparse raster has not")
        limit = cells.sparkSession.range(1).select(F.lit(float(value)).alias("threshold"))
    else:
        raise ValueError("mode is percentile or absolute")
    return cells.join(F.broadcast(limit)).where(F.col("cnt") >= F.col("threshold"))


def log_scaled(cells: DataFrame) -> DataFrame:
    """log(1 + count) over its greatest value."""
    most = cells.agg(F.max(F.log1p("cnt")).alias("_most"))
    return cells.join(F.broadcast(most)).withColumn("value", F.when(F.col("_most") > 0, F.log1p("cnt") / F.col("_most")).otherwise(0.0)).drop("_most")


def display_scaled(cells: DataFrame, share: float = 0.98) -> DataFrame:
    """Counts over their percentile of a share, held at 1: what a picture shows without being drowned by the busiest cells."""
    top = cells.agg(F.percentile("cnt", share).cast("double").alias("_top"))
    return cells.join(F.broadcast(top)).withColumn("shade", F.when(F.col("_top") > 0, F.least(F.lit(1.0), F.col("cnt") / F.col("_top"))).otherwise(0.0)).drop("_top")


def crop(cells: DataFrame, geo, shape, window) -> DataFrame:
    """Cells of a window (min lon, max lon, min lat, max lat), numbered from its corner; empty where they don't meet."""
    import math

    x0, y0, d_lon, d_lat = geo
    ny, nx = shape
    a, b = max(0, math.floor((window[0] - x0) / d_lon)), min(nx, math.ceil((window[1] - x0) / d_lon))
    c, d = max(0, math.floor((window[2] - y0) / d_lat)), min(ny, math.ceil((window[3] - y0) / d_lat))
    inside = cells.where((F.col("ix") >= a) & (F.col("ix") < b) & (F.col("iy") >= c) & (F.col("iy") < d))
    return inside.withColumns({"ix": F.col("ix") - a, "iy": F.col("iy") - c})


def resample(cells: DataFrame, geo, shape, window, size, mode: str = "nearest") -> DataFrame:
    """A grid of ``size`` (rows, columns) over a window: the nearest source cell, or four weighted ones.

    Places are taken at cell corners and halves round to even. Targets are a
    grid of a window, small and of known size; the raster is joined to it.
    """
    spark = cells.sparkSession
    (x0, y0, d_lon, d_lat), (ny, nx), (h, w) = geo, shape, size
    rows = spark.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("ty"), (F.col("id") % w).cast("int").alias("tx"))
    lon = F.lit(window[0]) + (F.col("tx") + 0.5) * ((window[1] - window[0]) / w)
    lat = F.lit(window[2]) + (F.col("ty") + 0.5) * ((window[3] - window[2]) / h)
    fx = F.greatest(F.lit(0.0), F.least((lon - x0) / d_lon, F.lit(float(nx - 1))))
    fy = F.greatest(F.lit(0.0), F.least((lat - y0) / d_lat, F.lit(float(ny - 1))))
    rows = rows.withColumns({"fx": fx, "fy": fy})
    if mode == "nearest":
        rows = rows.withColumn("near", F.array(F.struct(F.rint("fy").cast("int").alias("iy"), F.rint("fx").cast("int").alias("ix"), F.lit(1.0).alias("weight"))))
    elif mode == "bilinear":
        wx, wy = F.col("fx") - F.floor("fx"), F.col("fy") - F.floor("fy")
        near = []
        for dy, a in ((0, 1 - wy), (1, wy)):
            for dx, b in ((0, 1 - wx), (1, wx)):
                near.append(F.struct(F.least(F.floor("fy") + dy, F.lit(ny - 1)).cast("int").alias("iy"), F.least(F.floor("fx") + dx, F.lit(nx - 1)).cast("int").alias("ix"), (a * b).alias("weight")))
        rows = rows.withColumn("near", F.array(*near))
    else:
        raise ValueError("mode is nearest or bilinear")
    parts = rows.select("ty", "tx", F.explode("near").alias("n")).select("ty", "tx", "n.*")
    return parts.join(cells.select("iy", "ix", "cnt"), ["iy", "ix"], "left").groupBy("ty", "tx").agg(F.sum(F.col("weight") * F.coalesce("cnt", F.lit(0))).alias("value"))


#: Cells a side of a tile: what one group of rows holds at most is its square, whatever the grid.
TILE = 512
#: The neighbours that come later in row order; each pair of neighbours is met once.
LATER = ((0, 1), (1, -1), (1, 0), (1, 1))


def _label_tile(frame: pd.DataFrame) -> pd.DataFrame:
    """Cells of a tile with the first cell, in row order, of their component within it."""
    cell = np.sort((frame["iy"].to_numpy(np.int64) << 31) + frame["ix"].to_numpy(np.int64))
    cell = cell[np.append(True, cell[1:] != cell[:-1])]
    a, b = [], []
    for dy, dx in LATER:
        other = cell + (dy << 31) + dx
        at = np.minimum(np.searchsorted(cell, other), len(cell) - 1)
        met = np.flatnonzero(cell[at] == other)
        a.append(met)
        b.append(at[met])
    a, b, label = np.concatenate(a), np.concatenate(b), np.arange(len(cell))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, label[end], least)
        while ((up := label[label]) != label).any():
            label = up
    return pd.DataFrame({"iy": cell >> 31, "ix": cell & (1 << 31) - 1, "part": cell[label]})


def components(cells: DataFrame, min_cells: int = 3, tile: int = TILE) -> DataFrame:
    """8-neighbour components of cells, of a least size, numbered by their first cell in row order from 0.

    Tiles are labelled in parallel, each in one group of at most ``tile``
    squared cells. Only cells on the borders of tiles then meet those across,
    and the graph of tiles' components is joined up in rounds that grow with
    the logarithm of the tiles that a component crosses. Cells with an index
    below 0 are refused.
    """
    at = lambda c: F.when(F.col(c) >= 0, F.col(c).cast("long")).otherwise(F.raise_error(F.lit("a cell before the grid")).cast("long"))
    rows = cells.select(at("iy").alias("iy"), at("ix").alias("ix"))
    in_tile = [F.floor(F.col(c) / tile).alias(f"t{c}") for c in ("iy", "ix")]
    parts = materialize(rows.groupBy(*in_tile).applyInPandas(_label_tile, "iy int, ix int, part long"), "parts")
    edge = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    border = parts.where(edge("iy") | edge("ix"))
    near = F.explode(F.array(*(F.struct((F.col("iy") + dy).alias("y"), (F.col("ix") + dx).alias("x")) for dy, dx in LATER)))
    across = border.select("iy", "ix", "part", near.alias("n")).where((F.floor(F.col("n.y") / tile) != F.floor(F.col("iy") / tile)) | (F.floor(F.col("n.x") / tile) != F.floor(F.col("ix") / tile)))
    others = border.select(F.col("iy").alias("y"), F.col("ix").alias("x"), F.col("part").alias("other"))
    links = materialize(across.select("part", "n.*").join(others, ["y", "x"]).select("part", "other").distinct(), "links")
    whole = parts.withColumnRenamed("part", "component")
    if links.limit(1).count():
        joined = connected_components(links, "part", "other")
        whole = parts.join(joined, parts.part == joined.node, "left").select("iy", "ix", F.coalesce("component", "part").alias("component"))
    kept = whole.groupBy("component").agg(F.count("*").alias("cells_count")).where(F.col("cells_count") >= min_cells)
    # a row per component, ordered by its first cell
    kept = running_total(kept.withColumn("_one", F.lit(1).cast("long")), ["component"], "_one", "poi_id").withColumn("poi_id", F.col("poi_id").cast("int"))
    return whole.join(kept, "component").select("iy", "ix", "poi_id", "cells_count")


def degrees(cells: DataFrame) -> DataFrame:
    """How many of the eight neighbours of each cell are set, of those that have any; eight keys per cell, no range join."""
    around = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    near = cells.select("iy", "ix", F.explode(around).alias("d")).select("iy", "ix", (F.col("iy") + F.col("d.dy")).alias("ny"), (F.col("ix") + F.col("d.dx")).alias("nx"))
    set_ = cells.select(F.col("iy").alias("ny"), F.col("ix").alias("nx"))
    return near.join(set_, ["ny", "nx"], "left_semi").groupBy("iy", "ix").agg(F.count("*").alias("degree"))
