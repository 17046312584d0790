"""Stops of vessels and the time they weigh on a grid, as windows over the order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import StopConfig


def stops(positions: DataFrame, config: StopConfig = StopConfig()) -> DataFrame:
    """Runs of slow fixes without a long gap, with their seconds and mean place.

    Rows without progress in time are skipped. Time between fixes is clipped;
    the first slow fix brings the time since the one before it. One exchange by
    vessel serves both windows and the run's aggregate.
    """
    order = Window.partitionBy("ship_id").orderBy("seq")
    step = F.col("timestamp") - F.lag("timestamp").over(order)
    rows = positions.select("ship_id", "seq", "timestamp", "lat", "lon", "speed").withColumn("step", step).where("step is null or step > 0")
    gap = F.coalesce(F.col("step") > config.gap_sec, F.lit(False))
    rows = rows.withColumns({"gap": gap, "slow": F.col("speed") <= config.speed_max, "dt": F.when(F.col("step").isNull() | gap, 0).otherwise(F.least(F.col("step"), F.lit(config.clip_sec)))})
    cut = F.when(~F.col("slow") | F.col("gap"), 1).otherwise(0)
    rows = rows.withColumn("run", F.sum(cut).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("slow")
    found = rows.groupBy("ship_id", "run").agg(F.sum("dt").alias("stop_sec"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"))
    return found.where(F.col("stop_sec") >= config.min_sec)


def stop_heatmap(positions: DataFrame, config: StopConfig = StopConfig()) -> DataFrame:
    """Seconds of stops per cell (x, y), cells by truncation."""
    x0, x1, y0, y1 = config.extent
    nx, ny = config.bins
    x = ((F.col("lon") - x0) / (x1 - x0) * nx).cast("int")
    y = ((F.col("lat") - y0) / (y1 - y0) * ny).cast("int")
    cells = stops(positions, config).select(x.alias("x"), y.alias("y"), "stop_sec").where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))
    return cells.groupBy("x", "y").agg(F.sum("stop_sec").cast("long").alias("stop_sec"))
