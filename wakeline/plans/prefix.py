"""Running totals over a global order, without a single-partition window."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .materialize import materialize


def _local_sums(value: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = np.asarray(batch.column(value).to_numpy(zero_copy_only=False), np.int64)
            upto = np.cumsum(sizes) + total
            before = upto - sizes
            total = int(upto[-1]) if len(upto) else total
            columns = [*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_before"])

    return run


def add_part_base(df: DataFrame, value: str, before: str, part: str, out: str) -> DataFrame:
    """Turn sums inside ordered parts into global ones; the part table has a row per task only."""
    totals = df.groupBy(part).agg(F.sum(value).alias("_total"))
    base = F.sum("_total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(F.col(part).alias("_p"), F.coalesce(base, F.lit(0)).alias("_base"))
    return df.join(F.broadcast(bases), F.col(part) == F.col("_p")).withColumn(out, (F.col("_base") + F.col(before)).cast("long")).drop("_p", "_base")


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of the long column ``value`` over all rows before this one in ``order``.

    One range shuffle; the sums of the parts, a row per task, are the only
    thing gathered. ``order`` should be unique, else ties fall as they may.
    Null values count as 0; an empty table gives an empty table.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType())])
    clean = df.withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast("long"))
    ordered = clean.repartitionByRange(*order).sortWithinPartitions(*order)
    schema[value].dataType = T.LongType()
    kept = materialize(ordered.mapInArrow(_local_sums(value), schema), "prefix")
    return add_part_base(kept, value, "_before", "_part", out).drop("_part", "_before")
