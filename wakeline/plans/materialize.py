"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.

    A folder of this machine is taken only where the setting is absent and the
    master is local, as in tests; on a cluster without it this raises.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wakeline-")
        context.setCheckpointDir(base)
        base = f"file://{base}"
    root = f"{base.rstrip('/')}/wakeline-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later plans read the files, so a lost executor never repeats the work, and
    every reader prunes columns.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    for made in _made:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of tables written since each open :func:`materialize_alone` began.
_made: list[list[str]] = []


def materialize_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Write what ``make`` gives, then drop the tables that were written for it: a job of many steps keeps one step's tables at a time."""
    _made.append([])
    try:
        out = materialize(make(), label)
    finally:
        made = _made.pop()
    for path in made[:-1]:
        _delete(spark, path)
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a table that :func:`materialize` wrote."""
    spark = df.sparkSession
    own = f"/wakeline-{spark.sparkContext.applicationId}/"
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if own in name:
            _delete(spark, name)
