"""Operator 3: token ids of whole texts in Parquet files for selective reads."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.materialize import scratch_root
from .encoding import encoder
from .text import documents

END = 2
#: Where a folder of token files keeps its table of files; readers of the folder pass over it.
PARTS = "_parts"
SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)
#: Small row groups and pages let a reader of a few documents skip by the page index;
#: ids stay in a dictionary of one page, metadata of format 2 falls to delta encoding.
FILE_OPTIONS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20), "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "compression": "zstd"}


def _encode(path: str, end: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for some, ids, ends in encoder(path, special).groups(batches, end):
            sizes = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), part, np.int32)), some.column("doc_id").cast(pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), lists], names=SCHEMA.names)
            start += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, out: str, path: str, end: int = END, special: bool = True) -> None:
    """Encode every whole text (null: empty), add ``end`` and write ids by ascending ``doc_id``.

    File k holds the k-th range of ids. A text is read once more for the range
    bounds, shuffled once and encoded after that. A folder ``_parts`` beside the
    files has, for each, its range of ids and the tokens before it, a row per
    file, so that a reader of a few documents need not add up all files.
    ``special=False`` reads the strings of special tokens as ordinary text.

    Rows with the same id, repeated rows among them, stand side by side by
    text; a null id comes first. Other columns are ignored, whatever their
    names. An empty table writes no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encode(path, end, special), SCHEMA).write.options(**FILE_OPTIONS).parquet(out)
    files = docs.sparkSession.read.schema(SCHEMA).parquet(out)
    parts = files.groupBy("part").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n_tokens").alias("tokens"))
    ahead = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts.withColumn("base", F.coalesce(ahead, F.lit(0))).coalesce(1).write.parquet(f"{out}/{PARTS}")


def read_token_files(spark: SparkSession, path: str, *wanted: int) -> DataFrame:
    """The files as a table; ``start`` is the sum of all tokens before a document.

    With ``wanted`` ids only those documents are read: the predicate reaches
    the files, whose row groups and pages are sorted by id, and ``start`` comes
    from the table of parts.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    if wanted:
        files = files.where(F.col("doc_id").isin(*wanted))
    parts = spark.read.schema("part int, base long").parquet(f"{path}/{PARTS}").select(F.col("part").alias("_part"), F.col("base").alias("_base"))
    found = files.join(F.broadcast(parts), F.col("part") == F.col("_part"))
    return found.withColumn("start", F.col("_base") + F.col("part_start")).drop("_part", "_base")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), np.uint32)).cast("B")
        ends = ids.offsets.to_numpy().astype(np.int64) * 4
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array((ends[1:] - ends[:-1]) // 4), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_token_files(documents(spark, sf_dir), out, public_tokenizers.path("byte_bpe_50k.json"))
    read = read_token_files(spark, out).select("doc_id", "start", "ids")
    return read.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
