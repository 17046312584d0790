"""Operator 9: packing documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .encoding import encoder
from .text import documents

END, ROOM = 1, 4096
#: Up to so many rows (20 bytes each), a row per task and length, all tasks get what lies before each; beyond it pieces are shuffled, without their texts.
BROADCAST_PARTS = 1_000_000
PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, part_rank long"


def _cut(path: str, end: int, room: int, known: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), [x.split()[0] for x in PIECES.split(", ")]
        types, seen = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), np.zeros(room + 1, np.int64)
        for some, ids, ends in encoder(path, known=known).groups(batches, end):
            raw, begin, found = memoryview(ids).cast("B"), 0, []
            for doc_id, stop in zip(some.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                for piece, at in enumerate(range(begin, stop, room)):
                    n = min(room, stop - at)
                    found.append((part, doc_id, piece, piece * room, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), seen[n]))
                    seen[n] += 1
                begin = stop
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return run


def fullest(counts: np.ndarray, room: int, first: int) -> list[int]:
    """Lengths, ``first`` among them, that fill a bin of ``room`` as far as any choice can.

    Subset sums are bits of one integer: taking a length shifts it. Lengths are
    tried from the longest down and the search ends once the bin is exactly
    full; what each length added is kept, to walk back from the best sum.
    """
    left = room - first
    counts[first] -= 1
    sums, steps, mask, target = 1, [], (1 << (left + 1)) - 1, 1 << left
    for length in np.flatnonzero(counts[: left + 1])[::-1].tolist():
        for _ in range(min(int(counts[length]), left // length)):
            grown = sums | (sums << length) & mask
            if grown == sums:
                break
            steps.append((length, sums))
            sums = grown
        if sums & target:
            break
    counts[first] += 1
    at, chosen = sums.bit_length() - 1, [first]
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(length)
            at -= length
    return chosen


def plan_bins(histogram: np.ndarray, room: int) -> np.ndarray:
    """Rows (length, first rank, per bin, bins, first bin, offset) that place every rank of every length.

    A chosen combination is removed as often as its lengths last, so the work
    and the rows depend on the room, not on the number of documents: each row
    of choices leaves some length with too few pieces for one more such bin.
    """
    counts, taken, bins, rows = histogram.copy(), np.zeros(room + 1, np.int64), 0, []
    first = room
    while True:
        while first and not counts[first]:
            first -= 1
        if not first:
            break
        need: dict[int, int] = {}
        for length in fullest(counts, room, first):
            need[length] = need.get(length, 0) + 1
        times = min(int(counts[k]) // n for k, n in need.items())
        offset = 0
        for length, n in need.items():
            rows.append((length, taken[length], n, times, bins, offset))
            counts[length] -= n * times
            taken[length] += n * times
            offset += n * length
        bins += times
    return np.array(rows, np.int64).reshape(-1, 6)


def _place(plan_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of.value
        key = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            row = plan[np.searchsorted(key, length << 44 | rank, "right") - 1] if len(plan) else np.zeros((0, 6), np.int64)
            within = rank - row[:, 1]
            sequence, offset = row[:, 4] + within // np.maximum(row[:, 2], 1), row[:, 5] + within % np.maximum(row[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "piece", "start")), pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, end: int = END, room: int = ROOM, known: int | None = None) -> DataFrame:
    """Pieces of all documents (null text: empty) with their place in sequences of at most ``room`` tokens.

    Only documents above ``room`` are cut. Where a piece goes depends on its
    length alone, so the driver plans over the histogram of lengths (``room``
    numbers at any input size); ranks among equal lengths come from counts per
    task and length. The plan is broadcast: its rows are bounded by what
    :func:`plan_bins` says, not by the documents. Texts are never shuffled.
    Pieces of equal length are placed in the order in which they were read.
    Repeated rows and ids give pieces of their own; other columns are ignored,
    whatever their names; an empty table gives none. ``known`` bounds a
    worker's table of parts where other operators use its memory, too.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(rows.mapInArrow(_cut(path, end, room, known), PIECES), "pieces")
    parts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialize(parts.withColumn("base", F.coalesce(before, F.lit(0))), "lengths")
    histogram = np.zeros(room + 1, np.int64)
    for x in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[x.length] = x.n
    plan = plan_bins(histogram, room)
    plan = spark.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    bases = parts.select("part", "length", "base")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_PARTS else bases.hint("merge")
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("part_rank"))
    return ranked.mapInArrow(_place(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
