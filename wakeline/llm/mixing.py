"""Operator 4: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import materialize, running_total
from .text import WORD, documents

#: How often a document may be taken, and so a source's words against its size.
REPEATS = 3
#: Rows of one source and epoch that are queued together, about.
QUEUE = 2_000


def weights(place: Column) -> Column:
    """1, 2, 3, repeating, by a source's place from 1."""
    return (place - 1) % 3 + 1


def targets(sources: DataFrame, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """Add ``target`` to rows (place, weight, source_size): the budget shared by weight, none above ``repeats`` sizes.

    Sources in order of their limit for a unit of weight fill up first; the
    first whose limit the level of what remains doesn't reach sets the level
    for itself and all after it. Sums before a source are running totals over
    ranges, so sources may be as many as hosts of the web.
    """
    known = sources.withColumn("_limit", F.lit(repeats).cast("double") * F.col("source_size") / F.col("weight"))
    known = known.withColumns({"_most": (repeats * F.col("source_size")).cast("long"), "weight": F.col("weight").cast("long")})
    for value, before in (("_most", "_full"), ("weight", "_ahead")):
        known = running_total(known, ["_limit", "place"], value, before)
    known = materialize(known, "limits")
    sums = known.agg(F.sum("source_size").alias("_every"), F.sum("weight").alias("_weights"))
    level = (F.lit(share) * F.col("_every") - F.col("_full")) / (F.col("_weights") - F.col("_ahead"))
    levels = known.join(F.broadcast(sums)).withColumn("_level", level).where("_level <= _limit")
    # one row, null where every source is full
    first = levels.agg(F.min(F.struct("_limit", "place", "_level"))["_level"].alias("_at"))
    target = F.least(F.col("_most").cast("double"), F.coalesce("_at", "_limit") * F.col("weight"))
    return known.join(F.broadcast(first)).withColumn("target", target).drop("_limit", "_full", "_ahead", "_most", "_at")


def mix(docs: DataFrame, share: float = 1.0, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every document, and ``copies``, how often it is taken.

    Each source's documents are shuffled by a hash for each epoch and get a
    virtual finish time, the source's words so far divided by its target; all
    are sorted by that time and taken until the budget is spent. A document
    counts by half in its own time, so that the last one of a source falls on
    the nearer side of the target. Running sums are by hash ranges of about
    ``QUEUE`` rows, so a large source is spread.

    Rows that share an id are one document with the sum of their sizes and the
    least of their sources. A text of any length is counted whole, as a row. A null text has size 0; documents of size 0 are
    taken as they come. A null source is a source, the last. Where no document
    has a word, targets are 0. An empty table gives no rows, and other columns
    are ignored, whatever their names.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))
    units = materialize(units.groupBy("doc_id").agg(F.sum("size").alias("size"), F.min("source").alias("source")), "units")
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = running_total(sources.withColumns({"_null": F.col("source").isNull(), "_one": F.lit(1).cast("long")}), ["_null", "source"], "_one", "place")
    sources = sources.withColumn("place", F.col("place") + 1).withColumn("weight", weights(F.col("place"))).drop("_null", "_one")
    sources = materialize(targets(sources, share, repeats), "sources")
    ranges = max(1, min(1 << 30, -(-int(sources.agg(F.max("n")).first()[0] or 0) // QUEUE)))

    rows = units.join(sources, units.source.eqNullSafe(sources.source)).select("doc_id", "size", "place", "source_size", "target")
    epochs = F.least(F.lit(repeats), F.greatest(F.lit(1), F.ceil(F.coalesce(F.try_divide("target", "source_size"), F.lit(1)))))
    queue = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs.cast("int") - 1)))
    queue = queue.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), "epoch", "doc_id").cast("binary")))
    queue = queue.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges, 32))
    sums = queue.groupBy("place", "epoch", "range").agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("place").orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("place", "epoch", "range", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    own = F.sum("size").over(Window.partitionBy("place", "epoch", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    queue = queue.withColumn("own", own).join(sums, ["place", "epoch", "range"])
    queue = queue.withColumn("finish", F.coalesce(F.try_divide(F.col("ahead") + F.col("own") - F.col("size") / 2, F.col("target")), F.lit(0.0)))

    budget = float(sources.agg(F.sum("target")).first()[0] or 0)
    served = running_total(queue.drop("ahead", "own", "range"), ["finish", "place", "epoch", "key", "doc_id"], "size", "before")
    fits = F.col("before") + F.col("size") / 2 <= budget
    return served.groupBy("doc_id", "size", "source_size", "target").agg(
        F.sum(F.when(fits, F.col("size")).otherwise(0)).alias("taken"), F.count_if(fits).alias("copies"), F.min(F.when(fits, F.col("finish"))).alias("finish")
    )


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
