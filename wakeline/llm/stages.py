"""The operators as stages over the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import materialize
from . import language_id, mixing, near_dedup, packing, quality_rules
from .text import fresh

#: Below this many ids (16 bytes each) a list of ids is broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000
#: Near duplicates of a corpus share 80 % of their shingles; op1's limit of 85 % is its query's own.
NEAR_PERCENT = 80
#: A worker of the last stage has held the tables of those before it; its own is smaller than op9's.
KNOWN_PARTS = 250_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without boilerplate lines; see :func:`quality_rules.keep_good` for odd rows."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; see :func:`language_id.keep_known` for odd rows."""
    return language_id.keep_known(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least id, then of the least hash of its text.

    Of rows repeated with their id and text one stays, whichever. Texts
    without a word, null ones among them, and rows with a null id all stay.
    Columns stay as they are, whatever their names; an empty table gives none.
    """
    judged = materialize(near_dedup.near_duplicates(docs, NEAR_PERCENT).where("group is not null").select("doc_id", "text_hash", "group"), "judged")
    groups = judged.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1"), "groups")
    _id, _hash, key = fresh(docs.columns, "id", "hash", "key")
    here = judged.join(groups.select("group", "first"), "group").select(F.col("doc_id").alias(_id), F.col("text_hash").alias(_hash), (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays"))
    gone = materialize(here.where("not stays").select(_id, _hash).distinct(), "gone")
    again = materialize(here.where("stays").groupBy(_id, _hash).agg(F.count("*").alias("n")).where("n > 1").select(_id, _hash), "again")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = (F.col("doc_id").cast("long") == F.col(_id)) & (F.col(key) == F.col(_hash))
    left = keyed.join(listed(gone), same, "left_anti")
    if again.limit(1).count():
        twice = left.join(listed(again), same, "left_semi").dropDuplicates(["doc_id", key])
        left = left.join(listed(again), same, "left_anti").unionByName(twice)
    return left.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents that it doesn't take go.

    Rows that share an id are one document, all taken as often; so are repeated
    rows. Null and empty texts are as in :func:`mixing.mix`. Columns stay as
    they are, whatever their names; an empty table gives none.
    """
    _id, _copies, _copy = fresh(docs.columns, "id", "copies", "copy")
    taken = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias(_id), F.col("copies").cast("int").alias(_copies))
    taken = listed(materialize(taken, "taken"))
    copies = docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col(_id)))
    return copies.withColumn(_copy, F.explode(F.sequence(F.lit(1), F.col(_copies)))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in full sequences; see :func:`packing.pack` for odd rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), known=KNOWN_PARTS)


def digest(docs: DataFrame) -> tuple[int, int]:
    """Rows of a table and one number of their ids and texts, whatever their order: two runs that differ show in which stage."""
    one = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")), F.lit(1 << 32))
    found = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(one), F.lit(0)).alias("sum")).first()
    return found.n, found["sum"]


def listed(ids: DataFrame) -> DataFrame:
    """A written list of ids, broadcast if it is short."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
