"""Orders of rows for training: a permutation by seed and epoch that each worker computes alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import running_total

#: Steps of the permutation; a prime above which numbers are folded, and a multiplier of its own.
STEPS, PRIME, MULTIPLIER = 48, 2_147_483_647, 48_271


def keys(seed: int, epoch: int, steps: int = STEPS) -> list[tuple[int, int, int]]:
    """What a seed and an epoch give each step: where it mirrors, and a factor and summand below the prime."""
    out = []
    for step in range(steps):
        raw = hashlib.sha256(f"{seed}:{epoch}:{step}".encode()).digest()
        out.append((int.from_bytes(raw[:7], "big"), 1 + int.from_bytes(raw[8:12], "big") % (PRIME - 1), int.from_bytes(raw[12:16], "big") % PRIME))
    return out


def _stepped(number: Column, n: int, steps: list[tuple[int, int, int]]) -> Column:
    """Each step pairs x with (mirror - x) mod n and swaps the two or not, by a bit that both give: so it is its own inverse, for any n."""
    table = F.array(*(F.struct(F.lit(m % n).cast("long").alias("mirror"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for m, a, b in steps))

    def step(x: Column, key: Column) -> Column:
        other = F.pmod(key["mirror"] - x, F.lit(n).cast("long"))
        mixed = F.pmod(F.pmod(F.greatest(x, other), F.lit(PRIME).cast("long")) * key["a"] + key["b"], F.lit(PRIME).cast("long"))
        return F.when(F.pmod(mixed * MULTIPLIER, F.lit(PRIME).cast("long")) >= 1 << 30, other).otherwise(x)

    return F.aggregate(table, number.cast("long"), step)


def place_of(number: Column, n: int, seed: int, epoch: int) -> Column:
    """Where row ``number`` of n (from 0) stands in an epoch: a bijection of 0 to n - 1, without a sort or a table."""
    return _stepped(number, n, keys(seed, epoch))


def number_at(place: Column, n: int, seed: int, epoch: int) -> Column:
    """The row at a place of an epoch: the steps backwards."""
    return _stepped(place, n, keys(seed, epoch)[::-1])


def numbered(rows: DataFrame, order: list[str], out: str = "number") -> DataFrame:
    """Rows with their number from 0 in an order, which should be unique; once for all epochs."""
    return running_total(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")


def epoch(rows: DataFrame, n: int, seed: int, number: int, shards: int = 1, batch: int = 32) -> DataFrame:
    """Numbered rows with their ``place`` in epoch ``number``, and the ``shard`` and ``batch`` of the worker that takes them.

    Shards are ranges of places whose sizes differ by one at most; a shard's
    batches count from 0. A map: nothing is shuffled or sorted.
    """
    if n <= 0:
        return rows.withColumns({c: F.lit(None).cast("long") for c in ("place", "shard", "batch")})
    placed = rows.withColumn("place", place_of(F.col("number"), n, seed, number))
    placed = placed.withColumn("shard", F.floor(F.col("place") * shards / n).cast("long"))
    # doubles may miss the shard by one at its ends
    begin = lambda s: F.expr(f"({s} * {n}L + {shards - 1}) div {shards}L")
    placed = placed.withColumn("shard", F.when(F.col("place") < begin("shard"), F.col("shard") - 1).when(F.col("place") >= begin("(shard + 1)"), F.col("shard") + 1).otherwise(F.col("shard")))
    return placed.withColumn("batch", F.floor((F.col("place") - begin("shard")) / batch).cast("long"))


def shard_numbers(spark: SparkSession, n: int, seed: int, number: int, shard: int, shards: int) -> DataFrame:
    """The rows (place, number) of one worker in an epoch, in its order, from the seed alone."""
    low, high = -(-shard * n // shards), -(-(shard + 1) * n // shards)
    return spark.range(low, high).select(F.col("id").alias("place"), number_at(F.col("id"), n, seed, number).alias("number")) if n else spark.range(0).select(F.col("id").alias("place"), F.col("id").alias("number"))


def place_sql(table: str, count: str, seed: int, epoch_number: int, carry: str) -> str:
    """The same places in SQL: ``table`` has ``number`` and the columns ``carry``, ``count`` is its number of rows."""
    out = f"(select {carry}, number, number x from {table})"
    for mirror, a, b in keys(seed, epoch_number):
        other = f"((({mirror} % ({count})) - x + ({count})) % ({count}))"
        out = f"(select {carry}, number, case when (((greatest(x, o) % {PRIME}) * {a} + {b}) % {PRIME}) * {MULTIPLIER} % {PRIME} >= 1073741824 then o else x end x from (select {carry}, number, x, {other} o from {out}))"
    return f"select {carry}, number, x place from {out}"
