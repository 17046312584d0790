"""Orders of epochs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from wakeline.operators import epochs, rasters


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_places_are_a_permutation_and_workers_find_their_rows(spark, n):
    rows = spark.range(n).select(F.col("id").alias("number"), F.lit("z").alias("mirror"))
    found = epochs.epoch(rows, n, 5, 2, shards=3, batch=10).collect()
    place = {r.number: r.place for r in found}
    assert sorted(place.values()) == list(range(n))
    sizes = Counter(r.shard for r in found)
    assert sum(sizes.values()) == n and (n < 3 or max(sizes.values()) - min(sizes.values()) <= 1) and set(sizes) <= {0, 1, 2}
    for shard in range(3):
        alone = {r.number: r.place for r in epochs.shard_numbers(spark, n, 5, 2, shard, 3).collect()}
        assert alone == {r.number: r.place for r in found if r.shard == shard}
        batches = Counter(r.batch for r in found if r.shard == shard)
        assert all(batches[b] == 10 for b in range(len(batches) - 1))


def test_epochs_and_seeds_differ_and_look_random(spark):
    rows = spark.range(3000).select(F.col("id").alias("number"))
    orders = [tuple(r.place for r in epochs.epoch(rows, 3000, *key).orderBy("number").collect()) for key in ((1, 0), (1, 1), (2, 0), (1, 0))]
    assert orders[0] == orders[3] and len(set(orders)) == 3
    for order in orders[:3]:
        # neighbours don't stay neighbours, and a tenth of rows falls into each tenth of places about evenly
        assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:], strict=False)) < 12
        tenths = Counter((k // 300, p // 300) for k, p in enumerate(order))
        assert len(tenths) == 100 and max(tenths.values()) < 60 and min(tenths.values()) > 8
    assert sum(a == b for a, b in zip(orders[0], orders[1], strict=True)) < 12


def test_no_rows(spark):
    rows = spark.range(0).select(F.col("id").alias("number"))
    assert epochs.epoch(rows, 0, 1, 0).count() == 0 == epochs.shard_numbers(spark, 0, 1, 0, 0, 1).count()


def test_pyramid_levels_sum_up(spark):
    rows = spark.createDataFrame([(0.1, 0.1, 5), (0.9, 0.9, 5), (3.99, 3.99, 5), (0.1, 0.1, 12), (4.0, 1.0, 5), (None, 1.0, 5), (1.0, 1.0, None)], "lat double, lon double, t long")
    found = {tuple(r) for r in rasters.pyramid(rows, (0.0, 4.0, 0.0, 4.0), 4, 4, 3, "t", 10).collect()}
    assert found == {(0, 0, 0, 0, 2), (0, 0, 3, 3, 1), (0, 1, 0, 0, 1), (1, 0, 0, 0, 2), (1, 0, 1, 1, 1), (1, 1, 0, 0, 1), (2, 0, 0, 0, 3), (2, 1, 0, 0, 1)}
