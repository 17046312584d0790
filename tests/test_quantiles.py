"""Percentiles by selection against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.plans import percentile_columns, percentiles, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.501, 0.9, 0.99, 1.0]


def drawn(kind, n):
    draw = random.Random(kind)
    pick = {
        "metres": lambda: draw.random() * 1e5,
        "tail": lambda: draw.choice((1e-300, 1e-9, 1.0, 1e9, 1e300)) * draw.random() * draw.choice((1, -1)),
        "ties": lambda: float(draw.choice((3, 3, 3, 4, 90))),
        "widest": lambda: draw.choice((-1.7e308, 1.7e308, -0.0, 0.0, 5e-324)),
    }
    return [pick[kind]() for _ in range(n)]


@pytest.mark.parametrize("kind", ["metres", "tail", "ties", "widest"])
@pytest.mark.parametrize(("most", "bins"), [(100_000, 2048), (20, 16)])
def test_equal_to_numpy(spark, kind, most, bins, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", most)
    monkeypatch.setattr(quantiles, "BINS", bins)
    values = drawn(kind, 700)
    table = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double").repartition(3)
    found = {r.share: r.value for r in percentiles(table, "v", SHARES).collect()}
    ranked = sorted(values)
    for s in SHARES:
        place = s * (len(values) - 1)
        a, b = int(np.floor(place)), int(np.ceil(place))
        want = ranked[a] if a == b else (b - place) * ranked[a] + (place - a) * ranked[b]
        assert found[s] == pytest.approx(want, rel=1e-12, abs=0)


def test_groups_at_once(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 30)
    monkeypatch.setattr(quantiles, "BINS", 8)
    draw = random.Random(1)
    # one group has most rows, one is null, one has no values
    rows = [(draw.choice(["a"] * 8 + ["b", None]), draw.random() ** 5) for _ in range(1500)] + [("c", None), ("d", 2.5)]
    found = percentiles(spark.createDataFrame(rows, "g string, x double"), "x", [0.5, 0.9], ["g"])
    assert found.columns == ["g", "n", "share", "value"]
    got = {(r.g, r.share): (r.n, r.value) for r in found.collect()}
    for g in ("a", "b", None, "d"):
        mine = [x for k, x in rows if k == g and x is not None]
        for s in (0.5, 0.9):
            assert got.pop((g, s)) == (len(mine), pytest.approx(float(np.percentile(mine, 100 * s)), rel=1e-12))
    assert not got


def test_nothing_and_bad_shares(spark):
    none = spark.createDataFrame([], "x double")
    assert percentiles(none, "x", [0.5]).count() == 0
    assert percentile_columns(none, "x", {"p": 0.5}).collect()[0].p is None
    with pytest.raises(ValueError):
        percentiles(none, "x", [1.5])


def test_no_task_takes_all_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 50)
    table = spark.range(20_000).select((F.col("id") * 1.5).alias("x"))
    plain = quantiles._narrowed
    seen = []
    monkeypatch.setattr(quantiles, "_narrowed", lambda base, ranks: seen.append(ranks.count()) or plain(base, ranks))
    assert percentile_columns(table, "x", {"p": 0.5, "q": 0.99}).first() == (19_999 * 0.75, pytest.approx(19_999 * 1.5 * 0.99))
    assert 0 < len(seen) <= 2
