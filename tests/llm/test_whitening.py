"""Operator 11 against numpy on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import whitening as W

KIND = "vec_id long, embedding array<float>, label int"
NAMES = {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


def expected(vectors):
    """By component and row: n, deviation, |whitened|, explained."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    values, columns = np.linalg.eigh(np.cov(x.T.astype(np.float64), bias=True).reshape(x.shape[1], -1))
    values, columns = values[::-1], columns[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    whitened = (x - sums / n) @ columns / np.sqrt(np.maximum(values, 1e-300))
    return n, deviation, whitened, values / values.sum()


def held(found, vectors, ids, most=8):
    rows = found.collect()
    assert dict(found.dtypes) == NAMES
    n, deviation, whitened, explained = expected(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == len(ids) * most
    sign = {c: 1 if by[ids[0], c].whitened * whitened[0, c - 1] >= 0 else -1 for c in range(1, most + 1)}
    for k, vec_id in enumerate(ids):
        for c in range(1, most + 1):
            r = by[vec_id, c]
            assert (r.n, r.deviation) == (n, deviation[k])
            assert r.whitened * sign[c] == pytest.approx(whitened[k, c - 1], abs=1e-7)
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert 0 <= r.identity_error < 1e-9
    z = np.array([[by[i, c].whitened for c in range(1, most + 1)] for i in ids])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(most)).max() == pytest.approx(rows[0].identity_error, abs=1e-11)


@pytest.mark.parametrize("pairs", [3000, 700])
def test_query_equals_numpy(spark, pairs, monkeypatch):
    monkeypatch.setattr(W, "PAIRS", pairs)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    held(W.op11_embedding_whitening(spark, "/root/testdata/sf0.001"), [r.embedding for r in rows], [r.vec_id for r in rows])


def drawn(n, size, seed=3):
    draw = np.random.default_rng(seed)
    return (draw.normal(size=(n, size)) @ draw.normal(size=(size, size)) * 3).astype(np.float32).tolist()


def test_unusable_vectors_go_and_names_may_clash(spark):
    good = drawn(60, 9)
    bad = [None, [], [None] * 9, [1.0] * 8 + [None], [1.0] * 8 + [float("nan")], [1.0] * 8 + [float("inf")], [float("-inf")] + [1.0] * 8, [1.0] * 4, [2.0] * 10]
    rows = [(k, v, 0) for k, v in enumerate(good + bad)]
    table = spark.createDataFrame(rows, KIND).repartition(5).withColumns({c: F.lit("z") for c in ("x", "y", "n", "deviation", "component", "d0", "w1", "whitened")})
    held(W.whiten(table), good, list(range(60)))


def test_repeats_count_and_null_ids_stay(spark):
    good = drawn(40, 8)
    rows = [(k, v, 0) for k, v in enumerate(good)]
    found = W.whiten(spark.createDataFrame([*rows, rows[0], rows[0], (None, good[1], 0)], KIND))
    first = [r for r in found.collect() if r.vec_id in (0, None)]
    n, deviation, whitened, _ = expected([*good, good[0], good[0], good[1]])
    assert len(first) == 32 and {r.n for r in first} == {n} == {43}
    assert {r.deviation for r in first if r.vec_id == 0} == {deviation[0]} and {r.deviation for r in first if r.vec_id is None} == {deviation[1]}
    assert sorted(round(abs(r.whitened), 7) for r in first if r.vec_id is None) == sorted(round(abs(w), 7) for w in whitened[1])


def test_few_dimensions_flat_axes_and_empty_tables(spark):
    # three dimensions, the third twice the first: two axes
    rows = [(k, [float(a), float(b), 2.0 * a], 0) for k, (a, b) in enumerate([(0, 1), (1, 5), (2, 0), (3, 3)])]
    found = W.whiten(spark.createDataFrame(rows, KIND))
    assert {(r.vec_id, r.component) for r in found.collect()} == {(k, c) for k in range(4) for c in (1, 2)}
    assert found.agg(F.max("identity_error")).first()[0] < 1e-9
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, KIND)).count() == 0
    empty = W.whiten(spark.createDataFrame([], KIND))
    assert empty.count() == 0 and dict(empty.dtypes) == NAMES


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(k, [1e9 * (-1) ** k, 1e7 * k], 0) for k in range(6)]
    found = W.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert len(found) == 12 and {r.deviation for r in found} == {None} and found[0].n == 6
