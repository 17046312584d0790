import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import near_dedup as nd
from wakeline.llm.text import shingles


def brute(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_small_table_equals_brute_force(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(nd.near_duplicates(docs)) == brute(texts)


@pytest.mark.parametrize("block", [nd.BLOCK, 3])
def test_chains_and_edges(spark, monkeypatch, block):
    """Copies of copies link in a chain; similarities lie on both sides of the limit; groups fit a block, or take many."""
    monkeypatch.setattr(nd, "BLOCK", block)
    random.seed(2)
    base = [f"w{k}" for k in range(120)]
    texts = {0: " ".join(base), 1: " ".join(base).upper()}
    for k in range(2, 40):
        near = texts[random.randrange(k)].split()
        for _ in range(random.choice((1, 2, 3, 4))):
            near[random.randrange(len(near))] = f"x{random.random()}"
        texts[k] = " ".join(near)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(nd.near_duplicates(docs)) == brute(texts)


def test_large_group_in_blocks(spark, monkeypatch):
    """Blocks meet each other when a group is larger than one."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    random.seed(4)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for k in range(60):
        near = list(base)
        near[random.randrange(200)] = f"y{k}"
        texts[k] = " ".join(near)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(nd.near_duplicates(docs)) == brute(texts)


def test_sets_far_from_the_first_find_each_other_across_blocks(spark):
    """In one candidate group of many blocks: copies of the first, pairs apart from it, and sets alone."""
    random_ = np.random.default_rng(5)
    draw = lambda n: np.unique(random_.integers(0, 1 << 60, n).astype(np.uint64))
    base, rows, want = draw(100), [], {}
    for k in range(900):
        rows.append((0, k, np.unique(np.append(base, draw(2)))))
        want[k] = 0
    for k in range(900, 1500, 2):
        pair = draw(60)
        rows += [(0, k, pair), (0, k + 1, pair[1:])]
        want[k] = want[k + 1] = k
    rows += [(0, k, draw(50)) for k in range(1500, 1600)]
    sets = spark.createDataFrame([(c, r, len(rows), bytearray(f.tobytes())) for c, r, f in rows], "class long, rep long, n long, found binary")
    assert {r.node: r.component for r in nd.confirmed_links(sets, 85).collect()} == want


def test_odd_rows(odd, none):
    got = {(r.doc_id): (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(odd).collect()}
    assert got[0] == (0, 0, True) and got[2] == (0, 2, True) and got[4] == (1, 3, False) and got[None][1:] == (None, True) and len(got) == 12
    assert nd.near_duplicates(none).count() == 0


def test_repeated_rows(odd):
    twice = odd.unionByName(odd)
    assert nd.near_duplicates(twice).where("doc_id = 4 and component_id = 3").count() == 2


def test_estimates_are_close():
    random = np.random.default_rng(0)
    for share in (0.5, 0.85, 0.95):
        both = random.integers(0, 1 << 63, int(2000 * share)).astype(np.uint64)
        sides = [np.unique(np.concatenate([both, random.integers(0, 1 << 63, (2000 - len(both)) // 2).astype(np.uint64)])) for _ in range(2)]
        low = [nd.minima(s) & 15 for s in sides]
        estimate = ((low[0] == low[1]).mean() - 1 / 16) / (15 / 16)
        true = len(np.intersect1d(*sides)) / len(np.union1d(*sides))
        assert abs(estimate - true) < 0.17


def test_native_and_numpy_bit_counts_agree(spark):
    random = np.random.default_rng(1)
    a, b = (nd.packed(random.integers(0, 1 << 32, nd.PERMUTATIONS).astype(np.uint32)) for _ in range(2))
    rows = spark.createDataFrame([({n: int(v) for n, v in zip(nd.WORDS_OF_BITS, x, strict=True)},) for x in (a,)], "m map<string,bigint>").select(F.struct(*(F.col("m")[n].alias(n) for n in nd.WORDS_OF_BITS)).alias("x"))
    other = F.struct(*(F.lit(int(v)).alias(n) for n, v in zip(nd.WORDS_OF_BITS, b, strict=True)))
    got = rows.withColumn("y", other).select(nd.matches("x", "y")).first()[0]
    nibbles = lambda x: np.stack([x.view(np.uint64) >> np.uint64(4 * k) & np.uint64(15) for k in range(16)])
    assert got == int((nibbles(a) == nibbles(b)).sum())


def test_intersections():
    random = np.random.default_rng(3)
    sets = [np.unique(random.integers(0, 300, 100).astype(np.uint64)) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    apart = ~np.eye(12, dtype=bool)  # a set isn't compared with itself
    assert (nd.intersections(sets)[apart] == want[apart]).all()
    assert len(shingles(np.zeros(0, np.uint64))) == 0


def test_few_strays_in_a_bucket_cost_a_copy_of_it(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rows = [(1, k, 410, 0 if k < 400 else k) for k in range(410)] + [(2, k, 40, k % 2) for k in range(40)] + [(3, k, 50, 7) for k in range(50)]
    units = nd.units_apart(spark.createDataFrame(rows, "bucket long, rep long, n long, class long")).collect()
    # the bucket of one class is left out, and rows move a few times
    assert {u.bucket for u in units} == {1, 2} and sum(u.bucket == 1 for u in units) < 3 * 410
    met = {}
    for u in units:
        met.setdefault((u.bucket, u.i, u.j), []).append(u)
    pairs = {(u.bucket, frozenset((u.rep, v.rep))) for some in met.values() for u in some for v in some if u["class"] != v["class"]}
    want = {(b, frozenset((x, y))) for b, x, _, c in rows for d, y, _, e in rows if b == d and c != e}
    assert pairs == want
