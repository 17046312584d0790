"""Operator 13 against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from wakeline.llm import periodic_runs as P

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def brute(words, least=12):
    """Every maximal stretch of each period, kept with its least one."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            stop = start
            while stop + q < n and words[stop] == words[stop + q]:
                stop += 1
            if stop - start >= max(q, least - q):
                found.setdefault((start, stop + q), q)
            start = stop + 1
    return sorted((s, t - s, q) for (s, t), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def cases(seed):
    draw = random.Random(seed)
    for _ in range(250):
        n = draw.choice([0, 1, 5, 11, 12, 13, 40, 120, 300])
        words = [draw.choice("abcdefgh"[: draw.choice([1, 2, 3, 8])]) for _ in range(n)]
        for _ in range(draw.randint(0, 4)):
            # a stretch again, once or often, and at times with a word changed
            if words:
                at, size = draw.randrange(len(words)), draw.randint(1, 30)
                words[at:at] = words[at : at + size] * draw.randint(1, 6)
                if draw.random() < 0.5:
                    words[draw.randrange(len(words))] = "z"
        yield words
    yield list(fibonacci(500))
    yield ["w"] * 400
    yield list("ab" * 200 + "c" + "ab" * 200)
    yield [str(k % 7) for k in range(100)] + [str(k) for k in range(100)] * 3


@pytest.mark.parametrize("least", [12, 4])
def test_runs_equal_brute_force(least, monkeypatch):
    monkeypatch.setattr(P, "PAIRS", 700)
    texts = [[w.encode() for w in words] for words in cases(least)]
    for together in (1, 3_000, 10**6):
        monkeypatch.setattr(P, "TOGETHER", together)
        found = P.runs_of(texts, least)
        for words, runs in zip(texts, found, strict=True):
            assert [tuple(r) for r in runs.tolist()] == brute(words, least), b" ".join(words)


def test_longest_previous_factors_equal_brute_force():
    draw = random.Random(5)
    for _ in range(60):
        codes = np.array([draw.randrange(3) for _ in range(draw.randint(1, 60))] + [9])
        longest, source = P.Suffixes(codes).previous_factors()
        for i in range(len(codes)):
            lengths = [next((k for k in range(len(codes) - i) if codes[i + k] != codes[j + k]), len(codes) - i) for j in range(i)]
            assert longest[i] == max(lengths, default=0)
            assert longest[i] == 0 or lengths[source[i]] == longest[i]


def expected(doc_id, text):
    """The contract, word by word."""
    words, blank = [], True
    for byte in (text or "").encode():
        if byte in BLANKS:
            blank = True
        elif blank:
            words.append(bytes([byte]))
            blank = False
        else:
            words[-1] += bytes([byte])
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in dropped))


def checked(found, rows):
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in found.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, found.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_query_equals_brute_force(spark, texts):
    checked(P.op13_periodic_runs(spark, "/root/testdata/sf0.001"), list(texts.items()))


def test_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(P, "documents", lambda *_: odd.where("doc_id is null or doc_id <> 8"))
    checked(P.op13_periodic_runs(spark, ""), [(r.doc_id, r.text) for r in odd.where("doc_id is null or doc_id <> 8").collect()])
    monkeypatch.setattr(P, "documents", lambda *_: odd.where("doc_id = 8").union(odd.where("doc_id = 8")))
    twice = P.op13_periodic_runs(spark, "").collect()
    # 30,000 words that are one: a run with period 1, or with the edit the same
    assert [(r.n_runs, r.start, r.length, r.period) for r in twice] == [(1, 0, 30_000, 1)] * 2
    monkeypatch.setattr(P, "documents", lambda *_: none)
    assert P.op13_periodic_runs(spark, "").count() == 0


def test_long_text_is_searched_whole(spark):
    block = [str(k) for k in range(120_000)]
    text = " ".join(block * 2 + ["end"])
    row = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 240_000, 120_000)]
    assert row.collapsed == " ".join([*block, "end"])
