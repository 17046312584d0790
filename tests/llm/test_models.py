import zlib
from collections import Counter, defaultdict
from math import exp, log, log10

import numpy as np
import pyarrow as pa
import pytest

from wakeline.llm import language_id, lm_scoring, quality_knn
from wakeline.llm.text import words

SMALL = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def brute_scores(texts):
    """Add-one and interpolated modified Kneser-Ney scores by dictionaries."""
    tokens = {i: [*words(t), b""] for i, t in texts.items()}
    train = [w for i, w in tokens.items() if fold(i, 7) != 2]
    one, two = Counter(t for w in train for t in w), Counter(p for w in train for p in zip([None, *w[:-1]], w, strict=True))
    kinds, hist = Counter(b for _, b in two), defaultdict(Counter)
    for (a, _), n in two.items():
        hist[a]["all"] += n
        hist[a][min(n, 3)] += 1
    cut = lambda counts: [0.0, *lm_scoring.discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])]
    d2, d1 = cut(list(two.values())), cut(list(kinds.values()))
    n, v, pairs = sum(one.values()), len(one), len(two)
    spread = sum(d1[min(k, 3)] for k in kinds.values()) / pairs

    def p(a, b):
        low = max(kinds[b] - d1[min(kinds[b], 3)], 0) / pairs + spread / (v + 1)
        if a not in hist:
            return low
        h, c = hist[a], two[a, b]
        return max(c - d2[min(c, 3)], 0) / h["all"] + sum(d2[k] * h[k] for k in (1, 2, 3)) / h["all"] * low

    for a in list(hist)[:5]:  # probabilities after a history sum to 1, with one unknown word
        assert sum(p(a, b) for b in [*one, b"\0unknown"]) == pytest.approx(1)
    return {i: (len(w), sum(t in one for t in w), n, sum(log10((one[t] + 1) / (n + v + 1)) for t in w), sum(log10(p(a, b)) for a, b in zip([None, *w[:-1]], w, strict=True))) for i, w in tokens.items()}


@pytest.mark.parametrize("wide", [False, True])
def test_scores_equal_brute_force(spark, texts, monkeypatch, wide):
    """Also with keys as for more words than 32 bits can number."""
    if wide:
        monkeypatch.setattr(lm_scoring, "WIDE", 0)
    want = brute_scores(texts)
    rows = lm_scoring.op8_lm_scoring(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (fold(r.doc_id, 7) == 2)
        assert (r.base_score, r.score) == (pytest.approx(want[r.doc_id][3]), pytest.approx(want[r.doc_id][4]))


def test_many_shards_need_few_open_files(spark, texts, monkeypatch, tmp_path):
    """200 shards of 9 files each, scored alike, and looked up by a process that may open 64 files more."""
    import glob
    import os
    import resource

    want = {r.doc_id: r.score for r in lm_scoring.op8_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(lm_scoring, "LEAST_SHARDS", 200)
    monkeypatch.setattr(lm_scoring, "scratch_root", lambda _: f"file://{tmp_path}")
    got = {r.doc_id: r.score for r in lm_scoring.op8_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    [folder] = glob.glob(f"{tmp_path}/lm-*")
    sizes = [len(np.load(f)) if os.path.exists(f := f"{folder}/words-{s}.npy") else 0 for s in range(200)]
    monkeypatch.setattr(lm_scoring, "MAPPED", 16)
    model = lm_scoring.Arrays(folder, 200, [0, *np.cumsum(sizes)[:-1].tolist()])
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    open_now = len(os.listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (max(int(x) for x in os.listdir("/proc/self/fd")) + 64, before[1]))
    try:
        tokens = [lm_scoring.words(t) for t in texts.values()]
        ids = model.word_ids(tokens)
        counts, *_ = model.by_id(["counts", "kinds", "total", "one", "two", "more"], ids)
        assert len(os.listdir("/proc/self/fd")) <= open_now + 40
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)
    assert len(set(np.searchsorted(model.bases, ids[ids >= 0], "right"))) > 190 and (counts[ids >= 0] > 0).all()


def test_large_counts_are_kept_whole():
    keys, counts = np.array([3, 5, 1 << 63], np.uint64), np.array([1, 1 << 40, 7])
    blob = lm_scoring._pack(keys, counts, counts * 0)
    assert [c.tolist() for c in lm_scoring._unpack(blob, 2)] == [keys.tolist(), counts.tolist(), [0, 0, 0]]
    rows = [pa.record_batch([pa.array([0, 0], pa.int32()), pa.array([blob, blob], pa.binary())], names=["shard", "data"])]
    assert [c.tolist() for c in next(lm_scoring._by_shard(iter(rows), 2))[1]] == [keys.tolist(), (2 * counts).tolist(), [0, 0, 0]]


def test_scores_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in lm_scoring.score_documents(odd).collect()}
    assert len(got) == 12 and got[0].n_tokens == got[2].n_tokens == 1 and all(r.score < 0 for r in got.values())
    twice = lm_scoring.score_documents(odd.unionByName(odd)).collect()
    assert len(twice) == 24 and len({(r.doc_id, r.score) for r in twice}) == 12 and lm_scoring.score_documents(none).count() == 0


def brute_quality(texts, labels):
    """Cosines with all labelled vectors by a plain singular value decomposition, and a full sort."""
    known = sorted((i, y) for i, y in labels.items() if fold(i, 3) != 1 and i in texts)
    found = {i: quality_knn.term_counts(t) for i, t in texts.items()}
    holds = Counter(k for i, _ in known for k in found[i])
    terms = sorted(k for k, n in holds.items() if n >= 2)
    rows = lambda ids: np.array([[found[i].get(k, 0.0) * log(1 + len(known) / holds[k]) for k in terms] for i in ids])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.svd(rows([i for i, _ in known]), full_matrices=False)[2][: quality_knn.DIMENSIONS].T
    taught, out = unit(rows([i for i, _ in known]) @ axes), {}
    for i, vector in zip(texts, unit(rows(texts) @ axes), strict=True):
        near = sorted(((float(c), y) for c, (_, y) in zip(taught @ vector, known, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
        votes = [(max(c, 1e-6) ** 8, y) for c, y in near]
        out[i] = sum(v * y for v, y in votes) / sum(v for v, _ in votes)
    return out


def test_quality_equals_brute_force(spark, texts):
    labels = {i: int("!" in (t or "")) for i, t in texts.items() if i % 2}
    want = brute_quality(texts, labels)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_knn.score_quality(docs, spark.createDataFrame([*labels.items()] * 2, "doc_id long, quality int")).collect()}
    assert all(r.held_out == (fold(i, 3) == 1) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    assert sum(abs(got[i].score - want[i]) < 1e-3 for i in want) >= 0.98 * len(want) == 0.98 * len(got)


def test_axes_in_rounds_equal_exact_ones():
    """700 sparse rows with a falling spectrum: the same cosines from the exact axes and from those found in rounds."""
    draw = np.random.default_rng(5)
    topics = np.where(draw.random((60, 3000)) < 0.03, draw.random((60, 3000)), 0.0) * np.exp(-np.arange(60) / 12)[:, None]
    dense = np.where(draw.random((700, 60)) < 0.08, draw.random((700, 60)), 0.0) @ topics
    rows = quality_knn._Sparse([(np.flatnonzero(r).tolist(), r[r > 0].tolist()) for r in dense], np.ones(3000))
    assert np.allclose(rows.times(np.eye(3000)[:, :50]), dense[:, :50]) and np.allclose(rows.turned_times(dense[:, :40]), dense.T @ dense[:, :40])
    found, exact = quality_knn.axes_of(rows, 20), np.linalg.svd(dense, full_matrices=False)[2][:20].T
    assert np.abs(np.linalg.svd(found.T @ exact)[1] - 1).max() < 1e-3 and np.allclose(found.T @ found, np.eye(20), atol=1e-8)


def test_quality_on_held_out_rows(spark, odd, none):
    rows = quality_knn.op6_quality_classifier(spark, SMALL)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows.collect() if r.held_out and r.doc_id in labels]
    assert sum(p == y for _, p, y in held) / len(held) > 0.97
    up, down = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down)) > 0.97
    known = spark.createDataFrame([(3, 1), (8, 0), (5, None)], "doc_id long, quality int")
    got = quality_knn.score_quality(odd, known).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert {(r.doc_id, r.score) for r in quality_knn.score_quality(odd.unionByName(odd), known).collect()} and quality_knn.score_quality(odd.unionByName(odd), known).count() == 24
    assert {r.score for r in quality_knn.score_quality(odd, known.where("false")).collect()} == {0.5} and quality_knn.score_quality(none, known).count() == 0


def brute_languages(docs):
    """Mean log frequency of known words, else of known n-grams of the longest order, by dictionaries; docs: (id, text, lang)."""
    seen = defaultdict(Counter)
    letters = lambda t: ["".join(c for c in w.lower() if c.isalpha()) for w in (t or "").split()]
    grams = lambda w, k: [f" {w} "[i : i + k] for i in range(len(w) + 3 - k)] if k > 1 else list(w)
    for i, text, lang in docs:
        if lang and fold(i, 4) != 2:
            seen[lang, 0].update(w for w in letters(text) if w)
            for k in range(1, 6):
                seen[lang, k].update(g for w in letters(text) if w for g in grams(w, k))
    langs = sorted({lang for lang, _ in seen})
    every = [set().union(*(seen[g, k] for g in langs)) for k in range(6)]
    total = {(g, k): sum(seen[g, k].values()) + 0.5 * len(every[k]) + 1 for g in langs for k in range(6)}
    of = lambda x, g, k: log((seen[g, k][x] + 0.5) / total[g, k])
    out = {}
    for i, text, _ in docs:
        sums, n = [0.0] * len(langs), 0
        for w in filter(None, letters(text)):
            found = next(((k, some) for k in (0, 5, 4, 3, 2, 1) if (some := [x for x in (grams(w, k) if k else [w]) if x in every[k]])), None)
            if found:
                n += 1
                sums = [s + sum(of(x, g, found[0]) for x in found[1]) / len(found[1]) for s, g in zip(sums, langs, strict=True)]
        share = [exp((s - max(sums)) / max(1, n**0.5)) for s in sums]
        best = share.index(max(share))
        out[i] = (langs[best], share[best] / sum(share)) if any(c.isalpha() for c in text or "") else ("und", 0.0)
    return out


def test_languages_equal_brute_force(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    known = [tuple(r) for r in rows.collect()]
    known += [(-1, "12 !!", None), (-2, None, "en"), (-3, "qqzzqx " * 5, None)]
    want, docs = brute_languages(known), spark.createDataFrame(known, rows.schema)
    # scores are the same when the table of words starts anew all the time, and when languages are too many to broadcast
    for numbers, langs in ((language_id.NUMBERS, language_id.BROADCAST_LANGS), (40, 0)):
        monkeypatch.setattr(language_id, "NUMBERS", numbers)
        monkeypatch.setattr(language_id, "BROADCAST_LANGS", langs)
        for r in language_id.identify(docs).collect():
            assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-3)


def test_rare_languages_keep_their_words(spark):
    """A language of few rows beside a large one knows all its words, in one label or many."""
    docs = spark.createDataFrame([(k, " ".join(f"w{'abcdefghij'[j % 10] * (1 + j // 10)}{'abcdefghij'[k % 10]}" for j in range(60)), "big") for k in range(300)] + [(1000 + k, "saperlot zut flute", "rare") for k in range(3)], "doc_id long, text string, lang string")
    model = language_id.learn(docs, docs.doc_id.isNotNull())
    assert {"saperlot", "zut", "flute"} <= model.index[0].keys() and language_id.Scorer(model)(["zut", "saperlotte"])[0][0] == "rare"


def test_languages_on_held_out_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99
    got = {r.doc_id: r for r in language_id.identify(odd.unionByName(odd)).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, 10)) and got[5].lang_pred in ("en", "fr")
    assert language_id.identify(odd.unionByName(odd)).count() == 24 and language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", odd.lang.substr(9, 0))).collect()} <= {"", "und"}
    nothing = language_id.identify(odd.where("doc_id = 3").withColumn("lang", odd.source.substr(1, 0)).where("lang <> ''")).collect()
    assert nothing == []


def test_unseen_words_fall_back_to_ngrams(spark):
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate([("walking talking", "en"), ("gehen stehen", "de")] * 6)], "doc_id long, text string, lang string")
    model = language_id.learn(docs, docs.doc_id.isNotNull())
    score = language_id.Scorer(model)
    assert [x[0] for x in score(["stalking", "drehen", "123", "x" * 100 + "king"])] == ["en", "de", "und", "en"] and not any(len(t) > 64 for t in score.place)
    assert language_id.keep_known(docs.unionByName(spark.createDataFrame([(99, "123", None)], docs.schema)), 0.5).count() == 12
