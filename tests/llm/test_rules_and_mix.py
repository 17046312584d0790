import hashlib
import os
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import fingerprints as fp
from wakeline.llm import mixing, quality_rules


def of(text):
    return fp.Fingerprint(fp.PrefixHashes(fp._codes(text)))


def test_fingerprints_equal_brute_force(spark, odd, none, texts):
    rows = fp.op5_fingerprints(spark, "/root/testdata/sf0.001").collect()
    ids = sorted(texts)
    seen = {}
    for r in rows:
        text, after = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.start_edited, r.start_next) == (len(os.path.commonprefix([text, edited])), len(os.path.commonprefix([text, after])))
        assert r.fingerprint == of(text).text() and r.edited_fingerprint == of(edited).text()
        # likeness is had from the two strings alone, and is near the share that both texts have
        assert r.near_edited == fp.likeness(fp.Fingerprint.read(r.fingerprint), fp.Fingerprint.read(r.edited_fingerprint))
        assert r.near_next == fp.likeness(of(text), of(after))
        assert abs(r.near_edited - (brute_likeness(text, edited) if len(text) <= 1500 else 0.75)) < 0.15 or len(text) > 1500 and r.near_edited > 0.75
        assert seen.setdefault(r.fingerprint, text) == text and (r.fingerprint == r.edited_fingerprint) == (text == edited)
    assert len(rows) == len(ids)
    got = {r.doc_id: r for r in fp.fingerprints(odd).collect()}
    assert len(got) == 12 and got[3].fingerprint == got[4].fingerprint and got[5].n_chars == 12 and got[0].n_chars == 0
    assert fp.fingerprints(none).count() == 0 and fp.fingerprints(odd.where("doc_id = 3")).first().near_next == 1.0
    assert fp.fingerprints(odd.unionByName(odd)).count() == 24


def brute_likeness(a, b):
    """Share of the longer text in common runs of 12 or more, longest first (each place once)."""
    if a == b:
        return 1.0
    found = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    start, end = len(os.path.commonprefix([a, b])), len(os.path.commonprefix([a[::-1], b[::-1]]))
    every = [(m.a, m.a + m.size) for m in found if m.size >= 12] + [(0, start), (len(a) - end, len(a))]
    return min(1.0, len({k for x, y in every for k in range(x, y)}) / max(len(a), len(b), 1))


def test_edits_anywhere_cost_what_they_touch():
    random.seed(12)
    for n in (40, 300, 3000, 60_000):
        words = ["".join(random.choice("abcdefghij") for _ in range(random.randrange(2, 9))) for _ in range(n)]
        whole = " ".join(words)
        for places in ((0,), (n // 2,), (n - 1,), (1, n - 2), (0, n // 3, n - 1)):
            changed = list(words)
            for k in places:
                changed[k] = "ELSE" if k % 2 else "one more"
            # an edit costs at most a span of some twelfths of a short text, and next to nothing of a long one
            assert fp.likeness(of(whole), of(" ".join(changed))) > (1 - 0.13 * len(places) - 0.02 if n < 3000 else 0.93)
        random.shuffle(words)
        assert fp.likeness(of(whole), of(" ".join(words))) < 0.1
    assert fp.likeness(of("word " * 30_000), of("word " * 20_000 + "x" * 50_000)) > 0.6
    assert len(of("a b c " * 500_000).text()) < 1500 and len(of(whole).text()) < 5000 and fp.likeness(of(""), of("a")) == 0.0 and fp.likeness(of(""), of("")) == 1.0


@pytest.mark.parametrize("n", [20, 200, 2_000, 20_000, 100_000])
def test_likeness_follows_the_share_of_equal_text_at_all_lengths(n):
    """Words changed anywhere: against the share of text in unchanged spans, and far above what unrelated texts have."""
    draw = random.Random(n)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(n)]
    whole = " ".join(words)
    for every in (10**9, 500, 200, 40, 10):
        changed = [f"Z{k}" if k % every == every // 2 else w for k, w in enumerate(words)]
        got = fp.likeness(of(whole), of(" ".join(changed)))
        # a place is told if its span, of 32 code points on average, and the window behind it hold no edit
        length = np.arange(0, 2_000, 0.5)
        apart = len(whole) / max(1, sum(k % every == every // 2 for k in range(n)))
        want = float((np.maximum(0, 1 - (length + 13) / apart) * length * np.exp(-length / 32)).sum() / (length * np.exp(-length / 32)).sum()) if every < 10**9 else 1.0
        if n >= 2_000:
            assert abs(got - want) < 0.1, (every, got, want)
        if every >= 200 and n >= 2_000:
            assert got > 0.8
        assert got == fp.likeness(fp.Fingerprint.read(of(whole).text()), fp.Fingerprint.read(of(" ".join(changed)).text()))
        assert 0 <= got <= 1
    cut = of(whole[: len(whole) * 3 // 4] + "".join(draw.choice("klmnop ") for _ in range(len(whole) // 4)))
    assert abs(fp.likeness(of(whole), cut) - 0.75) < 0.1
    moved = of("PUT BEFORE " + whole[len(whole) // 2 :] + " " + whole[: len(whole) // 2])
    assert n < 200 or fp.likeness(of(whole), moved) > 0.8
    # a long text and the first tenth of it
    assert n < 2_000 or abs(fp.likeness(of(whole), of(whole[: len(whole) // 10])) - 0.1) < 0.05


def test_places_among_cuts(spark):
    import bisect

    random.seed(9)
    rows = spark.range(-5, 130).select(F.col("id").alias("at"))
    for n in (0, 1, 2, 5, 50):
        cuts = sorted(random.sample(range(120), n))
        got = rows.select("at", fp.place_among(F.col("at"), cuts).alias("p")).collect()
        assert [r.p for r in got] == [bisect.bisect_right(cuts, r["at"]) for r in got]


def test_spans_and_extensions():
    random.seed(1)
    for _ in range(100):
        a, b = ("".join(random.choice("ab") for _ in range(random.randrange(1, 40))) for _ in range(2))
        x, y = fp.PrefixHashes(fp._codes(a)), fp.PrefixHashes(fp._codes(b))
        i, j = random.randrange(len(a)), random.randrange(len(b))
        assert x.common(i, y, j) == len(os.path.commonprefix([a[i:], b[j:]]))
        assert x.common(i, y, j, back=True) == len(os.path.commonprefix([a[:i][::-1], b[:j][::-1]]))


def measured(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    marks = [0] * len(w)
    for k in range(len(w) - 7):
        if c[tuple(w[k : k + 8])] > 1:
            marks[k : k + 8] = [1] * 8
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, sum(marks)


def test_measures_equal_brute_force(odd, none, texts):
    for text in [*texts.values(), *(r.text for r in odd.collect())]:
        assert quality_rules.measure(text)[:5] == measured(text)
    got = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    assert len(got) == 12 and got[0].base_failed and not got[0].kept and got[8].base_failed
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0


def test_lines_of_many_documents_go_but_copies_stay(spark):
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    line = "All of this SITE is ours"
    rows = [(k, f"{line}\n{words(k, 40)}\n{words(k + 1000, 40)}", "h") for k in range(15)]
    rows += [(100 + k, f"{line}\n{line.upper()}\n{' '.join([line] * 4)}\nx y", "h") for k in range(12)]
    rows += [(200 + k, f"{words(7777, 60)}\n{words(8888, 60)}", "h") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert all(got[k].kept and len(got[k].removed) == 1 for k in range(15)) and all(got[200 + k].kept and not got[200 + k].removed for k in range(40))
    out = {r.doc_id: r for r in quality_rules.keep_good(docs).collect()}
    assert all(line not in out[k].text and out[k].n_chars == len(out[k].text) for k in range(15)) and out[200].text == rows[27][1]
    assert out.keys() == {k for k, r in got.items() if r.kept}


def test_documents_of_a_line_are_counted_apart_whatever_its_hash(spark):
    """300 documents share a line and differ in the others: it goes from all, be its key the least or the greatest of the host's."""
    words = lambda k: " ".join(f"d{k}n{i}" for i in range(30))
    key = lambda line: quality_rules.line_key(b"h", line.encode().split())
    tried = sorted((f"header number {k} of this host" for k in range(2000)), key=key)
    for line in (tried[0], tried[-1]):
        rows = [(k, f"{line}\n{words(k)}", "h") for k in range(300)] + [(1000 + k, f"{tried[1]}\n{words(k)}".upper(), "g") for k in [7] * 12]
        got = {r.doc_id: r.removed for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert all(got[k] == [key(line)] for k in range(300)) and got[1007] is None


def test_both_ways_of_cleaning_agree(spark, odd, none, monkeypatch):
    """Lines known to all workers, or verdicts that are joined; with columns that bear the names used inside."""
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(k % 50, f"one line of all\n{words(k % 60, 40)}\nEND of page", "h", k) for k in range(90)] + [(None, f"one line of all\n{words(3, 30)}", "h", 1), (5, None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("_id", "id", "host", "kept", "_kept", "removed", "_removed", "text_hash", "Of", "at", "lines", "digest")})
    few = [sorted(map(str, quality_rules.keep_good(d).collect())) for d in (docs, odd, none)]
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", 0)
    many = [sorted(map(str, quality_rules.keep_good(d).collect())) for d in (docs, odd, none)]
    assert few == many and len(few[0]) == 91 and "one line of all" not in "".join(few[0]) and few[1] == few[2] == []
    assert quality_rules.keep_good(docs.drop("n_chars")).count() == 91


def brute_targets(sizes, weights, repeats=3):
    left, open_, out = float(sum(sizes)), set(range(len(sizes))), {}
    while open_:
        level = left / sum(weights[k] for k in open_)
        over = {k for k in open_ if level * weights[k] > repeats * sizes[k]}
        if not over:
            return [out.get(k, level * weights[k]) for k in range(len(sizes))]
        for k in over:
            out[k] = float(repeats * sizes[k])
            left -= out[k]
        open_ -= over
    return [out[k] for k in range(len(sizes))]


def test_targets_are_shared_and_capped(spark):
    random.seed(3)
    for _ in range(4):
        sizes = [random.choice((0, 1, 10, 1000)) for _ in range(7)]
        rows = spark.createDataFrame([(k + 1, k % 3 + 1, s) for k, s in enumerate(sizes)], "place int, weight int, source_size long")
        got = [r.target for r in mixing.targets(rows).orderBy("place").collect()]
        assert got == pytest.approx(brute_targets(sizes, [k % 3 + 1 for k in range(7)]))


def test_mix_meets_targets_and_repeats(spark, odd, none, monkeypatch):
    docs = spark.createDataFrame([(k, "w " * (k % 17), f"s{k % 10 // 4}") for k in range(3000)], "doc_id long, text string, source string")
    one = {r.doc_id: r for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "QUEUE", 50)
    other = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert {k: r.taken for k, r in one.items()} == other
    taken = Counter()
    for r in one.values():
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[r.target] += r.taken
    assert all(abs(t - n) <= 17 for t, n in taken.items()) and len(one) == 3000
    got = {r.doc_id: r for r in mixing.mix(odd).collect()}
    assert len(got) == 12 and got[0].taken == 0 and mixing.mix(none).count() == 0


def test_a_source_of_very_many_ranges(spark, monkeypatch):
    """Beyond 32,768 ranges a range's number times a key doesn't fit 31 bits."""
    docs = spark.range(80_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two").alias("text"))
    monkeypatch.setattr(mixing, "QUEUE", 2)
    found = mixing.mix(docs).agg(F.sum("taken"), F.count("*")).first()
    assert tuple(found) == (160_000, 80_000)
