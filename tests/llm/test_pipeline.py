from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from wakeline.llm import language_id, mixing, near_dedup, quality_rules, stages
from wakeline.plans import materialize

from test_models import brute_languages
from test_near_dedup import brute
from test_rules_and_mix import measured


def test_stages_keep_columns_and_decide(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, folder), name)
        assert out.dtypes == columns
        got, ids = Counter(r.doc_id for r in out.collect()), {r.doc_id for r in docs.collect()}
        if name == "quality_rules":
            assert set(got) == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
        elif name == "language_id":
            assert set(got) <= ids and len(got) >= 0.99 * len(ids) and language_id.keep_known(docs, 1.1).count() == 0
        elif name == "near_dedup":
            want = brute({r.doc_id: r.text for r in docs.collect()}, stages.NEAR_PERCENT)
            assert set(got) == {i for i, (_, _, kept) in want.items() if kept} and len(got) < len(ids) and max(got.values()) == 1
        else:
            assert got == {r.doc_id: r.copies for r in mixing.mix(docs).where("copies > 0").collect()}
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in last if r.piece == 0) == Counter(r.doc_id for r in docs.collect())


def test_odd_rows_pass_through(spark, odd, none):
    """Each stage takes odd rows, twice, with columns named as those inside, and an empty table; the columns stay."""
    extra = {c: F.lit(7) for c in ("id", "hash", "key", "copies", "copy", "_id", "_copies", "lines", "digest", "group", "text_hash", "kept")}
    docs = odd.withColumns(extra)
    for twice, source in ((2, docs.unionByName(docs)), (1, docs)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, source, "")
            assert out.columns == source.columns
            got = Counter(r.doc_id for r in out.collect())
            if name == "quality_rules":
                assert not got  # too few words, or the same ones again
            elif name == "language_id":
                assert set(got) <= {3, 4, 5, 6, 7, 8, 9, None} and got[3] == twice
            elif name == "near_dedup":
                # 3 and 4 are one text; without words or without an id all stay
                assert got == {0: twice, 1: twice, 2: twice, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1, None: twice}
            else:
                assert set(got) <= {r.doc_id for r in odd.collect()} and got[0] == got[1] * 1
        assert corpus_pipeline.STAGES[-1][1](spark, source, "").where("piece = 0").count() == 12 * twice
    empty = none.withColumns(extra)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_rows_that_share_an_id_keep_their_links(spark):
    text = [f"w{k}" for k in range(60)]
    rows = [(5, "other words " + " ".join(f"v{k}" for k in range(60))), (5, " ".join(text)), (8, " ".join(text[:58])), (9, "alone here")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(5, 56, 5), (5, 58, 5), (8, 54, 5), (9, 1, 9)]
    assert sorted(map(tuple, stages.dedup(spark, docs, "").select("doc_id", "text").collect())) == sorted([rows[0], rows[1], rows[3]])


def test_long_lists_of_ids_are_joined_alike(spark, monkeypatch):
    """Beyond the limits of broadcasts the same rows stay."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = [sorted(r.doc_id for r in stage(spark, docs, "").collect()) for stage in (stages.dedup, stages.mixture)]
    monkeypatch.setattr(stages, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert few == [sorted(r.doc_id for r in stage(spark, docs, "").collect()) for stage in (stages.dedup, stages.mixture)]


def test_near_copies_above_80_percent_go(spark):
    """Of 100 words, 96 shingles each: a changed word costs 5, so 91 / 101 and 86 / 106 (0.81) go, 81 / 111 (0.73) stays."""
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(f"x{k}" if k in changed else w for k, w in enumerate(base)) for changed in ((), (20, 60), (20, 50, 80))]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in stages.dedup(spark, docs.where("doc_id < 2"), "").collect()} == {0}
    assert {r.doc_id for r in stages.dedup(spark, docs.where("doc_id <> 1"), "").collect()} == {0, 2}


def test_bands_follow_the_limit():
    assert near_dedup.band_rows(85) == 5 and near_dedup.band_rows(80) == 4
    for percent in range(30, 100, 5):
        rows = near_dedup.band_rows(percent)
        assert rows == 1 or (1 - (percent / 100) ** rows) ** (near_dedup.PERMUTATIONS // rows) <= near_dedup.MISSES


def brute_rules(rows, most=10, left=30):
    """What the quality stage keeps: (doc_id, text) of rows (doc_id, source, text), with sets of lines and windows."""
    parts = lambda line: tuple(line.encode().lower().split())
    seen, lines_of = {}, {}
    for doc_id, source, text in rows:
        every = tuple(p for line in (text or "").split("\n") if (p := parts(line)))
        lines_of[doc_id] = every
        for p in set(every):
            seen.setdefault((source, p), set()).add(every)
    common, out = {k for k, documents in seen.items() if len(documents) > most}, {}
    for doc_id, source, text in rows:
        n, _, _, _, again = measured(text)
        gone = sum(len(p) for p in lines_of[doc_id] if (source, p) in common)
        if n >= 20 and 100 * again <= 30 * n and 100 * (n - gone) >= left * n:
            out[doc_id] = "\n".join(x for x in text.split("\n") if (source, parts(x)) not in common)
    return out


def test_quality_and_language_stages_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # some lines are boilerplate of a host, some texts little else
    more = [(10_000 + k, "\n".join([f"word{k} " * 3 + " ".join(f"v{k}x{j}" for j in range(25 if k % 3 else 2))] + ["Imprint and terms of this site"] * (1 if k % 3 else 9)), "en", "host" if k % 2 else "other", 0) for k in range(60)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    out = materialize(stages.quality(spark, docs, folder), "quality")
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_rules(rows) and 0 < len(got) < len(rows) and any(t != got[i] for i, _, t in rows if i in got)
    want = brute_languages([(r.doc_id, r.text, r.lang) for r in out.collect()])
    kept = {r.doc_id for r in stages.language(spark, out, folder).collect()}
    sure = {i for i, (lang, score) in want.items() if lang != "und" and score >= language_id.LEAST_SCORE + 1e-3}
    maybe = {i for i, (lang, score) in want.items() if lang != "und" and score >= language_id.LEAST_SCORE - 1e-3}
    assert sure <= kept <= maybe


def test_runs_agree_however_rows_are_dealt(spark, tmp_path):
    """Every stage leaves the same rows and texts, told by a digest, with other partitions, another order and other shuffles."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for parts, shuffles in ((1, "3"), (7, "11")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        rows, mine = docs.repartition(parts, F.xxhash64("doc_id", F.lit(parts))), []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = materialize(stage(spark, rows, ""), name)
            mine.append((name, stages.digest(rows)))
        found.append(mine)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and [n for _, (n, _) in found[0]] == sorted((n for _, (n, _) in found[0][:3]), reverse=True) + [found[0][3][1][0]]
    # a changed text or a row more is another digest
    base = stages.digest(docs)
    assert stages.digest(docs.repartition(5)) == base != stages.digest(docs.withColumn("text", F.upper("text"))) and stages.digest(docs.limit(0)) == (0, 0)
