"""Operator 12 against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wakeline.llm import word_bpe as W

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return W.Merges(PATH)


def raw(ids):
    return np.array(ids, np.uint32).tobytes()


def fuzzed(seed, n):
    draw = random.Random(seed)
    pools = ["abc ABC'sStTmM", "don't we'll I'd they've it's 'tis", "0123 ²½ ٣ 四 Ⅷ", " \t\n\r\x0b\x0c\x85\xa0 　 ​﻿\x1c\x1f\x00\x01", "éÉàÀßÄäſŉİıǅǆȺⱥ", "é ạ̈ ̈́ Å ẛ̣", "漢字かな 한글 가 กำ العَرَبِية", "😀👩‍👩‍👧 ﬁ №", "!?.,;:-_()[]{}<>|\"'`~@#$%^&*+=/\\", "<|startoftext|> <|endoftext|> <|ENDOFTEXT|> <|endoftext"]
    for _ in range(n):
        some = draw.sample(pools, draw.randint(1, 4))
        words = [draw.choice(some) if draw.random() < 0.15 else "".join(draw.choice(draw.choice(some)) for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(0, 12))]
        yield draw.choice(["", " ", " ", "\n", "\xa0"]).join(words)


def test_ids_and_decoded_texts_equal_the_library(library, merges):
    texts = [*fuzzed(1, 15_000), "", "=" * 700, "ab" * 400 + "'s", "漢" * 500, "ſ" * 300 + "É" * 300, None]
    tool = W.Words(PATH, merges)
    seen = [w for t in texts[:4000] if t for special, found in tool.parts(t) if not special for w in found]
    words = sorted({w.encode() for w in seen})[::2]
    lexicon = W.Lexicon(W.Lexicon.build(dict(zip(words, merges.many(words), strict=True))))
    for tool in (W.WordEncoder(PATH, None), W.WordEncoder(PATH, lexicon)):
        for at in range(0, len(texts), 1000):
            some = texts[at : at + 1000]
            for text, ids in zip(some, tool.encode(some), strict=True):
                wanted = library.encode(text or "", add_special_tokens=False).ids
                assert ids == raw(wanted), repr(text)
                assert tool.merges.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_single_words_by_heap_equal_rounds(merges):
    draw = random.Random(2)
    words = [bytes(draw.choice(b"aeinorst") for _ in range(draw.randint(1, 40))) for _ in range(3000)] + [b"a" * k for k in range(1, 60)]
    assert merges.many(words) == [merges.one(w) for w in words]


def test_lexicon_is_minimal_and_ranks_words():
    draw = random.Random(4)
    words = sorted({bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 7))) for _ in range(400)})
    made = W.Lexicon(W.Lexicon.build({w: raw([k, 7][: 1 + k % 2]) for k, w in enumerate(words)}))
    assert made.rank(words).tolist() == list(range(len(words)))
    assert made.find(words) == [raw([k, 7][: 1 + k % 2]) for k in range(len(words))]
    others = [w + x for w in words for x in (b"d", b"ab") if w + x not in words] + [b"", b"a" * 50]
    assert set(made.rank(others).tolist()) == {-1}
    # as many states as there are sets of endings
    every = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(made.final) == len({tuple(w[len(p) :] for w in words if w.startswith(p)) for p in every})
    empty = W.Lexicon(W.Lexicon.build({}))
    assert empty.find([b"a", b""]) == [None, None]


def held(found, rows, library):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    wanted = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        wanted.append((doc_id, len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert sorted(map(tuple, found.collect()), key=key) == sorted(wanted, key=key)


def test_query_equals_the_library(spark, texts, library):
    held(W.op12_bpe_round_trip(spark, "/root/testdata/sf0.001"), list(texts.items()), library)


def test_odd_rows_and_small_tables(spark, odd, none, library, monkeypatch):
    twice = odd.union(odd.where("doc_id = 5"))
    # words are passed on often, remembered seldom, and broadcast where the folder isn't mounted
    for settings in ({}, {"COUNTED": 1, "KNOWN": 1, "SHORT": 3}, {"scratch_root": lambda _: "hdfs://somewhere/x"}):
        for name, value in settings.items():
            monkeypatch.setattr(W, name, value)
        monkeypatch.setattr(W, "frequent_words", lambda *_: ["one", "word", "the", "a"]) if "scratch_root" in settings else None
        monkeypatch.setattr(W, "documents", lambda *_: twice)
        held(W.op12_bpe_round_trip(spark, ""), [(r.doc_id, r.text) for r in twice.collect()], library)
        monkeypatch.setattr(W, "documents", lambda *_: none)
        assert W.op12_bpe_round_trip(spark, "").count() == 0


def test_frequent_words_are_counted_over_all_texts(spark):
    docs = spark.range(40).select(F.lit("x").alias("word"), F.concat(F.lit("The the "), F.col("id").cast("string"), F.when(F.col("id") < 20, " it's").otherwise(" Été")).alias("text"))
    assert set(W.frequent_words(docs, PATH)) == {"the", "it", "'s", "été", *"0123456789"}
    assert set(W.frequent_words(docs, PATH, 1)) == {"the"}
    assert W.frequent_words(docs, PATH, 0) == []
