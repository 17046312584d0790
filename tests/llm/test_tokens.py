import cProfile
import pstats
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wakeline.llm import encoding, packing, token_files, wordpiece
from wakeline.llm.text import sliced

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TRICKY = ["", " ", "a", " a", "a ", "\n", " \n x", "x\n y", "x \ny", "a\n\n b", "don't it's", "x  y", "a <|endoftext|> b", "É́ Σας ΟΔΟΣ ", "12 345,6. 7!!", "a b  c", "trail\n", "first line\n\xa0 second", " x \u0130, y \u0130. z", "\t\r\n x\x85y", "  lead", "end  ", "x.\nY!!\n\nz", "!!! ??", "x'!! y's.", None, "\0a b", "a \0", "a  b", "a  b"]

SIGNS = [*"abxyZ,.!'\"-0 7\n\t\r ", "  ", "\n\n", *"\xa0\u3000\u2028\u2003\x85\u0130\u0131\xe9\u0301\u0327\u03a3\u03c2\xdf\u1e9e\u01c5\xaa\u6f22\ud55c\u1100\u1161\u0958\u093c\u200b\ufeff\u180e\x1c\x1f\0\1\xb2\xbd\u2167\u0663\u2026\u201c\xad\u0345\u212b\ufffd", "e\u0301", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'ll", "don't", "the", "word "]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path, texts, monkeypatch):
    plain = Tokenizer.from_file(path)
    random.seed(11)
    every = TRICKY + list(texts.values()) + ["".join(random.choice(SIGNS if random.random() < 0.5 else "abc d") for _ in range(random.randrange(1, 14))) for _ in range(20_000)]
    for most in (encoding.KNOWN, 50):  # ids are the library's, called with no flag set
        monkeypatch.setattr(encoding, "KNOWN", most)
        tool, got = encoding.Encoder(path), []
        for _, ids, ends in tool.groups(iter([pa.record_batch([pa.array(every)], names=["text"])]), 9):
            got += np.split(ids, ends[:-1])
        want = [[*x.ids, 9] for x in plain.encode_batch([t or "" for t in every], add_special_tokens=False)]
        assert [g.tolist() for g in got] == want


def test_strings_of_special_tokens_can_be_ordinary_text():
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    text = "a <|endoftext|> b"
    asked, given = encoding.Encoder(BYTES, special=False), encoding.Encoder(BYTES)
    assert np.frombuffer(asked.encode([text])[0], np.uint32).tolist() == plain.encode(text).ids
    assert np.frombuffer(given.encode([text])[0], np.uint32).tolist() == [64, 220, 50256, 275]


def test_long_words_are_not_kept():
    tool = encoding.Encoder(WORDS)
    tool.encode([f"{'y' * 100_000} {'x' * 65} short"])
    assert set(tool.known) == {"\0", "short"}


def test_words_of_byte_vocabularies_cost_no_call_each():
    def calls(n):
        random.seed(n)
        words = ["".join(random.choices("abcdefghij\xe9", k=9)) + random.choice(["", ",", ".", "!?"]) for _ in range(n)]
        tool, watch = encoding.Encoder(BYTES), cProfile.Profile()
        watch.runcall(tool.encode, [" ".join(words), "\n".join(words)])
        return pstats.Stats(watch).total_calls

    assert calls(20_000) < calls(200) + 100


@pytest.mark.parametrize("longest", [64, 3])
def test_parts_of_bytes_that_cannot_be_cut_are_encoded_alone(longest, monkeypatch):
    plain, tool = Tokenizer.from_file(BYTES), encoding.Encoder(BYTES)
    monkeypatch.setattr(encoding.Encoder, "_cut", lambda *_: None)
    monkeypatch.setattr(encoding, "LONGEST", longest)
    for _ in range(2):  # the second time from the table
        got = tool.encode(pa.array(TRICKY).slice(3))
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [plain.encode(t or "").ids for t in TRICKY[3:]]
    assert max(map(len, tool.names.to_pylist())) <= longest
    assert tool.encode([]) == [] and tool.encode([None, ""]) == [b"", b""]


def test_slices_are_bounded_by_bytes():
    batch = pa.record_batch([pa.array(["a" * 40, None, "b" * 500, "c", "d" * 90, "é" * 10])], names=["text"])
    assert [s.num_rows for s in sliced(iter([batch, batch.slice(0, 0)]), 3, 100)] == [2, 1, 2, 1]


def test_selected_documents_skip_row_groups(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setitem(token_files.FILE_OPTIONS, "parquet.block.size", str(16 << 10))
    docs = spark.range(0, 4000).selectExpr("id doc_id", "concat('text ', repeat(md5(cast(id as string)), 4)) text").coalesce(1)
    out = str(tmp_path / "t")
    token_files.write_token_files(docs, out, BYTES)
    every = {r.doc_id: (r.start, r.ids) for r in token_files.read_token_files(spark, out).collect()}
    some = token_files.read_token_files(spark, out, 7, 3999)
    assert {r.doc_id: (r.start, r.ids) for r in some.collect()} == {k: every[k] for k in (7, 3999)}
    scan = spark.read.schema(token_files.SCHEMA).parquet(out).where("doc_id in (7, 3999)").select("doc_id")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    assert "PushedFilters: [In(doc_id, [" in scan._jdf.queryExecution().executedPlan().toString()
    groups = [pq.ParquetFile(f).metadata.row_group(g).column(1) for f in tmp_path.glob("t/part-*") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    hit = [g for g in groups if g.path_in_schema == "doc_id" and any(g.statistics.min <= k <= g.statistics.max for k in (7, 3999))]
    assert len(hit) == 2 and len(groups) > 4 and all(g.has_offset_index for g in groups)


def test_files_round_trip(spark, odd, none, tmp_path):
    plain = Tokenizer.from_file(BYTES)
    token_files.write_token_files(odd.unionByName(odd), str(tmp_path / "t"), BYTES)
    rows = token_files.read_token_files(spark, str(tmp_path / "t")).collect()
    rows.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == 24
    texts, start = {r.doc_id: r.text for r in odd.collect()}, 0
    for r in rows:
        assert r.ids == [*plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2] and (r.start, r.n_tokens) == (start, len(r.ids))
        start += len(r.ids)
    token_files.write_token_files(none, str(tmp_path / "e"), BYTES)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_query_digests_ids(spark, texts):
    plain = Tokenizer.from_file(BYTES)
    start = 0
    for r in token_files.op3_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect():
        ids = np.array([*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], np.uint32)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def check_packing(rows, lengths, room):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r.length)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sum(v) for k, v in by_doc.items()} == lengths
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    return len(by_bin)


def test_packing_is_tight(spark, texts):
    plain = Tokenizer.from_file(WORDS)
    rows = packing.op9_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    ids = {k: np.array([*plain.encode(t, add_special_tokens=False).ids, 1], np.uint32) for k, t in texts.items()}
    bins = check_packing(rows, {k: len(v) for k, v in ids.items()}, 4096)
    assert bins <= -(-sum(map(len, ids.values())) // 4096) + 1
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * 4096 and r.ids_crc32 == zlib.crc32(piece.tobytes()) and (r.length == 4096 or r.start + r.length == len(ids[r.doc_id]))


def test_packing_with_many_parts_is_the_same(odd, monkeypatch):
    few = sorted(map(tuple, packing.pack(odd, WORDS).collect()), key=str)
    monkeypatch.setattr(packing, "BROADCAST_PARTS", 0)
    assert sorted(map(tuple, packing.pack(odd, WORDS).collect()), key=str) == few


def test_packing_odd_rows(odd, none):
    rows = packing.pack(odd, WORDS).collect()
    assert sum(r.doc_id == 8 for r in rows) == 8 and sum(r.length for r in rows if r.doc_id in (0, 1, 2)) == 3
    assert packing.pack(none, WORDS).count() == 0


def test_fullest_bin_is_exact():
    random.seed(1)
    for _ in range(200):
        counts, room = np.zeros(41, np.int64), 40
        for _ in range(random.randrange(1, 7)):
            counts[random.randrange(1, 41)] += random.randrange(1, 3)
        first = int(np.flatnonzero(counts)[-1])
        chosen = packing.fullest(counts, room, first)
        rest = counts.copy()
        rest[first] -= 1
        sums = {first}
        for k in np.flatnonzero(rest):
            for _ in range(rest[k]):
                sums |= {s + int(k) for s in sums if s + k <= room}
        assert sum(chosen) == max(sums) and all(chosen.count(k) <= counts[k] for k in set(chosen))


def test_plan_does_not_grow_with_copies():
    lengths = np.random.default_rng(0).integers(1, 4097, 3000)
    histogram = np.bincount(lengths, minlength=4097)
    one, many = packing.plan_bins(histogram, 4096), packing.plan_bins(histogram * 1000, 4096)
    assert len(many) < 4 * len(one)


def greedy(word, pieces, follow=b""):
    at = n = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (follow if at else b"") + word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return 1
    return n


@pytest.mark.parametrize("follow", [b"", b"##"])
def test_automaton_equals_greedy_search(follow):
    random.seed(7)
    some = lambda most: bytes(random.choice(b"ab") for _ in range(random.randint(1, most)))
    for _ in range(200):
        pieces = {some(5) for _ in range(random.randint(1, 8))} | ({follow + some(4) for _ in range(random.randint(1, 8))} if follow else set())
        tool = wordpiece.LongestMatch(pieces, follow)
        for word in (b"", *(some(12) for _ in range(25))):
            assert tool.count(word) == greedy(word, pieces, follow)


def test_counts_of_texts(odd, none, texts, spark):
    pieces = set(wordpiece.load_pieces(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    rows = {r.doc_id: r for r in wordpiece.op2_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for k in list(texts)[:40]:
        found = texts[k].encode().split()
        assert (rows[k].n_words, rows[k].n_tokens) == (len(found), sum(greedy(w, pieces) for w in found))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.count_pieces(odd, path).collect()}
    assert got[0] == got[1] == got[2] == (0, 0) and got[8] == (30_000, 30_000) and wordpiece.count_pieces(none, path).count() == 0
