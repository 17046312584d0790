"""Operator 12: exact BPE of words with ends, by a minimal automaton of frequent words and merges of the others."""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import drop_materialized, materialize, scratch_root
from .text import documents, held, sliced

#: Words of the lexicon at most: those from some frequency on, counted over all texts. It bounds memory only; ids don't depend on it.
LEXICON = 200_000
#: Rows and bytes of text encoded together; words that a worker remembers, and that it counts before it passes counts on; characters of a word that is remembered, and bytes of one that is merged with others.
ROWS, CHARACTERS, KNOWN, COUNTED, SHORT, TOGETHER = 500, 4_000_000, 150_000, 400_000, 64, 256
#: Counts fall into this many classes for each doubling; the lexicon takes whole classes.
CLASSES = 16
NONE = np.iinfo(np.int64).max
END = "</w>"

#: Characters whose case, class and composition every table in use agrees on: up to here, but for one capital and four separators.
OLD = "ƀ"
_ODD = "[^\\x00-\\x1b\\x20-įı-ſ]"
_BLANKS = " \\t\\n\\x0b\\x0c\\r"
_IS_ODD = re.compile(_ODD)
_IS_BLANK = re.compile(f"[{_BLANKS}]")


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(ord(OLD))) if unicodedata.category(c)[0] == kind)


def _pattern(letters: str, numbers: str, blanks: str) -> re.Pattern:
    """What the vocabulary's pattern finds in lower-cased text: an ending, letters, one digit, or other marks."""
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{blanks}{letters}{numbers}]+")


_ASCII = _pattern("a-z", "0-9", _BLANKS)
_LATIN = _pattern(_class("L"), _class("N"), _BLANKS + "\x85\xa0")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Merges:
    """A vocabulary file's merges: ids of words, one by one or many at once, and words of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, letters = whole["model"], byte_letters()
        if model["end_of_word_suffix"] != END or whole["decoder"] is not None:
            raise ValueError("a vocabulary of words with ends and no decoder is needed")
        vocabulary = model["vocab"]
        self.inner, self.last = (np.array([vocabulary[x + end] for x in letters], np.int64) for end in ("", END))
        ranks = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        made = {new: rank for rank, new in ranks.values()}
        if max(vocabulary.values()) >> 20 or any(made.get(x, -1) >= rank for pair, (rank, _) in ranks.items() for x in pair):
            # all pairs of the least rank are merged at once: nothing that comes of them may have a lesser one
            raise ValueError("a part of a merge is made after it")
        keys = np.array([a << 20 | b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys, (self.rank, self.new) = keys[order], np.array(list(ranks.values()), np.int64)[order].T
        self.pairs = ranks
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.special = {text: np.uint32(k).tobytes() for text, k in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = max([*vocabulary.values(), *special.values()]) + 1
        self.tokens = [""] * size
        for token, k in (vocabulary | special).items():
            self.tokens[k] = token

    def many(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit numbers."""
        short = [k for k, w in enumerate(words) if len(w) <= TOGETHER]
        out = [b""] * len(words)
        for k, ids in zip(short, self._together([words[k] for k in short]), strict=True):
            out[k] = ids
        if len(short) < len(words):
            for k, w in enumerate(words):
                if len(w) > TOGETHER:
                    out[k] = self.one(w)
        return out

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Each round merges every pair of a word's least rank, from the left; a word with no pair left is done."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[np.frombuffer(b"".join(words), np.uint8)[ends]]
        word, done_word, done = np.repeat(np.arange(len(words)), size), [], []
        while len(symbol):
            key = symbol[:-1] << 20 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbol), NONE)
            rank[:-1] = np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.rank[at], NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            over = least == NONE
            if over.any():
                done_word.append(word[over])
                done.append(symbol[over])
                symbol, word, rank, least, at = symbol[~over], word[~over], rank[~over], least[~over], np.append(at, 0)[~over]
            hit = np.flatnonzero(rank == least)
            # of overlapping equal pairs every second is merged
            fresh = np.append(True, hit[1:] != hit[:-1] + 1)[: len(hit)]
            hit = hit[(hit - hit[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]) % 2 == 0]
            symbol[hit] = self.new[at[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, word = symbol[keep], word[keep]
        word, symbol = np.concatenate(done_word), np.concatenate(done)
        order = np.argsort(word, kind="stable")
        raw, upto = symbol[order].astype(np.uint32).tobytes(), 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [raw[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def one(self, word: bytes) -> bytes:
        """Ids of one word of any length: merges from a heap by rank and place, in n log n steps."""
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], k, pairs[p][1], p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, new, (a, b) = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= n or ids[right] != b:
                continue
            ids[k], ids[right], after[k] = new, -1, after[right]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in pairs:
                    rank, made = pairs[p]
                    heapq.heappush(heap, (rank, x, made, p))
        return np.array([x for x in ids if x >= 0], np.uint32).tobytes()

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as the library does for a vocabulary with no decoder; ids without a token are left out."""
        tokens, n = self.tokens, len(self.tokens)
        found = np.frombuffer(ids, np.uint32)
        return " ".join([t for t in map(tokens.__getitem__, found[found < n].tolist()) if t])


class Words:
    """What the vocabulary's own steps before BPE make of a text: special strings, and lower-case words."""

    def __init__(self, path: str, merges: Merges):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normal, self.cut, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str, merges.split
        self.special = list(merges.special)
        self.bytes_of = {ord(c): b for b, c in enumerate(byte_letters())}
        self.odd: dict[str, list[str]] = {}

    def _odd(self, part: str) -> list[str]:
        """Words of a part with a character that tools may treat differently, by the library's normaliser and pattern."""
        if (found := self.odd.get(part)) is None:
            # its letters stand for bytes
            found = [x.translate(self.bytes_of).encode("latin-1").decode() for x, _ in self.cut(self.normal(part))]
            if len(part) <= SHORT:
                if len(self.odd) >= KNOWN:
                    self.odd.clear()
                self.odd[part] = found
        return found

    def plain(self, text: str) -> list[str]:
        """Words of a text in which no special string is sought. Blanks always divide words, so parts between them stand alone."""
        if text.isascii() and not _IS_ODD.search(text):
            return _ASCII.findall(text.lower())
        if not _IS_ODD.search(text):
            return _LATIN.findall(text.lower())
        out, at = [], 0
        for odd in _IS_ODD.finditer(text):
            if odd.start() < at:
                continue
            # the part between blanks that holds it
            begin = max(at, 1 + max(text.rfind(blank, at, odd.start()) for blank in " \t\n\x0b\x0c\r"))
            end = found.start() if (found := _IS_BLANK.search(text, odd.start())) else len(text)
            out += _LATIN.findall(text[at:begin].lower())
            out += self._odd(text[begin:end])
            at = end
        return out + _LATIN.findall(text[at:].lower())

    def parts(self, text: str) -> Iterator[tuple[bool, list[str] | str]]:
        """Lists of words, and special strings, in order."""
        if not any(x in text for x in self.special):
            yield False, self.plain(text)
            return
        for k, piece in enumerate(self.split.split(text)):
            if k % 2:
                yield True, piece
            elif piece:
                yield False, self.plain(piece)


class Lexicon:
    """A minimal acyclic transducer from words to ids.

    Words with the same endings share states. Each arc has a byte and how many
    words of its state come before those behind it, so the sum along a word is
    its rank, and ranks have ids side by side. All arrays lie in one buffer,
    which workers map; a look-up takes all words of a batch a byte at a time.
    """

    NAMES = ("arcs", "to", "skip", "final", "begin", "ids")
    TYPES = (np.int64, np.int32, np.int32, np.int8, np.int32, np.uint32)

    def __init__(self, raw):
        head = 8 * (len(self.NAMES) + 1)
        sizes = np.frombuffer(raw[:head], np.int64).tolist()
        self.longest, at = sizes[0], head
        for name, kind, size in zip(self.NAMES, self.TYPES, sizes[1:], strict=True):
            width = np.dtype(kind).itemsize
            setattr(self, name, np.frombuffer(raw, kind, size, at))
            at += -(-size * width // 8) * 8

    @classmethod
    def build(cls, words: dict[bytes, bytes]) -> bytes:
        """The buffer for words with their ids, built in one pass over the sorted words: a state is looked up among those with the same arcs once no later word can change it."""
        order, same, states = sorted(words), {}, []
        # the path of the last word: each state as [final, [(byte, state), ...]]
        path: list[list] = [[0, []]]
        last = b""

        def freeze(upto: int) -> None:
            while len(path) > upto:
                final, arcs = path.pop()
                key = (final, *arcs)
                if (number := same.get(key)) is None:
                    number = same[key] = len(states)
                    states.append((final, arcs))
                path[-1][1].append((last[len(path) - 1], number))

        for word in order:
            shared = len(os.path.commonprefix([word, last]))
            freeze(shared + 1)
            path += [[0, []] for _ in word[shared:]]
            path[-1][0], last = 1, word
        freeze(1)
        states.append(tuple(path[0]))
        # words behind each state; states come after those that they lead to
        behind, arcs, to, skip = [0] * len(states), [], [], []
        for state, (final, out) in enumerate(states):
            total = final
            for byte, target in out:
                arcs.append(state << 8 | byte)
                to.append(target)
                skip.append(total)
                total += behind[target]
            behind[state] = total
        begin = np.cumsum([0, *(len(words[w]) // 4 for w in order)])
        # the root has the greatest number
        made = (arcs, to, skip, [f for f, _ in states], begin, np.frombuffer(b"".join(words[w] for w in order), np.uint32))
        parts = [np.array(x, kind) for x, kind in zip(made, cls.TYPES, strict=True)]
        head = np.array([max(map(len, order), default=0), *map(len, parts)], np.int64).tobytes()
        return head + b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in parts)

    def rank(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word among those of the lexicon, or -1."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat, begin = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, out = np.full(len(words), len(self.final) - 1), np.zeros(len(words), np.int64)
        live = np.flatnonzero((size <= self.longest) & (len(self.arcs) > 0))
        out[(size > self.longest) | (len(self.arcs) == 0)] = -1
        for k in range(self.longest):
            live = live[size[live] > k]
            if not len(live):
                break
            key = state[live] << 8 | flat[begin[live] + k]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            out[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live] = self.to[at]
            out[live] += self.skip[at]
        return np.where((out >= 0) & (self.final[state] == 1) & (size > 0), out, -1)

    def find(self, words: list[bytes]) -> list[bytes | None]:
        rank = self.rank(words)
        a, b = self.begin[rank], self.begin[rank + 1]
        ids = self.ids
        return [ids[x:y].tobytes() if r >= 0 else None for r, x, y in zip(rank.tolist(), a.tolist(), b.tolist(), strict=True)]


class WordEncoder:
    """Whole texts to ids: a lexicon for frequent words, merges for others; what a worker met before it remembers, up to ``KNOWN`` words."""

    def __init__(self, path: str, lexicon: Lexicon | None):
        self.merges = Merges(path)
        self.words, self.lexicon = Words(path, self.merges), lexicon
        self.known: dict[str, bytes] = {}

    def learn(self, new: Iterable[str]) -> dict[str, bytes]:
        words = list(new)
        raw = [w.encode() for w in words]
        found = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        unseen = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(unseen, self.merges.many([raw[k] for k in unseen]), strict=True):
            found[k] = ids
        return dict(zip(words, found, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > KNOWN:
            self.known = {}
        parts = [list(self.words.parts(text)) if text else [] for text in texts]
        new = {w for text in parts for special, words in text if not special for w in words}.difference(self.known)
        learnt = self.learn(new)
        here = self.known | learnt if learnt else self.known
        self.known.update((w, ids) for w, ids in learnt.items() if len(w) <= SHORT)
        special = self.merges.special
        return [b"".join([special[x] if alone else b"".join(map(here.__getitem__, x)) for alone, x in text]) for text in parts]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(f"words of {path}", "tool", lambda: Words(path, Merges(path)))
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for some in sliced(batches, ROWS, CHARACTERS):
            for text in some.column("text").to_pylist():
                for special, found in words.parts(text) if text else ():
                    if not special:
                        counts.update(found)
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        yield out()

    return run


def frequent_words(docs: DataFrame, path: str, most: int = LEXICON) -> list[str]:
    """The words from some frequency on, of all whole texts: as many as ``most`` holds without parting equal counts' classes.

    Tasks pass on counts, not words. The driver gets a row per class of counts
    and then at most ``most`` words. Words above ``SHORT`` characters are left out.
    """
    counted = docs.select("text").mapInArrow(_count(path), "word string, n long").where(F.length("word") <= SHORT)
    counts = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("class", F.floor(F.log2("n") * CLASSES)), "words")
    classes = {r["class"]: r["count"] for r in counts.groupBy("class").count().collect()}
    total, least = 0, None
    for k in sorted(classes, reverse=True):
        total += classes[k]
        if total > most:
            break
        least = k
    found = [r.word for r in counts.where(F.col("class") >= least).select("word").collect()] if least is not None else []
    drop_materialized(counts)
    return found


def build_lexicon(spark: SparkSession, words: list[str], path: str) -> tuple[str, object]:
    """The lexicon in the shared folder, to be mapped by workers, or a broadcast of it where that folder isn't mounted; it is bounded by ``LEXICON``."""
    merges, raw = Merges(path), [w.encode() for w in words]
    made = Lexicon.build(dict(zip(raw, merges.many(raw), strict=True)))
    root = scratch_root(spark)
    if not root.startswith(("file:", "/")):
        return "", spark.sparkContext.broadcast(made)
    folder = "/" + root.removeprefix("file:").lstrip("/")
    os.makedirs(folder, exist_ok=True)
    name = f"{folder}/lexicon-{uuid.uuid4().hex[:12]}"
    with open(f"{name}.part", "wb") as file:
        file.write(made)
    os.rename(f"{name}.part", name)
    return name, None


def _encode(path: str, name: str, sent, decoded: bool):
    key = name or uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = held(f"words of {path} by {key}", "tool", lambda: WordEncoder(path, Lexicon(np.memmap(name, np.uint8, "r") if name else np.frombuffer(sent.value, np.uint8))))
        for some in sliced(batches, ROWS, CHARACTERS):
            ids = tool.encode(some.column("text").to_pylist())
            columns = [some.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(list(map(tool.merges.decode, ids)), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def encode_words(docs: DataFrame, path: str, most: int = LEXICON, decoded: bool = True) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) of every whole text and, if wanted, the text that they decode to.

    Ids are those of the library's call with no special tokens added; strings
    of special tokens in a text are these tokens. Texts are read twice: to
    count words, of which only counts are shuffled, and to encode. A null or
    empty text has no ids; repeated rows give a row each; null ids of documents
    stay; other columns are ignored, whatever their names; an empty table gives
    none. A text is encoded whole in one task: memory is some 100 bytes a word.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    name, sent = build_lexicon(docs.sparkSession, frequent_words(rows, path, most), path)
    kind = "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else "")
    return rows.mapInArrow(_encode(path, name, sent, decoded), kind)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_words(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
