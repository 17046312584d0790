"""Operator 13: stretches of words that repeat with a period, and texts without the repeats."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import documents, mix, sliced

#: Words of the shortest run, and of a window that every such run holds twice: with period q, max(12, 2q) - q words come again q later.
LEAST = 12
#: Rows and bytes of text that are read together, words whose suffixes are sorted together (a longer text is sorted alone), and pairs of a bound and a period that are tried together.
ROWS, CHARACTERS, TOGETHER, PAIRS = 2_000, 8_000_000, 250_000, 1_000_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Suffixes:
    """Suffix array of a sequence of numbers by doubling, with the ranks of every doubling kept.

    ``ranks[k][i]`` names the 2^k numbers from i on: equal names are equal
    numbers. Whatever follows the sequence's end differs from everything, so a
    sequence of several parts must end each with a number of its own.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.array = np.argsort(codes, kind="stable")
        ordered = codes[self.array]
        rank, self.ranks, width = np.empty(n, np.int64), [], 1
        open_, members, key = np.arange(n), self.array, ordered
        while True:
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            rank[members] = open_[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            alone = new & np.append(new[1:], True)
            if alone.all():
                break
            self.ranks.append(rank.astype(np.int32) if n < 1 << 31 else rank.copy())
            open_ = open_[~alone]
            members = self.array[open_]
            after = members + width
            key = rank[members] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key, kind="stable")
            members, key = members[order], key[order]
            self.array[open_] = members
            width *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on; i < j."""
        i, j, begin = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            step = np.where(self.ranks[k][i] == self.ranks[k][j], 1 << k, 0)
            i += step
            j += step
        return i - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers up to i, itself included, equal those up to j; i < j, and i may be -1."""
        i, j, begin = i.copy(), j.copy(), i
        for k in range(len(self.ranks) - 1, -1, -1):
            at, to = i - (1 << k) + 1, j - (1 << k) + 1
            step = np.where((at >= 0) & (self.ranks[k][np.maximum(at, 0)] == self.ranks[k][np.maximum(to, 0)]), 1 << k, 0)
            i -= step
            j -= step
        return begin - i

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of the longest stretch from it on that also begins earlier, and where (-1: nowhere)."""
        n = len(self.array)
        shared = np.zeros(n + 1, np.int64)
        a, b = self.array[:-1], self.array[1:]
        shared[1:n] = self.ahead(np.minimum(a, b), np.maximum(a, b))
        longest, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        # what shares nothing with either neighbour in the array has no earlier copy
        some = np.flatnonzero((shared[:-1] > 0) | (shared[1:] > 0))
        places, lengths = self.array[some].tolist(), shared[some].tolist()
        places.append(-1)
        lengths.append(0)
        stack: list[tuple[int, int]] = []
        found, of, at = [], [], []
        for place, upto in zip(places, lengths, strict=True):
            while stack and stack[-1][0] > place:
                top, below = stack.pop()
                found.append(top)
                if below >= upto:
                    of.append(below)
                    at.append(stack[-1][0] if below else -1)
                    continue
                of.append(upto)
                at.append(place)
                upto = below
            stack.append((place, upto))
        longest[found], source[found] = of, at
        return longest, source


def factors(longest: np.ndarray, begin: int, end: int) -> list[int]:
    """Where the blocks of a part [begin, end) start: each the longest that begins earlier, or one number; ``end`` is the last entry."""
    steps, out, at = longest[begin:end].tolist(), [], 0
    while at < end - begin:
        out.append(begin + at)
        at += steps[at] or 1
    return [*out, end]


def _crossing(tree: Suffixes, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, spans: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period) of runs that touch a block's bound, with their least period.

    A run that ends in a block, or with it, has a period of at most this block
    and the one before together. With period q a run that touches bound b
    repeats from b on or from b - q on, so both are extended to either side.
    ``starts`` and ``ends`` are those of each bound's part.
    """
    out, upto = [], np.cumsum(spans)
    # about twice as many pairs as places, taken in portions
    for portion in range(0, int(upto[-1]), PAIRS):
        pair = np.arange(portion, min(portion + PAIRS, int(upto[-1])))
        which = np.searchsorted(upto, pair, "right")
        b, q, low, high = bounds[which], pair - (upto[which] - spans[which]) + 1, starts[which], ends[which]
        two = tree.ranks[min(1, len(tree.ranks) - 1)]
        for x in (b, b - q):
            inside = (x >= low) & (x + q <= high)
            at, period = x[inside], q[inside]
            # of six words that come again, two stand on one side
            near = (two[at] == two[at + period]) | ((at >= 2) & (two[np.maximum(at - 2, 0)] == two[np.maximum(at + period - 2, 0)])) if least >= 8 else np.ones(len(at), bool)
            at, period = at[near], period[near]
            right, left = tree.ahead(at, at + period), tree.behind(at - 1, at + period - 1)
            long = right + left >= np.maximum(period, least - period)
            out.append(np.stack([at - left, right + left + period, period], 1)[long])
    found = np.concatenate([np.zeros((0, 3), np.int64), *out])
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    return found[first]


def enumerate_runs(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs (start, length, period) of parts of a sequence, by start, then period.

    Part k is ``codes[begins[k]:ends[k]]``, and ``codes[ends[k]]`` is a number
    that stands nowhere else; parts share no numbers. A run is a stretch of at
    least ``least`` numbers and two periods, with its least period, that can't
    be extended to either side.

    Suffix array and longest common prefixes give the longest previous factors
    and the blocks. Runs that touch a bound of blocks come from extensions to
    either side of it; any other lies within a block and is copied, from
    buckets by start, from where the block began before.
    """
    tree = Suffixes(codes)
    if not tree.ranks:
        return np.zeros((0, 3), np.int64)
    longest, source = tree.previous_factors()
    bounds, spans, low, high, copied = [], [], [], [], []
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        cuts = np.array(factors(longest, begin, end), np.int64)
        size = np.diff(cuts)
        copied.append(cuts[:-1][size >= least + 2])
        bounds.append(cuts[1:])
        spans.append(np.minimum(size + np.append(size[1:], 0), (end - begin) // 2))
        low.append(np.full(len(size), begin))
        high.append(np.full(len(size), end))
    if not bounds:
        return np.zeros((0, 3), np.int64)
    found = _crossing(tree, *(np.concatenate(x) for x in (low, high, bounds, spans)), least)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, length, period in found.tolist():
        buckets.setdefault(start, []).append((start + length, period))
    more = []
    for block in np.concatenate(copied).tolist() if buckets else ():
        before, size = int(source[block]), int(longest[block])
        shift, end = block - before, before + size
        # a copy may lie in the block's own source again, further on
        for start in range(before + 1, end - least):
            for stop, period in buckets.get(start, ()):
                if stop < end:
                    buckets.setdefault(start + shift, []).append((stop + shift, period))
                    more.append((start + shift, stop - start, period))
    if more:
        found = np.concatenate([found, np.array(more, np.int64)])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _numbers(words: list[bytes]) -> np.ndarray:
    """Words as numbers in order of appearance; equal words only have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _repeating(codes: list[np.ndarray], width: int) -> np.ndarray:
    """Which texts hold a window of so many words twice; equal hashes of different windows only cost time."""
    size = np.array([len(c) for c in codes], np.int64)
    if int(size.max(initial=0)) <= width:
        return np.zeros(len(codes), bool)
    flat, text = np.concatenate(codes).astype(np.uint64), np.repeat(np.arange(len(codes)), size)
    n = len(flat) - width + 1
    window = np.zeros(n, np.uint64)
    for k in range(width):
        window = window * np.uint64(0x9E3779B97F4A7C15) + mix(flat[k : k + n] + np.uint64(1))
    whole = text[:n] == text[width - 1 :]
    bits = np.uint64(max(1, int(len(codes) - 1).bit_length()))
    key = np.sort(mix(window[whole]) >> bits << bits | text[:n][whole].astype(np.uint64))
    out = np.zeros(len(codes), bool)
    out[(key[1:][key[1:] == key[:-1]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    return out


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Runs of each list of words. A text whose windows of ``least`` / 2 words all differ has none; the others are sorted together, up to ``TOGETHER`` words."""
    none = np.zeros((0, 3), np.int64)
    codes, out = [_numbers(words) for words in texts], [none] * len(texts)
    wanted, at = np.flatnonzero(_repeating(codes, (least + 1) // 2)).tolist(), 0
    while at < len(wanted):
        size, to = 0, at
        while to < len(wanted) and (to == at or size + len(codes[wanted[to]]) <= TOGETHER):
            size += len(codes[wanted[to]]) + 1
            to += 1
        parts, begins, ends, base, place = [], [], [], 0, 0
        for k in wanted[at:to]:
            own = codes[k]
            last = int(own.max()) + 1
            parts += [own + base, np.array([base + last])]
            begins.append(place)
            ends.append(place + len(own))
            base, place = base + last + 1, place + len(own) + 1
        found = enumerate_runs(np.concatenate(parts), np.array(begins), np.array(ends), least)
        cut = np.searchsorted(found[:, 0], begins + [place])
        for k, begin, a, b in zip(wanted[at:to], begins, cut[:-1], cut[1:], strict=True):
            out[k] = found[a:b] - np.array([begin, 0, 0])
        at = to
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that repeat a run's first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _search(least: int, order: Callable[[int | None, int], np.ndarray | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in sliced(batches, ROWS, CHARACTERS):
            ids = some.column("doc_id").to_pylist()
            texts = [raw.split() if raw else [] for raw in pc.cast(some.column("text"), pa.binary()).to_pylist()]
            if order is not None:
                for k, (doc_id, words) in enumerate(zip(ids, texts, strict=True)):
                    if (places := order(doc_id, len(words))) is not None:
                        texts[k] = [words[p] for p in places.tolist()]
            runs = runs_of(texts, least)
            columns = np.concatenate(runs).T if runs else np.zeros((3, 0), np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(RUN)))
            kept = [collapsed(words, found) for words, found in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), listed, pc.cast(pa.array(kept, pa.binary()), pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per document its runs of words, by start, then period, and its words without what repeats in them.

    Words are cut at ASCII blanks and compared as they are. A run is a stretch
    of words with least period q (words q apart are equal), of at least
    ``least`` words and two periods, that no neighbouring word extends; runs
    may overlap. ``collapsed`` has the words joined by one space but those that
    a run holds after its first q words. ``order`` may name, for an id and a
    number of words, the word to take at each place in place of the text's own.

    A map without a shuffle. A null or empty text has no words and no runs;
    repeated rows give a row each; a null id stays; other columns are ignored,
    whatever their names; an empty table gives none. A text is searched whole,
    in one task and in n log n steps for n words, with at most 4 bytes a word
    for each doubling of its longest repeat and some 200 beside.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_search(least, order), OUT)


def with_repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The edit that the query makes to a tenth of all texts, by the id's crc32: from some word on, words repeat with some period."""
    if doc_id is None or not n:
        return None
    g, remainder = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if remainder:
        return None
    a = g % n
    p, places = 1 + (n - a) // (3 + g % 8), np.arange(n)
    return np.where(places >= a, a + (places - a) % p, places)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), order=with_repeated_tail)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    # the greatest of (length, -start, -period)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("longest", longest)
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
