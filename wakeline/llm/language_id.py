"""Operator 10: language identification by known words, falling back to shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import materialize
from .text import alone, crc_fold, documents, sliced

#: About so many labelled documents of each language are learnt from, chosen by a hash of the id; all their words and n-grams are kept.
SAMPLE = 1_500
#: Longer runs of letters are no words; they are scored by their n-grams.
LONGEST = 64
#: Character n-grams of these lengths, tried from the longest; words are framed by a blank on each side.
ORDERS = (5, 4, 3, 2, 1)
#: A document of a score below this is rejected where documents are filtered.
LEAST_SCORE = 0.5
#: Numbers of a worker's table of scores (4 bytes each), and bytes of a token that is kept in it.
NUMBERS, KEPT = 800_000, 64
#: Up to so many languages, their counts are broadcast.
BROADCAST_LANGS = 10_000

_LETTER = re.compile(r"[^\W\d_]")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha())


def normal(token: bytes) -> str:
    """The letters of a token in lower case; what stands around or between them goes."""
    word = token.decode().lower()
    if word.isalpha() or (word := word.strip(_MARKS)).isalpha():
        return word
    return "".join(filter(str.isalpha, word))


def _grams(word: str, order: int) -> list[str]:
    framed = f" {word} "
    return [framed[k : k + order] for k in range(len(framed) - order + 1)] if order > 1 else list(word)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (order 0) and n-grams by language, summed within a batch."""
    alone()
    for batch in sliced(batches, 2_000, 8_000_000):
        raw: defaultdict[str, Counter[bytes]] = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw[lang].update((text or "").encode().split())
        for lang, tokens in raw.items():
            found: list[Counter[str]] = [Counter() for _ in range(max(ORDERS) + 1)]
            for token, n in tokens.items():
                if word := normal(token):
                    if len(word) <= LONGEST:
                        found[0][word] += n
                    for order in ORDERS:
                        for gram in _grams(word, order):
                            found[order][gram] += n
            for order, counts in enumerate(found):
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array([order] * len(counts), pa.int32()), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["lang", "order", "gram", "n"])


class Model:
    """Per-language log frequencies of words and n-grams, with add-half smoothing, a row of ``table`` each."""

    def __init__(self, counts: pa.Table, langs: list[str]):
        self.langs = sorted(langs)
        self.index: list[dict[str, int]] = [{} for _ in range(max(ORDERS) + 1)]
        order = counts.column("order").to_numpy()
        lang = np.searchsorted(np.array(self.langs, object), np.array(counts.column("lang").to_pylist(), object)) if len(order) else order
        n = counts.column("n").to_numpy()
        tables, base = [np.zeros((0, len(self.langs)))], 0
        for k, index in enumerate(self.index):
            mine = np.flatnonzero(order == k)
            place = np.array([index.setdefault(g, base + len(index)) for g in counts.column("gram").take(pa.array(mine)).to_pylist()], np.int64) - base
            table = np.full((len(index), len(self.langs)), 0.5)
            np.add.at(table, (place, lang[mine]), n[mine])
            # one more half for all that was not seen
            tables.append(np.log(table) - np.log(table.sum(axis=0) + 1))
            base += len(index)
        self.table = np.concatenate(tables).astype(np.float32)

    def known(self, word: str) -> list[int]:
        """Rows of the word, or of its known n-grams of the longest order that has any."""
        if (k := self.index[0].get(word)) is not None:
            return [k]
        for order in ORDERS:
            if known := [k for g in _grams(word, order) if (k := self.index[order].get(g)) is not None]:
                return known
        return []


class Scorer:
    """Sums of the words' scores, each the mean of what the model knows of the word; remembered by token."""

    def __init__(self, model: Model):
        self.model, self.place, self.used = model, {}, 0
        self.room = NUMBERS // max(1, len(model.langs))
        self.rows = np.zeros((self.room + 1, max(1, len(model.langs))), np.float32)

    def _learn(self, new: list[bytes]) -> None:
        if self.used + len(new) > len(self.rows) - 1:
            self.rows = np.zeros((self.used + len(new) + 1, self.rows.shape[1]), np.float32)
        known = [self.model.known(word) if (word := normal(token)) else [] for token in new]
        full = [k for k, rows in enumerate(known) if rows]
        if full:
            sizes = np.array([len(known[k]) for k in full])
            flat = np.fromiter((r for k in full for r in known[k]), np.int64, sizes.sum())
            sums = np.add.reduceat(self.model.table[flat], np.cumsum(sizes) - sizes, axis=0)
            self.rows[self.used + 1 : self.used + 1 + len(full)] = sums / sizes[:, None]
        self.place.update(dict.fromkeys(new, 0))
        self.place.update((new[k], self.used + 1 + at) for at, k in enumerate(full))
        self.used += len(full)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        tokens = [text.encode().split() if text and self.model.langs and _LETTER.search(text) else None for text in texts]
        every = set().union(*(t for t in tokens if t))
        new = [t for t in every if t not in self.place]
        if self.used + len(new) > self.room:
            self.place, self.used, new = {}, 0, list(every)
            self.rows = self.rows[: self.room + 1]
        if new:
            self._learn(new)
        out = [self._score(t) if t else ("und", 0.0) for t in tokens]
        for token in new:
            if len(token) > KEPT:
                del self.place[token]
        return out

    def _score(self, tokens: list[bytes]) -> tuple[str, float]:
        total, words = np.zeros(len(self.model.langs)), 0
        for at in range(0, len(tokens), 50_000):
            found = np.array(list(map(self.place.__getitem__, tokens[at : at + 50_000])))
            total += self.rows[found].sum(axis=0, dtype=np.float64)
            words += int((found > 0).sum())
        # words of a text hang together, so their evidence counts as its root
        sure = np.exp((total - total.max()) / max(1.0, words**0.5))
        best = int(total.argmax())
        return self.model.langs[best], float(sure[best] / sure.sum())


def learn(docs: DataFrame, train, sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` rows of each language that satisfy ``train``, whole texts, with all their words and n-grams.

    The driver gets these counts, whose number the sample bounds for each
    language, and a row per language: the column is one of tags.
    """
    rows = docs.where(train & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("size")), "languages")
    langs = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes
    chance = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) / (1 << 20)
    chosen = rows.join(langs, "lang").where(chance < F.lit(sample) / F.col("size"))
    counts = chosen.select("lang", "text").mapInArrow(_counted, "lang string, order int, gram string, n long")
    counts = counts.groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    return Model(counts.toArrow(), [r.lang for r in sizes.collect()])


def _predicted(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        score = Scorer(model.value)
        for some in sliced(batches, 2_000, 4_000_000):
            found = score(some.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, by: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row, by its whole text; a map without a shuffle.

    Known words score by their log frequency in each language; other words by
    the mean over their longest known n-grams. Only text and ``lang`` of rows
    not held out are learnt from. A null text, or one without a letter, is
    ``und`` with score 0; so is all where no row has a language. Ties go to the
    first language by name. A null id has no remainder and is learnt from.
    Repeated rows are learnt from and scored each; other columns are ignored,
    whatever their names; an empty table gives none.
    """
    out = F.coalesce(crc_fold("doc_id", by) == held, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, ~out, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    return rows.mapInArrow(_predicted(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is known with at least ``least``; all their columns stay as they are, whatever their names.

    A null text or one without a letter goes; repeated rows and ties are as in
    :func:`identify`; an empty table gives none.
    """
    out = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, ~out))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        score = Scorer(model.value)
        for some in sliced(batches, 2_000, 4_000_000):
            found = score(some.column("text").to_pylist())
            yield some.select(names).filter(pa.array([lang != "und" and sure >= least for lang, sure in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
