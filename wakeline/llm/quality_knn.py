"""Operator 6: document quality by votes of the nearest labelled documents in a latent space."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import materialize
from .text import KEPT, crc_fold, documents, held, release, sliced

#: About so many labelled documents are learnt from, chosen by a hash of the id.
SAMPLE = 4_000
#: All terms that so many rows of the sample hold make the space: a term of one row tells of no other.
LEAST_ROWS = 2
DIMENSIONS, NEIGHBOURS = 48, 15
#: Directions that the axes are sought in beside their own number, and rounds of it; up to so many rows, axes are exact.
SPARE, ROUNDS, EXACT = 32, 8, 600
#: Values of sparse rows that are multiplied together.
PORTION = 16_384
#: Documents whose cosines are computed at once.
BLOCK = 512



def shape(token: bytes) -> str:
    """A word's outline: runs of capitals, small letters, digits and marks, each as one sign."""
    out = []
    for c in token.decode():
        sign = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "a" if c.isalpha() else c
        if not out or out[-1] != sign:
            out.append(sign)
    return "".join(out)


class Terms(dict):
    """Terms of a token: itself in lower case and its outline; remembered up to a bound."""

    def __missing__(self, token: bytes) -> tuple[str, str]:
        out = ("w" + token.decode().lower(), "s" + shape(token))
        if len(token) <= KEPT:
            if len(self) > 300_000:
                self.clear()
            self[token] = out
        return out


def term_counts(text: str | None) -> dict[str, float]:
    """Weighted terms of a whole text: how its words look, which common words it has, how much it repeats itself.

    Outlines and repeats are graded: a term for each doubling of their share, so
    that how much of a text is made of them shows beside whether it has any.
    """
    tokens = (text or "").encode().split()
    known = held("terms", "terms", Terms)
    out: dict[str, float] = {"_": 1.0}
    if not tokens:
        return out | {"empty": 3.0}
    shapes: Counter[str] = Counter()
    for token, n in Counter(tokens).items():
        word, form = known[token]
        out[word] = out.get(word, 0.0) + n
        shapes[form] += n
    scale = 0.5 / log(1 + len(tokens))
    out = {k: scale * log(1 + v) for k, v in out.items()}
    twice = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    graded = {"s-" + s[1:]: n / len(tokens) for s, n in shapes.items()} | {"distinct": len(set(tokens)) / len(tokens), "twice": twice / len(tokens), "length": min(1.0, len(tokens) / 4000), "line": min(1.0, (text or "").count("\n") / len(tokens))}
    for name, share in graded.items():
        grade = int(-2 * log2(max(share, 1e-4)))
        for k in range(28 - grade):
            out[f"{name}>{k}"] = 0.25
    return out


class _Sparse:
    """Rows of weighted terms: where each row's values begin, their columns and themselves."""

    def __init__(self, rows: list[tuple[list[int], list[float]]], weight: np.ndarray):
        sizes = np.array([len(at) for at, _ in rows], np.int64)
        self.shape, self.row = (len(rows), len(weight)), np.repeat(np.arange(len(rows)), sizes)
        self.at = np.concatenate([np.array(at, np.int64) for at, _ in rows]) if rows else np.zeros(0, np.int64)
        values = np.concatenate([np.array(v, np.float64) for _, v in rows]) if rows else np.zeros(0)
        self.values = values * weight[self.at] if len(self.at) else values

    @staticmethod
    def _sums(to: np.ndarray, of: np.ndarray, values: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        """Rows of ``dense`` by ``of``, times values, summed by sorted ``to``; a portion at a time."""
        out = np.zeros((n, dense.shape[1]))
        for k in range(0, len(to), PORTION):
            mine = to[k : k + PORTION]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
            out[mine[first]] += np.add.reduceat(dense[of[k : k + PORTION]] * values[k : k + PORTION, None], first, axis=0)
        return out

    def times(self, dense: np.ndarray) -> np.ndarray:
        return self._sums(self.row, self.at, self.values, dense, self.shape[0])

    def turned_times(self, dense: np.ndarray) -> np.ndarray:
        order = np.argsort(self.at, kind="stable")
        return self._sums(self.at[order], self.row[order], self.values[order], dense, self.shape[1])


def axes_of(rows: _Sparse, many: int) -> np.ndarray:
    """The first right singular vectors: exactly for few rows, else within directions that rounds of products with the rows make those of most variance; the same for the same rows."""
    n, terms = rows.shape
    if not n or not terms:
        return np.zeros((terms, 0))
    if n <= EXACT:
        basis = np.eye(n)
    else:
        basis = rows.times(np.random.default_rng(6).standard_normal((terms, many + SPARE)))
        for _ in range(ROUNDS):
            basis = rows.times(rows.turned_times(np.linalg.qr(basis)[0]))
        basis = np.linalg.qr(basis)[0]
    small = rows.turned_times(basis)
    values, turn = np.linalg.eigh(small.T @ small)
    values, turn = values[::-1][:many], turn[:, ::-1][:, :many]
    some = values > max(values[0], 0.0) * 1e-12
    return small @ turn[:, some] / np.sqrt(values[some])


class Space:
    """Latent-semantic axes of the sample's terms, and the labelled vectors in them.

    ``taught`` has of each row its label and its values of ``terms``, by
    number; ``holds`` says how many rows hold each term.
    """

    def __init__(self, terms: list[str], holds: list[int], taught: list[tuple[int, list[int], list[float]]]):
        self.place = {k: i for i, k in enumerate(terms)}
        weight = np.log1p(len(taught) / np.array(holds or [1]))[: len(terms)]
        self.labels = np.array([t[0] for t in taught], np.float32)
        rows = _Sparse([t[1:] for t in taught], weight)
        axes = axes_of(rows, DIMENSIONS)
        self.vectors = self._unit(rows.times(axes).astype(np.float32))
        # weights belong to the axes from here on
        self.axes = np.ascontiguousarray(axes * weight[:, None], np.float32)

    def numbered(self, terms: dict[str, float]) -> tuple[list[int], list[float]]:
        known = [(p, v) for t, v in terms.items() if (p := self.place.get(t)) is not None]
        return ([p for p, _ in known], [v for _, v in known])

    def _placed(self, found: list[tuple[list[int], list[float]]]) -> np.ndarray:
        """Texts, as numbered terms, on the axes."""
        rows = _Sparse(found, np.ones(len(self.place)))
        return rows.times(self.axes).astype(np.float32)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Votes for label 1 by cosine, among the nearest; a half where nothing was learnt."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        cosines = self._unit(self._placed([self.numbered(term_counts(t)) for t in texts])) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosines, near, axis=1).astype(np.float64), 1e-6) ** 8
        return np.clip((votes * self.labels[near]).sum(axis=1) / votes.sum(axis=1), 0, 1)


def _scored(space, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = space.value
        for some in sliced(batches, BLOCK, 8_000_000):
            score = model.score(some.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in sliced(batches, BLOCK, 8_000_000):
        found = [term_counts(t) for t in some.column("text").to_pylist()]
        lists = [pa.array([list(f) for f in found], pa.list_(pa.string())), pa.array([list(f.values()) for f in found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("label"), some.column("text_hash"), *lists], names=["doc_id", "label", "text_hash", "terms", "amounts"])


def learn(rows: DataFrame, chosen: DataFrame) -> Space:
    """The space of the chosen rows' terms. Terms are counted where texts are read; the driver gets those of more rows than one, and of each row its values of these, by number."""
    taught = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", F.col("_label").cast("int").alias("label"), F.xxhash64("text").alias("text_hash"), "text")
    taught = materialize(taught.mapInArrow(_terms, "doc_id long, label int, text_hash long, terms array<string>, amounts array<double>"), "taught")
    holds = taught.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    common = holds.orderBy("term").collect()
    known = {r.term for r in common}
    place = {r.term: k for k, r in enumerate(common)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [[(place[t], v) for t, v in zip(*x, strict=True) if t in known] for x in zip(batch.column("terms").to_pylist(), batch.column("amounts").to_pylist(), strict=True)]
            lists = [pa.array([np.array([p[k] for p in some], kind).tobytes() for some in pairs], pa.binary()) for k, kind in enumerate((np.int64, np.float64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label", "text_hash")), *lists], names=["doc_id", "label", "text_hash", "at", "amounts"])

    # as bytes, a tenth of what lists of numbers take on the driver
    gathered = taught.mapInArrow(numbered, "doc_id long, label int, text_hash long, at binary, amounts binary").collect()
    gathered.sort(key=lambda r: r[:3])
    made = Space([r.term for r in common], [r.n for r in common], [(r.label, np.frombuffer(r.at, np.int64), np.frombuffer(r.amounts)) for r in gathered])
    release()
    return made


def score_quality(docs: DataFrame, labels: DataFrame, by: int = 3, held: int = 1, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, by its whole text; a map without a shuffle.

    About ``sample`` labelled rows that aren't held out build the space of all
    terms that two of them hold; it is broadcast with its vectors, all bounded
    by the sample's texts. A text of any length is scored whole. Every document is compared with every vector, a block
    of documents at a time.

    A null or empty text is scored like any other, by having no words. Rows
    whose label is null teach nothing; a repeated label counts once, an id with
    two labels once for each, and each row of a repeated id teaches. With no
    labels at all every score is 0.5. Ties at the edge of the nearest fall by
    position in the sample, which is ordered by id. Repeated rows score alike,
    a null id isn't held out, other columns are ignored, whatever their names,
    and an empty table gives none.
    """
    out = F.coalesce(crc_fold("doc_id", by) == held, F.lit(False))
    known = labels.where(F.col("quality").isNotNull() & ~crc_fold("doc_id", by).eqNullSafe(F.lit(held))).select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_label")).distinct()
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    space = docs.sparkSession.sparkContext.broadcast(learn(rows.where("not held_out"), chosen))
    return rows.mapInArrow(_scored(space, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
