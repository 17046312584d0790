"""Operator 2: greedy word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import CACHE, KEPT, documents, held


class LongestMatch:
    """How many pieces greedy longest-match cuts a word into, in one pass over its bytes.

    A trie of the pieces, where each node has the number of pieces that its
    failure link pops and the node that remains. Reading a byte with no child
    follows links, adding their counts; no piece is ever built. ``follow``
    marks pieces inside a word (such as ``##``); empty means that pieces may
    stand anywhere. A word that can't be cut whole counts as one unknown piece.
    """

    def __init__(self, pieces: Iterable[bytes], follow: bytes = b""):
        self.child: dict[int, int] = {}
        self.accepts: list[bool] = [False]
        self.root, parent, edge, inside = 0, [0], [0], [False]

        def add(node: int, piece: bytes) -> int:
            for byte in piece:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.accepts)
                    self.accepts.append(False)
                    parent.append(node)
                    edge.append(byte)
                node = self.child[key]
            return node

        self.inner = add(0, follow) if follow else 0
        for piece in pieces:
            if piece and piece != follow:
                self.accepts[add(0, piece)] = True
        n = len(self.accepts)
        self.link, self.pops = [-1] * n, [0] * n
        depth = [0] * n
        for node in range(1, n):
            depth[node] = 0 if node == self.inner else depth[parent[node]] + 1
        for node in sorted(range(1, n), key=depth.__getitem__):
            if node == self.inner:
                continue
            if self.accepts[node]:
                self.link[node], self.pops[node] = self.inner, 1
                continue
            at, popped = self.link[parent[node]], self.pops[parent[node]]
            while at >= 0 and (at << 8 | edge[node]) not in self.child:
                at, popped = self.link[at], popped + self.pops[at]
            if at >= 0:
                self.link[node], self.pops[node] = self.child[at << 8 | edge[node]], popped
        self.cache: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of one word (1 for a word that isn't covered, 0 for an empty one)."""
        node, total, child, link, pops = self.root, 0, self.child, self.link, self.pops
        for byte in word:
            while (to := child.get(node << 8 | byte)) is None:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node != self.inner and node != self.root:
            total += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return total

    def __call__(self, word: bytes) -> int:
        if (n := self.cache.get(word)) is None:
            n = self.count(word)
            if len(word) <= KEPT:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[word] = n
        return n


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a rank file: a base64 piece and a number on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def automaton(path: str) -> LongestMatch:
    return held(f"automaton of {path}", "tool", lambda: LongestMatch(load_pieces(path)))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = automaton(path)
        for batch in batches:
            n_words, n_pieces = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = text.encode().split() if text else []
                n_words[k], n_pieces[k] = len(found), sum(map(pieces, found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_pieces)], names=["doc_id", "n_words", "n_tokens"])

    return run


def count_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_words`` and ``n_tokens`` of every whole text; a map without a shuffle.

    Words are cut at ASCII blanks and taken as they are, each with the blank
    before it left out. A null or empty text has 0 of both. Repeated rows are
    counted each; other columns are ignored, whatever their names; an empty
    table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_count(path), "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
