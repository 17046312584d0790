"""What the operators share: words, hashes and Arrow loops."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII blanks 0x20 and 0x09-0x0D; ``bytes.split`` cuts at just these.
WORD = r"[^\x20\x09-\x0D]+"
#: Entries of a worker's word caches, and bytes of a word that is kept; a cache that is full starts anew.
CACHE, KEPT = 150_000, 64


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, with A-Z lower-cased and nothing else changed."""
    return text.encode().lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to ``CACHE`` entries."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_held: dict[str, dict] = {}


def held(user: str, name: str, make: Callable):
    """A table that this process keeps between tasks. A worker serves one operator after another, so what another user held goes."""
    if user not in _held:
        _held.clear()
    mine = _held.setdefault(user, {})
    if name not in mine:
        mine[name] = make()
    return mine[name]


def alone() -> None:
    """Drop what this process keeps for other operators; for one that keeps nothing itself between tasks."""
    _held.clear()


def word_hashes(user: str = "words") -> WordHashes:
    return held(user, "hashes", WordHashes)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the murmur3 one)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; with fewer words, of the one sequence there is."""
    n = min(width, len(hashes))
    if not n:
        return hashes
    out = np.full(len(hashes) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = mix(out + hashes[k : len(hashes) - n + 1 + k]) if k == n - 1 else out * np.uint64(0x9E3779B97F4A7C15) + mix(hashes[k : len(hashes) - n + 1 + k])
    return np.unique(out)


def release() -> None:
    """Give back what this process no longer needs: a worker serves one operator after another, and its memory stays at the most that any took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and about so many bytes of ``text``; a longer text is a slice of its own."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of ``names`` has, whatever its case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def crc_fold(column: str, by: int) -> F.Column:
    """crc32 of the id written as text, modulo ``by``: the split of training and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
