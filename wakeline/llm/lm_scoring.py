"""Operator 8: an interpolated modified Kneser-Ney bigram model over memory-mapped hash arrays."""

from __future__ import annotations

import os
import uuid
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import materialize
from ..plans.materialize import scratch_root
from .text import KEPT, crc_fold, documents, held, mix, word_hashes, words

#: The end of a text is a token of its own; no word is empty. A text's first word follows the start, whose number no word has.
END, START, WIDE_START = b"", 0xFFFFFFFF, 1 << 62
#: Texts read together: about so many tokens at once. Words whose numbers a worker keeps.
TOKENS, NUMBERED = 1_000_000, 400_000
#: Bytes of text for one shard of the model's arrays, whose number grows with them; shards are ranges of hashes.
SHARD_BYTES, LEAST_SHARDS = 14_000_000, 8
#: Files that a worker keeps mapped; the one not used for longest gives way.
MAPPED = 512
#: From so many distinct words on, two numbers don't make one key of 64 bits, and keys of pairs are hashes.
WIDE = START


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write whole and rename, so that a repeated task leaves the same file."""
    path = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(path, "wb") as out:
        np.save(out, array)
    os.replace(path, f"{folder}/{name}.npy")


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in 1, 2, 4 or 8 bytes, as their greatest needs."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)


def _pack(*arrays: np.ndarray) -> bytes:
    """Sorted keys as differences, then the other columns in the bytes they need, deflated."""
    keys = np.diff(arrays[0].astype(np.uint64), prepend=np.uint64(0))
    columns = [_small(a) for a in arrays[1:]]
    sizes = bytes(c.itemsize for c in columns)
    return zlib.compress(sizes + keys.view(np.uint8).reshape(-1, 8).T.tobytes() + b"".join(c.tobytes() for c in columns), 1)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    sizes, at = list(raw[:columns]), columns
    n = (len(raw) - columns) // (8 + sum(sizes))
    out = [np.cumsum(np.frombuffer(raw, np.uint8, n * 8, at).reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64)]
    at += 8 * n
    for size in sizes:
        out.append(np.frombuffer(raw, f"<u{size}", n, at).astype(np.int64))
        at += n * size
    return out


def _shard_cuts(sorted_keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of 64-bit keys begins."""
    step = (1 << 64) // shards
    return np.append(np.searchsorted(sorted_keys, np.arange(shards, dtype=np.uint64) * np.uint64(step)), len(sorted_keys))


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct sorted keys with the sums of their columns."""
    if not len(keys):
        return keys, *columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], *(np.add.reduceat(c[order].astype(np.int64), first) for c in columns)


def _texts(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Rows with their tokens, in groups of about ``TOKENS``."""
    rows, tokens, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            for row in zip(*(some.column(c).to_pylist() for c in columns), strict=True):
                found = words(row[-1])
                found.append(END)
                rows.append(row[:-1])
                tokens.append(found)
                n += len(found)
                if n >= TOKENS:
                    yield rows, tokens
                    rows, tokens, n = [], [], 0
    if rows:
        yield rows, tokens


def _blobs(shards: int, keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    cuts = _shard_cuts(keys, shards)
    full = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
    data = [_pack(keys[cuts[s] : cuts[s + 1]], *(c[cuts[s] : cuts[s + 1]] for c in columns)) for s in full]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])


def _count_words(shards: int):
    def run(batches):
        for _, tokens in _texts(batches, ["text"]):
            counts: Counter[bytes] = Counter()
            for found in tokens:
                counts.update(found)
            keys, sums = _summed(word_hashes("lm").of(list(counts)), np.fromiter(counts.values(), np.int64, len(counts)))
            yield _blobs(shards, keys, sums)

    return run


def _by_shard(batches: Iterator[pa.RecordBatch], columns: int, fixed: int = 0) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each shard, from blobs that arrive sorted by shard; blobs are merged eight at a time. All columns are summed but the first ``fixed``, which a key determines."""
    now, held = None, []

    def merged() -> list[np.ndarray]:
        keys, *rest = (np.concatenate([h[k] for h in held]) for k in range(columns + 1))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return [keys[first], *(c[order][first] for c in rest[:fixed]), *(np.add.reduceat(c[order], first) for c in rest[fixed:])]

    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if now is not None and shard != now:
                yield now, merged()
                held = []
            now = shard
            held.append(_unpack(blob, columns))
            if len(held) >= 8:
                held = [merged()]
    if held:
        yield now, merged()


def _store_words(folder: str):
    def run(batches):
        for shard, (keys, counts) in _by_shard(batches, 1):
            _save(folder, f"words-{shard}", keys)
            _save(folder, f"counts-{shard}", _small(counts))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["shard", "n", "total"])

    return run


class Arrays:
    """Sorted hash arrays of all shards, mapped into this process, ``MAPPED`` files at a time, and looked up by binary search."""

    def __init__(self, folder: str, shards: int, bases: list[int]):
        self.folder, self.shards, self.bases = folder, shards, np.array(bases, np.int64)
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()
        self.ids: dict[bytes, int] = {}

    def get(self, name: str) -> np.ndarray | None:
        if name not in self.open:
            try:
                loaded = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
            except FileNotFoundError:
                return None
            if len(self.open) >= MAPPED:
                # a map is closed with the last array on it
                self.open.popitem(last=False)
            self.open[name] = loaded
        self.open.move_to_end(name)
        return self.open[name]

    def places(self, name: str, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For sorted keys, by shard: the keys' numbers and their places in the shard, of those that are there."""
        cuts = _shard_cuts(keys, self.shards)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            have = self.get(f"{name}-{s}")
            if have is not None and len(have):
                part = keys[cuts[s] : cuts[s + 1]]
                at = np.minimum(np.searchsorted(have, part), len(have) - 1)
                hit = np.flatnonzero(have[at] == part)
                yield s, cuts[s] + hit, at[hit]

    def word_ids(self, tokens: list[list[bytes]]) -> np.ndarray:
        """Numbers of all tokens in a row, -1 for a word that isn't known."""
        flat = [w for found in tokens for w in found]
        new = list(set(flat).difference(self.ids))
        if new:
            if len(self.ids) + len(new) > NUMBERED:
                self.ids.clear()
                new = list(set(flat))
            keys = word_hashes("lm").of(new)
            order = np.argsort(keys)
            found = np.full(len(new), -1, np.int64)
            for s, which, at in self.places("words", keys[order]):
                found[order[which]] = self.bases[s] + at
            self.ids.update(zip(new, found.tolist(), strict=True))
        out = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        for word in new:
            if len(word) > KEPT:
                del self.ids[word]
        return out

    def by_id(self, names: list[str], ids: np.ndarray) -> list[np.ndarray]:
        """Values of columns of the words' shards for known ids, 0 elsewhere."""
        every, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(names), len(every)), np.int64)
        shard = np.searchsorted(self.bases, every, "right") - 1
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(every) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(every)], strict=True):
            s, a = int(shard[a]), a if every[a] >= 0 else a + 1
            if s < 0 or a == b:
                continue
            for k, name in enumerate(names):
                if (have := self.get(f"{name}-{s}")) is not None:
                    out[k, a:b] = have[every[a:b] - self.bases[s]]
        return [column[back] for column in out]


def _arrays(folder: str, shards: int, bases: list[int]) -> Arrays:
    model = held("lm", "arrays", lambda: Arrays(folder, shards, bases))
    return model if model.folder == folder else _fresh(folder, shards, bases)


def _fresh(folder: str, shards: int, bases: list[int]) -> Arrays:
    """The arrays of another model, in place of the last one's."""
    held("", "", dict)
    return held("lm", "arrays", lambda: Arrays(folder, shards, bases))


def _history(ids: np.ndarray, tokens: list[list[bytes]], start: int) -> np.ndarray:
    """The number before each token; the start before each text's first."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum([0, *map(len, tokens[:-1])])] = start
    return before


def _pair(before: np.ndarray, ids: np.ndarray, wide: bool) -> np.ndarray:
    """A key for each pair of numbers: a bijection where they have 32 bits each, so that pairs never clash; else a hash."""
    if wide:
        return mix(mix(before.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64))
    return mix(before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))


def _count_pairs(folder: str, shards: int, bases: list[int], wide: bool):
    def run(batches):
        model = _arrays(folder, shards, bases)
        for _, tokens in _texts(batches, ["text"]):
            ids = model.word_ids(tokens)
            before = _history(ids, tokens, WIDE_START if wide else START)
            keys = _pair(before, ids, wide)
            if wide:
                order = np.argsort(keys)
                keys, before, ids = keys[order], before[order], ids[order]
            else:
                keys.sort()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.diff(np.append(first, len(keys)))
            yield _blobs(shards, keys[first], *((before[first], ids[first]) if wide else ()), counts)

    return run


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    for factor in (pow(0xC4CEB9FE1A85EC53, -1, 1 << 64), pow(0xFF51AFD7ED558CCD, -1, 1 << 64)):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _store_pairs(folder: str, bases: list[int], wide: bool):
    """Stores the pairs; gives what each word has as a history, and in how many pairs it comes second."""
    starts = np.array(bases, np.int64)
    names = ["kind", "shard", "data", "counts"]

    def parts(kind: int, ids: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        cuts = np.append(np.searchsorted(ids, starts.astype(np.uint64)), len(ids))
        full = [s for s in range(len(starts)) if cuts[s] < cuts[s + 1]]
        data = [_pack(ids[cuts[s] : cuts[s + 1]], *(c[cuts[s] : cuts[s + 1]] for c in columns)) for s in full]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(data, pa.binary()), pa.array([None] * len(full), pa.list_(pa.int64()))], names=names)

    def run(batches):
        for shard, (keys, *ends, counts) in _by_shard(batches, 3, 2) if wide else _by_shard(batches, 1):
            _save(folder, f"pairs-{shard}", keys)
            _save(folder, f"pair_counts-{shard}", _small(counts))
            both = None if wide else _unmix(keys)
            first, second = (e.astype(np.uint64) for e in ends) if wide else (both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))
            yield parts(0, *_summed(first, counts, counts == 1, counts == 2, counts > 2))
            yield parts(1, *_summed(second, np.ones(len(second), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([shard], pa.int32()), pa.array([None], pa.binary()), pa.array([[*_counts_of_counts(counts), len(keys)]], pa.list_(pa.int64()))], names=names)

    return run


def _store_histories(folder: str, bases: list[int], sizes: list[int], wide: bool):
    """Aligned with the words: total and kinds of successors; the start's own are in files of their own."""

    def run(batches):
        for shard, (ids, total, one, two, more) in _by_shard(batches, 4):
            start = ids == (WIDE_START if wide else START)
            known = (ids[~start] - np.uint64(bases[shard])).astype(np.int64)
            for name, values in (("total", total), ("one", one), ("two", two), ("more", more)):
                column = np.zeros(sizes[shard], np.int64)
                column[known] = values[~start]
                _save(folder, f"{name}-{shard}", _small(column))
                if start.any():
                    _save(folder, f"start_{name}", values[start])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], names=["shard"])

    return run


def _store_continuations(folder: str, bases: list[int], sizes: list[int]):
    def run(batches):
        for shard, (ids, kinds) in _by_shard(batches, 1):
            column = np.zeros(sizes[shard], np.int64)
            column[(ids - np.uint64(bases[shard])).astype(np.int64)] = kinds
            _save(folder, f"kinds-{shard}", _small(column))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_counts_of_counts(kinds)], pa.list_(pa.int64())), pa.array([[int((kinds == 1).sum()), int((kinds == 2).sum()), int((kinds > 2).sum())]], pa.list_(pa.int64()))], names=["shard", "counts", "kinds"])

    return run


def discounts(n: list[int]) -> list[float]:
    """For counts of 1, 2 and more, from how many counts are 1, 2, 3 and 4; half a count where that tells nothing."""
    if not all(n[:2]):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in range(3)]
    return [d if 0 < d <= k + 1 else 0.5 for k, d in enumerate(out)]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(folder: str, shards: int, bases: list[int], known: dict, wide: bool):
    n, v = known["tokens"], known["words"]
    pair_cut, word_cut = (np.array([0.0, *known[x]]) for x in ("pair_discounts", "word_discounts"))
    kinds_total = max(1, known["pairs"])
    spread = float(np.dot(word_cut[1:], known["word_kinds"])) / kinds_total if known["pairs"] else 1.0

    def run(batches):
        model = _arrays(folder, shards, bases)
        start = {x: int(s[0]) if (s := model.get(f"start_{x}")) is not None else 0 for x in ("total", "one", "two", "more")}
        for rows, tokens in _texts(batches, ["doc_id", "held_out", "text"]):
            ids = model.word_ids(tokens)
            before = _history(ids, tokens, WIDE_START if wide else START)
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            edges = np.cumsum(sizes) - sizes
            opens = before == (WIDE_START if wide else START)
            counts, kinds, *own = model.by_id(["counts", "kinds", "total", "one", "two", "more"], ids)
            low = np.maximum(kinds - word_cut[np.minimum(kinds, 3)], 0) / kinds_total + spread / (v + 1)
            # a token's history is the token before it
            total, one, two, more = (np.where(opens, start[x], np.append(0, c[:-1])) for x, c in zip(start, own, strict=True))
            seen = np.zeros(len(ids), np.int64)
            both = np.flatnonzero((ids >= 0) & (before >= 0))
            keys = _pair(before[both], ids[both], wide)
            order = np.argsort(keys)
            for s, which, at in model.places("pairs", keys[order]):
                seen[both[order[which]]] = model.get(f"pair_counts-{s}")[at]
            held = np.maximum(total, 1)
            back = np.where(total > 0, (pair_cut[1] * one + pair_cut[2] * two + pair_cut[3] * more) / held, 1.0)
            p = np.maximum(seen - pair_cut[np.minimum(seen, 3)], 0) / held + back * low
            base = np.log10((counts + 1) / (n + v + 1))
            add = lambda x: np.add.reduceat(x, edges)
            columns = [[r[0] for r in rows], [r[1] for r in rows], sizes, add((counts > 0).astype(np.int64)), np.full(len(rows), n), add(base), add(np.log10(p))]
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def score_documents(docs: DataFrame, by: int = 7, held: int = 2) -> DataFrame:
    """Base and Kneser-Ney log10 probabilities of every whole text, learnt from those not held out.

    Words, then pairs, are counted per task and merged by hash ranges: a shuffle
    of packed arrays, whose size follows the distinct words and pairs of a task.
    Each range is stored as sorted arrays in the shared folder, which workers
    map into memory, a bounded number of files at a time; texts are read three
    times, and once for their sizes, and never shuffled. Ranges grow with the
    bytes of all texts, so few long texts have as many as many short ones. The
    driver gets a row of sums for each range. A text of any length is counted
    and scored whole, in one task, at some 100 bytes a word.

    ``spark.checkpoint.dir`` must be a mounted folder (``file:``). A null or
    empty text is its end alone. Without training rows every token is unknown.
    A null id has no remainder and is learnt from. Repeated rows count each and
    score alike; other columns are ignored, whatever their names; an empty
    table gives none.
    """
    spark = docs.sparkSession
    root = scratch_root(spark)
    if "://" in root and not root.startswith("file:"):
        raise ValueError("the model's arrays need a mounted spark.checkpoint.dir that workers can map (file:)")
    folder = f"{'/' + root.removeprefix('file:').lstrip('/')}/lm-{uuid.uuid4().hex[:12]}"
    os.makedirs(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_fold("doc_id", by) == held, F.lit(False)).alias("held_out"), "text")
    train = rows.where("not held_out").select("text")
    shards = max(LEAST_SHARDS, int(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(shards, "shard").sortWithinPartitions("shard")

    blob = "shard int, data binary"
    stored = dealt(train.mapInArrow(_count_words(shards), blob)).mapInArrow(_store_words(folder), "shard int, n long, total long").collect()
    sizes, tokens = [0] * shards, 0
    for x in stored:
        sizes[x.shard], tokens = x.n, tokens + x.total
    bases = [0, *np.cumsum(sizes)[:-1].tolist()]
    wide = sum(sizes) >= WIDE

    pairs = dealt(train.mapInArrow(_count_pairs(folder, shards, bases, wide), blob)).mapInArrow(_store_pairs(folder, bases, wide), "kind int, shard int, data binary, counts array<long>")
    pairs = materialize(pairs, "histories")
    sums = pairs.where("kind = 2").agg(*(F.coalesce(F.sum(F.col("counts")[k]), F.lit(0)) for k in range(5))).first()
    pair_n, total = list(sums[:4]), sums[4]
    dealt(pairs.where("kind = 0").select("shard", "data")).mapInArrow(_store_histories(folder, bases, sizes, wide), "shard int").count()
    ends = dealt(pairs.where("kind = 1").select("shard", "data")).mapInArrow(_store_continuations(folder, bases, sizes), "shard int, counts array<long>, kinds array<long>").collect()
    word_n, word_kinds = [sum(x.counts[k] for x in ends) for k in range(4)], [sum(x["kinds"][k] for x in ends) for k in range(3)]
    known = {"tokens": tokens, "words": sum(sizes), "pairs": total, "pair_discounts": discounts(pair_n), "word_discounts": discounts(word_n), "word_kinds": word_kinds}
    return rows.mapInArrow(_score(folder, shards, bases, known, wide), SCORES)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
