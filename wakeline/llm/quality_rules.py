"""Operator 7: quality rules with line frequencies across the documents of a host."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import materialize
from .text import documents, fresh, mix, sliced, word_hashes

#: Base rules: fewer words, or a larger share (percent) of words in repeated windows of 8, fail.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A line of more documents of its host than this is boilerplate there.
LINE_DOCUMENTS = 10
#: A document with a smaller share (percent) of its words left without such lines is depleted.
LEFT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Below this many boilerplate lines (8 bytes each) all workers get them; above it rows of lines are joined.
BROADCAST_LINES = 500_000
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>, digest long"


def line_key(host: bytes, words: list[bytes]) -> int:
    """Of a host's line as its words, A-Z lower-cased, one blank between. Case and spacing don't count."""
    return int.from_bytes(xxhash.xxh3_64_digest(host + b"\n" + b" ".join(words).lower()), signed=True)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 which the text holds more than once."""
    if len(words) <= WINDOW:
        return 0
    one, n = word_hashes().of(words), len(words) - WINDOW + 1
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + mix(one[k : k + n])
    order = np.argsort(window)
    equal = window[order][1:] == window[order][:-1]
    if not equal.any():
        return 0
    again = np.zeros(n, np.int64)
    again[order[1:][equal]] = 1
    again[order[:-1][equal]] = 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[WINDOW : WINDOW + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def line_keys(text: str | None, host: bytes) -> tuple[list[int], int]:
    """Distinct keys of a text's lines, and a digest of all of them in order."""
    every = [line_key(host, found) for line in (text or "").encode().split(b"\n") if (found := line.split())]
    return list(dict.fromkeys(every)), digest(every)


def digest(keys: list[int]) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(np.array(keys, np.int64).tobytes()), signed=True)


def measure(text: str | None, host: bytes = b"") -> tuple:
    """Counts of one text, its distinct lines' keys with the words of all their occurrences, and a digest of all its lines in order."""
    raw = (text or "").encode()
    every: list[bytes] = []
    seen: set[bytes] = set()
    counts: Counter[int] = Counter()
    order: list[int] = []
    duplicates = 0
    for line in raw.split(b"\n"):
        if words := line.split():
            every += words
            duplicates += line in seen
            seen.add(line)
            order.append(key := line_key(host, words))
            counts[key] += len(words)
    chars = sum(len(w) for w in every)
    if not raw.isascii():
        joined = np.frombuffer(b"".join(every), np.uint8)
        chars = int(((joined & 0xC0) != 0x80).sum())
    symbols = sum(raw.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))
    return len(every), chars, symbols, duplicates, repeated_words(every), list(counts), list(counts.values()), digest(order)


def fails(n_words, n_repeat_words):
    """The base rules, of numbers or of columns."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def _measured(kept: list[str]):
    names = [x.split()[0] for x in MEASURES.split(", ")]
    types = [pa.list_(pa.int64()) if "array" in x else pa.int64() for x in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in sliced(batches, 1000, 8_000_000):
            found = [measure(t, h.encode()) for t, h in zip(some.column("text").to_pylist(), some.column("host").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), *(pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True))], names=[*kept, *names])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in sliced(batches, 1000, 8_000_000):
        found = [line_keys(t, h.encode()) for t, h in zip(some.column("text").to_pylist(), some.column("host").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.int64())], names=["lines", "digest"])


def host_of(docs: DataFrame) -> Column:
    """A null source is a host of its own."""
    return F.coalesce(docs["source"], F.lit("\0"))


def common_lines(lines: DataFrame, line_documents: int = LINE_DOCUMENTS) -> DataFrame:
    """Of rows (line, digest): lines of more different documents than the limit. A partial aggregate, so neither a large host nor a common line gathers in one task."""
    once = lines.select("line", "digest").distinct()
    return once.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") > line_documents).select("line")


def judge(docs: DataFrame, line_documents: int = LINE_DOCUMENTS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """A row for each row of ``docs``: the counts, ``base_failed``, ``kept`` and ``removed``, the keys of its boilerplate lines.

    A line (its words in lower case) is counted once for each different
    document of the host (``source``); copies of a document, which have the
    same lines in the same order, count as one by a digest of all of them, so a
    group of copies isn't boilerplate to itself. Lines of more documents than
    the limit are removed; a document that keeps too small a share of its words
    is rejected.

    A null or empty text has zero counts and fails the base rules; a null
    source is a host of its own. Rows that share an id are judged apart, each
    by its own text; repeated rows alike. A count that equals a limit passes.
    Other columns are ignored, whatever their names; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host_of(docs).alias("host"), F.xxhash64("text").alias("text_hash"), "text")
    kept = ["doc_id", "host", "text_hash"]
    measured = materialize(rows.mapInArrow(_measured(kept), f"doc_id long, host string, text_hash long, {MEASURES}"), "measured")
    lines = measured.select(*kept, "digest", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(*kept, "digest", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = lines.join(common_lines(lines, line_documents), "line").groupBy(*kept).agg(F.collect_set(F.struct("line", "words")).alias("found"))
    removed = removed.select(*(F.col(c).alias(f"_{c}") for c in kept), F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("gone"), F.col("found.line").alias("removed"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("host") == F.col("_host")) & (F.col("text_hash") == F.col("_text_hash"))
    out = measured.join(removed, same, "left")
    failed = fails(F.col("n_words"), F.col("n_repeat_words"))
    depleted = 100 * (F.col("n_words") - F.coalesce("gone", F.lit(0))) < left_percent * F.col("n_words")
    return out.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed")


def without(text: str, host: bytes, gone) -> str:
    """The text without its lines of these keys."""
    return "\n".join(x for x in text.split("\n") if not (w := x.encode().split()) or line_key(host, w) not in gone)


def _cleaned(names: list[str], host: str, judge_of: Callable):
    """Rows of columns ``names`` that the judge keeps, without the lines that it names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict = judge_of()
        for batch in sliced(batches, 1000, 8_000_000):
            text, hosts, stay = batch.column("text").to_pylist(), batch.column(host).to_pylist(), []
            for k, (good, gone) in enumerate(verdict(batch)):
                stay.append(good)
                if good and gone:
                    text[k] = without(text[k], hosts[k].encode(), gone)
            sizes = batch.column("n_chars").to_pylist() if "n_chars" in names else []
            columns = {"text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) if t != old else n for t, old, n in zip(text, batch.column("text").to_pylist(), sizes, strict=False)], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in names], names=names).filter(pa.array(stay, pa.bool_()))

    return run


def keep_good(docs: DataFrame, line_documents: int = LINE_DOCUMENTS, left_percent: int = LEFT_PERCENT) -> DataFrame:
    """The rows that pass :func:`judge`, without the boilerplate lines of their host; ``n_chars``, if there, of what is left.

    Lines are counted in one pass that shuffles their keys alone. Up to
    ``BROADCAST_LINES`` boilerplate lines go to all workers, and a second pass
    judges and cleans each text where it is read; beyond that the verdicts are
    joined, which shuffles each text once. The result is the same.

    Null, empty and repeated rows are judged like others, so texts of fewer
    words than the rules ask for go. All columns stay, whatever their names.
    An empty table gives none.
    """
    names = docs.columns
    host, key = fresh(names, "host", "text_hash")
    rows = docs.withColumns({"text": F.col("text"), **({"n_chars": F.col("n_chars").cast("long")} if "n_chars" in names else {})})
    schema = rows.schema
    lines = docs.select(host_of(docs).alias("host"), "text").mapInArrow(_keyed, "lines array<long>, digest long")
    common = materialize(common_lines(lines.select("digest", F.explode("lines").alias("line")), line_documents), "common_lines")
    if common.count() <= BROADCAST_LINES:
        found = docs.sparkSession.sparkContext.broadcast(np.array([r.line for r in common.collect()], np.int64))

        def by_lines():
            gone = frozenset(found.value.tolist())

            def verdict(batch: pa.RecordBatch) -> Iterator[tuple[bool, frozenset | None]]:
                for text, at in zip(batch.column("text").to_pylist(), batch.column(host).to_pylist(), strict=True):
                    n, _, _, _, again, lines, words, _ = measure(text, at.encode())
                    less = sum(w for line, w in zip(lines, words, strict=True) if line in gone)
                    yield not fails(n, again) and 100 * (n - less) >= left_percent * n, gone if less else None

            return verdict

        return rows.withColumn(host, host_of(docs)).mapInArrow(_cleaned(names, host, by_lines), schema)

    _id, _host, _key, _kept, _removed = fresh([*names, host, key], "id", "at", "of", "kept", "removed")
    judged = judge(docs, line_documents, left_percent).where("not kept or removed is not null")
    judged = judged.select(F.col("doc_id").alias(_id), F.col("host").alias(_host), F.col("text_hash").alias(_key), F.col("kept").alias(_kept), F.array_sort("removed").alias(_removed)).distinct()
    keyed = rows.withColumns({host: host_of(docs), key: F.xxhash64("text")})
    joined = keyed.join(judged, F.col("doc_id").cast("long").eqNullSafe(F.col(_id)) & (F.col(host) == F.col(_host)) & (F.col(key) == F.col(_key)), "left").where(F.coalesce(_kept, F.lit(True)))

    def listed():
        return lambda batch: ((True, set(gone) if gone else None) for gone in batch.column(_removed).to_pylist())

    return joined.select(*names, host, _removed).mapInArrow(_cleaned(names, host, listed), schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("removed", "host", "text_hash")
