"""Operator 1: near-duplicate documents by b-bit MinHash, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import connected_components, materialize
from .text import documents, mix, shingles, sliced, word_hashes, words

#: A set's 128 minima make bands of 5, or of fewer where a lower limit needs that; at a similarity of 0.85 all 25 bands of 5 miss once in two million pairs.
PERMUTATIONS, BAND_ROWS, BITS = 128, 5, 4
#: All bands may miss a pair at the limit as often as this at most.
MISSES = 1e-6
#: Links need 100 * intersection >= 85 * union; estimates may lie five deviations below.
PERCENT, DEVIATIONS = 85, 5.0
#: Rows of a block in comparisons within a bucket or group.
BLOCK = 512
#: Below this many candidate rows (16 bytes each) the list of candidates is broadcast.
BROADCAST_ROWS = 500_000
WORDS_OF_BITS = [f"s{k}" for k in range(PERMUTATIONS * BITS // 64)]

_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
_MASKS = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32)


def minima(found: np.ndarray) -> np.ndarray:
    """Least values of a shingle set under every permutation of 32 bits of its hashes."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(low, ((short[at : at + 1024, None] ^ _MASKS) * _FACTORS).min(axis=0), out=low)
    return low


def band_rows(percent: int = PERCENT) -> int:
    """The most minima in a band, ``BAND_ROWS`` at most, with which a pair at the limit is missed seldom enough."""
    missed = lambda r: (1 - (percent / 100) ** r) ** (PERMUTATIONS // r)
    return next((r for r in range(BAND_ROWS, 1, -1) if missed(r) <= MISSES), 1)


def bands(low: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    many = PERMUTATIONS // rows
    grouped = low[: many * rows].reshape(many, rows).astype(np.uint64)
    out = np.arange(1, many + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + grouped[:, k])
    return out.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of all minima, as 64-bit integers."""
    bits = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return np.bitwise_or.reduce(bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1).view(np.int64)


SKETCH = f"doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, {', '.join(f'{x} long' for x in WORDS_OF_BITS)}"


def set_digest(found: np.ndarray) -> tuple[int, int]:
    """Two sums over a set's hashes that tell sets apart, whatever the order."""
    return int(found.sum(dtype=np.uint64).view(np.int64)), int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _sketched(band: int):
    """Sizes, digests, bands of so many minima and low bits of the texts' shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for some in sliced(batches, 1000, 8_000_000):
            n = some.num_rows
            size, digest, banded, bits = np.zeros(n, np.int64), np.zeros((2, n), np.int64), [], np.zeros((n, len(WORDS_OF_BITS)), np.int64)
            for k, text in enumerate(some.column("text").to_pylist()):
                found = shingles(hashes.of(words(text)))
                size[k] = len(found)
                if not len(found):
                    banded.append([])
                    continue
                digest[:, k] = set_digest(found)
                low = minima(found)
                banded.append(bands(low, band))
                bits[k] = packed(low)
            columns = [some.column("doc_id"), some.column("text_hash"), pa.array(size), pa.array(digest[0]), pa.array(digest[1]), pa.array(banded, pa.list_(pa.int64())), *(pa.array(bits[:, k]) for k in range(bits.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCH.split(", ")])

    return run


def least_matches(percent: int = PERCENT, deviations: float = DEVIATIONS) -> int:
    """Equal low-bit values that a pair at the similarity limit has but for ``deviations``, collisions included."""
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * percent / 100
    return int(np.floor(PERMUTATIONS * (p - deviations * np.sqrt(p * (1 - p) / PERMUTATIONS))))


def matches(a: str, b: str) -> F.Column:
    """How many packed values of two rows are equal: bit counts of the fields that differ."""
    field = sum(1 << BITS * k for k in range(64 // BITS)) - 0
    field -= (1 << 64) if field >= 1 << 63 else 0
    differ = F.lit(0)
    for w in WORDS_OF_BITS:
        x = F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(field)))
    return F.lit(PERMUTATIONS) - differ


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows that arrive sorted by integer ``keys``."""
    open_, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        if last is not None and (key[0] != last).any():
            yield pa.concat_batches(open_)
            open_ = []
        last, start = key[-1], 0
        for cut in (np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist():
            yield pa.concat_batches([*open_, batch.slice(start, cut - start)]) if open_ else batch.slice(start, cut - start)
            open_, start = [], cut
        open_.append(batch.slice(start))
    if open_:
        yield pa.concat_batches(open_)


def forest(near: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the symmetric matrix ``near`` joins, at most one less than its rows."""
    left, out = np.ones(len(near), bool), []
    for first in range(len(near)):
        if not left[first]:
            continue
        left[first], stack = False, [first]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            out += [(int(names[at]), int(names[k])) for k in new]
            stack += new.tolist()
    return out


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _estimated(least: int):
    """Within a bucket's block pair: edges between classes whose estimate reaches the limit."""
    fields = np.uint64(sum(1 << BITS * k for k in range(64 // BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["bucket", "i", "j"]):
            classes = group.column("class").to_numpy()
            if (classes == classes[0]).all():
                continue
            bits = np.stack([group.column(w).to_numpy() for w in WORDS_OF_BITS], axis=1).view(np.uint64)
            differ = np.zeros((len(bits), len(bits)), np.int32)
            for k in range(bits.shape[1]):
                x = bits[:, k, None] ^ bits[None, :, k]
                x |= x >> np.uint64(2)
                x |= x >> np.uint64(1)
                differ += np.bitwise_count(x & fields)
            near = (PERMUTATIONS - differ >= least) & (classes[:, None] != classes)
            if near.any():
                yield _edges(forest(near, classes))

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of membership matrices, a slice of columns at a time."""
    sizes = np.array([len(s) for s in sets])
    every, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = np.repeat(np.arange(len(sets)), sizes), np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width = np.zeros((len(sets), len(sets)), np.float64), 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        member = np.zeros((len(sets), width), np.float32)
        member[owner[a:b], column[a:b] - at] = 1
        out += member @ member.T
    return out.astype(np.int64)


def _confirmed(percent: int):
    """Within a candidate group's block pair: edges between sets that are alike enough, all compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["class", "i", "j"]):
            sets = [np.frombuffer(x, np.uint64) for x in group.column("found").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            both = intersections(sets)
            near = 100 * both >= percent * (sizes[:, None] + sizes - both)
            np.fill_diagonal(near, False)
            if near.any():
                yield _edges(forest(near, group.column("rep").to_numpy()))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the classes' rows; a row that only shares its id with a class's goes."""
    hashes = word_hashes()
    for some in sliced(batches, 500, 8_000_000):
        found = [shingles(hashes.of(words(t))) for t in some.column("text").to_pylist()]
        own = pa.array([list(set_digest(f)) == of for f, *of in zip(found, *(some.column(c).to_pylist() for c in ("set_a", "set_b")), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("class", "rep", "n")), pa.array([f.tobytes() for f in found], pa.binary())], names=["class", "rep", "n", "found"]).filter(own)


def units_apart(held: DataFrame) -> DataFrame:
    """Rows (bucket, rep, class, i, j): what to compare of the buckets (bucket, rep, n, class) that hold several classes.

    Of two rows in different classes one isn't in the bucket's largest class.
    Such rows, in blocks i of twice ``BLOCK``, meet each block j of all rows; so few
    strays in a bucket of many alike cost a copy of each of its rows, and every
    pair of classes is still met.
    """
    parts = held.groupBy("bucket", "class").agg(F.count("*").alias("size"))
    mains = parts.groupBy("bucket").agg(F.max_by("class", F.struct("size", "class")).alias("main"), F.count("*").alias("kinds"), (F.sum("size") - F.max("size")).alias("strays")).where("kinds > 1")
    mains = mains.select("bucket", "main", F.ceil(F.col("strays") / (2 * BLOCK)).cast("long").alias("many"))
    rows = held.join(mains, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    i, j = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("many")), F.pmod(F.xxhash64("rep"), F.col("blocks"))
    strays = F.when(F.col("class") != F.col("main"), F.transform(every("blocks"), lambda k: F.struct(i.alias("i"), k.alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))
    others = F.transform(every("many"), lambda k: F.struct(k.alias("i"), j.alias("j")))
    # a stray is in its own unit by both
    return rows.withColumn("unit", F.explode(F.array_distinct(F.concat(strays, others)))).select("bucket", "rep", "class", "unit.i", "unit.j")


def confirmed_links(sets: DataFrame, percent: int) -> DataFrame:
    """Rows ``(node, component)`` of the sets (class, rep, n, found) that links join within their candidate group (class) of n.

    A group of up to ``BLOCK`` sets is compared whole. A larger one is dealt
    into blocks, each with the group's first set, so that every set moves
    once; this joins nearly all copies of a text. Then what is not in the
    group's largest component is compared with all blocks: of any two sets
    that are still apart, one is among these. So no link is lost, and a group
    of copies costs in proportion to its size.
    """
    compare = lambda units: units.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j").mapInArrow(_confirmed(percent), "a long, b long")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("rep"), blocks)
    every = lambda many: F.sequence(F.lit(0).cast("long"), many - 1)
    homes = F.when((F.col("rep") == F.col("class")) & (blocks > 1), every(blocks)).otherwise(F.array(own))
    edges = materialize(compare(sets.withColumn("i", F.explode(homes)).withColumn("j", F.col("i"))), "links")
    large = materialize(sets.where(F.col("n") > BLOCK).select("class", "rep", "n").distinct(), "large")
    if large.limit(1).count():
        placed = large.join(connected_components(edges, "a", "b"), F.col("rep") == F.col("node"), "left").select("class", "rep", "n", F.coalesce("component", "rep").alias("part"))
        parts = placed.groupBy("class", "part").agg(F.count("*").alias("size")).groupBy("class").agg(F.max_by("part", F.struct("size", "part")).alias("main"))
        rest = materialize(placed.join(parts, "class").where("part <> main").select("class", "rep", "n"), "rest")
        many = rest.groupBy("class").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("many"))
        left = rest.join(many, "class").select("class", "rep", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("many")).alias("i"), F.explode(every(blocks)).alias("j"))
        others = large.join(many, "class").select("class", "rep", F.explode(every(F.col("many"))).alias("i"), own.alias("j"))
        units = left.unionByName(others).distinct().join(sets.select("rep", "found"), "rep").select("class", "rep", "i", "j", "found")
        edges = edges.unionByName(materialize(compare(units), "links"))
    return connected_components(edges, "a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``text_hash`` and ``group`` of every row.

    Rows with the same set are one class at once. Classes that share a band are
    compared with the least of their bucket by bit counts; then what is still
    apart from most of its bucket meets all of it, in blocks of ``BLOCK``
    (:func:`units_apart`); that gives candidate groups, whose whole sets are compared by :func:`confirmed_links`. No list
    of pairs is made: a block gives a spanning forest.

    A null or empty text, or one of blanks, has no shingles, links with nothing
    and is kept. Each row is judged by its own text: a repeated row is like the
    first, and rows that share an id may belong to different groups, which
    ``group``, a number, tells apart (null without shingles). A row with a null
    id has a null component and is kept. A pair at the limit exactly is linked.
    Other columns are ignored, whatever their names; an empty table gives none.
    """
    limit = least_matches(percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    sketches = materialize(rows.mapInArrow(_sketched(band_rows(percent)), SKETCH), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    # classes go by a number of their set, as an id may stand for several texts
    key = F.xxhash64("set_a", "set_b")
    copies = materialize(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).select(key.alias("rep"), "set_a", "set_b", "least", "n"), "classes")
    reps = full.groupBy(key.alias("rep")).agg(F.first(F.struct("bands", *WORDS_OF_BITS)).alias("x")).select("rep", "x.*")
    reps = materialize(reps, "reps")

    banded = reps.select("rep", F.explode("bands").alias("bucket"))
    leads = banded.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(leads, "bucket").select("bucket", "rep", "lead", "n"), "buckets")
    bits = reps.select("rep", F.struct(*WORDS_OF_BITS).alias("bits"))
    stars = members.where("rep <> lead").select("rep", "lead").distinct()
    stars = stars.join(bits.withColumnRenamed("bits", "x"), "rep").join(bits.select(F.col("rep").alias("lead"), F.col("bits").alias("y")), "lead")
    grouping = connected_components(stars.where(matches("x", "y") >= limit), "rep", "lead").withColumnsRenamed({"node": "rep", "component": "class"})

    held = members.select("bucket", "rep", "n").join(grouping, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    apart = units_apart(held).join(reps.select("rep", *WORDS_OF_BITS), "rep").select("bucket", "i", "j", "class", *WORDS_OF_BITS)
    apart = apart.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    across = materialize(apart.mapInArrow(_estimated(limit), "a long, b long").distinct(), "across")
    if across.limit(1).count():
        merged = connected_components(across, "a", "b").withColumnsRenamed({"node": "class", "component": "wider"})
        every = grouping.unionByName(merged.select(F.col("class").alias("rep"), "class")).dropDuplicates(["rep"])
        grouping = every.join(merged, "class", "left").select("rep", F.coalesce("wider", "class").alias("class"))

    # one row of each class in a group brings its text
    sizes = grouping.groupBy("class").agg(F.count("*").alias("n"))
    wanted = grouping.join(sizes, "class").join(copies.drop("n"), "rep").select("class", "rep", "n", "set_a", "set_b", F.col("least").alias("at"))
    wanted = materialize(wanted, "wanted")
    listed = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = rows.join(listed, F.col("doc_id") == F.col("at")).select("class", "rep", "n", "set_a", "set_b", "text")
    links = confirmed_links(materialize(found.mapInArrow(_sets, "class long, rep long, n long, found binary"), "sets"), percent)

    # a component is named by the least id of its classes
    linked = links.join(copies.select("rep", "least"), F.col("node") == F.col("rep")).select("node", "component", "least")
    tops = linked.groupBy("component").agg(F.min("least").alias("top"))
    linked = linked.join(tops, "component").select("node", "component", "top")
    named = copies.join(linked, copies.rep == linked.node, "left").withColumn("top", F.coalesce("top", "least")).where("n > 1 or component is not null")
    named = named.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "top", "component")
    out = sketches.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(named, (F.col("n_shingles") > 0) & (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")), "left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("top", "doc_id"))
    group = F.when(known & (F.col("n_shingles") > 0), F.coalesce("component", key))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash", group.alias("group"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_hash", "group")
