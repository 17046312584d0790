"""Training artifacts: fragments, density, offsets, split and meta as tables of one folder."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Pieces, from_json, to_json
from ..operators import gaps, layout, rasters, relational, selection
from ..plans import materialize
from ..schema import FRAGMENTS


#: The longest silence and step of a good voyage, and how many of these are taken, those of most fixes first; the share and seed of held-out voyages.
GOOD, MOST, HELD_OUT = (7_200, 30_000.0), 500_000, (0.02, 42)


def build(positions: DataFrame, quality: DataFrame, extent, out: str, pieces: Pieces = Pieces(), held_out: tuple[float, int] = HELD_OUT, cell_m: float = 1000.0) -> None:
    """All artifacts of the good voyages, each a table below ``out``.

    ``frags`` in folders by split (so a half is read alone), ``track_index``,
    ``density`` with its ``density_geometry``, ``frag_stats``, ``split`` (the
    held-out voyages, its share and seed), ``config`` and counts in ``meta``.
    """
    good = selection.good_tracks(quality, *GOOD, MOST).select("track_id")
    rows = positions.join(good, "track_id", "left_semi")
    put = lambda table, name, *by: table.write.mode("overwrite").partitionBy(*by).parquet(f"{out}/{name}")
    put(gaps.split_fragments(gaps.fragments(rows, pieces), *held_out), "frags", "split")
    put(layout.track_offsets(rows), "track_index")
    put(rasters.metric_density(rows, extent, cell_m), "density")
    spark = positions.sparkSession
    one = spark.range(1)
    nx, ny, step_lon, step_lat = rasters.metric_shape(extent, cell_m)
    put(one.select(F.lit(float(extent[0])).alias("min_lon"), F.lit(float(extent[2])).alias("min_lat"), F.lit(step_lon).alias("step_lon"), F.lit(step_lat).alias("step_lat"), F.lit(nx).alias("columns"), F.lit(ny).alias("rows")), "density_geometry")
    saved = load_frags(spark, out)
    put(gaps.fragment_stats(saved), "frag_stats")
    put(saved.where("split = 'val'").select("track_id").distinct().withColumns({"seed": F.lit(held_out[1]), "val_fraction": F.lit(held_out[0])}), "split")
    put(one.select(F.lit(to_json(pieces)).alias("config")), "config")
    put(saved.agg(F.lit(json.dumps(list(extent))).alias("extent"), F.count("*").alias("fragments"), F.count_if(F.col("split") == "val").alias("val_fragments"), F.count_distinct("track_id").alias("tracks")), "meta")


def load_frags(spark: SparkSession, out: str, split: str | None = None) -> DataFrame:
    """Fragments, or those of one split; raises where a column of the model is missing."""
    rows = spark.read.parquet(f"{out}/frags")
    if lacks := [f.name for f in FRAGMENTS if f.name not in rows.columns]:
        raise ValueError(f"fragments without {', '.join(lacks)}")
    return rows if split is None else rows.where(F.col("split") == split)


def load_config(spark: SparkSession, out: str) -> Pieces:
    return from_json(Pieces, load(spark, out, "config").first().config)


def load_density(spark: SparkSession, out: str) -> tuple[DataFrame, tuple[float, float, float, float], tuple[int, int]]:
    """The raster, its corner and steps (longitude, latitude), and its rows and columns."""
    g = load(spark, out, "density_geometry").first()
    return load(spark, out, "density"), (g.min_lon, g.min_lat, g.step_lon, g.step_lat), (g["rows"], g["columns"])


def load(spark: SparkSession, out: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{table}")


def save_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_jdbc(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a relational mirror. A task that is run again appends its rows again; :func:`write_jdbc_once` doesn't."""
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


#: Batches that :func:`write_jdbc_once` has put into a mirror, by name.
LEDGER = "written_batches"


def write_jdbc_once(rows: DataFrame, url: str, table: str, batch: str, **options: str) -> bool:
    """Put each row into a table of a mirror once, whatever tasks and calls are repeated; False if this batch is there.

    Rows are fixed and numbered in the shared folder, then written by tasks to
    a table of their own, where a repeated task leaves rows twice. The driver
    then opens one transaction: it notes ``batch`` in ``LEDGER``, whose key
    refuses a second, and copies each number's row once. So a reader sees all
    rows or none, and a call that failed at any point can be made again. The
    rows themselves never pass the driver. Needs a mirror with transactions.
    """
    spark = rows.sparkSession
    connect = lambda: _connection(spark, url, options)
    with connect() as link:
        if not link.tables(LEDGER):
            link.run(f"CREATE TABLE {LEDGER} (batch VARCHAR(200) NOT NULL PRIMARY KEY)")
            link.commit()
        if link.count(f"SELECT COUNT(*) FROM {LEDGER} WHERE batch = ?", batch):
            return False
    number, copy = "row_no", "copy_no"
    while {number, copy} & {c.lower() for c in rows.columns}:
        number, copy = f"a_{number}", f"a_{copy}"
    # a row's number is the same for every attempt to write it, its copy's is not
    fixed = materialize(rows, "rows").select("*", F.concat_ws(":", F.regexp_extract("_metadata.file_path", "([^/]+)$", 1), "_metadata.row_index").alias(number), F.expr("reflect('java.util.UUID', 'randomUUID')").alias(copy))
    staged = f"{table}_{uuid.uuid4().hex[:12]}"
    if not _exists(spark, url, table, options):
        # the target has the columns of the rows
        write_jdbc(rows.where("false"), url, table, **options)
    try:
        _stage(fixed, url, staged, createTableColumnTypes=f"{number} VARCHAR(200), {copy} VARCHAR(200)", **options)
        with connect() as link:
            n, c = link.quoted(number), link.quoted(copy)
            names, mine = (", ".join(at + link.quoted(x) for x in rows.columns) for at in ("", "s."))
            link.run(f"INSERT INTO {LEDGER} VALUES (?)", batch)
            link.run(f"INSERT INTO {table} ({names}) SELECT {mine} FROM {staged} s JOIN (SELECT {n}, MIN({c}) AS least FROM {staged} GROUP BY {n}) f ON s.{n} = f.{n} AND s.{c} = f.least")
            link.commit()
    finally:
        with connect() as link:
            if link.tables(staged):
                link.run(f"DROP TABLE {staged}")
                link.commit()
    return True


def _stage(rows: DataFrame, url: str, table: str, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def _exists(spark: SparkSession, url: str, table: str, options: dict[str, str]) -> bool:
    with _connection(spark, url, options) as link:
        return link.tables(table)


class _connection:
    """One transaction of the driver; what isn't committed is undone."""

    def __init__(self, spark: SparkSession, url: str, options: dict[str, str]):
        jvm, given = spark._jvm, spark._jvm.java.util.Properties()
        for key, value in options.items():
            if key in ("user", "password"):
                given.setProperty(key, value)
        if "driver" in options:
            jvm.java.lang.Class.forName(options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        self.link = jvm.java.sql.DriverManager.getConnection(url, given)
        self.link.setAutoCommit(False)

    def __enter__(self) -> _connection:
        return self

    def __exit__(self, *_) -> None:
        self.link.rollback()
        self.link.close()

    def quoted(self, name: str) -> str:
        mark = self.link.getMetaData().getIdentifierQuoteString().strip()
        return f"{mark}{name}{mark}"

    def tables(self, name: str) -> bool:
        """Whether there is a table of this name, as the mirror spells names that aren't quoted."""
        facts = self.link.getMetaData()
        spelt = name.upper() if facts.storesUpperCaseIdentifiers() else name.lower() if facts.storesLowerCaseIdentifiers() else name
        return self.link.getMetaData().getTables(None, None, spelt, None).next()

    def _bound(self, sql: str, values: tuple):
        statement = self.link.prepareStatement(sql)
        for k, value in enumerate(values):
            statement.setString(k + 1, value)
        return statement

    def run(self, sql: str, *values: str) -> None:
        statement = self._bound(sql, values)
        statement.executeUpdate()
        statement.close()

    def count(self, sql: str, *values: str) -> int:
        statement = self._bound(sql, values)
        found = statement.executeQuery()
        found.next()
        out = found.getInt(1)
        statement.close()
        return out

    def commit(self) -> None:
        self.link.commit()


def insert_jdbc(found: DataFrame, url: str, table: str, key: str, id_name: str, **options: str) -> DataFrame:
    """Insert the values that a table of the mirror lacks, with the next ids, each once; gives all ids, old and new.

    Ids are fixed in the shared folder before anything is written. One writer
    at a time: two calls at once could give the same id twice.
    """
    known = materialize(read_jdbc(found.sparkSession, url, table, **options).select(id_name, key), "known")
    every = materialize(relational.insert_missing(found, known, key, id_name), "ids")
    write_jdbc_once(every.join(known.select(id_name), id_name, "left_anti"), url, table, uuid.uuid4().hex, batchsize="100", **options)
    return every


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
