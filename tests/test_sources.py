"""Ingest in batches and writes that are made once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wakeline.sources import archive, artifacts, dataset


def _archive(folder, days=4, per_day=3):
    draw = random.Random(7)
    for day in range(1, days + 1):
        for hour in range(per_day):
            here = folder / "2024" / f"{day:02}"
            here.mkdir(parents=True, exist_ok=True)
            ships = draw.sample(range(30), 8)
            rows = {f"m{s}": {"SHIPNAME": f"S{s}", "LAT": 30 + s / 10, "LON": 130.5, "SPEED": draw.randrange(200), "TIMESTAMP": None if draw.random() < 0.1 else 1_704_067_200 + 86_400 * (day - 1) + 3600 * hour + s} for s in ships}
            (here / f"{day:02}.01.2024_{hour:02}_00.json").write_text(json.dumps(rows))


def _rows(spark, path, table):
    return sorted(map(tuple, dataset.read(spark, path, table).drop("timestamp" if table == "files" else "").collect()))


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("archive"), str(tmp_path_factory.mktemp("whole") / "d")
    _archive(root)
    found = archive.ingest(spark, str(root), "01.01.2024", "04.01.2024")
    dataset.create(spark, out)
    for table in ("positions", "ships", "files"):
        dataset.write(found[table], out, table)
    return str(root), {t: _rows(spark, out, t) for t in ("positions", "ships", "files")}


def test_batches_equal_one_ingest_and_repeats_write_nothing(spark, whole, tmp_path):
    root, want = whole
    out = str(tmp_path / "d")
    assert archive.ingest_more(spark, root, out, "01.01.2024", "02.01.2024") == 6
    assert archive.ingest_more(spark, root, out, "01.01.2024", "02.01.2024") == 0
    assert archive.ingest_more(spark, root, out, "01.01.2024", "04.01.2024", most=4) == 4
    assert archive.ingest_more(spark, root, out, "01.01.2024", "04.01.2024", most=4) == 2
    assert archive.ingest_more(spark, root, out, "01.01.2024", "04.01.2024", most=4) == 0
    assert {t: _rows(spark, out, t) for t in want} == want and len(want["files"]) == 12 and len(want["positions"]) > 60


@pytest.mark.parametrize("fails", ["ships", "files"])
def test_a_batch_that_failed_is_taken_again(spark, whole, tmp_path, monkeypatch, fails):
    root, want = whole
    out, plain = str(tmp_path / "d"), dataset.write

    def failing(rows, path, table, mode="append"):
        if table == fails and rows.where("file_id >= 6" if table == "files" else "ship_id >= 0").count():
            raise RuntimeError("lost")
        plain(rows, path, table, mode)

    archive.ingest_more(spark, root, out, "01.01.2024", "02.01.2024")
    monkeypatch.setattr(dataset, "write", failing)
    with pytest.raises(RuntimeError):
        archive.ingest_more(spark, root, out, "01.01.2024", "04.01.2024")
    # positions without a line in the ledger are there now
    assert dataset.read(spark, out, "positions").where("file_id >= 6").count()
    monkeypatch.setattr(dataset, "write", plain)
    assert archive.ingest_more(spark, root, out, "01.01.2024", "04.01.2024") == 6
    assert {t: _rows(spark, out, t) for t in want} == want


@pytest.fixture
def mirror(tmp_path):
    return {"url": f"jdbc:derby:memory:once{random.random()};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def _twice(rows, url, table, plain=artifacts._stage, **options):
    """A task that is run again after it wrote: its rows are there twice."""
    plain(rows, url, table, **options)
    plain(rows.where("id % 2 = 0"), url, table, **options)


def test_rows_are_written_once(spark, mirror, monkeypatch):
    rows = spark.range(300).select("id", F.concat(F.lit("n"), F.col("id") % 7).alias("name"))
    # rows that are equal stay as many as they are
    rows = rows.union(rows.where("id < 20")).repartition(4)
    monkeypatch.setattr(artifacts, "_stage", _twice)
    assert artifacts.write_jdbc_once(rows, table="ships", batch="b1", **mirror)
    assert not artifacts.write_jdbc_once(rows, table="ships", batch="b1", **mirror)
    found = artifacts.read_jdbc(spark, table="ships", **mirror)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))


def test_a_write_that_fails_leaves_nothing_and_can_be_made_again(spark, mirror, monkeypatch):
    rows = spark.range(50).select("id")
    plain, link = artifacts._stage, artifacts._connection

    def lost(rows, url, table, **options):
        plain(rows.where("id < 30"), url, table, **options)
        raise RuntimeError("lost")

    monkeypatch.setattr(artifacts, "_stage", lost)
    with pytest.raises(RuntimeError):
        artifacts.write_jdbc_once(rows, table="t", batch="x", **mirror)
    assert artifacts.read_jdbc(spark, table="t", **mirror).count() == 0
    monkeypatch.setattr(artifacts, "_stage", plain)

    class Torn(link):
        def commit(self):
            raise RuntimeError("no commit")

    monkeypatch.setattr(artifacts, "_connection", Torn)
    with pytest.raises(RuntimeError):
        artifacts.write_jdbc_once(rows, table="t", batch="x", **mirror)
    monkeypatch.setattr(artifacts, "_connection", link)
    assert artifacts.read_jdbc(spark, table="t", **mirror).count() == 0
    assert artifacts.write_jdbc_once(rows, table="t", batch="x", **mirror)
    assert artifacts.read_jdbc(spark, table="t", **mirror).count() == 50
