import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that every operator must take: null and empty texts, blanks, ties, repeats, odd characters and a long text.
ODD = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "one", "en", "a", 3), (4, "one", "en", "b", 3), (5, "éà ÉÀ ß 漢字 😀", "fr", "b", 12), (6, "a  b\n\n c ", "en", None, 9),
    (7, "the same line\n" * 30, "en", "a", 420), (8, "word " * 30_000, "en", "a", 150_000), (9, "\x00 \x1f nul", "en", "a", 7), (10, "12 345 !!", None, "c", 9), (None, "no id here", "en", "c", 10),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, KIND).withColumns({c: F.lit(1) for c in ("n", "rep", "class", "range", "size", "host", "part", "score", "_id", "component")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def texts(spark):
    """The small input's rows as tuples, for brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return {r.doc_id: r.text for r in rows}
