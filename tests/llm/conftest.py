import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
    (2, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, "word", "fr", "b", 4),
    (6, "x" * 50_000, "de", "b", 50_000),
    (7, "many words " * 5_000, "de", "b", 55_000),
    (8, "日本語 🙂 ▁ <|endoftext|>\r\n\ttab  two", "ja", None, 30),
    (9, " \n\t ", "en", "a", 4),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows and columns with clashing names."""
    df = spark.createDataFrame([*EDGE, EDGE[0]], DDL)
    return df.selectExpr("*", "1 AS score", "'x' AS fp", "0 AS piece", "'y' AS x", "2 AS tag")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
