import duckdb
import pytest

from tests.conftest import SF_ORACLE


def read(sf_dir, columns, table="documents"):
    return duckdb.sql(f"SELECT {columns} FROM '{sf_dir}/{table}.parquet'").fetchall()


@pytest.fixture(scope="session")
def documents():
    return dict(read(SF_ORACLE, "doc_id, text"))


# every column null somewhere, empty and blank texts, ties, repeated rows, a very long text
LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n\x0b ", None, None),
    (4, "one", "en", None),
    (5, "one", "en", "b"),
    (6, "A b C d", "de", "b"),
    (7, "a B c D", "de", "b"),
    (8, PASSAGE + " tail words of eight", "fr", "a"),
    (9, "head " + PASSAGE + " and more", "fr", "a"),
    (9, "head " + PASSAGE + " and more", "fr", "a"),
    (10, LONG, "en", "c"),
    (11, LONG + " extra", "en", "c"),
    (12, PASSAGE + " " + PASSAGE, "es", "c"),
    (13, "x" * 200_000, "en", "c"),
    (14, "café éé   naïve\x1cword 漢字 \U0001f600 mail me@example.org", "fr", "c"),
]


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string")
    # names that operators might use themselves
    return df.withColumns({c: F.lit(c) for c in (
        "node", "ord", "key", "words", "target", "source_size", "toxicity", "copy_", "digest", "kept", "score", "rank")})


@pytest.fixture(scope="session")
def no_rows(edges):
    return edges.limit(0)
