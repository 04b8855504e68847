import pytest

#: Extra columns have names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, shard int, `__id` string, spans string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and rows that repeat."""
    long = " ".join(f"word{i % 977} of{i % 89}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, "b"),
        (None, "a null id", "en", None),
        (None, None, None, None),
        (4, long, "en", "a"),
        (5, long, "en", "b"),
        (6, " \n\t ", "en", "é"),
        (7, "x" * 100_000, "en", "b"),
        (8, "mail bob@example.com now, 10.0.0.1 or +1 (555) 123-4567; 4111 1111 1111 1111", "en", "c"),
        (9, "  two  spaces ▁ and é 😀 \r\n lines\n", "en", "c"),
    ]
    return spark.createDataFrame([(*r, 0, None, None, 3, "x", None) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
