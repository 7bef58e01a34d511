import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, white space of all kinds."""
    long = " ".join(f"w{i % 977} and" for i in range(30000))
    texts = [
        (1, "One two three four five six seven.", "en"), (2, None, "en"), (3, "", None), (4, long, "en"), (5, "One two three four five six seven.", "en"),
        (5, "One two three four five six seven.", "en"), (6, " \t\n\x0b\x0c\r ", "de"), (7, "ÀÉ ß x 12", None), (None, "null id text here with words", "fr"),
        (None, None, None), (8, "a", "en"), (9, "mail me: ab.c@ex-1.org or +49 (30) 123-4567, 10.0.0.255 4111 1111 1111 1111", "en"),
    ]
    return spark.createDataFrame([(i, t, x, None, len(t) if t else None) for i, t, x in texts], SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
