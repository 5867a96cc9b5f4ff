import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 8
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (2, "the QUICK brown fox\tjumps over the lazy dog again and again", "en", "a", 10),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \n\t ", "fr", None, 3),
        (6, long, "en", "a", len(long)),
        (7, body, None, None, None),
        (7, body, None, None, None),
        (8, body + "lambda", "fr", "b", 1),
        (None, "no identifier here but some words all the same", "fr", "b", 1),
        (None, None, None, None, None),
        (9, "é" * 50 + " mail: jo@ex.org, +44 20 7946 0958", "fr", "b", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    clash = {c: F.lit(-1) for c in ("score", "kept", "n_words", "id", "t", "h", "b", "p", "k", "rep", "component", "n_tokens", "epoch", "pii", "fail_bits", "row", "found", "f", "s", "n", "_s", "_h", "_b", "_at", "_p", "_m", "_c", "_before", "_total", "_room")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
