from __future__ import annotations

import pytest

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, keep string, body string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ties, columns with an operator's own names."""
    long = "word " * 30_000
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, "same text here\nand a line\nand a line"), (5, "same text here\nand a line\nand a line"), (6, "same text here\nand a line\nand a line"), (None, "no id at all"), (None, None), (7, "é" * 5000), (8, "x" * 40_000), (9, "a b  c \U0001f600 <|endoftext|>")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, "k", "b") for i, t in rows], ODD_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
