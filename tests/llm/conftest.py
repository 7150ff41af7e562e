from __future__ import annotations

import pytest

#: Nulls, empty and white-space texts, ties, repeated rows, and columns whose names clash with results.
TRICKY = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, "The QUICK brown fox jumps over the lazy dog"),
    (3, ""),
    (4, None),
    (5, " \t\n "),
    (None, "no id at all here"),
    (6, "naïve café ☃ 𝒳  double  spaces\n\nand\tlines"),
    (7, "word " * 5000),
    (8, "same text"),
    (8, "same text"),
    (9, "<|endoftext|> special <|endoftext|>"),
    (10, "x"),
]


@pytest.fixture(scope="session")
def tricky(spark):
    rows = [(i, t, "en", "s", 0, 1, 2, "r") for i, t in TRICKY]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, score int, row string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def no_documents(tricky):
    return tricky.where("false")
