import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Kept boolean, score int, row string, id string"


def prose(rng, words, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(words))


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and
    extra columns whose names clash with results."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = prose(rng, 120, vocabulary)
    near = base.replace(" w1", " w1 x", 1)
    rows = [
        (1, base, "en", "a", 1, True, 3, "r", "i"),
        (2, near, "en", "a", 1, None, None, None, None),
        (2, near, "en", "a", 1, None, None, None, None),
        (3, None, None, None, None, None, None, None, None),
        (4, "", "en", "a", 0, True, 1, "r", "i"),
        (5, " \n\t ", "fr", "b", 4, False, 1, "r", "i"),
        (6, prose(rng, 30_000, vocabulary), "en", "http://Host.test/sec/x", 9, True, 1, "r", "i"),
        (7, "one two three", "en", "b", 3, True, 1, "r", "i"),
        (8, "one two three", "en", "b", 3, True, 1, "r", "i"),
        (None, "one two three four five six", "en", "b", 3, True, 1, "r", "i"),
        (9, "x" * 200_000, "de", "b", 3, True, 1, "r", "i"),
        (10, "12 345 !!", "de", "b", 3, True, 1, "r", "i"),
        (11, "é Ä ß ﬁ\x00 \x1f", "fr", "", 3, True, 1, "r", "i"),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, None), (None, 1, 0), (7, None, 0), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
