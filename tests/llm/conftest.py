from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, source string, lang string, key string, node string, a string, size string, n string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty, blank, tiny and very long texts, repeated rows, versions, extra columns with clashing names."""
    extra = ("src", None, "k", "n", "a", "s", "x")
    long = words(30000, 1)
    base = words(200, 2)
    rows = [
        (1, None, *extra), (2, "", *extra), (3, " \n\t ", *extra), (4, "one two", *extra), (5, long, *extra), (6, base, *extra), (6, base, *extra), (7, base, *extra), (8, base.upper(), *extra),
        (9, base + " tail", *extra), (None, base, *extra), (None, None, *extra), (10, words(200, 3), None, None, None, None, None, None, None), (10, words(100, 4), *extra), (-5, "one two", *extra),
    ]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
