from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, n int, bucket string, h long, length string, chunk int, component string"


def words(rng, n, base=400):
    return " ".join(f"w{rng.randrange(base)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, ties, copies, near copies and clashing column names."""
    rng = random.Random(5)
    long = words(rng, 30_000, 5_000)
    near = words(rng, 300, 2_000)
    passage = words(rng, 60, 2_000)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "a"), (4, "A"), (5, "a b c"), (6, long), (7, long + " end"), (8, near), (9, near + " tail"), (10, near.replace(" ", "\n", 3))]
    rows += [(11, "head one " + passage + " two"), (12, "start " + passage), (13, passage + " " + passage), (14, "été À l'école — naïve ÉTÉ"), (15, "日本 語 テスト"), (16, "x" * 5_000)]
    rows += [(20 + i, words(rng, 20 + i)) for i in range(40)] + [(60 + i, "same text again and again") for i in range(12)]
    return spark.createDataFrame([(*r, 1, "b", 2, "l", 3, "c") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
