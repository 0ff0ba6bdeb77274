from __future__ import annotations

import random

import pytest

FOLDER = "/root/testdata/sf0.01"
WORDS = "the of and anoring thentat river stone light under winter carry among seven paper glass window quiet number follow simple garden silver market bridge".split()


@pytest.fixture
def folder():
    return FOLDER


@pytest.fixture
def prose():
    """``prose(seed, n)``: n words in sentences."""

    def make(seed: int, n: int) -> str:
        rng, out = random.Random(seed), []
        while n > 0:
            k = min(n, rng.randint(6, 14))
            out.append(" ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(k)).capitalize() + ".")
            n -= k
        return " ".join(out)

    return make


@pytest.fixture
def odd_documents(spark, prose):
    """Nulls everywhere, empty and long texts, repeated rows and ids, columns with clashing names."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __id string, __text string, fp int, score string, start string, depth string, `a.b` string"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, prose(1, 60)), (4, prose(1, 60)), (5, prose(2, 60)), (None, prose(3, 40)), (None, None), (6, "word " * 30_000), (7, "x" * 50_000), (8, "é  ß \x00\x01 😀"), (9, prose(1, 60))]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", 1, "z", "q", "r", "d") for i, t in rows], schema)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
