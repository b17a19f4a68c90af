from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, first=0):
    rows = [(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, tied and repeated texts, and some that word splitting may trip over."""
    rng = random.Random(7)
    words = "the of and to In is É für naïve ﬁx 中文 x1 2024 don't A-B".split()
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    lines = ["a shared line of more than twenty letters\n" + t for t in made[:6]]
    return [None, "", "   \n\t ", "x" * 30_000, "word " * 40_000, "\n" * 500, "one", "one", *made, *lines, made[3], made[3], "İstanbul K ſ\u2028\u0085 end\r\nnext\x0b\x0c"]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts above with a null id, repeated rows, and columns whose names the operators use themselves."""
    docs = make(spark, odd_texts)
    more = spark.createDataFrame([(None, "one", None, None, None), (None, None, None, None, None), (5, "\n" * 500, "en", "s", 500), (5, "other text of id five", "en", "s", 21)], SCHEMA)
    from pyspark.sql import functions as F

    names = ["row_key", "n_words", "kept", "fp", "score", "n_dropped", "kept_text", "items", "spans", "n_tokens", "digest", "ids", "shard", "item", "slot", "y"]
    return docs.unionByName(more).withColumns({n: F.lit("mine") for n in names}).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts, first=0: make(spark, texts, first)
