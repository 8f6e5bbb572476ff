from __future__ import annotations

import random

import pytest

WORDS = "the of and to in a is that it was for on are as with his they at be this from or had by hot word but what some we".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, score string, block int, key string, row string, names string"


def document(doc_id, text, lang="en"):
    return doc_id, text, lang, None, None, 7, "s", "x", None, "k", "r", None


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(4)
    return lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark, prose):
    """NULLs in every column, empty and blank texts, one long text, copies, repeated rows and ids, and columns named like internal ones."""
    common = prose(120)
    rows = [document(i, prose(40 + i)) for i in range(30)]
    rows += [document(100 + i, f"{prose(30)} {common} {prose(30)}") for i in range(6)]
    rows += [document(200, prose(30_000)), document(201, None), document(202, ""), document(203, " \n\t "), document(204, "a"), document(205, "a")]
    rows += [document(206, common), document(206, common), document(206, prose(80)), document(None, common), document(None, None, None), document(207, common, None)]
    rows += [document(300 + i, common) for i in range(20)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    """(doc_id, text) of all rows."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
