"""Documents with what the operators look for, and with every awkward case."""

import random

import pytest

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "nu", "ra") for b in ("ro", "sa", "te", "vi", "") for c in ("n", "st", "l", "r")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and repeated rows, one very long text, extra columns with clashing names."""
    rng = random.Random(9)
    rows = [
        (1, None, "en", "a", 1), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, None), (4, "one", "en", "a", 3), (5, "123 456 !!!", "en", "a", 11), (None, "no id at all here", "en", "a", 5),
        (7, prose(rng, 60_000), "en", "a", 9), (8, "same text twice for all of us", "en", "a", 1), (8, "same text twice for all of us", "en", "a", 1), (9, "same text twice for all of us", "xx", "a", 1),
        (10, "é" * 300 + " 日本語 " + "😀" * 50, "ja", "a", 1), (11, "a" * 30_000, "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "component", "bucket", "kept", "words", "draw", "good", "lang_pred", "score", "item_id", "gram", "n", "shard", "digest"):
        df = df.withColumn(name, df["doc_id"].cast("string"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
