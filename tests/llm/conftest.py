"""Fixtures of the operator tests: small tables with the awkward rows that every
operator must handle, made in the test (null columns, empty and long texts, ties,
repeated rows, clashing extra columns)."""

import pytest

SF = "/root/testdata/sf0.001"
TOKENIZERS = "/opt/tokenizers"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def sentence(start: int, n: int) -> str:
    return " ".join(WORDS[(start + i * i) % len(WORDS)] + str((start + i) % 7) for i in range(n))


def awkward_rows() -> list[tuple]:
    long_text = " ".join(sentence(i, 40) for i in range(300))
    rows = [(1, sentence(1, 60)), (2, sentence(1, 60)), (3, ""), (4, None), (5, "   \n "), (6, "one"),
            (7, sentence(1, 59) + " changed"), (8, long_text), (9, "Été déjà-vu ΑΣ 日本語 \U0001d4b3 á"),
            (10, "tab\tand  two\n\nlines "), (None, "text without an id"), (None, sentence(1, 60)),
            (11, "repeated row"), (11, "repeated row"), (12, "same id"), (12, "another text of the id"),
            (13, "\x00 \x1c odd   spaces  "), (14, "don't <|endoftext|> 12345 !!"), (-5, "negative id")]
    return [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]


@pytest.fixture()
def awkward(spark):
    """The awkward rows plus columns that clash with operators' own names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward_rows(), SCHEMA)
    for name in ("shard", "kept", "slot", "score", "ids", "place", "row", "hash", "body", "start", "rank", "_n"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
