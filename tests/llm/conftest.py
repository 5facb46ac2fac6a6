import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions near old stone bridges".split()


def prose(start: int, size: int) -> str:
    return " ".join(WORDS[(start + i * (1 + start % 5)) % len(WORDS)] + str((start * 7 + i) % 11) for i in range(size))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, odd characters, a hot group."""
    base = prose(3, 60)
    words = base.split()
    near = " ".join([*words[:58], "changed", "ending"])
    texts = [
        (1, base), (2, base.upper()), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "ONE"),
        (9, "one two three"), (10, "é É naïve 日本語 テキスト <|endoftext|> x"), (11, prose(5, 4000)), (12, prose(5, 4000) + " tail"),
        (13, "x" * 3000), (14, "\u0000 odd space\x1c\x85 end"), (15, prose(9, 40)), (16, prose(9, 40)), (17, "don't we'll 12345 !!'s ...\n\n  y "),
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    rows += [rows[0], rows[3]]  # repeated rows
    rows += [(100 + i, prose(1, 30), None, None, None) for i in range(40)]
    rows += [(None, base, "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
