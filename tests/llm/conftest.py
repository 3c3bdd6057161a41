import pytest

from diurnal.llm.common import prepare


@pytest.fixture(autouse=True)
def _package_on_workers(spark):
    prepare(spark)


#: Ids, texts, languages and sources with what trips operators: nulls, blanks, ties, repeats, other scripts.
ROWS = [
    (5, "The cat sat on the mat.\nshared line\n", "en", "a"),
    (3, None, None, None),
    (3, None, None, None),
    (1, "", "en", "b"),
    (None, "no id here, but a text\nShared Line ", "en", None),
    (8, " \t\n \r\n", "de", "a"),
    (9, "ça và — naïve ﬁne İstanbul ΣΊΣΥΦΟΣ 漢字テスト 😀 é", None, "c"),
    (2, "  two  spaces ▁mark▁   nbsp sep <|endoftext|> </s> don't WON'T 12345 ", "fr", "b"),
    (2, "  two  spaces ▁mark▁   nbsp sep <|endoftext|> </s> don't WON'T 12345 ", "fr", "b"),
    (4, "word " * 20_000, "en", "a"),
    (6, "x" * 5_000, "en", "a"),
    (7, "a\x00b\x1c\x1dc \x0b\x0c \x85 end", "en", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns whose names clash with those operators use inside."""
    schema = "doc_id long, text string, lang string, source string, key string, ids string, bits long, size long, block int, shard string, row string, place int, n int, score string"
    return spark.createDataFrame([(*r, "k", "i", 1, 2, 3, "s", "r", 4, 5, "z") for r in ROWS], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
