import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def row(i, text, lang=None):
    return (i, text, lang, None, None if text is None else len(text))


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    parts = ["an", "er", "tion", "the", "ou", "st", "re", "ing", "ha", "nd"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(300)]


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    copy = text(40)
    rows = [row(i, text(rng.randint(1, 80)), rng.choice(["en", "de"])) for i in range(10, 40)]
    rows += [row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "12 34 !!"), row(None, copy, "en"), row(5, copy), row(6, copy), row(6, copy)]
    rows += [row(7, text(30_000)), row(8, "x" * 20_000), row(9, "Zeile\x00 İ café é <|endoftext|> ½5 中文 \U0001f642'll")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
