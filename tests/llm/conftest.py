"""Documents with the awkward cases that every operator must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long, digest string, fp string"


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(["an", "er", "th", "ou", "ti", "le", "sa"], k=r.randint(1, 4))) for _ in range(n))


def awkward() -> list[tuple]:
    long = prose(1, 9000)
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, long), (6, long), (6, long), (7, prose(2)), (8, prose(2)), (None, prose(3)),
        (None, None), (9, "émoji 😀 中文 ﬁ \x00 é"), (10, prose(4) + " end"), (11, prose(4) + " fin"), (12, "x" * 5000), (13, ". , ! ?"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "c", 5, "d", "f") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
