import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rank int, labels string, extra array<int>"


def rows(texts, langs=None, sources=None):
    return [
        (i, text, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(text or ""), 0.5, 1, "x", [1])
        for i, text in enumerate(texts)
    ]


EDGES = [
    None, "", " \n\t ", "word", "Word word WORD word", "7 8 9", "é ñ ü", "😀 emoji text", "a" * 5000, "same text here today " * 3,
    "same text here today " * 3, "long " * 60_000, "\0zero\0", "x\r\ny\x0bz",
]


@pytest.fixture(scope="session")
def edges(spark):
    """NULL, empty, blank and very long texts, repeated rows and columns whose names clash with results."""
    data = rows(EDGES)
    return spark.createDataFrame(data + data[4:6], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """A maker of invented sentences from a few syllables."""

    def make(seed, words, syllables=("the", "on", "er", "ti", "ha", "re", "st", "in", "ed", "or")):
        draw = random.Random(seed)
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(words))

    return make
