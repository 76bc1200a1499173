import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "the", "of", "été", "漢字", "x" * 40, "A", "😀", "don't", "12,5", "c#", "a|b"]
    out = [None, "", " \n\t ", "one", "one two three four", "a b c d"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) + rng.choice([".", "", "\n\n"]) for _ in range(40)]
    out += ["Lines here. " * 3 + "\n" + "Lines here. " * 3 + "\nAnother line | menu | home", "word " * 30_000]
    return out + out[:12]


@pytest.fixture(scope="session")
def edge(spark, texts):
    """Nulls in every column, repeated rows and texts, and columns named as results are."""
    rows = [(None if i == 7 else i % (len(texts) - 3), t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", i, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, spans string, taken string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
