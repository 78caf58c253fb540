import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("th", "er", "on", "an", "re", "Ü") for b in ("ing", "ed", "ly", "é.", "ou,")]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(25)]
    common = "Released under the MIT License, all of it."
    texts = [t if i % 2 else f"{common}\n{t}\n \n  {common.upper()} " for i, t in enumerate(base)]
    texts += [base[0], base[1] + " tail", base[2].replace("th", "TH"), "a a a a a a a", "same line\nsame line\nother", "", " \t\n", None]
    texts += ["x" * 400, "ab" * 300, "Wort " * 120, 'token = "' + "a1" * 20 + '" AKIA' + "Z9" * 9 + " password:short1 secret: a\ntoken=token: abcdef " + "0f" * 13]
    texts += [" ".join(words * 200) + " end"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"host{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows and columns with clashing names."""
    long = "one two three four five six seven " * 20
    rows = [(None, long, 1, "k"), (None, long, 1, "k"), (5, long, 1, "k"), (5, long, 1, "k"), (5, "other text", 2, None), (6, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, source string").selectExpr(
        "*", "1 AS words", "2 AS row", "3 AS secrets", "4 AS _lines", "5 AS fp", "6 AS doc", "7 AS digest", "8 AS host", "9 AS kinds"
    )


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
