import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, n int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of oddity, and columns whose names operators use themselves."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(260)]
    near = list(base)
    near[100] = "changed"
    shared = " ".join(word() for _ in range(30))
    texts = [" ".join(base), " ".join(near), " ".join(base).upper(), "", None, "one", "one", " \t\n ", "two words", "é ü 日本 x", shared, "before " + shared + " after", "ab " * 400, "y" * 300, "z" * 49]
    texts += [" ".join(word() for _ in range(rng.randint(1, 120))) + "\nline\nline\n" for _ in range(12)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None, "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, " ".join(base), "en", "a", 3, None, None), (None, None, None, None, None, None, None), (90, " ".join(base) + " tail", "en", None, 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
