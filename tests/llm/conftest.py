import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, key string, label string"


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t), 7, "s", "k", "l") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def awkward_texts():
    words = [f"w{i}" for i in range(400)]
    rnd = random.Random(5)
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    base = " ".join(rnd.choice(words) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    return [None, "", " \t\n", "one", "one two three", base, base.upper().replace(" ", "\n "), " ".join(near), base, long, "Ünïcode — “quoted” 漢字   spaces　here", "> quoted\nx", "a\x00b"]


@pytest.fixture(scope="session")
def awkward(spark, awkward_texts):
    """Nulls in every column, empty and long texts, equal texts, repeated rows, extra columns with common names."""
    rows = rows_of(awkward_texts)
    rows += [rows[5], rows[3], (None, "no id", None, None, None, None, None, None, None), (50, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
