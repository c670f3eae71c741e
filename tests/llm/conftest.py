import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_words import words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, SIZE string, held_out string"


def rows():
    """Copies, near copies, nulls, empty and long texts, a repeated row."""
    out = []
    for i in range(40):
        out.append((i, words(i, 60), "en" if i % 2 else "de", f"s{i % 3}", 1, 0.5, "x", "y"))
    base = words(7, 200)
    near = base.split()
    near[100] = "changed"
    long = " ".join(words(100 + i, 1000) for i in range(12))
    out += [
        (50, base, "en", "s0", 1, None, None, None),
        (51, base.upper(), "en", "s0", 1, None, None, None),
        (52, " ".join(near), "en", "s1", 1, None, None, None),
        (53, None, "en", "s1", 1, None, None, None),
        (54, "", None, None, None, None, None, None),
        (55, " \t\n ", "de", "s9", 1, None, None, None),
        (56, long, "de", "s9", 1, None, None, None),
        (None, words(3, 30), "de", None, 1, None, None, None),
        (57, "one two", "en", "s2", 1, None, None, None),
        (58, "one two", "en", "s2", 1, None, None, None),
        (58, "one two", "en", "s2", 1, None, None, None),
        (59, "1234 5678 !!!", "en", "s2", 1, None, None, None),
        (60, "Licensed under CC BY-NC 4.0\nAll rights reserved. all  rights reserved", "en", "s2", 1, None, None, None),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(rows(), DOCS).repartition(3)
    df.cache()
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
