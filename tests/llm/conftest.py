"""Fixtures of the corpus tests; ``spark`` is the one of ``tests/conftest.py``."""

import pytest

from llm_tables import DOCS, EXTRA, texts


@pytest.fixture(scope="session")
def rows():
    out = [(k, t, ("en", "de", None)[k % 3], ("s1", None, "s0", "é")[k % 4], None if t is None else len(t), *EXTRA) for k, t in enumerate(texts())]
    out.append(out[4])  # a repeated row
    out.append((None, "a text without an id, of nine words", None, None, 35, *EXTRA))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
