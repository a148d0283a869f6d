"""Fixtures of the operator tests; a second conftest would hide the one above."""

import pytest
from plumbline.llm.rowkeys import prepare

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for columns of their own.
CLASHES = ("key", "text_", "node", "measures", "fail_bits", "_row", "spans", "candidates", "list", "_block", "_bits0", "found")


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def hostile(llm):
    """Rows with nulls everywhere, empty and very long texts, ties and repeats, and columns with clashing names."""
    long_word, long_text = "x" * 200_000, "alpha beta gamma delta " * 40_000
    texts = [None, "", " \n\t ", "one", long_word, long_text, "9" * 60_000, "a@b.c " * 5_000, "\U0001f600 ß é token = abcdef1234"]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    rows += [(5, long_text, "en", "src", 0), (None, "one two three four", None, None, None), (None, None, None, None, None)]
    rows += [(3, "one", "en", "src", 3), (20, "same key, other text", "en", "s", 1), (20, "same key, third text", "en", "s", 1)]
    df = llm.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


@pytest.fixture(scope="session")
def none(llm):
    return llm.createDataFrame([], DOCS)
