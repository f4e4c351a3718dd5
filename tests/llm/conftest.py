from __future__ import annotations

import pytest

#: Rows that every operator must take: null, empty and blank texts, ties, repeats, and odd code points.
TEXTS = [None, "", " \n\t ", "123 456", "One two three four five six seven.", "one two three four five six seven", "é" * 30, "a\x00b\ue000c", "Ünïcode — 漢字 words", "x" * 200_000, "word " * 30_000, "line\n" * 5_000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", 0, "extra", 1, 2, 3) for i, t in enumerate(TEXTS)]
    rows += [(3, "123 456", "en", "s", 0, "extra", 1, 2, 3), (None, "no id here at all today", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    # the extra columns have names that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hash string, n_lines int, _gone int, _losing_id int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
