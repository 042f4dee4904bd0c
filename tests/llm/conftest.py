import os

import pytest

TOKENIZERS = "/opt/tokenizers"


@pytest.fixture(scope="session")
def tokenizers_dir():
    if not os.path.isdir(TOKENIZERS):
        pytest.skip("no vocabulary files here")
    return TOKENIZERS


ODD = [
    (1, "plain words here and there"),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (5, "é中😀 <|endoftext|> a\x00b\x85c"),
    (6, "word " * 30000),
    (7, "x" * 60000),
    (1, "plain words here and there"),
    (None, "a row without an id"),
    (8, "one"),
    (9, "one two"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty, blank, odd and very long texts and a repeated row, and columns whose
    names the operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), i, t, 1, "b", 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, body string, n int, score string, component double")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
