import pytest

#: Rows with every awkward case: null and empty texts, null keys, ties, repeated rows, clashing extra columns.
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog. It runs far away! Does it come back?\nA second line follows here, with some more words."),
    (1, "The quick brown fox jumps over the lazy dog. It runs far away! Does it come back?\nA second line follows here, with some more words."),
    (2, None),
    (3, ""),
    (4, "one"),
    (5, "  \n\t "),
    (6, "äöü ß 中文 😀 ’quoted’ it's WE'LL don't 123 ½ ² \x00 \x1c end"),
    (7, "x" * 3000),
    (8, "word " * 5000),
    (None, "a row without an id, that has some words in it"),
    (9, "repeated row with the same words twice in the table"),
    (9, "repeated row with the same words twice in the table"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys int, sketch string, node string, label int, version string, run int, shard int, a string, b string"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, "en", "s", len(t or ""), 1, "k", "n", 2, "v", 3, 4, "a", "b") for d, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
