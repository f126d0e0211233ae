import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

#: Columns that no operator may mistake for its own.
CLASHING = "id long, n long, key string, score string, blocks int, component string, hashes string, spans int, label2 string, extra map<string,int>"
VALUES = (1, 2, "k", "s", 3, "c", "h", 4, "l", {"a": 1})


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank, long and repeated texts, repeated and null ids, and clashing columns."""

    def make(texts=None):
        long = " ".join(f"word{i % 977}" for i in range(30_000))
        rows = [(0, "a b c d e f g"), (1, None), (2, ""), (3, " \n\t"), (4, "A B C D E F G"), (5, long), (6, long), (7, "é" * 400), (8, "x" * 5000), (8, "x" * 5000), (9, "one two"), (None, "one two"), (10, "日本語 テスト 😀" * 30)] if texts is None else list(enumerate(texts))
        return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), *VALUES) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")

    return make


@pytest.fixture(scope="session")
def empty(odd):
    return odd().limit(0)
