import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from odd_documents import ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, source, None if t is None else len(t), True, 0.5, "u", 7) for i, t, lang, source in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, uid string, _uid long").repartition(3).cache()


@pytest.fixture(scope="session")
def plain(odd):
    return odd.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
