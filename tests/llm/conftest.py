import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"
#: Names that the operators use inside, on columns they must ignore.
CLASH = "doc string, n string, key string, items string, part string, label string, k0 string, size string, score string, row string"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def make_docs(spark):
    """(doc_id, text) rows with extra columns of clashing names."""
    def make(rows, lang=None):
        extra = ("x",) * len(CLASH.split(", "))
        langs = lang or [None] * len(rows)
        return spark.createDataFrame([(*r, x, "src", 0, *extra) for r, x in zip(rows, langs)],
                                     f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")
    return make
