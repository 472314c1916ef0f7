import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_texts import TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with null, empty, blank, repeated and long texts, and columns of clashing names."""
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1, "k", 2.0) for r in TEXTS], "doc_id bigint, text string, lang string, source string, n_chars bigint, copies int, g string, `mix.source` double")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
