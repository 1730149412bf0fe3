import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts, or from (doc_id, text) pairs; other columns may be given by name."""
    def make(items, extra=None):
        pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(items)]
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, DOC_SCHEMA)
        return df if extra is None else df.selectExpr("*", *[f"{v} AS `{k}`" for k, v in extra.items()])
    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def plain(rows):
    return json.loads(json.dumps(rows))
