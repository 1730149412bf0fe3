"""The SQL of the corpus queries, and the pipeline stage by stage."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from compare import compare, duck
from test_mixing import targets
from test_near_dedup import brute as near_brute
from tokenizers import Tokenizer

import corpus_pipeline
from tablegauge.llm.queries import ORACLES, QUERIES, TOKENIZER

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, con, name):
    verdict = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123", None, None, 3)], documents.schema)
    docs = documents.unionByName(extra)
    known = stages["language_id"](spark, docs, SF_DIR)
    rows = {r.doc_id: r for r in known.collect()}
    assert known.columns == documents.columns and not {9001, 9002} & set(rows)
    assert len(rows) >= 0.99 * documents.count()

    unique = stages["exact_dedup"](spark, known, SF_DIR)
    best = {}
    for r in rows.values():
        best[r.text] = max(r.doc_id, best.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in unique.collect()) == sorted(best.values()) and unique.columns == documents.columns

    near = stages["near_dedup"](spark, unique, SF_DIR)
    pairs = [(r.doc_id, r.text) for r in unique.collect()]
    kept = sorted(r.doc_id for r in near.collect())
    assert kept == sorted({c for _, _, c in near_brute(pairs)}) and near.columns == documents.columns

    mixed = stages["mixing"](spark, near, SF_DIR)
    size = {r.doc_id: (r.source, len(r.text.split())) for r in near.collect()}
    total, taken = Counter(), Counter()
    for s, n in size.values():
        total[s] += n
    for r in mixed.collect():
        taken[r.source] += size[r.doc_id][1]
    assert mixed.columns == documents.columns
    for s, t in targets(total).items():
        assert abs(taken[s] - t) <= 2 * max(n for x, n in size.values() if x == s)

    library = Tokenizer.from_file(TOKENIZER)
    text = {r.doc_id: r.text for r in near.collect()}
    encoded = stages["bpe"](spark, mixed, SF_DIR).collect()
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in mixed.collect())
    for r in encoded:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() > 0 and dict(out.dtypes)["ids"] == "string"
