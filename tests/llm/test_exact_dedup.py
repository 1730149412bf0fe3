import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablegauge.llm.exact_dedup import exact_dedup, filter_bits, fingerprints, may_repeat, repeated_filter
from tablegauge.llm import exact_dedup as module


def brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs)


def rows(df):
    return sorted((r.row.doc_id, r.keep_value, r.group_size, r.kept, bytes(r.digest).hex()) for r in df.collect())


def test_hot_group_and_edges(make_docs):
    random.seed(1)
    pairs = [(i, "hot") for i in range(400)] + [(400 + i, f"text {random.randrange(500)}") for i in range(600)]
    pairs += [(2000, None), (2001, ""), (2002, "x" * 300000), (2003, "x" * 300000), (2004, "Hot")]
    docs = make_docs(pairs, {"kept": "1", "group_size": "'a'", "digest": "2"}).repartition(7)
    assert rows(exact_dedup(docs)) == brute(pairs)


def test_repeated_rows_keep_one(make_docs):
    out = exact_dedup(make_docs([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")])).collect()
    kept = Counter((r.row.doc_id, r.row.text) for r in out if r.kept)
    assert kept == {(1, "a"): 1, (None, "b"): 1}


def test_empty(make_docs):
    assert exact_dedup(make_docs([])).collect() == []


def test_filter_misses_nothing(make_docs):
    docs = make_docs([f"t{i % 900}" for i in range(1000)]).repartition(5)
    stored = fingerprints(docs, "text", "doc_id", ["doc_id"])
    bits = filter_bits(1000)
    probed = may_repeat(stored, repeated_filter(stored, bits), bits)
    flags = {r.row.doc_id: r.maybe for r in probed.collect()}
    assert all(flags[i] and flags[900 + i] for i in range(100))
    assert sum(flags.values()) < 260  # most unique rows pass straight through


def test_full_filter_only_costs_time(make_docs, monkeypatch):
    monkeypatch.setattr(module, "FILTER_BITS", 2 * module.SEGMENT)
    pairs = [(i, f"t{i % 900}") for i in range(1000)]
    assert rows(exact_dedup(make_docs(pairs))) == brute(pairs)
