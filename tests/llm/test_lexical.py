"""Ranked search next to a plain scoring loop, and the parts of the treap."""

import math
import random
import re
from collections import Counter

import numpy as np

from tablegauge.llm import lexical
from tablegauge.llm.lexical import Treap, descend, ranked_search, term_hashes

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEMS = "item_id bigint, text string"


def terms_of(text):
    return Counter(x.translate(LOWER) for x in re.findall(TERM, text or ""))


def brute(docs, items, k=20):
    bags = [(ident, terms_of(text)) for ident, text in docs]
    bags = [(ident, bag) for ident, bag in bags if bag]
    documents, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item, text in items:
        asked, scored = terms_of(text), []
        for ident, bag in bags:
            m = 75 + (25 * sum(bag.values()) * documents) // total
            score = sum(r * math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (
                (10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, r in asked.items() if t in bag)
            if score > 0:
                scored.append((-score, ident is None, ident or 0, ident))
        out += [(item, rank, ident, -s) for rank, (s, _, _, ident) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(df, items, **options):
    return sorted((tuple(r) for r in ranked_search(df, items, **options).select("item", "rank", "ident", "score").collect()), key=repr)


def test_treap_holds_its_grid():
    r = np.random.default_rng(3)
    doc, term = np.sort(r.integers(0, 50, 4000)), r.zipf(1.3, 4000).astype(np.uint64)
    factor = r.integers(75, 400, 50)
    tree = Treap.build(doc, term, factor)
    again = Treap.unpacked(*tree.packed())
    assert (again.top == tree.top).all() and (again.first == tree.first).all()
    counts = Counter(zip(term.tolist(), doc.tolist()))
    for t in np.unique(term).tolist():
        at = tree.find(np.array([t], np.uint64))
        who, column, score = descend(tree, np.zeros(1, np.int64), tree.place[at], np.ones(1, np.int64), np.ones(1, np.int64), 100)
        want = {d: (10**9 * n) // (1000 * n + 12 * factor[d]) for (x, d), n in counts.items() if x == t}
        assert dict(zip(column.tolist(), score.tolist())) == want and tree.counts[at[0]] == len(want)
    assert tree.find(np.array([2**63], np.uint64))[0] == -1


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(5000)) + "x" * 3000 + " end"
    whole = term_hashes([text, None, "a b", ""])
    monkeypatch.setattr(lexical, "HASH_BYTES", 100)
    pieces = term_hashes([text, None, "a b", ""])
    assert (whole[0] == pieces[0]).all() and whole[1].tolist() == pieces[1].tolist() and whole[1][-1] == len(whole[0])


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(df, items) == want


def test_ties_copies_and_odd_rows(spark, make_docs):
    r = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ünder", "the", "THE", "x1", "日本", "don't"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(300)]
    docs += [(400 + i, "the same text for many") for i in range(150)] + [(400, "the same text for many"), (None, "the same text for many")]
    docs += [(900, None), (901, ""), (902, " .,;- "), (903, "long " * 300_000), (904, "w1 " * 4000 + "w2")]
    r.shuffle(docs)
    items = [(1, "the same THE text"), (2, "w1 w1 w1 w2 Ünder"), (3, "absent"), (4, None), (5, ""), (6, "日本 don't"), (7, " ".join(words)),
             (1, "many w5"), (None, "w7 long")]
    want = brute(docs, items)
    df, asked = make_docs(docs).repartition(5), spark.createDataFrame(items, ITEMS)
    for dealt in (df, df.repartition(40), df.coalesce(1)):
        assert found(dealt, asked) == want
    clashing = df.selectExpr("*", "1 AS ident", "2 AS terms", "3 AS number", "4 AS score", "5 AS rank")
    assert found(clashing, asked.selectExpr("*", "1 AS number", "2 AS item", "3 AS repeats")) == want
    assert found(df, asked, k=3) == brute(docs, items, 3)
    assert found(df.limit(0), asked) == [] and found(df, asked.limit(0)) == []


def test_items_in_several_rounds(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lexical, "ROUND_TERMS", 7)
    docs = [(i, f"a{i % 7} b{i % 3} c{i % 11}") for i in range(80)]
    items = [(i, f"a{i % 7} c{i % 13} b{i}") for i in range(12)]
    assert found(make_docs(docs), spark.createDataFrame(items, ITEMS)) == brute(docs, items)
