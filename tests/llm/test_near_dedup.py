"""Components next to an exhaustive comparison of word tuples."""

import random
import re

import pytest

from tablegauge.llm import near_dedup as module
from tablegauge.llm.near_dedup import near_dedup, representatives


def word_sets(texts):
    lower = {i: i + 32 for i in range(65, 91)}
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    return out


def brute(pairs):
    sets = word_sets([t for _, t in pairs])
    label = list(range(len(pairs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b)
            if a and b and 100 * same >= 75 * (len(a) + len(b) - same):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(pairs, sets)))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, n):
    rng = random.Random(seed)
    say = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k))
    passage, texts = say(40), []
    for _ in range(n):
        kind = rng.randrange(6)
        if kind < 3 and texts:
            t = rng.choice(texts)
            texts.append(edited(rng, t, rng.randrange(4)) if t.split() else t)
        elif kind == 3:
            texts.append(f"{say(rng.randrange(5, 40))} {passage}")
        else:
            texts.append(say(rng.randrange(0, 120)))
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def rows(df):
    return sorted((r.row.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_random_corpus(make_docs):
    pairs = corpus(1, 250)
    out = near_dedup(make_docs(pairs).repartition(4))
    assert rows(out) == brute(pairs)
    assert all(r.kept == (r.row.doc_id == r.component_id) for r in out.collect())


@pytest.mark.parametrize("node", [12])
def test_large_nodes(make_docs, monkeypatch, node):
    """Nodes over the limit branch, and what stays large is compared in blocks."""
    monkeypatch.setattr(module, "NODE", node)
    monkeypatch.setattr(module, "BLOCK", 5)
    rng = random.Random(4)
    base = " ".join(f"w{i}" for i in range(60))
    pairs = corpus(2, 60) + [(1000 + i, edited(rng, base, rng.randrange(4))) for i in range(60)]
    assert rows(near_dedup(make_docs(pairs))) == brute(pairs)


def test_edges(make_docs):
    pairs = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE  two"), (10, "one two three four five"),
             (11, "a b c d e f " * 5000), (12, "a b c d e f " * 5000), (12, "a b c d e f " * 5000)]
    docs = make_docs(pairs, {"component_id": "1", "number": "'x'", "kept": "2"})
    assert rows(near_dedup(docs)) == brute(pairs)
    kept = representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8, 10, 11]
    assert near_dedup(make_docs([])).collect() == []


def test_documents(documents):
    pairs = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows(near_dedup(documents)) == brute(pairs)
