"""Removed bytes next to a dictionary of all 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from tablegauge.llm import suffix_dedup as module
from tablegauge.llm.suffix_dedup import LevelIndex, sortable, suffix_dedup


def brute(docs, length=50):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k:k + length]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, b in raw:
        covered = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k:k + length]] < i:
                covered[k:k + length] = True
        edges = np.flatnonzero(np.diff(covered.astype(int), prepend=0))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((i, len(b), int(covered.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.ident, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, [tuple(s) for s in r.removed])
                   for r in df.collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    common, texts = say(30), []
    for i in range(n):
        kind = rng.randrange(8)
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
        elif kind == 1 and texts:
            t = rng.choice(texts)
            at = rng.randrange(len(t) + 1)
            texts.append(t[:at] + "X" + t[at:])
        elif kind == 2:
            texts.append(say(10) + " " + common + " " + say(10))
        elif kind == 3:
            texts.append("z" * rng.randrange(200))
        else:
            texts.append(say(rng.randrange(60)))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_corpus(make_docs, seed):
    pairs = corpus(120, seed)
    assert result(suffix_dedup(make_docs(pairs).repartition(5))) == brute(pairs)


def test_small_chunks_and_hot_anchors(make_docs, monkeypatch):
    """Long texts in several steps, many chunks, single windows for anchors with several segments."""
    pairs = corpus(80, 3)
    pairs += [(500, "".join(t for _, t in pairs)), (501, "".join(t for _, t in pairs[::-1]))]
    for name, value in (("CHUNK_BYTES", 700), ("STEP_BYTES", 300), ("LOCAL_HOT", 1), ("HOT", 2), ("BATCH", 40)):
        monkeypatch.setattr(module, name, value)
    assert result(suffix_dedup(make_docs(pairs).repartition(3))) == brute(pairs)


def test_edges(make_docs):
    long = "".join(chr(97 + i * i % 26) for i in range(80))
    pairs = [(1, None), (2, ""), (3, long), (3, long), (4, long[:49]), (5, long[:50]), (6, "\0" * 60), (7, "\0" * 60 + "a"),
             (None, long), (None, None), (8, long + long)]
    assert result(suffix_dedup(make_docs(pairs, {"payload": "1", "chunk": "'x'"}))) == brute(pairs)
    assert suffix_dedup(make_docs([])).collect() == []


def test_levels_grow_geometrically():
    index, rng = LevelIndex(), np.random.default_rng(0)
    seen = set()
    for _ in range(40):
        keys = np.unique(sortable(rng.integers(0, 3, (100, 50)).astype(np.uint8).view("V50").ravel()))
        assert index.has(keys).tolist() == [k in seen for k in keys.tolist()]
        index.add(keys[~index.has(keys)])
        seen |= set(keys.tolist())
        sizes = [len(x) for x in index.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)
