import hashlib
import random

import numpy as np

from tablegauge.llm import chunk_dedup as module
from tablegauge.llm.chunk_dedup import GEAR, JUDGED, LEAST, MOST, chunk_dedup, cuts, gear_hashes


def plain_cuts(data):
    out, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(GEAR[b])) & 0xFFFF
        if i + 1 - last >= MOST or i + 1 - last >= LEAST and (h >> 11) & module.MASK == 0:
            out.append(i + 1)
            last = i + 1
    return out + ([len(data)] if last < len(data) else [])


def brute(pairs):
    seen, out = set(), []
    for i, t in sorted(pairs, key=lambda p: p[0]):
        data = (t or "").encode()
        stops = plain_cuts(data)
        spans = []
        for a, b in zip([0, *stops[:-1]], stops):
            if b - a >= JUDGED:
                key = hashlib.sha256(data[a:b]).digest()
                if key in seen:
                    spans.append((a, b))
                seen.add(key)
        out.append((i, len(data), len(stops), spans))
    return out


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def test_cuts_match_the_rolling_hash():
    rng = random.Random(1)
    for n in (0, 1, 5, 31, 32, 33, 300, 3000):
        data = bytes(rng.choice(b"abc \xc3") for _ in range(n))
        assert cuts(data) == plain_cuts(data)
    assert cuts(b"a" * 1000) == plain_cuts(b"a" * 1000)
    assert len(gear_hashes(np.frombuffer(b"abc", np.uint8))) == 3


def test_repeats_are_found_after_insertions(make_docs):
    rng = random.Random(2)
    passage = say(rng, 60)
    pairs = [(i, f"{say(rng, rng.randrange(40))} {passage} {say(rng, 20)}") for i in range(40)]
    pairs += [(100 + i, say(rng, 80)) for i in range(20)] + [(200, None), (201, ""), (202, "z" * 5000)]
    out = sorted(chunk_dedup(make_docs(pairs, {"digest": "1", "ends": "'x'"}).repartition(4)).collect(), key=lambda r: r.row.doc_id)
    want = brute(pairs)
    assert [(r.row.doc_id, r.n_bytes, r.n_chunks, [tuple(s) for s in r.removed]) for r in out] == want
    assert all(r.n_repeated == len(r.removed) and r.n_removed == sum(s.end - s.start for s in r.removed) for r in out)
    found = {r.row.doc_id for r in out if r.n_repeated}
    assert set(range(1, 40)) <= found and not found & set(range(100, 120))


def test_edges(make_docs):
    assert chunk_dedup(make_docs([])).collect() == []
    rng = random.Random(3)
    text = say(rng, 100)
    out = chunk_dedup(make_docs([(1, text), (1, text), (None, text)])).collect()
    assert sorted(r.n_removed > 0 for r in out) == [False, True, True]
    assert [r.row.doc_id for r in out if not r.n_removed] == [None]
