"""The prefix trie next to nested dictionaries."""

import hashlib
import random
import zlib

import pytest

from tablegauge.llm.prefix_trie import rebuilt_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, group=5, heads=9):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, len(text.encode()), role, text))
    own = {c: [x[4:] for x in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        turns = own.get(c - c % group, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    sums = {}
    for key in sorted(nodes, key=len, reverse=True):
        below = [sums[k] for k in children.get(key, [])]
        saved = (len(nodes[key]) - 1) * len(key[-1][1].encode()) if key else 0
        sums[key] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + saved)
    out = set()
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, last in members if last))
        out.add((min(c for c, _ in members), len(key), min(c for c, _ in nodes[key[:-1]]) if key else None, len(members),
                 len(children.get(key, [])), *sums[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(df, **options):
    rows = rebuilt_trie(df, **options).select(
        "member", "depth", "parent", "n_members", "n_children", "n_leaves", "saved", "ends_sha256").collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert trie(df) == brute([tuple(r) for r in df.collect()])


@pytest.mark.parametrize("width", [2, 8])
def test_copies_long_conversations_and_odd_rows(spark, width):
    r = random.Random(width)
    rows = [(c, k, r.choice(["user", "assistant", None]), r.choice(["a", "ü", "", None]))
            for c in range(60) for k in range(r.randint(1, 7))]
    rows += [(100 + c, k, "user", "same") for c in range(40) for k in range(21)]  # one shared path through several blocks
    rows += [(200 + c, k, "user", "same" if k < 19 else f"{c % 7}") for c in range(20) for k in range(23)]
    rows += [(300, k, "user", f"{k}") for k in range(50)]
    rows += [(401, 0, "user", "short, and its base is absent"), (None, 0, "user", "no id"),
             (500, None, "user", "null first"), (500, 0, "user", "tie"), (500, 0, "user", "tie"), (500, 0, "assistant", "tie")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert trie(df, width=width) == want
    if width == 8:
        assert trie(df.selectExpr("*", "1 AS conv", "2 AS id", "3 AS place", "4 AS level", "5 AS `_tie`")) == want


def test_turnless_members_and_tables_without_conversations(spark):
    convs = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:3]
    rows = [(c, 0, "user", "gone") for c in convs]  # the base is absent and the only turn is among the first h
    found = trie(spark.createDataFrame(rows, SCHEMA))
    assert found == brute(rows) and [x[1] for x in found] == [0]
    assert trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)) == set()
    assert trie(spark.createDataFrame([], SCHEMA)) == set()
