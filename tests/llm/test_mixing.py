import random
from collections import Counter, defaultdict

from tablegauge.llm.mixing import emitted, mix


def targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, out, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (budget - sum(out.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return out


def docs(spark, n, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "Z", "é", None, "hot"]
    rows = [(i, None if rng.random() < 0.02 else " ".join("w" * rng.randint(1, 4) for _ in range(rng.randrange(60))),
             "hot" if rng.random() < 0.35 else rng.choice(names), 1, "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, place int, target string")


def test_targets_and_copies(spark):
    rows, df = docs(spark, 700, 1)
    out = mix(df).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    want, taken, largest = targets(sizes), Counter(), Counter()
    for r in out:
        assert r.size == len((r.row.text or "").split()) and r.source_size == sizes[r.row.source]
        assert abs(r.target - want[r.row.source]) < 1e-6 and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.row.source] += r.taken
        largest[r.row.source] = max(largest[r.row.source], r.size)
    for source, target in want.items():
        assert abs(taken[source] - target) <= 2 * largest[source]


def test_reruns_agree_in_any_partitioning(spark):
    _, df = docs(spark, 300, 2)
    first = sorted((r.row.doc_id, r.copies) for r in mix(df).collect())
    assert first == sorted((r.row.doc_id, r.copies) for r in mix(df.repartition(7)).collect())


def test_emitted_rows(spark):
    _, df = docs(spark, 100, 3)
    mixed = mix(df)
    out = emitted(mixed)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.row.doc_id: r.copies for r in mixed.collect() if r.copies})


def test_edges(make_docs, spark):
    assert mix(make_docs([])).collect() == []
    rows = mix(make_docs([(1, None), (2, ""), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3
    long = mix(make_docs([(1, "w " * 50000), (2, "w")])).collect()
    assert abs(sum(r.taken for r in long) - long[0].target) <= 50000 and long[0].target == 75001.5
