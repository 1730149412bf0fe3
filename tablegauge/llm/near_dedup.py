"""MinHash near-dedup by a chosen-path set similarity join.

Texts with equal shingle sets are one item first. Each of ten independent trees sends an item to the node of one of its
minwise tokens. A node with more than ``NODE`` items chooses one or two further positions of the signature, 4/3 on
average (the inverse of the similarity), and its items go on to the children of their tokens there, until nodes are
small. Items of a small node are compared with each other: signatures first, and the full sets of those whose signatures
agree often enough decide every link.

A crowd of near copies would not get smaller by branching. So the items of a large node are first compared with its
smallest item; they become one component, and pairs inside a component need no comparison. A node that is one component
is done. A node where at most ``NODE`` items are outside of its main component compares these with everything in it, in
blocks. Trees run in two rounds, and the second looks only at nodes that the links of the first leave open.

Full sets are made anew from the texts of the items that need them: a bitmap of row numbers picks those texts where they
are stored, so only they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import as_row, col, join_groups, map_texts, store, with_workers
from tablegauge.llm.components import connected
from tablegauge.llm.shingles import grouped, mix, shingle_sets

PER_CENT = 75
POOL = 64  # minwise hash functions
ROUNDS = ((0, 1), tuple(range(2, 10)))  # trees; the first token of tree t is the whole minwise hash of function t
NODE = 4000  # items of a node that are compared with each other by signature
BLOCK = 200  # items of a block in which a large node is compared
LAST_LEVEL = 60  # a node that is still large here is compared in blocks against blocks
PLAUSIBLE = 34  # equal minwise tokens of 64; a pair at the threshold has fewer twice in a hundred thousand
BITMAP_ROWS, BITMAP_BYTES = 1 << 15, 1 << 12
MARKED_BYTES = 32 << 20  # bitmaps that are broadcast at a time
_rng = np.random.default_rng(7)
FACTORS = _rng.integers(0, 1 << 63, POOL, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 64, POOL, np.uint64)


def min_tokens(sets: Sequence[np.ndarray]) -> np.ndarray:
    """The smallest hash of each set under each function; sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return np.stack([np.minimum.reduceat(flat * f + o, starts) for f, o in zip(FACTORS, OFFSETS)], 1)


def numbered(df: DataFrame, text: str, ident: str, carry: Sequence[str]) -> DataFrame:
    """Stored rows: the carried columns but the text, the id, a row number and the text."""
    kept = [c for c in carry if c != text] or [ident]
    return store(df.select(as_row(kept), col(ident).alias("ident"), F.monotonically_increasing_id().alias("number"),
                           col(text).cast("string").alias("text")), "near-rows")


def signatures(base: DataFrame) -> DataFrame:
    """Stored rows: carried columns, id, row number, set size, digest of the set, first tokens of the trees, signature.

    The signature holds a byte of the minwise hash of every function.
    """
    roots = sum(map(len, ROUNDS))

    def run(texts):
        sets = shingle_sets(texts)
        full = [s for s in sets if len(s)]
        tokens = min_tokens(full) if full else np.zeros((0, POOL), np.uint64)
        first = iter(tokens[:, :roots].copy().view(np.int64))
        short = iter(mix(tokens).astype(np.uint8))
        return [pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(first) if len(s) else None for s in sets], pa.list_(pa.int64())),
                pa.array([next(short).tobytes() if len(s) else None for s in sets], pa.binary())]

    made = map_texts(base, "text", ["row", "ident", "number"],
                     "n bigint, digest binary, roots array<bigint>, signature binary", lambda: run)
    return store(made.select("row.row", "row.ident", "row.number", "n", "digest", "roots", "signature"), "signatures")


def cut_groups(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]))


def matrix(signatures: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint8).reshape(-1, POOL)


def chains(near: np.ndarray) -> np.ndarray:
    """The smallest item that each item is connected with, by a symmetric matrix of pairs."""
    label = np.arange(len(near), dtype=np.int32)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(1).astype(np.int32))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def plausible(table: pa.Table) -> pa.Table:
    """The items of each node that may have a link to another component, grouped by chains of such pairs."""
    out: dict[str, list] = {"node": [], "number": []}
    numbers, components, nodes = (table[c].to_numpy() for c in ("number", "component", "node"))
    tokens = matrix(table["signature"])
    for a, b in cut_groups(nodes):
        same = np.zeros((b - a, b - a), np.int8)
        for column in np.ascontiguousarray(tokens[a:b].T):
            same += column[:, None] == column[None, :]
        near = same >= PLAUSIBLE
        near &= components[a:b, None] != components[None, a:b]
        met = np.flatnonzero(near.any(1))
        if len(met):
            first = chains(near[np.ix_(met, met)])
            out["node"].append(mix((first.astype(np.int64) << 32 ^ nodes[a]).view(np.uint64)).view(np.int64))
            out["number"].append(numbers[a + met])
    return pa.table({k: pa.array(np.concatenate([np.zeros(0, np.int64), *v]), pa.int64()) for k, v in out.items()})


def near_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, number, n, first) whose signature agrees with that of their node's first item."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            same = (matrix(table["signature"]) == matrix(table["leader"])).sum(1) >= PLAUSIBLE
            yield from table.filter(pa.array(same)).select(["node", "number", "n", "first"]).to_batches()


def verify(table: pa.Table) -> pa.Table:
    """Links (a, b) of each node's items by their full sets, as a forest: only links that connect two components.

    An item is first compared with the node's first one, and then with all earlier ones outside of its component at once:
    its shingles are marked in an array over the node's shingles, and the marks are summed per set.
    """
    out: dict[str, list] = {"a": [], "b": []}
    numbers, components = table["number"].to_numpy(), table["component"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
    for a, b in cut_groups(table["node"].to_numpy()):
        order = (a + np.argsort(numbers[a:b], kind="stable")).tolist()
        labels = components[order].tolist()
        if len(set(labels)) == 1:
            continue
        sizes = np.array([len(sets[i]) for i in order], np.int64)
        shingles, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        marks = np.zeros(len(shingles), np.int32)
        group = np.unique(labels, return_inverse=True)[1]
        for j in range(1, len(order)):
            marks[parts[j]] = 1
            for tried in (range(1), range(1, j)):
                tried = np.array(tried)[group[tried.start:tried.stop] != group[j]]
                if len(tried):
                    own = sizes[tried]
                    same = np.add.reduceat(marks[np.concatenate([parts[i] for i in tried])], np.cumsum(own) - own)
                    for i in tried[100 * same >= PER_CENT * (own + sizes[j] - same)].tolist():
                        if group[i] != group[j]:
                            group[group == group[i]] = group[j]
                            out["a"].append(int(numbers[order[i]]))
                            out["b"].append(int(numbers[order[j]]))
            marks[parts[j]] = 0
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def with_components(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("number"))
    return rows.join(labels.withColumnRenamed("node", "number"), "number", "left").withColumn(
        "component", F.coalesce("component", "number"))


def open_nodes(rows: DataFrame, labels: DataFrame | None, total: int) -> DataFrame:
    """Stored rows (node, number, component, n, first, main, left) of the nodes with more than one component: their size,
    smallest item, largest component, and the number of items outside of it."""
    named = with_components(rows, labels)
    if labels is None:
        stats = named.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"),
                                          F.min("component").alias("main"), F.lit(1).cast("bigint").alias("most"))
    else:
        named = store(named, "labelled")
        parts = named.groupBy("node", "component").agg(F.count(F.lit(1)).alias("k"), F.min("number").alias("least"))
        stats = parts.groupBy("node").agg(F.sum("k").alias("n"), F.min("least").alias("first"),
                                          F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("most"))
    stats = store(stats.filter("n > most").withColumn("left", F.col("n") - F.col("most")).drop("most"), "nodes")
    return store(join_groups(named, stats, "node", "n", total), "members")


def in_blocks(rows: DataFrame) -> DataFrame:
    """(node, number) blocks that compare every item outside of its node's main component with all items of the node."""
    blocks, chunks = [F.greatest(F.ceil(c / F.lit(BLOCK)).cast("long"), F.lit(1)) for c in (F.col("n") - F.col("left"), F.col("left"))]
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    inside = F.col("component") == F.col("main")
    chunk, block = F.pmod(F.xxhash64("number", F.lit(1)), chunks), F.pmod(F.xxhash64("number", F.lit(2)), blocks)
    # Items outside are dealt to chunks, and meet all blocks of the main component and all chunks of each other.
    own = F.when(inside, F.transform(upto(chunks), lambda c: F.xxhash64("node", F.lit(0), c, block))).otherwise(F.concat(
        F.transform(upto(blocks), lambda b: F.xxhash64("node", F.lit(0), chunk, b)),
        F.transform(upto(chunks), lambda c: F.xxhash64("node", F.lit(1), F.least(c, chunk), F.greatest(c, chunk)))))
    return rows.select(F.explode(own).alias("node"), "number")


def stars(large: DataFrame, total: int) -> DataFrame:
    """(node, number) blocks of the items of large nodes that may be similar to the first one, which is in every block."""
    leaders = large.filter("number = first").select("node", F.col("signature").alias("leader"), F.col("n").alias("size"))
    near = with_workers(join_groups(large.filter("number <> first").select("node", "number", "n", "first", "signature"), leaders,
                                    "node", "size", total).select("node", "number", "n", "first", "signature", "leader")).mapInArrow(
        near_leader, "node bigint, number bigint, n bigint, first bigint")
    placed = store(near.select("node", "number", "first", F.pmod(F.xxhash64("number", "node"), F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")).alias("b")), "stars")
    first = placed.select("node", F.col("first").alias("number"), "b").distinct()
    return placed.select(F.xxhash64("node", "b").alias("node"), "number").unionByName(first.select(F.xxhash64("node", "b").alias("node"), "number"))


def nearer(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Components known after the stars: an item takes the component of the smallest item it was linked with.

    Equal components stay linked with each other; that some could be merged further is left to the end of the round.
    """
    found = links.groupBy(F.col("b").alias("number")).agg(F.min("a").alias("a"))
    own = with_components(found.select(F.col("a").alias("number"), F.col("number").alias("node")), labels).select("node", "component")
    if labels is None:
        return store(own, "nearer")
    return store(labels.join(own.select("node"), "node", "left_anti").unionByName(own), "nearer")


def children(large: DataFrame) -> DataFrame:
    """(node, number) one level down: the node chooses one position of the signature, or two in one case of three."""
    place = [F.pmod(F.xxhash64("node", F.lit(b)), F.lit(POOL)).cast("int") for b in (0, 1)]
    down = [F.xxhash64("node", p, F.substring(F.col("signature"), p + 1, F.lit(1))) for p in place]
    twice = (F.pmod(F.xxhash64("node", F.lit(2)), F.lit(3)) == 0) & (place[0] != place[1])
    return large.select(F.explode(F.when(twice, F.array(*down)).otherwise(F.array(down[0]))).alias("node"), "number")


def chosen_texts(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (number, text) of ``base`` with a number in ``wanted``, picked where they are stored by bitmaps of numbers.

    Numbers grow within a stored file, so bitmaps are handed out for one range of files at a time.
    """
    marks = store(wanted.groupBy(F.shiftright("number", 15).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("number").bitwiseAND(F.lit(BITMAP_ROWS - 1))).alias("bits")), "marks")
    top, buckets = marks.agg(F.coalesce(F.max("bucket"), F.lit(0)), F.count(F.lit(1))).first()
    files = (top >> 18) + 1  # the number's part above 2^33
    step = max(1, files * MARKED_BYTES // max(buckets * BITMAP_BYTES, MARKED_BYTES))
    found = []
    for low in range(0, files, step):
        rows = base.filter((F.col("number") >= low << 33) & (F.col("number") < (low + step) << 33))
        part = marks.filter((F.col("bucket") >= low << 18) & (F.col("bucket") < (low + step) << 18))
        at = F.col("number").bitwiseAND(F.lit(BITMAP_ROWS - 1)).cast("int")
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        found.append(rows.join(F.broadcast(part), F.shiftright("number", 15) == F.col("bucket")).filter(
            byte.bitwiseAND(F.pow(F.lit(2), at.bitwiseAND(F.lit(7))).cast("int")) > 0).select("number", "text"))
    return reduce(DataFrame.unionByName, found)


def compare(nodes: DataFrame, texts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links between the items of each node (node, number) by their full sets; known components are not compared."""
    wanted = store(with_components(nodes.groupBy("number").agg(F.collect_set("node").alias("nodes")), labels), "wanted")

    def sets():
        return lambda texts: [pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())]

    texts = wanted.join(chosen_texts(texts, wanted).hint("merge"), "number")
    full = map_texts(texts, "text", ["number", "component", "nodes"], "shingles binary", sets).select(
        F.explode("row.nodes").alias("node"), "row.number", "row.component", "shingles")
    return store(grouped(full, "node", "a bigint, b bigint", verify, rows=2 * BLOCK), "near-links")


def similar_pairs(cells: DataFrame, items: DataFrame, texts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links between the items of small nodes or blocks, by signature and then by full sets."""
    # An item brings its signature once and then stands in all of its nodes.
    held = cells.groupBy("number").agg(F.collect_set("node").alias("nodes"))
    rows = with_components(held, labels).join(items.select("number", "signature"), "number").select(
        F.explode("nodes").alias("node"), "number", "component", "signature")
    return compare(store(grouped(rows, "node", "node bigint, number bigint", plausible), "plausible"), texts, labels)


def similarity_join(items: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(node, component) of all items that are linked with another one."""
    total, links, labels = items.count(), [], None

    for trees in ROUNDS:
        rows = items.select("number", F.explode(F.array(*[
            F.xxhash64(F.lit(t), F.element_at("roots", t + 1)) for t in trees])).alias("node"))
        cells, known = [], labels
        for level in range(LAST_LEVEL + 1):
            found = open_nodes(rows, known, total)
            cells.append(found.filter(F.col("n") <= NODE).select("node", "number"))
            few = (F.col("left") <= NODE) | F.lit(level == LAST_LEVEL)
            cells.append(in_blocks(found.filter((F.col("n") > NODE) & few)))
            many = found.filter((F.col("n") > NODE) & ~few)
            if many.isEmpty():
                break
            held = store(many.join(items.select("number", "signature"), "number"), "large")
            links.append(compare(stars(held, total), texts, known))
            known, rows = nearer(links[-1], known), children(held)
        links.append(similar_pairs(reduce(DataFrame.unionByName, cells), items, texts, known))
        labels = connected(reduce(DataFrame.unionByName, links))
    return labels


def decide(base: DataFrame) -> DataFrame:
    """(row, number, n_shingles, component_id, kept) for every numbered row."""
    signed = signatures(base)
    best = F.min(F.struct(F.col("ident").isNull().alias("missing"), "ident", "number")).alias("best")
    sets = store(signed.filter("n > 0").groupBy("digest").agg(
        F.min("number").alias("item"), best, F.count(F.lit(1)).alias("rows")), "distinct-sets")
    items = store(signed.select("number", "roots", "signature").join(sets.select(F.col("item").alias("number")), "number", "left_semi"), "items")
    labels = similarity_join(items, base.select("number", "text"))
    placed = store(sets.join(labels.withColumnRenamed("node", "item"), "item", "left").withColumn(
        "component", F.coalesce("component", "item")), "placed-sets")
    whole = store(placed.groupBy("component").agg(F.min("best").alias("top"), F.count(F.lit(1)).alias("n_sets")), "components")
    answer = store(join_groups(placed.select("digest", "component", F.col("rows").alias("n_rows")), whole, "component", "n_sets",
                               placed.count()).select("digest", "n_rows", "top"), "answers")
    linked = join_groups(signed.filter("n > 0").select("row", "number", "n", "digest"), answer, "digest", "n_rows", signed.count())
    return linked.select("row", "number", F.col("n").alias("n_shingles"), F.col("top.ident").alias("component_id"),
                         (F.col("top.number") == F.col("number")).alias("kept")).unionByName(
        signed.filter("n = 0").select("row", "number", F.col("n").alias("n_shingles"), F.col("ident").alias("component_id"),
                                      F.lit(True).alias("kept")))


def near_dedup(df: DataFrame, text: str = "text", ident: str = "doc_id", carry: Sequence[str] | None = None) -> DataFrame:
    """Components of texts whose shingle sets are linked.

    Returns ``row`` (the carried columns, by default all but the text), ``n_shingles`` long (set size), ``component_id``
    (smallest ``ident`` of the component, null ids last) and ``kept``: true for exactly one row of each component, one
    with that id. Two texts are linked if 100 x intersection >= 75 x union of their sets of five-word shingles (A-Z in
    lower case, words split at ASCII white space; a shorter text is one shingle). Null texts and texts without words
    have an empty set and are components of their own. Repeated rows are linked like any equal texts. An empty table
    gives an empty result.
    """
    return decide(numbered(df, text, ident, df.columns if carry is None else carry)).drop("number")


def representatives(df: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that ``near_dedup`` keeps, with the same columns."""
    base = numbered(df, text, ident, df.columns)
    kept = store(decide(base).filter("kept").select("number"), "kept-rows")
    return base.join(kept, "number", "left_semi").select(*[
        F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])
