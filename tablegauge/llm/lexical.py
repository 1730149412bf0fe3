"""Ranked lexical search in K2-treaps over blocks of the term-document grid.

Documents are cut into blocks of bounded text. The grid of a block (rows: its terms, columns: its documents) is a
quadtree in level order: four bits per inner cell for the quadrants that are not empty, and for every cell the largest
impact inside, stored as the difference to its parent's. The impact of a term in a document leaves the term's weight out,
so the index does not depend on document frequencies, and the largest impact of a cell times a term's weight bounds all
scores below it.

A query item descends along the paths of all its terms' rows at once: a state is a range of documents with the cells of
the terms that occur there, its bound the weighted sum of their impacts. The states of an item with the highest bounds go
first, a batch at a time for many items, and a range is given up when its bound is under the item's k-th best score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.llm.common import col, map_texts, slices, store, with_workers
from tablegauge.llm.shingles import hash_words

GAPS = np.ones(256, bool)  # bytes between terms; every byte of a character beyond ASCII belongs to a term
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    GAPS[_low:_high] = False
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
HASH_BYTES = 1 << 20  # text that is hashed at a time
BLOCK_BYTES = 3 << 20
BLOCK_ROWS = 1 << 13
ROUND_TERMS = 200_000  # terms of the items of one round, which is what is broadcast at a time
STATE_TERMS = 300_000  # occurrences of the terms of the items that descend together
FIRST_BATCH = 32  # ranges of an item that are opened at a time until its first scores are known
ONES = np.array([bin(b).count("1") for b in range(16)], np.int32)
# Of a cell with these four bits, the place of a quadrant's cell among the children; -1 if it is empty.
CHILD = np.array([ONES[b & ((1 << q) - 1)] if b >> q & 1 else -1 for b in range(16) for q in range(4)], np.int64)
SCALE, SMOOTH = 1_000_000_000, 12
EMPTY = np.zeros(0, np.int64)


def length_factor(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The factor m of documents with n terms, out of ``documents`` documents with ``total`` terms."""
    return 100 - 25 + (25 * n * documents) // max(total, 1)


class Treap:
    """A block's grid as a quadtree: ``terms`` are sorted term hashes, ``place`` their rows (frequent terms first)."""

    def __init__(self, terms: np.ndarray, place: np.ndarray, counts: np.ndarray, height: int, bits: np.ndarray, top: np.ndarray):
        self.terms, self.place, self.counts, self.height, self.bits, self.top = terms, place, counts, height, bits, top
        inner = ONES[bits].astype(np.int64)
        self.first = np.cumsum(inner) - inner + 1  # cells stand in level order, so children follow each other

    @classmethod
    def build(cls, doc: np.ndarray, term: np.ndarray, factor: np.ndarray) -> Treap:
        """The treap of term occurrences (``doc`` column, ``term`` hash), one per word; ``factor`` has each document's m."""
        terms, row = np.unique(term, return_inverse=True)
        cells, tf = np.unique(row * len(factor) + doc, return_counts=True)
        row, doc = np.divmod(cells, len(factor)) if len(cells) else (EMPTY, EMPTY)
        counts = np.bincount(row, minlength=len(terms))
        place = np.empty(len(terms), np.int64)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(terms))
        height = int(max(len(terms), len(factor), 2) - 1).bit_length()
        code, shift = np.zeros(len(cells), np.int64), 0
        for bit in range(height):
            code |= ((doc >> bit) & 1) << (2 * bit) | ((place[row] >> bit) & 1) << (2 * bit + 1)
        order = np.argsort(code)
        code, impact = code[order], ((SCALE * tf) // (1000 * tf + SMOOTH * factor[doc]))[order]
        levels, bits = [impact], []
        for _ in range(height):
            new = np.flatnonzero(np.diff(code >> 2, prepend=-1))
            bits.append(np.bitwise_or.reduceat(1 << (code & 3), new) if len(new) else EMPTY)
            levels.append(np.maximum.reduceat(levels[-1], new) if len(new) else EMPTY)
            code = code[new] >> 2
        top = np.concatenate(levels[::-1]).astype(np.int32)
        return cls(terms, place, counts, height, np.concatenate([*bits[::-1], np.zeros(0, np.int64)]).astype(np.uint8), top)

    def packed(self) -> list:
        """Arrays for storage; impacts as differences to the parent's."""
        drop = self.top.copy()
        if len(drop) > 1:
            parent = np.repeat(np.arange(len(self.bits)), ONES[self.bits])
            drop[1:] = self.top[parent] - self.top[1:]
        return [self.terms.tobytes(), self.place.astype(np.int32).tobytes(), self.counts.astype(np.int32).tobytes(), self.height,
                self.bits.tobytes(), drop.tobytes()]

    @classmethod
    def unpacked(cls, terms: bytes, place: bytes, counts: bytes, height: int, bits: bytes, drop: bytes) -> Treap:
        made = cls(np.frombuffer(terms, np.uint64), np.frombuffer(place, np.int32), np.frombuffer(counts, np.int32), height,
                   np.frombuffer(bits, np.uint8), np.frombuffer(drop, np.int32).copy())
        size, start = 1, 0  # from the top down: a level's impacts are its parents' less the differences
        for _ in range(height if len(made.top) else 0):
            children = ONES[made.bits[start:start + size]]
            below = int(children.sum())
            made.top[start + size:start + size + below] = np.repeat(made.top[start:start + size], children) - \
                made.top[start + size:start + size + below]
            start, size = start + size, below
        return made

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted terms in ``terms``, -1 if absent."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)


class Pool:
    """Document ranges that wait: item, depth, first document, bound; and per range the cells of its terms."""

    def __init__(self, item, depth, column, bound, owner, row, weight, cell):
        self.item, self.depth, self.column, self.bound = item, depth, column, bound
        self.owner, self.row, self.weight, self.cell = owner, row, weight, cell

    def pick(self, chosen: np.ndarray) -> Pool:
        """The chosen ranges with their terms."""
        at = np.cumsum(chosen) - 1
        held = chosen[self.owner]
        return Pool(self.item[chosen], self.depth[chosen], self.column[chosen], self.bound[chosen], at[self.owner[held]],
                    self.row[held], self.weight[held], self.cell[held])

    def plus(self, other: Pool) -> Pool:
        return Pool(*[np.concatenate([a, b]) for a, b in (
            (self.item, other.item), (self.depth, other.depth), (self.column, other.column), (self.bound, other.bound),
            (self.owner, other.owner + len(self.item)), (self.row, other.row), (self.weight, other.weight), (self.cell, other.cell))])

    def opened(self, tree: Treap) -> Pool:
        """The halves of all ranges, with the terms that occur in them."""
        depth = self.depth[self.owner]
        first = tree.first[self.cell]
        corner = tree.bits[self.cell].astype(np.int64) * 4 + ((self.row >> (tree.height - 1 - depth)) & 1) * 2
        parts = []
        for half in (0, 1):
            child = CHILD[corner + half]
            has = np.flatnonzero(child >= 0)
            parts.append((self.owner[has] * 2 + half, self.row[has], self.weight[has], first[has] + child[has]))
        owner, row, weight, cell = (np.concatenate(x) for x in zip(*parts))
        bound = np.bincount(owner, weight * tree.top[cell], 2 * len(self.item))  # sums stay far below 2^53
        alive = np.bincount(owner, minlength=2 * len(self.item)) > 0
        step = 1 << (tree.height - 1 - self.depth)
        at = np.cumsum(alive) - 1
        return Pool(np.repeat(self.item, 2)[alive], np.repeat(self.depth + 1, 2)[alive],
                    np.stack([self.column, self.column + step], 1).ravel()[alive], bound[alive].astype(np.int64),
                    at[owner], row, weight, cell)


def best_of(item: np.ndarray, key: np.ndarray, tie: np.ndarray, most: int | np.ndarray) -> np.ndarray:
    """Which rows are among the ``most`` with the highest key of their item; equal keys by the smaller tie."""
    order = np.lexsort((tie, -key, item))
    start = np.flatnonzero(np.diff(item[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    chosen = np.zeros(len(order), bool)
    chosen[order] = rank < most
    return chosen


def descend(tree: Treap, item: np.ndarray, row: np.ndarray, weight: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(item, column, score) of each item's k best documents with a score of at least the item's ``floor``.

    ``item``, ``row`` and ``weight`` list the terms of the items; the floor is an array over item numbers.
    """
    items, owner = np.unique(item, return_inverse=True)
    zero = np.zeros(len(items), np.int64)
    bound = np.bincount(owner, weight * np.int64(tree.top[0])).astype(np.int64)
    pool = Pool(items, zero, zero, bound, owner, row, weight, np.zeros(len(item), np.int64))
    found, floor = (EMPTY, EMPTY, EMPTY), floor.copy()
    batch = FIRST_BATCH
    while len(pool.item):
        chosen = best_of(pool.item, pool.bound, -pool.depth, batch)
        rest = pool.pick(~chosen)
        half = pool.pick(chosen).opened(tree)
        done = half.depth == tree.height
        if done.any():
            found = tuple(np.concatenate(x) for x in zip(found, (half.item[done], half.column[done], half.bound[done])))
            keep = best_of(found[0], found[2], found[1], k)
            found = tuple(x[keep] for x in found)
            full = np.bincount(found[0], minlength=len(floor)) >= k
            least = np.full(len(floor), np.iinfo(np.int64).max)
            np.minimum.at(least, found[0], found[2])
            floor = np.where(full, np.maximum(floor, least), floor)
            half, batch = half.pick(~done), batch * 2
        pool = rest.plus(half)
        hopeful = pool.bound >= floor[pool.item]  # a document with the same score may have the smaller id
        if not hopeful.all():
            pool = pool.pick(hopeful)
    keep = found[2] >= floor[found[0]]
    return tuple(x[keep] for x in found)


def term_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in order and the end of each text in that array; a long text is hashed in pieces."""
    hashes, ends, waiting, size, total = [], [], [], 0, 0

    def flush() -> None:
        nonlocal waiting, size, total
        if waiting:
            found, stops = hash_words([raw for raw, _ in waiting], GAPS)
            hashes.append(found)
            ends.extend(total + stop for stop, (_, last) in zip(stops.tolist(), waiting) if last)
            total += len(found)
        waiting, size = [], 0

    for text in texts:
        raw, start = (text or "").encode("utf-8", "surrogatepass"), 0
        while len(raw) - start > HASH_BYTES and (gap := GAP.search(raw, start + HASH_BYTES)):
            waiting.append((raw[start:gap.start()], False))
            start = gap.start()
            flush()
        waiting.append((raw[start:], True))
        size += len(raw) - start
        if size > HASH_BYTES:
            flush()
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(ends, np.int64)


INDEX = "terms binary, place binary, counts binary, height bigint, bits binary, drops binary"


def corpus_size(df: DataFrame, text: str) -> tuple[int, int]:
    """How many documents hold a term, and how many terms they hold in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        for batch in batches:
            for part in slices(batch, 0):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(0).to_pylist()]
                data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
                begins = GAPS[data[:-1]] & ~GAPS[data[1:]]
                starts = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]])
                n = np.add.reduceat(begins, starts, dtype=np.int64)
                documents, total = documents + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], names=["documents", "total"])

    counted = with_workers(df.select(col(text).cast("string").alias("text"))).mapInArrow(run, "documents bigint, total bigint")
    row = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in counted.columns]).first()
    return row[0], row[1]


def build_index(df: DataFrame, text: str, ident: str, documents: int, total: int) -> DataFrame:
    """One stored row per block of documents: their ids in ascending order (null last) and the block's treap."""
    source = df.select(col(ident).alias("ident"), col(text).cast("string").alias("text"))
    out = T.StructType([T.StructField("idents", T.ArrayType(source.schema["ident"].dataType)), *T.StructType.fromDDL(INDEX).fields])

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        idents = pa.concat_arrays([p.column(0) for p in parts])
        hashes, ends = term_hashes([t for p in parts for t in p.column(1).to_pylist()])
        n = np.diff(ends, prepend=0)
        order = pc.array_sort_indices(idents, null_placement="at_end").to_numpy()
        order = order[n[order] > 0]
        column = np.zeros(len(n), np.int64)
        column[order] = np.arange(len(order))
        tree = Treap.build(np.repeat(column, n), hashes, length_factor(n[order], documents, total))
        return pa.RecordBatch.from_arrays([pa.array([idents.take(pa.array(order)).to_pylist()], pa.list_(idents.type)),
                                           *[pa.array([x]) for x in tree.packed()]], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for batch in batches:
            for whole in slices(batch, 1, HASH_BYTES):
                for at in range(0, whole.num_rows, BLOCK_ROWS):
                    part = whole.slice(at, BLOCK_ROWS)
                    if held and (size + part.nbytes > BLOCK_BYTES or rows + part.num_rows > BLOCK_ROWS):
                        yield block(held)
                        held, size, rows = [], 0, 0
                    held.append(part)
                    size, rows = size + part.nbytes, rows + part.num_rows
        if held:
            yield block(held)

    # A block to a row group, checked after every row, so that writers and readers hold one block at a time.
    return store(with_workers(source).mapInArrow(run, out), "treaps",
                 **{"parquet.block.size": str(BLOCK_BYTES), "parquet.page.size.row.check.min": "1"})


def query_terms(items: DataFrame, text: str, ident: str) -> DataFrame:
    """Stored rows (item number, id, distinct term hashes, repeats) of the items with terms."""
    def make():
        def run(texts):
            hashes, ends = term_hashes(texts)
            found = [np.unique(h, return_counts=True) for h in np.split(hashes, ends[:-1])]
            return [pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                    pa.array([n for _, n in found], pa.list_(pa.int64()))]
        return run

    made = map_texts(items, text, [ident], "terms array<bigint>, repeats array<bigint>", make)
    return store(made.filter(F.size("terms") > 0).select(
        F.monotonically_increasing_id().alias("number"), F.col("row").getField(ident).alias("item"), "terms", "repeats"), "items")


def frequencies(index: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, df): in how many documents each of the wanted terms (sorted hashes) occurs; absent terms have no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts in zip(*(c.to_pylist() for c in batch.columns)):
                terms, counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int32)
                _, here, there = np.intersect1d(wanted, terms, assume_unique=True, return_indices=True)
                total[here] += counts[there]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return with_workers(index.select("terms", "counts")).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(
        F.sum("df").alias("df"))


def search_round(index: DataFrame, numbers: np.ndarray, item: np.ndarray, term: np.ndarray, repeats: np.ndarray, documents: int,
                 k: int) -> DataFrame:
    """Rows (number, ident, score) that hold the k best documents of each item; ``item`` are sorted places in ``numbers``."""
    wanted, slot = np.unique(term, return_inverse=True)
    weigh = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(wanted), np.int64)
    for at, weight in frequencies(index, wanted).select("term", weigh).collect():  # one row per term of the round at most
        weights[at] = weight
    weight = weights[slot] * repeats
    useful = weight > 0
    item, slot, weight, items = item[useful], slot[useful], weight[useful], len(numbers)
    ident = index.schema["idents"].dataType.elementType
    out = T.StructType([T.StructField("number", T.LongType()), T.StructField("ident", ident), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.ones(items, np.int64)
        best_item, best_score = EMPTY, EMPTY
        for batch in batches:
            for n in range(batch.num_rows):
                tree = Treap.unpacked(*[c[n].as_py() for c in batch.columns[1:]])
                at = tree.find(wanted)[slot]
                here = np.flatnonzero(at >= 0)
                if not len(here):
                    continue
                at, owner, power = at[here], item[here], weight[here]
                load = np.cumsum(np.bincount(owner, tree.counts[at], items))
                cuts = np.searchsorted(owner, np.flatnonzero(np.diff(load // STATE_TERMS, prepend=0)))
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)]):
                    if a == b:
                        continue
                    who, column, score = descend(tree, owner[a:b], tree.place[at[a:b]].astype(np.int64), power[a:b], floor, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[who]), batch.column(0)[n].values.take(pa.array(column)), pa.array(score)], names=out.names)
                    best_item, best_score = np.concatenate([best_item, who]), np.concatenate([best_score, score])
                keep = best_of(best_item, best_score, np.zeros(len(best_item), np.int64), k)
                best_item, best_score = best_item[keep], best_score[keep]
                full = np.bincount(best_item, minlength=items) >= k
                least = np.full(items, np.iinfo(np.int64).max)
                np.minimum.at(least, best_item, best_score)
                floor = np.where(full, np.maximum(floor, least), floor)

    return with_workers(index.select("idents", *T.StructType.fromDDL(INDEX).fieldNames())).mapInArrow(run, out)


def ranked_search(df: DataFrame, items: DataFrame, k: int = 20, text: str = "text", ident: str = "doc_id",
                  item_text: str = "text", item_ident: str = "item_id") -> DataFrame:
    """The k documents of ``df`` that score highest for each item: ``item``, ``rank`` from 1, ``ident``, ``score``.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact in a document (10^9 tf) div (1000 tf + 12 m) with
    m = 75 + (25 n N) div L, and the score sums weight times impact over the item's terms, repeats included. Only scores
    above 0 are ranked; equal scores are ordered by ascending id, null last, and rows that repeat an id are documents of
    their own. Null texts, empty ones and texts without terms match nothing; nor does any text if either table is empty.
    Terms are compared by 64-bit hashes. Other columns are ignored.
    """
    documents, total = corpus_size(df, text)
    index = build_index(df, text, ident, documents, total)
    asked = query_terms(items, item_text, item_ident)
    terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    rounds = -(-terms // ROUND_TERMS)
    found = None
    for r in range(rounds):
        # A round's terms are about ROUND_TERMS, or those of its largest item; they are what the workers get.
        rows = asked.filter(F.pmod(F.xxhash64("number"), F.lit(rounds)) == r).select("number", "terms", "repeats").collect()
        if not rows:
            continue
        sizes = [len(x.terms) for x in rows]
        term, repeats = (np.concatenate([x[c] for x in rows]).astype(np.int64) for c in ("terms", "repeats"))
        hits = search_round(index, np.array([x.number for x in rows], np.int64), np.repeat(np.arange(len(rows)), sizes),
                            term.view(np.uint64), repeats, documents, k)
        order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("ident").asc_nulls_last())
        part = store(hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "hits")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.select("item", F.lit(1).alias("rank"), F.lit(None).cast(df.schema[ident].dataType).alias("ident"),
                            F.lit(0).cast("bigint").alias("score")).filter("false")
    return found.join(asked.select("number", "item"), "number").select("item", "rank", "ident", "score")
