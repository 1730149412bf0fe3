"""Suffix-array dedup: remove every byte that a long string of a text with a smaller id already holds.

The judged strings are all windows of ``LONG`` = 50 bytes. Comparing every window with every other would move fifty
times the text, so windows are organised in segments first: a window belongs to the smallest hash among its
16-byte grams (its anchor), and neighbouring windows with one anchor form a segment. Equal windows have equal anchors,
so a window only needs to be looked for in segments of its anchor.

1. Texts are stored in chunks of some MB. Each chunk sends its distinct (anchor, segment hash) entries, with the
   smallest id, to the anchor's bucket; a bucket answers per entry: no other text has the anchor; an earlier text has
   the whole segment; or contents have to be compared.
2. Those contents go to buckets again. Each bucket keeps a logarithmic index family (``LevelIndex``): contents arrive
   in batches in the order of ids, a batch gets a suffix array, is merge-scanned against the levels, and equal-sized
   levels merge. The answer is the set of windows of each content that an earlier text has.
3. Chunks join the covered windows to spans and cut them out.

An anchor with many different segments (the edges of a line that a third of all texts share) sends single windows,
bucketed by their own hash, in step 2, so that no bucket depends on how common a string is; equal windows of a chunk
are sent once. Everything a task holds is a chunk or a bucket, and the number of buckets follows the size of the input.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import col, slices, store, with_workers
from tablegauge.llm.shingles import mix

LONG, GRAM = 50, 16
GRAMS = LONG - GRAM + 1  # grams of a window
CHUNK_BYTES = 4 << 20  # text of a chunk
STEP_BYTES = 1 << 20  # text hashed at a time; the arrays take some hundred bytes for each
BUCKET_BYTES = 8 << 20  # text per bucket
LOCAL_HOT, HOT = 8, 2000  # different segments of an anchor in a chunk, in a bucket, from which it sends single windows
BATCH = 1 << 16  # windows that enter the index together

_rng = np.random.default_rng(50)
BYTE_VALUES = _rng.integers(0, 1 << 64, 256, np.uint64)
BASE = 0x9E3779B97F4A7C15
FACTORS = _rng.integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)
NONE, WHOLE, COMPARE, WINDOWS = 0, 1, 2, 3  # answers for an entry
LOW48 = np.uint64((1 << 48) - 1)


def pack(**values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, protocol=5))


def unpack(data: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 16 and of the 32 bytes from each place."""
    h = BYTE_VALUES[data]
    for step in (1, 2, 4, 8):
        h = h[:-step] * power(step) + h[step:]
    return h, h[:-16] * power(16) + h[16:]


def step_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """First and last window start of each segment, its anchor hash and its content hash; places within ``data``."""
    h16, h32 = gram_hashes(data)
    anchor = mix(h16)
    low = np.uint64((1 << 24) - 1)
    least = (anchor & ~low) | np.arange(len(anchor), dtype=np.uint64)  # ties go to the first place
    for step in (1, 2, 4, 8, 16):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[:len(least) - (GRAMS - 32)], least[GRAMS - 32:])
    n = len(least)
    over = np.zeros(len(data) + 1, np.int32)
    np.add.at(over, np.maximum(starts, ends - LONG + 1), 1)
    np.add.at(over, ends, -1)
    valid = np.cumsum(over)[:n] == 0
    same = np.concatenate([[False], (least[1:] == least[:-1]) & valid[:-1]])
    first = np.flatnonzero(valid & ~same)
    last = np.flatnonzero(valid & ~np.concatenate([same[1:] & valid[1:], [False]]))
    size = last - first + LONG
    content = mix(h32[first] * FACTORS[0] + h32[first + (size - 32) // 2] * FACTORS[1] + h32[last + LONG - 32] * FACTORS[2]
                  + size.astype(np.uint64) * FACTORS[3])
    # Anchors are minima, so their own bits are mostly low; mixed again they spread over the buckets.
    return first, last, mix(anchor[(least[first] & low).astype(np.int64)] * FACTORS[3]), content


class Chunk:
    """Texts of a chunk as one byte array, with the segments and distinct entries that both steps compute alike."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, bits: int):
        self.ids, self.sizes, self.bits = ids, sizes, bits
        self.data = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self._segments()
        self._entries()

    def _segments(self) -> None:
        pieces = [(d, s, min(s + STEP_BYTES, e - LONG + 1) + LONG - 1)
                  for d, (s, e) in enumerate(zip(self.starts.tolist(), self.ends.tolist())) if e - s >= LONG
                  for s in range(s, e - LONG + 1, STEP_BYTES)]
        found, step, size = [], [], 0
        for i, piece in enumerate(pieces):
            step.append(piece)
            size += piece[2] - piece[1]
            if size < STEP_BYTES and i + 1 < len(pieces):
                continue
            docs, begin, end = (np.array(x) for x in zip(*step))
            local = np.cumsum(end - begin) - (end - begin)
            data = np.concatenate([self.data[a:b] for _, a, b in step])
            first, last, anchor, content = step_segments(data, local, local + end - begin)
            at = np.searchsorted(local, first, "right") - 1
            found.append((docs[at], first - local[at] + begin[at], last - local[at] + begin[at], anchor, content))
            step, size = [], 0
        empty = np.zeros(0, np.int64)
        self.doc, self.first, self.last, self.anchor, self.content = (
            [np.concatenate(x) for x in zip(*found)] if found else [empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)])

    def _entries(self) -> None:
        """Distinct (anchor, content) with their smallest id; ``entry`` maps each segment to its own."""
        doc_ids = self.ids[self.doc]
        key = mix(self.anchor + (self.content & LOW48) * FACTORS[0])
        order = np.lexsort((doc_ids, key)) if len(key) else np.zeros(0, np.int64)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
        heads = order[new]
        self.entry = np.zeros(len(key), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.head, self.entry_id = heads, doc_ids[heads]
        anchors, which, times = np.unique(self.anchor[heads], return_inverse=True, return_counts=True)
        self.hot = times[which] > LOCAL_HOT
        # One marker stands for all entries of an anchor that is hot here.
        hot_anchors = np.flatnonzero(times > LOCAL_HOT)
        marker_id = np.full(len(anchors), np.iinfo(np.int64).max)
        np.minimum.at(marker_id, which, self.entry_id)
        cold = np.flatnonzero(~self.hot)
        sent_anchor = np.concatenate([self.anchor[heads[cold]], anchors[hot_anchors]])
        sent_content = np.concatenate([np.maximum(self.content[heads[cold]] & LOW48, 1), np.zeros(len(hot_anchors), np.uint64)])
        sent_id = np.concatenate([self.entry_id[cold], marker_id[hot_anchors]])
        bucket = (sent_anchor >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.lexsort((sent_anchor, sent_id, bucket))
        self.sent_entry = np.concatenate([cold, np.full(len(hot_anchors), -1)])[order]
        self.sent = bucket[order], sent_anchor[order], sent_content[order], sent_id[order]

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, entries) to send."""
        bucket, anchor, content, ids = self.sent
        for a, b in cut(bucket):
            short = (anchor[a:b] >> np.uint64(32 - self.bits)).astype(np.uint32)
            yield int(bucket[a]), pack(anchor=short, low=content[a:b].astype(np.uint32), high=(content[a:b] >> np.uint64(32)).astype(np.uint16),
                                       ids=np.diff(ids[a:b], prepend=0))

    def answers(self, replies: dict[int, bytes]) -> np.ndarray:
        """Answer for each segment: those of a larger id than its entry's are repeated within the chunk."""
        by_entry = np.where(self.hot, WINDOWS, NONE).astype(np.uint8)
        bucket = self.sent[0]
        for a, b in cut(bucket):
            got = np.frombuffer(zstandard.ZstdDecompressor().decompress(replies[int(bucket[a])]), np.uint8)
            own = self.sent_entry[a:b]
            by_entry[own[own >= 0]] = got[own >= 0]
        out = by_entry[self.entry]
        out[self.ids[self.doc] > self.entry_id[self.entry]] = WHOLE
        return out


def cut(keys: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of equal keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]))


def judge(table: pa.Table) -> pa.Table:
    """Answers of one bucket to the entries of all chunks."""
    parts = [unpack(p) for p in table["payload"].to_pylist()]
    sizes = [len(p["anchor"]) for p in parts]
    anchor = np.concatenate([p["anchor"] for p in parts])
    content = np.concatenate([p["low"].astype(np.uint64) | p["high"].astype(np.uint64) << np.uint64(32) for p in parts])
    ids = np.concatenate([np.cumsum(p["ids"]) for p in parts])
    order = np.lexsort((ids, content, anchor))
    a, c, d = anchor[order], content[order], ids[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
    new = new_anchor | np.concatenate([[True], c[1:] != c[:-1]])
    group = np.cumsum(new_anchor) - 1
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    starts = np.flatnonzero(new_anchor)
    kinds = np.add.reduceat(new.astype(np.int64), starts)
    smallest, largest = np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)
    marked = np.maximum.reduceat((c == 0).astype(np.int8), starts) > 0
    open_ = (marked | (kinds > 1)) & (smallest < largest)
    state = np.where(marked | (kinds > HOT), WINDOWS, np.where(open_, COMPARE, NONE))[group]
    state[(d > d[head]) & (c != 0)] = WHOLE
    out = np.zeros(len(a), np.uint8)
    out[order] = state
    stops = np.cumsum(sizes)
    press = zstandard.ZstdCompressor(level=3).compress
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"],
                     "payload": pa.array([press(out[e - n:e].tobytes()) for e, n in zip(stops, sizes)], pa.binary())})


class LevelIndex:
    """Sorted windows (suffixes cut at ``LONG`` bytes) in levels of geometrically growing size."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Merge scan: which of the sorted keys some level holds."""
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            found |= level[at] == keys
        return found

    def add(self, keys: np.ndarray) -> None:
        """Enter sorted distinct keys as a new level; levels of about equal size become one."""
        if len(keys):
            self.levels.append(keys)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            both = np.concatenate([self.levels.pop(), self.levels.pop()])
            both.sort(kind="stable")
            self.levels.append(both)


def suffix_windows(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the contents as fixed-width byte strings, the content and the place in it of each."""
    sizes = np.array([len(c) for c in contents], np.int64)
    data = np.frombuffer(b"".join(contents), np.uint8)
    views = np.lib.stride_tricks.sliding_window_view(data, LONG)
    windows = sizes - LONG + 1
    owner = np.repeat(np.arange(len(contents)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (np.cumsum(sizes) - sizes)[owner] + place
    return np.ascontiguousarray(views[at]).view(f"V{LONG}").ravel(), owner, place


def sortable(keys: np.ndarray) -> np.ndarray:
    """Fixed-width strings that compare byte by byte; a last byte keeps trailing zero bytes."""
    out = np.full((len(keys), LONG + 1), 1, np.uint8)
    out[:, :LONG] = keys.view(np.uint8).reshape(-1, LONG)
    return out.view(f"S{LONG + 1}").ravel()


def scan(table: pa.Table) -> pa.Table:
    """Which windows of each content an earlier text has: a bit per window, for the contents of all chunks."""
    parts = [unpack(p) for p in table["payload"].to_pylist()]
    sizes = [len(p["ids"]) for p in parts]
    ids = np.concatenate([p["ids"] for p in parts])
    contents: list[bytes] = []
    for p in parts:
        stops = np.cumsum(p["sizes"]).tolist()
        contents += [p["data"][b - n:b] for b, n in zip(stops, p["sizes"].tolist())]
    order = np.argsort(ids, kind="stable")
    masks = np.zeros(len(ids), np.uint64)
    index, i = LevelIndex(), 0
    counts = np.array([len(c) for c in contents], np.int64) - LONG + 1
    while i < len(order):
        j, held = i, 0
        # A batch ends between two ids, so that all earlier batches hold smaller ids only.
        while j < len(order) and (held < BATCH or ids[order[j]] == ids[order[j - 1]]):
            held += int(counts[order[j]])
            j += 1
        batch = order[i:j]
        keys, owner, place = suffix_windows([contents[x] for x in batch])
        keys = sortable(keys)
        own_ids = ids[batch][owner]
        suffix_array = np.lexsort((own_ids, keys))
        keys, own_ids = keys[suffix_array], own_ids[suffix_array]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
        heads = np.flatnonzero(new)
        known = index.has(keys[heads])
        hit = known[np.cumsum(new) - 1] | (own_ids > own_ids[head])
        at = suffix_array[hit]
        np.bitwise_or.at(masks, batch[owner[at]], np.uint64(1) << place[at].astype(np.uint64))
        index.add(keys[heads[~known]])
        i = j
    stops = np.cumsum(sizes)
    press = zstandard.ZstdCompressor(level=3).compress
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"],
                     "payload": pa.array([press(masks[e - n:e].tobytes()) for e, n in zip(stops, sizes)], pa.binary())})


def merged(first: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of covered bytes, each within one text."""
    order = np.lexsort((first, doc))
    first, end, doc = first[order] + doc[order], end[order] + doc[order], doc[order]  # a gap of one between texts
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    last = np.concatenate([new[1:], [True]])
    return first[new] - doc[new], reach[last] - doc[new], doc[new]


def outcomes(ids, sizes, data: bytes, first, end, doc, spans_too: bool) -> dict[str, list]:
    """Result rows of texts from their covered windows' spans."""
    stops = np.cumsum(sizes)
    starts = stops - sizes
    if len(first):
        first, end, doc = merged(first, end, doc)
    at = np.searchsorted(doc, np.arange(len(ids) + 1))
    out: dict[str, list] = {k: [] for k in ("ident", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")}
    for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist())):
        spans = list(zip(first[at[i]:at[i + 1]].tolist(), end[at[i]:at[i + 1]].tolist()))
        digest, place = hashlib.sha256(), a
        for s, e in spans:
            digest.update(data[place:s])
            place = e
        digest.update(data[place:b])
        out["ident"].append(int(ids[i]))
        out["n_bytes"].append(b - a)
        out["n_removed"].append(sum(e - s for s, e in spans))
        out["n_spans"].append(len(spans))
        out["kept_sha256"].append(digest.hexdigest())
        out["removed"].append([(s - a, e - a) for s, e in spans] if spans_too else None)
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = [("ident", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
          ("kept_sha256", pa.string()), ("removed", SPANS)]
RESULT_DDL = ("ident bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
              "removed array<struct<start: bigint, end: bigint>>")
MESSAGE_DDL = "kind string, chunk bigint, bucket int, payload binary, "


def result_table(rows: dict[str, list], n: int | None = None) -> pa.Table:
    return pa.table({k: pa.array(rows[k] if rows else [None] * (n or 0), t) for k, t in RESULT})


def message_table(kind: str, chunk: list[int], bucket: list[int], payload: list[bytes]) -> pa.Table:
    head = pa.table({"kind": pa.array([kind] * len(chunk), pa.string()), "chunk": pa.array(chunk, pa.int64()),
                     "bucket": pa.array(bucket, pa.int32()), "payload": pa.array(payload, pa.binary())})
    body = result_table({}, len(chunk))
    for name in body.column_names:
        head = head.append_column(name, body[name])
    return head


def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows of (ident, text) rows."""
    task = TaskContext.get().partitionId()
    held, size, made = [], 0, 0

    def flush():
        ids = np.array([i for i, _ in held], np.int64)
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([(task << 32) + made], pa.int64()),
            "payload": pa.array([pack(ids=ids, sizes=np.array([len(t) for _, t in held], np.int64), data=b"".join(t for _, t in held))],
                                pa.binary())})

    for batch in batches:
        for part in slices(batch, 1, CHUNK_BYTES):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                raw = (t or "").encode()
                if held and size + len(raw) > CHUNK_BYTES:
                    yield flush()
                    held, size, made = [], 0, made + 1
                held.append((i, raw))
                size += len(raw)
    if held:
        yield flush()


def suffix_dedup(df: DataFrame, text: str = "text", ident: str = "doc_id", spans: bool = True) -> DataFrame:
    """Remove the bytes of each text that a string of 50 bytes covers which also starts in a text of a smaller id.

    Returns per row ``ident`` long, ``n_bytes``, ``n_removed`` and ``n_spans`` long (maximal removed runs),
    ``kept_sha256`` (of the remaining bytes) and ``removed``, the runs as [start, end) byte spans (null if ``spans`` is
    false). Texts are UTF-8 bytes, null counts as empty; strings are judged on the input and never cross texts. Rows
    with the same id are not earlier than each other; rows with a null id take no part and lose nothing. An empty table
    gives an empty result.
    """
    rows = with_workers(df).select(col(ident).cast("bigint").alias("ident"), col(text).cast("string").alias("text"))
    chunks = store(rows.filter("ident IS NOT NULL").mapInArrow(to_chunks, "chunk bigint, payload binary"), "text-chunks")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (int(total) // BUCKET_BYTES).bit_length())
    buckets = 1 << bits

    def load(payload: bytes) -> Chunk:
        p = unpack(payload)
        return Chunk(p["ids"], p["sizes"], p["data"], bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = list(load(payload.as_py()).messages())
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int32()),
                                                  pa.array([p for _, p in out], pa.binary())], names=["chunk", "bucket", "payload"])

    message = "chunk bigint, bucket int, payload binary"
    judged = store(chunks.mapInArrow(send, message).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(judge, message), "anchor-answers")

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return message_table("none", [], [], [])
        number = left["chunk"][0].as_py()
        p = unpack(left["payload"][0].as_py())
        chunk = Chunk(p["ids"], p["sizes"], p["data"], bits)
        answer = chunk.answers(dict(zip(right["bucket"].to_pylist(), right["payload"].to_pylist())))
        whole, windows = answer == WHOLE, answer == WINDOWS
        first, end, doc = chunk.first[whole], chunk.last[whole] + LONG, chunk.doc[whole]

        # Items to compare: one segment for each entry, one window for each distinct window of hot anchors.
        compare = np.flatnonzero(answer == COMPARE)
        entries, head, item = np.unique(chunk.entry[compare], return_index=True, return_inverse=True)
        heads = compare[head]
        start, size, ids = chunk.first[heads], chunk.last[heads] + LONG - chunk.first[heads], p["ids"][chunk.doc[heads]]
        bucket = (chunk.anchor[heads] >> np.uint64(64 - bits)).astype(np.int64)

        w = np.flatnonzero(windows)
        lengths = chunk.last[w] - chunk.first[w] + 1
        owner = np.repeat(w, lengths)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + chunk.first[owner]
        raw = np.lib.stride_tricks.sliding_window_view(chunk.data, LONG)[place] if len(place) else np.zeros((0, LONG), np.uint8)
        hashed = [hashlib.blake2b(x, digest_size=8).digest() for x in raw]
        key = np.frombuffer(b"".join(hashed), np.uint64)
        window_ids = p["ids"][chunk.doc[owner]]
        order = np.lexsort((window_ids, key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
        lead = order[new]
        window_item = np.zeros(len(key), np.int64)
        window_item[order] = np.cumsum(new) - 1 + len(heads)
        later = window_ids > window_ids[lead][window_item - len(heads)] if len(key) else np.zeros(0, bool)
        first, end, doc = (np.concatenate(x) for x in ((first, place[later]), (end, place[later] + LONG), (doc, chunk.doc[owner[later]])))
        start, ids = np.concatenate([start, place[lead]]), np.concatenate([ids, window_ids[lead]])
        size = np.concatenate([size, np.full(len(lead), LONG)])
        bucket = np.concatenate([bucket, (key[lead] >> np.uint64(64 - bits)).astype(np.int64)])

        order = np.argsort(bucket, kind="stable")
        place_of = np.zeros(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        payloads, names = [], []
        for a, b in cut(bucket[order]):
            own = order[a:b]
            names.append(int(bucket[own[0]]))
            payloads.append(pack(ids=ids[own], sizes=size[own], data=b"".join(
                p["data"][s:s + n] for s, n in zip(start[own].tolist(), size[own].tolist()))))
        asked_first = np.concatenate([chunk.first[compare], place[~later]])
        asked_doc = np.concatenate([chunk.doc[compare], chunk.doc[owner[~later]]])
        asked_item = place_of[np.concatenate([item, window_item[~later]]).astype(np.int64)]

        pending = np.unique(asked_doc)
        done = np.setdiff1d(np.arange(len(p["ids"])), pending)

        def of(which: np.ndarray, f, e, d, more=None):
            """The texts ``which`` and their spans, renumbered."""
            number_of = np.full(len(p["ids"]), -1)
            number_of[which] = np.arange(len(which))
            stops = np.cumsum(p["sizes"][which])
            shift = (stops - p["sizes"][which]) - chunk.starts[which]
            keep = number_of[d] >= 0
            nd = number_of[d[keep]]
            body = b"".join(p["data"][a:b] for a, b in zip(chunk.starts[which].tolist(), chunk.ends[which].tolist()))
            return (p["ids"][which], p["sizes"][which], body, f[keep] + shift[nd], e[keep] + shift[nd], nd)

        made = [message_table("item", [number] * len(names), names, payloads)]
        result = result_table(outcomes(*of(done, first, end, doc), spans))
        lead_columns = message_table("done", [number] * len(done), [0] * len(done), [b""] * len(done)).select(
            ["kind", "chunk", "bucket", "payload"])
        for name in result.column_names:
            lead_columns = lead_columns.append_column(name, result[name])
        made.append(lead_columns)
        if len(pending):
            w_ids, w_sizes, body, f, e, d = of(pending, first, end, doc)
            _, _, _, af, _, ad = of(pending, asked_first, asked_first, asked_doc)
            made.append(message_table("open", [number], [0], [pack(
                ids=w_ids, sizes=w_sizes, data=body, first=f, end=e, doc=d, asked_first=af, asked_doc=ad, asked_item=asked_item)]))
        return pa.concat_tables(made)

    applied = store(chunks.groupBy("chunk").cogroup(judged.groupBy("chunk")).applyInArrow(apply, MESSAGE_DDL + RESULT_DDL), "applied")
    scanned = store(applied.filter("kind = 'item'").select("chunk", "bucket", "payload").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(
        scan, message), "window-answers")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return result_table({}, 0)
        p = unpack(left["payload"][0].as_py())
        replies = sorted(zip(right["bucket"].to_pylist(), right["payload"].to_pylist()))
        masks = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for _, x in replies), np.uint64)[p["asked_item"]]
        firsts, docs = [p["first"]], [p["doc"]]
        ends = [p["end"]]
        for bit in range(GRAMS):
            hit = (masks >> np.uint64(bit)) & np.uint64(1) == 1
            firsts.append(p["asked_first"][hit] + bit)
            ends.append(p["asked_first"][hit] + bit + LONG)
            docs.append(p["asked_doc"][hit])
        return result_table(outcomes(p["ids"], p["sizes"], p["data"], *map(np.concatenate, (firsts, ends, docs)), spans))

    late = applied.filter("kind = 'open'").select("chunk", "payload").groupBy("chunk").cogroup(
        scanned.groupBy("chunk")).applyInArrow(finish, RESULT_DDL)
    names = [n for n, _ in RESULT]
    ignored = rows.filter("ident IS NULL").select(
        "ident", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        (F.array() if spans else F.lit(None)).cast("array<struct<start: bigint, end: bigint>>").alias("removed"))
    return applied.filter("kind = 'done'").select(*names).unionByName(late).unionByName(ignored)
