"""Byte-level BPE encoding and decoding with a pair occurrence index.

The words of a slice of texts that are not in the worker's cache are laid out as one chain of symbols. An index maps
each mergeable pair to all its positions; ranks that occur are taken in ascending order, all occurrences of a pair are
merged at once, and the lists of the pairs this makes are updated. A word's ids then serve every later occurrence.

Texts are split into words as byte-level pre-tokenization does it: texts of code points below 256 by the pattern below
with its classes written out, other texts by the tokenizers library's own splitter, whose Unicode tables decide what a
letter is. The strings of added tokens are cut out first and become their own ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from tablegauge.llm.common import map_texts

# The split pattern of byte-level BPE, with the letters, numbers and spaces of the first 256 code points.
LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = r"\t-\r \x85\xa0"
WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

CACHE_WORDS = 150_000  # words in each of the worker's two cache generations
SLICE = 1 << 20  # bytes of text split at a time; the words take some fifty bytes for each


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    names |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in names)}
    return names


class PairIndexBpe:
    """One tokenizer file's vocabulary and merges, ready to encode words and decode ids."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        vocab, names = spec["model"]["vocab"], byte_names()
        byte_of = {c: b for b, c in names.items()}
        self.byte_id = np.array([vocab[names[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pair_keys, self.pair_ranks = pairs[order], order.astype(np.int64)
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.splitter = None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where the pair has no merge."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1) if len(self.pair_keys) else np.full(len(keys), -1)

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        n, ends = len(ids), np.cumsum(sizes)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(places: np.ndarray) -> None:
            """Enter the pairs that begin at these places."""
            places = places[after[places] >= 0]
            ranks = self.ranks(ids[places], ids[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
                rank = int(ranks[start])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(places[start:end])

        add(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            left, right, made = self.pairs[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            nxt = after[at]
            at = at[(ids[at] == left) & (nxt >= 0) & (ids[nxt] == right)]
            if left == right and len(at) > 1:  # of overlapping pairs in a run, every second one from the left
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                heads = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - heads) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            ids[at] = made
            ids[gone] = -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            prior = before[at]
            add(np.unique(np.concatenate([prior[prior >= 0], at])))
        live = ids >= 0
        counts = np.concatenate([[0], np.cumsum(live)])
        stops = (counts[ends] * 4).tolist()
        packed = ids[live].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops)] if stops else []

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.splitter is None:
                from tokenizers.pre_tokenizers import ByteLevel
                self.splitter = ByteLevel(add_prefix_space=False)
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return WORDS.findall(text)

    def parts(self, text: str) -> list[str]:
        """Words of a whole text; an added token is one word."""
        if self.cut is None or not any(t in text for t in self.added):
            return self.split(text)
        out = []
        for piece in self.cut.split(text):
            out += [piece] if piece in self.added else self.split(piece)
        return out

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.parts(t) for t in texts]
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        table = {t: int(i).to_bytes(4, "little") for t, i in self.added.items()}
        new = []
        for w in set().union(*split):
            if w in table:
                continue
            ids = self.young.get(w)
            if ids is None:
                ids = self.old.get(w)
                if ids is None:
                    new.append(w)
                    continue
                self.young[w] = ids
            table[w] = ids
        made = dict(zip(new, self.encode_words(new)))
        table |= made
        self.young |= made
        return [b"".join(map(table.__getitem__, words)) for words in split]

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; added tokens appear as their strings."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, PairIndexBpe] = {}


def load(tokenizer_json: str) -> PairIndexBpe:
    """The tokenizer of this worker process; the last one stays loaded with its cache."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PairIndexBpe(tokenizer_json)
    return _loaded[key]


def bpe_round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", carry: Sequence[str] | None = None,
                   with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns ``row`` (the carried columns, all by default), ``ids`` array<int> (unless ``with_ids`` is false), ``n_tokens``
    long, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and ``decoded_sha256`` (of the decoded
    text in UTF-8). Null counts as the empty text, which has no ids. ``tokenizer_path`` is a tokenizer file on the
    driver; executors get its contents, a few MB.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    kind = ("ids array<int>, " if with_ids else "") + "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def make():
        bpe = load(spec.value)

        def run(texts):
            packed = bpe.encode([t or "" for t in texts])
            ids = [[np.frombuffer(p, "<i4") for p in packed]] if with_ids else []
            return [*ids, [len(p) // 4 for p in packed], [hashlib.sha256(p).hexdigest() for p in packed],
                    [hashlib.sha256(bpe.decode(p).encode()).hexdigest() for p in packed]]
        return run

    return map_texts(df, text, df.columns if carry is None else carry, kind, make, SLICE)
