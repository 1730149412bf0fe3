"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's vector is the mean embedding of its byte n-grams; a linear layer on it gives the language. The classifier is
fitted on a bounded sample: about ``TRAIN_ROWS_PER_LANGUAGE`` labelled rows of each language, those whose id has a hash
under the share that gives so many. Executors count the n-grams of whole texts, the driver trains on those counts. A fifth of the sample is kept
out of the training: it sets the temperature of the softmax and the score under which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.common import col, map_texts, store

TRAIN_ROWS_PER_LANGUAGE = 1500
BUCKETS = 1 << 13
DIMENSIONS = 16
GRAMS = (2, 3, 4)
EPOCHS, BATCH, RATE = 12, 32, 40.0
REJECTED_SHARE = 0.0005  # of correctly predicted calibration rows, at most so many lie under the rejection score
UNKNOWN = "und"
SLICE = 1 << 20  # bytes of text counted or scored at a time; the arrays take some forty bytes for each

SEPARATOR = 0x20
# a-z and all bytes of multi-byte characters stay; anything else separates words
KEEP = np.full(256, SEPARATOR, np.uint8)
KEEP[97:123] = np.arange(97, 123)
KEEP[128:] = np.arange(128, 256)


def grams(texts: Sequence[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket arrays (one per gram length) of all texts' n-grams, and the first and last byte place of each text."""
    raw = [KEEP[np.frombuffer(t.lower().encode("utf-8", "replace"), np.uint8)] for t in texts]
    gap = np.full(1, SEPARATOR, np.uint8)
    flat = np.concatenate([x for r in raw for x in (gap, r)] + [gap])
    sep = flat == SEPARATOR
    stay = np.concatenate([[True], ~(sep[1:] & sep[:-1])])
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    stay[np.cumsum(lengths) - lengths] = True  # every text begins with a separator, whatever the one before ends with
    kept = np.cumsum(stay)
    ends = kept[np.cumsum(lengths) - 1]
    starts = np.concatenate([[0], ends[:-1]])
    # Texts are set apart by as many separators as the longest n-gram has bytes, so that no n-gram meets the next text.
    apart = max(GRAMS) * np.arange(len(raw))
    owner = np.repeat(np.arange(len(raw) + 1), np.concatenate([ends - starts, [len(kept) and int(kept[-1]) - int(ends[-1])]]))
    spaced = np.full(int(kept[-1]) + max(GRAMS) * (len(raw) + 1), SEPARATOR, np.uint8)
    spaced[np.arange(int(kept[-1])) + max(GRAMS) * owner] = flat[stay]
    starts, ends, flat = starts + apart, ends + apart, spaced
    padded = np.concatenate([flat, np.full(max(GRAMS), SEPARATOR, np.uint8)]).astype(np.uint32)
    n, out = len(flat), []
    for size in GRAMS:
        h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(size):
            h = (h ^ padded[k:k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        out.append((h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return out, starts, ends


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(texts: Sequence[str]) -> list[bytes]:
    """Bucket numbers and counts of each text as packed pairs of unsigned 32-bit integers."""
    buckets, starts, ends = grams(texts)
    out = []
    for a, b in zip(starts, ends):
        n = np.bincount(np.concatenate([x[a:b] for x in buckets]), minlength=BUCKETS)
        at = np.flatnonzero(n)
        out.append(np.stack([at, n[at]], 1).astype("<u4").tobytes())
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times output layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """Calibrated probability of each language for each text."""
        buckets, starts, ends = grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for x in buckets:
            weights = self.table[x]
            total += [weights[a:b].sum(axis=0, dtype=np.float64) for a, b in zip(starts, ends)]
        logits = total / ((ends - starts) * len(GRAMS))[:, None] + self.bias
        return softmax(logits / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(samples: Sequence[tuple[str, bytes]]) -> LanguageModel:
    """Train on (language, packed counts) rows; every fifth row calibrates."""
    languages = sorted({lang for lang, _ in samples})
    label = np.array([languages.index(lang) for lang, _ in samples], np.int64)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS))
        for i, r in enumerate(rows):
            pairs = np.frombuffer(samples[r][1], "<u4").reshape(-1, 2)
            x[i, pairs[:, 0]] = pairs[:, 1] / max(1, pairs[:, 1].sum())
        return x

    rng = np.random.default_rng(0)
    order = rng.permutation(len(samples))
    held, train = order[::5], np.delete(order, np.s_[::5])
    if len(samples) < 5 * len(languages):
        held = train = order
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    out = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    steps, done = EPOCHS * -(-len(train) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for i in range(0, len(train), BATCH):
            rows = train[i:i + BATCH]
            rate = RATE * (1 - done / steps)
            x = dense(rows)
            vec = x @ embed
            err = softmax(vec @ out + bias)
            err[np.arange(len(rows)), label[rows]] -= 1
            err /= len(rows)
            back = err @ out.T
            # Rare n-grams have small means, so the embedding takes larger steps than the output layer.
            embed -= rate * 10 * (x.T @ back)
            out -= rate * 0.05 * (vec.T @ err)
            bias -= rate * 0.002 * err.sum(axis=0)
            done += 1
    table = embed @ out
    logits = np.concatenate([dense(held[i:i + 256]) @ table + bias for i in range(0, len(held), 256)])
    truth = label[held]
    grid = np.geomspace(1, 20, 60)  # never sharper than trained: without errors to learn from, sharper always looks better
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    below = float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0
    return LanguageModel(languages, table.astype(np.float32), bias.astype(np.float64), temperature, below)


def train(df: DataFrame, text: str, label: str, ident: str, allowed: Column | None = None) -> LanguageModel | None:
    """Fit a model on a bounded sample of the labelled rows, of those that ``allowed`` admits; None if there are none.

    Rows without label, id or text are not used. Which rows are sampled depends on their ids only.
    """
    admitted = df if allowed is None else df.filter(allowed)
    usable = admitted.filter(col(label).isNotNull() & col(ident).isNotNull())
    language, place = col(label).cast("string"), F.xxhash64(col(ident).cast("string"))
    # Stored, so that its size is known and the texts are not shuffled to join it.
    shares = store(usable.select(language.alias("label")).groupBy("label").agg(
        (F.lit(float(TRAIN_ROWS_PER_LANGUAGE)) / F.count(F.lit(1))).alias("share")), "language-shares")
    sample = usable.filter(col(text).isNotNull()).select(
        language.alias("label"), place.alias("place"), col(text).cast("string").alias("text")).join(shares, "label").filter(
        F.col("place") / F.lit(2.0 ** 64) + 0.5 < F.col("share"))

    def make():
        return lambda texts: [pa.array(counts(texts), pa.binary())]

    packed = map_texts(sample, "text", ["label", "place"], "counts binary", make, SLICE)
    # Rows of one id count once, however often they repeat.
    rows = store(packed.groupBy("row.label", "row.place").agg(F.max("counts").alias("counts")), "language-sample").orderBy(
        "label", "place").collect()
    return fit([(r.label, bytes(r["counts"])) for r in rows]) if rows else None


def identify(df: DataFrame, model: LanguageModel | None, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Predict the language of every whole text.

    Returns ``row`` (the carried columns, all by default), ``lang_pred``, ``score`` (its calibrated probability) and
    ``rejected``. Texts that are null or have no letter, and all texts when there is no model, get ``und`` with score 0
    and are rejected; a prediction is rejected when its score is under the model's rejection score.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            if at:
                p = m.scores([texts[i] for i in at])
                for i, best, value in zip(at, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    pred[i], score[i] = m.languages[best], value
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                    pa.array([s == UNKNOWN or v < m.reject_below for s, v in zip(pred, score)], pa.bool_())]
        return run

    return map_texts(df, text, df.columns if carry is None else carry,
                     "lang_pred string, score double, rejected boolean", make, SLICE)
