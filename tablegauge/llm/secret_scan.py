"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are maximal runs of one character class. A window of the class's width slides over each candidate; its
entropy changes by the one character that enters and the one that leaves, so it is kept from the counts without
recounting. The windows over the class's threshold are joined to spans. What an allowed shape explains is cut out of a
candidate (see ``EXPLAINED`` and ``WORDS``), and what is left on either side is looked at by itself. Spans inside a
pattern match are not reported again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from tablegauge.llm.common import map_texts

KINDS = ("assign", "access", "hex", "entropy")  # the order of spans that begin together
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24}")

# class: pattern of a candidate, window, bits per character from which a window counts
CLASSES = {
    "hex": (re.compile(r"(?<![0-9A-Za-z+/_-])[0-9A-Fa-f]{24,}(?![0-9A-Za-z+/_-])"), 24, 3.0),
    "base64": (re.compile(r"[0-9A-Za-z+/_-]{20,}=*"), 20, 4.1 * log2(20) / log2(28)),
}
LONG = 28, 4.1  # a second window for base64, in which words may stand among random characters
# A part that is all of one such shape is none of a secret: words and numbers alone, identifiers joined by _ - /.
ALLOWED = re.compile(r"[A-Za-z]+|[0-9]+|(?:[A-Za-z]+[_/+-]+)+[A-Za-z]*[0-9]{0,4}")
# Shapes that look random and explain just themselves: UUIDs, digests announced as such, each up to its own length.
EXPLAINED = re.compile(
    r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])"
    r"|sha1-(?:[0-9A-Fa-f]{40}|[0-9A-Za-z+/_-]{1,27}=*)|sha256-(?:[0-9A-Fa-f]{64}|[0-9A-Za-z+/_-]{1,43}=*)"
    r"|sha384-(?:[0-9A-Fa-f]{96}|[0-9A-Za-z+/_-]{1,64})|sha512-(?:[0-9A-Fa-f]{128}|[0-9A-Za-z+/_-]{1,86}=*))")
SAMPLE = re.compile("EXAMPLE|example")
SAMPLE_KEY = 40  # a run of at most so many characters with such a word inside of other characters is a sample key
SEQUENCE = 10  # so many characters that follow each other in the alphabet or the digits explain themselves
# Path segments that are words, also in camel case and numbered, and hex runs, which the patterns find.
WORDS = re.compile(
    r"[_/+-]?(?<![0-9A-Za-z])(?=[0-9A-Za-z]{4})(?:[A-Z]++[0-9]{0,4}+|[0-9]++|(?:[A-Z]?[a-z]{2,}+[0-9]{0,4}+)++)(?![0-9A-Za-z=])[_/+-]?"
    r"|[0-9a-f]{24,}")


def sequences(text: str) -> list[tuple[int, int]]:
    out, start = [], 0
    for i in range(1, len(text) + 1):
        if i == len(text) or ord(text[i]) != ord(text[i - 1]) + 1:
            if i - start >= SEQUENCE:
                out.append((start, i))
            start = i
    return out


def explained(run: str) -> list[tuple[int, int]]:
    """Parts of a candidate that an allowed shape explains."""
    out = [m.span() for m in EXPLAINED.finditer(run)] + sequences(run)
    for m in SAMPLE.finditer(run):
        inside = run[:m.start()][-1:].isalnum() or run[m.end():][:1].isalnum()
        out.append((0, len(run)) if inside and len(run) <= SAMPLE_KEY else m.span())
    return sorted(out)


def rests(start: int, end: int, cuts: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of [start, end) without the cuts, which are sorted by start."""
    out = []
    for a, b in cuts:
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def entropic_spans(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Joined spans of the windows of ``text`` with at least so many bits per character; [start, end)."""
    if len(text) < window:
        return []
    counts: dict[str, int] = {}
    weight = [0.0, *[c * log2(c) for c in range(1, window + 2)]]
    total = 0.0  # sum of c log2 c; the entropy is log2(window) - total / window
    out: list[list[int]] = []
    most = (log2(window) - least) * window + 1e-9
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        total += weight[c + 1] - weight[c]
        counts[ch] = c + 1
        if i >= window:
            gone = text[i - window]
            c = counts[gone]
            total += weight[c - 1] - weight[c]
            counts[gone] = c - 1
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([start, i + 1])
    return [(a, b) for a, b in out]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three patterns, leftmost and non-overlapping per kind; too short ones are dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if HEX_RUN.search(text):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def added_spans(text: str, base: Sequence[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of high entropy that no pattern covers and no allowed shape explains."""
    found = []
    for name, (pattern, window, least) in CLASSES.items():
        for m in pattern.finditer(text):
            if ALLOWED.fullmatch(m[0]):
                continue
            for start, end in rests(0, len(m[0]), explained(m[0])):
                part, at = m[0][start:end], m.start() + start
                if ALLOWED.fullmatch(part):
                    continue
                pieces = [(0, len(part), window, least)]
                if name == "base64":
                    pieces = [(0, len(part), *LONG)] + [
                        (x, y, window, least) for x, y in rests(0, len(part), [w.span() for w in WORDS.finditer(part)])
                        if not ALLOWED.fullmatch(part[x:y])]
                found += [(at + x + a, at + x + b) for x, y, w, bits in pieces for a, b in entropic_spans(part[x:y], w, bits)]
    out: list[tuple[str, int, int]] = []
    for a, b in sorted(found):
        if any(s <= a and b <= e for _, s, e in base):
            continue
        if out and a < out[-1][2]:
            out[-1] = ("entropy", out[-1][1], max(b, out[-1][2]))
        else:
            out.append(("entropy", a, b))
    return out


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def secret_scan(df: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """Find secrets in every whole text.

    Returns ``row`` (the carried columns, all by default), ``n_assign``, ``n_access``, ``n_hex``, ``n_entropy`` long,
    ``base_sha256`` (of the joined pattern spans) and ``spans`` (all spans as kind:start:end in code points, end
    exclusive, by start and then kind, comma-joined). A span is the whole match. Null counts as the empty text, which
    has no spans.
    """
    def run(texts):
        rows = []
        for t in texts:
            base = base_spans(t or "")
            rows.append((base, added_spans(t or "", base)))
        count = lambda k: pa.array([sum(s[0] == k for s in b) for b, _ in rows], pa.int64())
        return [count("assign"), count("access"), count("hex"), pa.array([len(a) for _, a in rows], pa.int64()),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string()),
                pa.array([joined([*b, *a]) for b, a in rows], pa.string())]

    return map_texts(df, text, df.columns if carry is None else carry,
                     "n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans string",
                     lambda: run)
