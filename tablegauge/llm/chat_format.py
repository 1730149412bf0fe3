"""Chat formatting by incremental black-box rendering.

A template is any object with ``render(turns) -> str``; nothing else about it is known here. Each turn is added to the
turns before it, both prefixes are rendered, and the two outputs are compared: what the longer one has beyond the
shorter one is the turn's span. Two more renderings, with one-letter texts in place of the turn's own, show where the
text lies inside the span, which gives the loss mask. An output that does not continue the one before it means that the
template rewrites history; the number of characters it takes back is reported with the turn.

The whole prefix is rendered for every turn, whatever the length of the conversation, because a template may look at any
of its turns. Time and the text rendered grow with the square of a conversation's length, so the turns of a long one are
dealt out in blocks, each to a task that gets the turns before its block as well; a task holds one conversation's prefix
and two outputs of it. Only a caller that names a ``reach`` has a bounded context instead: the first ``HEAD`` and the
last ``reach`` turns. There every turn beyond is rendered in two contexts, one turn apart in length, and a template whose
output depends on how far back the context goes is reported as rewriting.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.llm.common import col, slices, with_workers

Turn = tuple[str, str]
HEAD = 1
REACH = 4
BLOCK_TURNS = 500  # turns of a conversation that one task formats
LOSS_ROLE = "assistant"
FLUSH_CHARS, FLUSH_ROWS = 1 << 20, 4096


class Template(Protocol):
    def render(self, turns: Sequence[Turn]) -> str: ...


class InstructTemplate:
    """``<s>``, then ``[INST] text [/INST]`` for a user, ``[REPLY] text</s>`` for an assistant and
    ``[ROLE] name``, a line break, ``text [/ROLE]`` for any other role.

    Control strings inside texts and role names get a backslash after their first character; those that already hold
    backslashes there get one more, so that reading takes exactly one away.
    """

    MARKED = re.compile(r"<\\*/?s>|\[\\*/?(?:INST|REPLY|ROLE)\]")
    OPEN = re.compile(r"\[(INST|REPLY|ROLE)\] ")
    CLOSE = {"INST": " [/INST]", "REPLY": "</s>", "ROLE": " [/ROLE]"}
    START = "<s>"

    def escape(self, text: str) -> str:
        if "<" not in text and "[" not in text:
            return text
        return self.MARKED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        if "\\" not in text:
            return text
        return self.MARKED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)

    def render(self, turns: Sequence[Turn]) -> str:
        out = [self.START]
        for role, text in turns:
            body = self.escape(text)
            if role == "user":
                out += ["[INST] ", body, self.CLOSE["INST"]]
            elif role == "assistant":
                out += ["[REPLY] ", body, self.CLOSE["REPLY"]]
            else:
                name = self.escape(role).replace("%", "%25").replace("\n", "%0A")
                out += ["[ROLE] ", name, "\n", body, self.CLOSE["ROLE"]]
        return "".join(out)

    def read(self, output: str) -> Iterator[Turn]:
        """The turns of a formatted text, or of a part of it that begins with a turn."""
        at = len(self.START) if output.startswith(self.START) else 0
        while at < len(output):
            kind = self.OPEN.match(output, at)
            if kind is None:
                raise ValueError(f"no turn begins at character {at}")
            end = output.index(self.CLOSE[kind[1]], kind.end())
            body, at = output[kind.end():end], end + len(self.CLOSE[kind[1]])
            if kind[1] == "ROLE":
                name, body = body.split("\n", 1)
                yield self.unescape(name.replace("%0A", "\n").replace("%25", "%")), self.unescape(body)
            else:
                yield "user" if kind[1] == "INST" else "assistant", self.unescape(body)


@dataclass
class Span:
    """What one turn adds to the output: ``piece`` after ``taken_back`` characters are dropped from its end."""

    piece: str
    taken_back: int
    text_start: int | None = None  # place of the turn's text inside ``piece``
    text_end: int | None = None


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Incremental:
    """Spans of a conversation's turns, added one by one. The template's opening text belongs to the first span.

    Without a ``reach`` every output is that of the whole prefix.
    """

    def __init__(self, template: Template, reach: int | None = REACH):
        self.template, self.reach = template, reach
        self.context: list[Turn] = []
        self.shown: str | None = ""

    def skip(self, turn: Turn) -> None:
        """The next turn is context of later ones; its own span is not asked for. Not with a ``reach``."""
        self.context.append(turn)
        self.shown = None

    def output(self) -> str:
        """What the template makes of the context."""
        if self.shown is None:
            self.shown = self.template.render(self.context)
        return self.shown

    def add(self, turn: Turn, locate: bool) -> Span:
        """The span of the next turn; ``locate`` asks for the place of its text as well."""
        render, before = self.template.render, self.output()
        after = render([*self.context, turn])
        same = common(before, after)
        span = Span(after[same:], len(before) - same)
        if locate and not span.taken_back:
            # Two texts that differ in their only letter: the outputs part where the text begins.
            a, b = (render([*self.context, (turn[0], letter)]) for letter in "ab")
            at = common(a, b)
            tail = len(a) - at - 1
            if at >= same and at + tail <= len(after) and a[:at] == after[:at]:
                span.text_start, span.text_end = at - same, len(after) - tail - same
        self.context.append(turn)
        self.shown = after
        if self.reach is not None and len(self.context) > HEAD + self.reach:
            shorter = [*self.context[:HEAD], *self.context[HEAD + 1:]]
            known, self.shown = render(shorter[:-1]), render(shorter)
            if not span.taken_back and self.shown[common(known, self.shown):] != span.piece:
                span.taken_back, span.text_start, span.text_end = len(before), None, None
            self.context = shorter
        return span


def streamed(df: DataFrame, schema: str, texts: int, make) -> DataFrame:
    """A pass over rows whose first column tells conversations apart and whose rows are sorted by it.

    ``make()`` gives a function of (whether a conversation begins, row) that yields rows of the output, and is called
    with (True, None) at the end. The first column of the output is that of the input. ``texts`` is the place of the
    column that holds the most text.
    """
    first = df.columns[0]
    out = T.StructType([T.StructField(first, df.schema[first].dataType), *T.StructType.fromDDL(schema).fields])
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in out.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, rows, held, last, key = make(), [], 0, run, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [key, *kinds])], names=out.names)

        for batch in batches:
            key = batch.schema.field(0).type
            for part in slices(batch, texts):
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    for made in step(row[0] != last, row):
                        rows.append(made)
                        held += len(made[2]) if isinstance(made[2], str) else 0
                    last = row[0]
                    if held > FLUSH_CHARS or len(rows) >= FLUSH_ROWS:
                        yield packed()
                        rows, held = [], 0
        rows += step(True, None)
        if rows:
            yield packed()

    return with_workers(df).mapInArrow(run, out)


def format_chats(df: DataFrame, template: Template, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", reach: int | None = None, loss_role: str = LOSS_ROLE, block: int = BLOCK_TURNS) -> DataFrame:
    """One row per turn of the formatted conversations, each conversation's rows in order within one partition.

    Returns ``ident`` (the conversation), ``nth`` (from 0), ``piece`` (what the turn adds to the output), ``start`` (the
    place of the piece in the output), ``taken_back`` (characters of the earlier output that the template rewrote; 0 for
    one that only appends) and ``loss_start``, ``loss_end`` (place in the output of the text of a turn by ``loss_role``,
    null for others and where history was rewritten). Positions are code points. A conversation's output is built from
    its pieces: drop ``taken_back`` characters, append ``piece``. The template's opening belongs to the first piece.

    Turns are ordered by ``turn`` (null first), then role and text; repeated rows are turns of their own. Null roles and
    texts are empty. Rows with a null id are one conversation. An empty table gives no rows. Other columns are ignored.

    A conversation of more than ``block`` turns is formatted in blocks of so many, side by side, each after the turns
    before it. With a ``reach`` the context is bounded and a conversation is one stream.
    """
    if block <= 0:
        raise ValueError("block must be positive")
    source = df.select(col(conversation).alias("ident"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(col(text).cast("string"), F.lit("")).alias("text"), col(turn).alias("turn"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]

    def spans(turns: DataFrame) -> DataFrame:
        return streamed(turns.select("ident", "role", "text", "begins", "own"), "nth bigint, piece string, start bigint, taken_back bigint, "
                        "loss_start bigint, loss_end bigint", 2, make)

    def make():
        made, nth, size = Incremental(template, reach), 0, 0

        def step(new: bool, row: tuple | None) -> Iterator[tuple]:
            nonlocal made, nth, size
            if row is None:
                return
            ident, name, body, begins, own = row
            if new or begins:
                made, nth, size = Incremental(template, reach), 0, 0
            if not own:
                made.skip((name, body))
                nth, size = nth + 1, None
                return
            if size is None:
                size = len(made.output())
            span = made.add((name, body), name == loss_role)
            size -= span.taken_back
            places = (None, None) if span.text_start is None else (size + span.text_start, size + span.text_end)
            yield (ident, nth, span.piece, size, span.taken_back, *places)
            nth, size = nth + 1, size + len(span.piece)

        return step

    def whole(turns: DataFrame) -> DataFrame:
        return spans(turns.repartition("ident").sortWithinPartitions("ident", *order).withColumns({"begins": F.lit(False), "own": F.lit(True)}))

    if reach is not None:
        return whole(source)
    long = source.groupBy("ident").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select(F.col("ident").alias("long"), "n")
    # At most one conversation in ``block`` rows is long; broadcast, so that the texts of all others are shuffled once.
    long, same = F.broadcast(long), F.col("ident").eqNullSafe(F.col("long"))
    numbered = source.join(long, same).select(
        "ident", "role", "text", "n", (F.row_number().over(Window.partitionBy("ident").orderBy(*order)) - 1).alias("nth"))
    last = F.floor((F.col("n") - 1) / block)
    dealt = numbered.withColumn("first", F.floor(F.col("nth") / block)).withColumn("part", F.explode(F.sequence("first", last))).withColumns(
        {"begins": F.col("nth") == 0, "own": F.col("first") == F.col("part")})
    parts = spans(dealt.repartition("ident", "part").sortWithinPartitions("ident", "part", "nth"))
    return whole(source.join(long, same, "left_anti")).unionByName(parts.repartition("ident").sortWithinPartitions("ident", "nth"))


def read_back(pieces: DataFrame, template: InstructTemplate) -> DataFrame:
    """One row per conversation, read from the rows of ``format_chats`` as they come: only pieces and loss places are used.

    Returns ``ident``, ``n_turns``, ``turns_sha256`` (of role, line break, text, line break per turn), ``loss_chars`` and
    ``loss_sha256`` (of all text under the loss mask, unescaped), ``formatted_chars`` and ``rewritten`` (turns that changed
    earlier output). Where a template rewrites history, the pieces are no text that can be read: the digests are null.
    """
    thin = pieces.select("ident", "taken_back", "piece", "start", "loss_start", "loss_end")

    def make():
        turns, loss = hashlib.sha256(), hashlib.sha256()
        ident, n_turns, loss_chars, formatted, rewritten, begun = None, 0, 0, 0, 0, False

        def step(new: bool, row: tuple | None) -> Iterator[tuple]:
            nonlocal turns, loss, ident, n_turns, loss_chars, formatted, rewritten, begun
            if new:
                if begun:
                    plain = not rewritten
                    yield (ident, n_turns, turns.hexdigest() if plain else None, loss_chars if plain else None,
                           loss.hexdigest() if plain else None, formatted, rewritten)
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n_turns, loss_chars, formatted, rewritten, begun = 0, 0, 0, 0, True
            if row is None:
                return
            ident, taken_back, piece, start, loss_start, loss_end = row
            formatted += len(piece) - taken_back
            rewritten += taken_back > 0
            if rewritten:
                n_turns += 1
                return
            for role, text in template.read(piece):
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode())
            if loss_start is not None:
                text = template.unescape(piece[loss_start - start:loss_end - start])
                loss_chars += len(text)
                loss.update(text.encode())

        return step

    return streamed(thin, "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                          "formatted_chars bigint, rewritten bigint", 2, make)
