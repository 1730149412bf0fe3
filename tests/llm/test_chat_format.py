"""Chat formatting next to whole-prefix rendering, templates that rewrite history, odd tables."""

import hashlib
import random

import pytest

from tablegauge.llm.chat_format import HEAD, REACH, Incremental, InstructTemplate, format_chats, read_back

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE] ", "[/ROLE]", "[REPLY]", "\\", "<", "[", "s>", "/", " ", "a", "b", "\n",
         "%", "%0A", "<\\s>", "[\\\\/INST]", "ü", "𝄞"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def random_turns(r, most=14):
    roles = ["user", "assistant", "system", "", "user\n", "".join(r.choices(PARTS, k=3))]
    return [(r.choice(roles), "".join(r.choices(PARTS, k=r.randint(0, 8)))) for _ in range(r.randint(0, most))]


def test_template_reads_back_what_it_writes():
    r, template = random.Random(5), InstructTemplate()
    for _ in range(2000):
        turns = random_turns(r)
        assert list(template.read(template.render(turns))) == turns


def test_spans_equal_whole_prefix_rendering():
    r, template = random.Random(6), InstructTemplate()
    for _ in range(500):
        turns, spans = random_turns(r), Incremental(template)
        for k, turn in enumerate(turns):
            before, after = template.render(turns[:k]) if k else "", template.render(turns[:k + 1])
            span = spans.add(turn, True)
            assert span.taken_back == 0 and before + span.piece == after
            assert template.unescape(span.piece[span.text_start:span.text_end]) == turn[1]


class DropsThoughts:
    """Keeps the thoughts of the last answer only."""

    def render(self, turns):
        last = max((i for i, (role, _) in enumerate(turns) if role == "user"), default=-1)
        return "".join(f"<{role}>{text.split('|')[-1] if i < last else text}\n" for i, (role, text) in enumerate(turns))


class ClosesAtTheEnd:
    def render(self, turns):
        return "".join(f"<{role}>{text}\n" for role, text in turns) + "<end>"


class Numbers:
    """The number of each turn, so a turn's output depends on how many came before."""

    def render(self, turns):
        return "".join(f"{len(turns[:i])}:{text}\n" for i, (_, text) in enumerate(turns))


class CountsFromTheEnd:
    def render(self, turns):
        return "".join(f"{len(turns) - i}:{text}\n" for i, (_, text) in enumerate(turns))


@pytest.mark.parametrize("template", [DropsThoughts(), ClosesAtTheEnd(), CountsFromTheEnd()])
def test_rewriting_templates_are_detected(template):
    turns = [("user", "q"), ("assistant", "thought|answer"), ("user", "r"), ("assistant", "more|done")]
    spans, out, rewritten = Incremental(template), "", 0
    for k, turn in enumerate(turns):
        span = spans.add(turn, True)
        before, after = template.render(turns[:k]) if k else "", template.render(turns[:k + 1])
        assert (span.taken_back > 0) == (not after.startswith(before))
        assert span.taken_back == 0 or span.text_start is None
        out = out[:len(out) - span.taken_back] + span.piece
        rewritten += span.taken_back > 0
        assert out == after
    assert rewritten


def test_output_that_depends_on_turns_outside_of_the_context_is_detected():
    spans = Incremental(Numbers())
    found = [spans.add(("user", f"t{k}"), False).taken_back > 0 for k in range(HEAD + REACH + 3)]
    assert not any(found[:HEAD + REACH]) and any(found)


def expected(rows, template):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss),
                     len(template.render(turns)), 0)
    return out


def digests(df, template=None):
    template = template or InstructTemplate()
    rows = read_back(format_chats(df, template), template).collect()
    assert len({r.ident for r in rows}) == len(rows)
    return {r.ident: tuple(r)[1:] for r in rows}


def test_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert digests(df) == expected([tuple(r) for r in df.collect()], InstructTemplate())


def test_odd_rows(spark):
    r = random.Random(7)
    rows = [(c, k, role, text) for c in range(30) for k, (role, text) in enumerate(random_turns(r))]
    rows += [(50, None, "user", "null turn"), (50, 0, None, None), (50, 0, "assistant", "tie"), (50, 0, "assistant", "tie"),
             (None, 1, "user", "no id"), (None, 0, "assistant", "no id"), (51, 0, "assistant", "")]
    rows += [(52, k, ("user", "assistant")[k % 2], f"</s>[INST] {k}") for k in range(300)]
    rows += [(53, 0, "assistant", "long " * 2_000_000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows, InstructTemplate())
    assert digests(df) == want
    clashing = df.selectExpr("*", "1 AS ident", "2 AS nth", "'x' AS piece", "3 AS start").repartition(7)
    assert digests(clashing) == want
    assert digests(df.limit(0)) == {}


def test_pieces_join_to_the_output(spark):
    template = InstructTemplate()
    turns = [(1, k, role, text) for k, (role, text) in enumerate(
        [t for seed in range(12) for t in random_turns(random.Random(seed))])]
    assert len(turns) > 20
    rows = sorted(format_chats(spark.createDataFrame(turns, SCHEMA), template).collect(), key=lambda r: r.nth)
    output = "".join(r.piece for r in rows)
    assert output == template.render([(role, text) for *_, role, text in turns])
    for r, (_, _, role, text) in zip(rows, turns):
        assert output[r.start:r.start + len(r.piece)] == r.piece
        if role == "assistant":
            assert template.unescape(output[r.loss_start:r.loss_end]) == text
        else:
            assert r.loss_start is None and r.loss_end is None


def test_rewritten_conversations_have_no_digests(spark):
    class Local:  # defined here, so that it travels to the workers by value
        def render(self, turns):
            return "".join(text if i == len(turns) - 1 else text[-1:] for i, (_, text) in enumerate(turns))

        def read(self, output):
            yield "user", output

        def unescape(self, text):
            return text

    df = spark.createDataFrame([(1, 0, "user", "qq"), (1, 1, "assistant", "taa"), (1, 2, "user", "rr")], SCHEMA)
    pieces = sorted(format_chats(df, Local()).collect(), key=lambda r: r.nth)
    assert [r.taken_back for r in pieces] == [0, 1, 3] and all(r.loss_start is None for r in pieces)
    assert digests(df, Local()) == {1: (3, None, None, None, len("qarr"), 2)}


class MarksTheThird:
    """Looks at the third turn, which is neither among the first nor among the last ones of a long conversation."""

    def render(self, turns):
        mark = turns[2][1] if len(turns) > 2 else ""
        return "".join(f"<{role}>{text}{mark if i > 2 else ''}\n" for i, (role, text) in enumerate(turns))


class ForgetsTheThird:
    """Takes the third turn back at the tenth."""

    def render(self, turns):
        return "".join(f"<{role}>{'' if i == 2 and len(turns) > 9 else text}\n" for i, (role, text) in enumerate(turns))


class CountsTurns:
    def render(self, turns):
        return "".join(f"{i}:{text}\n" for i, (_, text) in enumerate(turns))


def local(template):
    """The template as an object of a class that travels to the workers by value."""
    class Local:
        render = staticmethod(lambda turns, f=type(template).__dict__["render"]: f(None, turns))
    Local.render.__module__ = type(template).__dict__["render"].__module__ = Local.__module__ = "__main__"
    return Local()


@pytest.mark.parametrize("kind", [MarksTheThird, ForgetsTheThird, CountsTurns, ClosesAtTheEnd, InstructTemplate])
@pytest.mark.parametrize("block", [500, 4, 1])
def test_whole_prefixes_are_rendered(spark, kind, block):
    template = kind()
    if kind is not InstructTemplate:
        template = local(template)
    r = random.Random(3)
    convs = {c: [(r.choice(["user", "assistant"]), f"{c}.{k}" + "".join(r.choices(PARTS, k=3))) for k in range(n)] for c, n in ((1, 23), (2, 3), (None, 12), (4, 4))}
    df = spark.createDataFrame([(c, k, *t) for c, turns in convs.items() for k, t in enumerate(turns)], SCHEMA).repartition(3)
    placed = format_chats(df, template, block=block).selectExpr("*", "spark_partition_id() AS p", "monotonically_increasing_id() AS at").collect()
    for c, turns in convs.items():
        rows = sorted((x for x in placed if x.ident == c), key=lambda x: x["at"])
        assert [x.nth for x in rows] == list(range(len(turns))) and len({x.p for x in rows}) == 1
        out = ""
        for k, x in enumerate(rows):
            before, out = out, out[:len(out) - x.taken_back] + x.piece
            assert out == template.render(turns[:k + 1]) and x.start == len(out) - len(x.piece)
            assert (x.taken_back > 0) == (not out.startswith(before))
            if x.loss_start is not None:
                assert turns[k][0] == "assistant" and template.unescape(out[x.loss_start:x.loss_end]) == turns[k][1] \
                    if kind is InstructTemplate else out[x.loss_start:x.loss_end] == turns[k][1]


def test_digests_of_blocks(spark):
    r = random.Random(11)
    rows = [(c, k, role, text) for c in range(20) for k, (role, text) in enumerate(random_turns(r))]
    rows += [(c, k, ("user", "assistant")[k % 2], f"</s>[INST] {k}") for c, n in ((52, 300), (None, 41), (53, 40)) for k in range(n)]
    r.shuffle(rows)
    df, template = spark.createDataFrame(rows, SCHEMA), InstructTemplate()
    got = read_back(format_chats(df, template, block=40), template).collect()
    assert {x.ident: tuple(x)[1:] for x in got} == expected(rows, template) and len(got) == len({x.ident for x in got})
