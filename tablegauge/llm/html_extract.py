"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags and classes are one node of the site style
tree; pages of a host that show the same count once. A node has as many presentations as there are different sequences of children on it, and as many contents as
there are different texts in it. Its importance is the larger entropy of the two distributions, to the base of its
number of pages: 1 where every page differs, 0 where all agree, as in menus and footers. Branches of low importance are
removed from each page (``html`` and ``body`` are no branches), and so are the elements that say by tag, role or class that they are none of the article, unless
the article or most of the page's important text is in them (see ``lifted``). ``article``
and ``main`` are a hint: where they hold at least half of a page's important text, its text is theirs, else they are a
teaser or a card among the rest. Inside them too, what a site repeats is removed.

Only digests and counts per node travel between pages, combined before they are shuffled, so a host with a third of all
pages is no task of its own.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.llm.common import as_row, col, map_texts, slices, store, with_workers

LOW_IMPORTANCE = 0.2
LINK_WEIGHT = 0.1  # of a character in a link, where amounts of text are compared
LEAST_PAGES = 5  # a node on fewer pages says nothing about its site

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td template tfoot th thead tr ul".split())
CLOSED_BY = {  # an open element of the key ends where one of these begins
    "p": BLOCKS - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
LEAVES = frozenset("p li td th tr option h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("table td th caption button object html body article section div ul ol dl".split())

# What says of itself that it is none of the article.
NOISE_TAGS = frozenset(
    "nav footer aside form head noscript template svg button select dialog menu object audio video canvas search map math "
    "script style textarea title iframe".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside rail ad ads adv "
    "advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion notice notices notification alert cookie "
    "cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond form search widget widgets pagination pager toolbar "
    "copyright disclaimer skip".split())

# Words that a page's layout carries as well as its extras do; elements of this kind may hold the article.
LAYOUT_TAGS = frozenset("header aside form search noscript".split())
LAYOUT_ROLES = frozenset("banner complementary form search".split())
LAYOUT_WORDS = frozenset(
    "header masthead topbar bottombar sidebar aside rail banner notice notices notification alert modal overlay form search widget "
    "widgets toolbar skip login signup subscription share sharing social promotion".split())
# Next to these words the others only tell what an element has or has not, or whose header it is.
STATE_WORDS = frozenset("has no with without hide show open closed on off enabled disabled layout".split())
OWNER_WORDS = frozenset("post entry article content story".split())
NO_TEXT = NOISE_TAGS - LAYOUT_TAGS - {"nav", "footer", "dialog", "menu"}
NO_NOISE, LAYOUT, EXTRA, SHELL, NEVER = range(5)  # how sure it is that an element is none of the article

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PARTS = re.compile(r"[^a-z]+")


@dataclass
class Node:
    tag: str
    path: str
    article: bool
    noise: int = NO_NOISE  # of the element itself
    within: Node | None = None  # the innermost element with noise that holds this one, or this one itself
    beyond: Node | None = None  # the next such element outside of ``within`` where that is this one
    worst: int = NO_NOISE  # of the elements around it and itself
    top: Node | None = None  # the outermost article or main
    mute: bool = False  # inside an inline element that is noise: its text is not part of the block around it
    link: bool = False
    leaf: bool = False  # a paragraph, item, cell or heading without a class: no node of the style tree
    first: int = 0
    last: int = 0
    style: list[str] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return out


def words_of(value: str) -> set[str]:
    return set(NAME_PARTS.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())) - {""}


def noise_words(value: str, own_header: bool) -> set[str]:
    """Words of a class or id attribute that call the element noise."""
    out: set[str] = set()
    for name in value.split():
        words = words_of(name)
        if not words & STATE_WORDS:
            out |= words & NOISE_WORDS - ({"header"} if own_header or words & OWNER_WORDS else set())
    return out


def noise_of(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """How sure an element says by itself that it is none of the article."""
    if tag in NO_TEXT:
        return NEVER
    if tag in NOISE_TAGS and tag not in LAYOUT_TAGS:
        return SHELL
    found = LAYOUT if tag in NOISE_TAGS or tag == "header" and not in_article else NO_NOISE
    if not attrs:
        return found
    if tag in ("html", "body", "article", "main"):
        return EXTRA if tag == "article" and words_of(attrs.get("class", "")) & {"comment", "comments", "reply"} else NO_NOISE
    role = attrs.get("role", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
        return SHELL
    own_header = in_article or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    words = noise_words(attrs.get("class", ""), own_header) | noise_words(attrs.get("id", ""), own_header)
    if words - LAYOUT_WORDS or role in NOISE_ROLES - LAYOUT_ROLES:
        return EXTRA
    return LAYOUT if words or role in LAYOUT_ROLES else found


def parse(page: str) -> tuple[list[Node], list[tuple[str, Node, float]]]:
    """Block elements in document order, each with the range of blocks in it, and the blocks: text, innermost element, weight."""
    root = Node("", "", False)
    stack, nodes, blocks, run = [root], [root], [], []
    muted: dict[int, tuple[Node, list[str]]] = {}
    linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((text, stack[-1], len(text) - (1 - LINK_WEIGHT) * min(linked, len(text))))
        linked = 0
        for node, parts in muted.values():
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((text, node, len(text) * (LINK_WEIGHT if node.link else 1)))
        muted.clear()

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1].tag in BLOCKS:
                flush()
            node = stack.pop()
            node.last = len(blocks)

    place, n = 0, len(page)
    while place < n:
        m = TOKEN.search(page, place)
        end = n if m is None else m.start()
        if end > place and stack[-1].mute:
            muted.setdefault(id(stack[-1]), (stack[-1], []))[1].append(page[place:end])
        elif end > place:
            run.append(page[place:end])
            linked += (end - place) * stack[-1].link
        if m is None:
            break
        place = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            depth = len(stack) - 1
            while depth > 0 and stack[depth].tag != tag:
                depth -= 1
            if depth > 0:
                close(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            run.append("\n")
            continue
        block = tag in BLOCKS
        if block:
            depth = len(stack) - 1
            while depth > 0:
                open_tag = stack[depth].tag
                if tag in CLOSED_BY.get(open_tag, ()):
                    close(depth)
                elif open_tag in SCOPES:
                    break
                depth -= 1
                depth = min(depth, len(stack) - 1)
            flush()
        if tag in VOID:
            continue
        attrs = attributes(m["attrs"]) if m["attrs"].strip(" /\n\t") else {}
        up = stack[-1]
        noise = noise_of(tag, attrs, up.article)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, place)
            place = end.end() if end else n
            continue
        name = tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").split())) if attrs else tag
        if block:
            if not up.style or up.style[-1] != name:
                up.style.append(name)
            here = tag in ("article", "main") or attrs.get("role") == "main"
            node = Node(tag, f"{up.path}/{name}", up.article or here, noise)
            node.top = up.top or (node if here else None)
            node.first = len(blocks)
            nodes.append(node)
        else:
            node = Node(tag, up.path, up.article, noise)
            node.top = up.top
        node.within, node.beyond = (node, up.within) if noise else (up.within, None)
        node.worst = max(up.worst, noise)
        node.mute = up.mute or noise > NO_NOISE and not block
        node.link = up.link or tag == "a"
        node.leaf = tag in LEAVES and name == tag
        if m["attrs"].endswith("/") and not block:
            continue
        stack.append(node)
    close(1)
    flush()
    root.last = len(blocks)
    return nodes, blocks


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def tree_part(page: str) -> tuple[bytes, list[dict]]:
    """Digest of what the page shows, and its part of the style tree: for each path its presentation and its content."""
    nodes, blocks = parse(page)
    shown = "\0".join([*(n.path for n in nodes), "", *(t for t, _, _ in blocks)])
    digest = hashlib.blake2b(shown.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    styles: dict[str, list[str]] = {}
    contents: dict[str, list[str]] = {}
    for node in nodes[1:]:
        if node.tag not in ("html", "body") and not node.leaf:
            styles.setdefault(node.path, []).append(" ".join(node.style))
            contents.setdefault(node.path, []).extend(t for t, x, _ in blocks[node.first:node.last] if x.tag in BLOCKS or not x.mute)
    return digest, [{"path": p, "style": number("|".join(styles[p])), "content": number("\n".join(contents[p]))} for p in styles]


def style_nodes(page: str) -> list[dict]:
    return tree_part(page)[1]


def lifted(nodes: Sequence[Node], weighed: Sequence[tuple[Node, float]]) -> set[int]:
    """Identities of the elements with noise whose text counts, as the page's text is in them and in all around them.

    These hold the article with the most text, or more than half of all text. Only elements that their tag or words
    give to the layout are lifted where the page has text or an article elsewhere; all but menus, footers, dialogs and
    hidden elements where all of its text is in such elements, and these too where they hold the article.
    """
    order: list[Node] = []  # elements with noise, outer ones first
    seen: set[int] = set()
    for node, _ in weighed:
        chain, at = [], node.within
        while at is not None and id(at) not in seen:
            seen.add(id(at))
            chain.append(at)
            at = at.beyond
        order += reversed(chain)
    lift: set[int] = set()
    for most in (LAYOUT, SHELL):
        total, inside, articles = 0.0, dict.fromkeys(map(id, order), 0.0), {}
        for node, weight in weighed:
            if not weight or node.worst > most:
                continue
            total += weight * (node.worst < SHELL)
            if node.within is not None:
                inside[id(node.within)] += weight
            if node.top is not None and node.within is node.top.within and not node.top.noise:
                articles.setdefault(id(node.top), [node.top, 0.0])[1] += weight
        for h in reversed(order):
            if h.beyond is not None:
                inside[id(h.beyond)] += inside[id(h)]
        best = max(articles.values(), key=lambda x: x[1])[0] if articles else None
        if total or best or any(n.top is n and n.within is None for n in nodes):
            lift = {id(h) for h in order if h.worst <= most and h.noise < SHELL and 2 * inside[id(h)] > total}
            at = best and best.within
            while at is not None:
                lift.add(id(at))
                at = at.beyond
            break
    out: set[int] = set()
    for h in order:
        if id(h) in lift and (h.beyond is None or id(h.beyond) in out):
            out.add(id(h))
    return out


def main_text(page: str, unimportant: frozenset[str]) -> str:
    """Text of the article: one line per block."""
    nodes, blocks = parse(page)
    low = tuple(f"{p}/" for p in unimportant)
    marked = [(text, node, weight, bool(low) and f"{node.path}/".startswith(low)) for text, node, weight in blocks]
    lift = lifted(nodes, [(node, 0 if bad else weight) for _, node, weight, bad in marked])
    shown = [m for m in marked if m[1].within is None or id(m[1].within) in lift]
    inside = sum(weight for _, node, weight, bad in shown if node.article and not bad)
    outside = sum(weight for _, node, weight, bad in shown if not node.article and not bad)
    if not inside and not outside:  # the site repeats all that the page has: the article, if there is one, stays
        return "\n".join(text for text, node, _, _ in shown if node.article)
    only = inside >= outside
    return "\n".join(text for text, node, _, bad in shown if not bad and (node.article or not only or not inside))


def host_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1), F.lit(""))


def node_importance(pages: DataFrame, page: str, url: str) -> DataFrame:
    """(host, path, n_pages, presentation, content, importance) of every node of the hosts' style trees.

    Pages of a host that show the same are one page, however many copies there are.
    """
    named = pages.select(host_of(col(url)).alias("host"), col(page).alias("html"))
    node = pa.struct([("path", pa.string()), ("style", pa.int64()), ("content", pa.int64())])

    def run(texts):
        parts = [tree_part(t or "") for t in texts]
        return [pa.array([d for d, _ in parts], pa.binary()), pa.array([n for _, n in parts], pa.list_(node))]

    made = map_texts(named, "html", ["host"], "digest binary, nodes array<struct<path: string, style: bigint, content: bigint>>",
                     lambda: run)
    seen = made.groupBy("row.host", "digest").agg(F.first("nodes").alias("nodes")).select("host", F.inline("nodes"))
    values = seen.select("host", "path", F.inline(F.array(
        F.struct(F.lit("style").alias("kind"), F.col("style").alias("value")),
        F.struct(F.lit("content").alias("kind"), F.col("content").alias("value")))))
    counted = values.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    m = F.sum("c")
    entropy = F.when(m > 1, (F.log(m) - F.sum(F.col("c") * F.log("c")) / m) / F.log(m)).otherwise(1.0)
    by_kind = counted.groupBy("host", "path", "kind").agg(m.alias("n_pages"), entropy.alias("entropy"))
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("entropy")))
    return by_kind.groupBy("host", "path").agg(
        F.max("n_pages").alias("n_pages"), pick("style").alias("presentation"), pick("content").alias("content"),
        F.max("entropy").alias("importance"))


def extract(df: DataFrame, page: str = "html", url: str = "url", carry: Sequence[str] | None = None) -> DataFrame:
    """The main text of every whole page.

    Returns ``row`` (the carried columns, all but the page by default), ``text`` and ``n_chars`` (its code points).
    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
    one line feed. Null and empty pages and pages without an article text give the empty text. Pages with a null url
    are pages of one unnamed host. An empty table gives an empty result.
    """
    keep = [c for c in df.columns if c != page] if carry is None else list(carry)
    low = store(node_importance(df, page, url).filter(
        (F.col("importance") < LOW_IMPORTANCE) & (F.col("n_pages") >= LEAST_PAGES)).groupBy("host").agg(
        F.collect_set("path").alias("low")), "site-noise")
    rows = with_workers(df).select(as_row(keep), host_of(col(url)).alias("host"), col(page).alias("html")).join(
        low, "host", "left").select("row", "html", "low")
    out = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = [main_text(p or "", frozenset(low or ())) for p, low in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=out.names)

    return rows.mapInArrow(run, out)
