import html
import math
import re
from collections import Counter, defaultdict

from tablegauge.llm.html_extract import extract, main_text, node_importance, style_nodes


def expected(page):
    """The supplied pages, by their own shape: headings and paragraphs of the article."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    rows = extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), carry=["page_id", "html"]).collect()
    assert len(rows) == 250
    assert all(r.text == expected(r.row.html) and r.n_chars == len(r.text) for r in rows)


def test_markup():
    none = frozenset()
    assert main_text("<p>a  b<p>c<b>d</b>&amp;&lt;x&gt;<br>e", none) == "a b\ncd&<x> e"
    assert main_text("<nav>n</nav><div class='ad'>x</div><div id=cookie-notice>x</div><article><header><h1>T</h1></header><p>x"
                     "<aside>y</aside><p>z</article><footer>f", none) == "T\nx\nz"
    assert main_text("<main><p>one</p><section class='comments'><p>no</p></section><form>f</form></main><div>no</div>", none) == "one"
    assert main_text("a<script>if (x<y) '</p>'</script>b<style>p{}</style>c<!-- d --><!-- open", none) == "abc"
    assert main_text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", none) == "a\nb\nc\nd"
    assert main_text("<p>x <button>no</button> y <span class='ad'>no</span>z</p>", none) == "x y z"
    assert main_text("1 < 2 <b>&nbsp;3</b> <unclosed", none).startswith("1 < 2 3")
    assert main_text("<div title='a>b'>t</div></p></nope>", none) == "t"
    assert main_text("<p>" * 3000 + "x" + "<div>" * 3000 + "y", none) == "x\ny"


def page(i, text):
    return (f"<html><body><div class=top><ul><li>Home<li>News</ul></div><div class=body><p>{text}</p></div>"
            f"<div class=end>All rights</div></body></html>")


def brute_importance(pages):
    style, content, n = defaultdict(Counter), defaultdict(Counter), Counter()
    for host, text in pages:
        for node in style_nodes(text):
            key = host, node["path"]
            n[key] += 1
            style[key][node["style"]] += 1
            content[key][node["content"]] += 1
    entropy = lambda c, m: 1.0 if m == 1 else -sum(x / m * math.log(x / m) for x in c.values()) / math.log(m)
    return {k: (m, max(entropy(style[k], m), entropy(content[k], m))) for k, m in n.items()}


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, "http://user@a.com:80/x", page(i, f"text {i}")) for i in range(12)] + [(50, "http://b.com", page(50, "only"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {(r.host, r.path): (r.n_pages, r.importance) for r in node_importance(df, "html", "url").collect()}
    want = brute_importance([("b.com" if i == 50 else "a.com", h) for i, _, h in rows])
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    out = {r.row.page_id: r.text for r in extract(df).collect()}
    assert all(out[i] == f"text {i}" for i in range(12))
    assert out[50] == "Home\nNews\nonly\nAll rights"


def test_copies_keep_their_article(spark):
    rows = [(i, "http://a.com", "<body><nav>n</nav><article><p>same</p></article></body>") for i in range(20)]
    out = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in out} == {"same"}


def test_hot_copies_count_once(spark):
    texts = [f"text {max(0, i - 949)}" for i in range(1000)]  # 950 copies and 50 other pages, by divs only
    rows = [(i, "http://a.com", page(i, t)) for i, t in enumerate(texts)] + [(2000 + i, "http://b.com", page(i, "copy")) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    got = {(r.host, r.path): (r.n_pages, r.importance) for r in node_importance(df, "html", "url").collect()}
    want = brute_importance({(u.removeprefix("http://"), h) for _, u, h in rows})
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert not any(path in ("/html", "/html/body") for _, path in got)
    out = {r.row.page_id: r.text for r in extract(df).collect()}
    assert all(out[i] == t for i, t in enumerate(texts))
    assert all(out[2000 + i] == "Home\nNews\ncopy\nAll rights" for i in range(9))


def test_article_is_a_hint(spark):
    box = "<div class='k7'><p>Written by our team</p></div><p class='k8'>Rate this</p>"
    rows = [(i, "http://a.com", f"<body><article><p>text {i}</p>{box}</article></body>") for i in range(8)]
    rows += [(100 + i, "http://b.com", f"<body><article><p>card {i}</p></article><div><p>{f'real text {i} ' * 9}</p></div></body>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r.row.page_id: r.text for r in extract(df).collect()}
    assert all(out[i] == f"text {i}" for i in range(8))
    assert all(out[100 + i] == f"card {i}\n{f'real text {i} ' * 9}".strip() for i in range(8))
    assert main_text("<article>teaser</article><div>the whole text</div>", frozenset()) == "teaser\nthe whole text"
    assert main_text("<article>the text</article><div><a href=x>many linked words</a></div>", frozenset()) == "the text"


def test_noise_words_do_not_remove_the_text():
    none = frozenset()
    for start, end in (("<div class='layout has-sidebar'>", "</div>"), ("<div id='search-results'>", "</div>"),
                       ("<div class='content no-banner'>", "</div>"), ("<form id='aspnetForm'>", "</form>"),
                       ("<app-root class='widget'>", "</app-root>"), ("<div class='comments-page'>", "</div>")):
        for inner in ("<h1>Title</h1><p>the text", "<article><h1>Title</h1><p>the text</article>"):
            noise = "<div class=sidebar>side</div><nav><a href=x>many links on this page, more than text</a></nav>"
            assert main_text(f"{start}{noise}{inner}{end}<footer>foot and much more of it</footer>", none) == "Title\nthe text", (start, inner)
    assert main_text("<article><h1 class='entry-header'>T</h1><div class='post-header'>by x</div><p>text</article>", none) == "T\nby x\ntext"
    assert main_text("<article>text</article><div class=comments><article>a longer comment</article></div>", none) == "text"
    assert main_text("<div>text</div><div class=comments><p>a longer comment</p></div>", none) == "text"
    assert main_text("<nav>menu</nav><div class=ad>buy</div><article></article><footer>foot</footer>", none) == ""
    assert main_text("<nav>menu</nav><footer>foot</footer>", none) == ""


def test_edges(spark):
    rows = [(1, None, None, 1), (2, "not a url", "", 2), (3, None, "plain", 3), (3, None, "plain", 3), (4, "http://x", "<p>" + "w " * 200000, 4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    out = sorted((r.row.page_id, r.text[:7], r.n_chars) for r in extract(df).collect())
    assert out == [(1, "", 0), (2, "", 0), (3, "plain", 5), (3, "plain", 5), (4, "w w w w", 399999)]
    assert extract(df.limit(0)).count() == 0
