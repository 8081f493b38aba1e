import os
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

from siftlake.llm import html as extraction
from siftlake.llm.html import main_text, op2_html

SHELL = "<!DOCTYPE html><html><head><title>T</title><style>p::x</style><script>var t='</p>';</script></head><body>{}<article>{}</article>{}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\nb"),
        (SHELL.replace("{}", "<nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy, now.</div>", 1).replace("{}", "<h1>Head  line</h1><p><b>One &eacute;&#33;<br>two<p>Three.\n four</p>", 1).replace("{}", "<footer>&copy; me</footer>", 1), "Head line\nOne é! two\nThree. four"),
        ("<article><header><h1>Own</h1></header><p>x <b>bold</b>y</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><form><p>mail?</p></form><section class=comments><p>Nice. Very nice, indeed.</p></section></article>", "Own\nx boldy\none\ntwo\na\nb"),
        ("<body><header>Site</header><div id=content><h1>T</h1><p>Para one, is long. And has text; more.</p><p>Short</p></div><aside>links</aside><div class='cookie-notice'>We use cookies, yes.</div></body>", "T\nPara one, is long. And has text; more.\nShort"),
        ("<div class='site-header'><p>Top</p></div><article><div class='post-header'><h1>H</h1></div><p>one <button>Buy</button>two<span class=ad>now</span></p></article>", "H\none two"),
        ("<article><p>a &lt;b&gt; c</p><!-- gone --><p>d</p", "a <b> c\nd"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


SENTENCE = "This is a sentence of the article, and it goes on; it ends here. "


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><nav>Home</nav><div id=content><h1>T</h1><div class=s1><p>{6}</p></div><div class=s2><p>{3}</p><ul><li>x</ul></div></div><footer>f</footer></body>", "T\n{6}\n{3}\nx"),
        ("<body><div id=content><h1>T</h1><p class=byline>By me</p><div class=text><p>{6}</p><p>{6}</p><table><tr><td>1<td>2</table><p class=caption>Cap</p></div></div></body>", "T\nBy me\n{6}\n{6}\n1\n2\nCap"),
        ("<body><main><h1>T</h1><article><p>{6}</p></article><section><p>{3}</p><p>End</p></section></main></body>", "T\n{6}\n{3}\nEnd"),
        ("<body><article><p>{6}</p><article><p>{6}</p><p>{6}</p></article><p>tail</p></article></body>", "{6}\n{6}\n{6}\ntail"),
        ("<body><article><p>{6}</p></article><article><p>{3}</p></article></body>", "{6}\n{3}"),
        ("<body><section><h2>A</h2><p>{6}</p></section><section><h2>B</h2><p>{3}</p></section></body>", "A\n{6}\nB\n{3}"),
        ("<body><div id=c><div>{6}</div><div>short</div></div></body>", "{6}\nshort"),
    ],
)
def test_whole_article(html, text):
    fill = lambda s: s.replace("{6}", (SENTENCE * 6).strip()).replace("{3}", (SENTENCE * 3).strip())
    assert main_text(fill(html)) == fill(text)


PARA = "One sentence of the text, with a comma. Another one follows, and it ends. "
PLAIN_PAGES = [
    # neither article nor main, and no telling names
    ("<body><div><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Contact</a></ul></div><div><h1>T</h1><p>{4}</p><p>{2}</p><p>Short</p></div><div><ul><li><a href=d>Imprint</a><li><a href=e>Terms</a><li><a href=f>More</a></ul></div></body>", "T\n{4}\n{2}\nShort"),
    ("<table><tr><td><a href=a>Home</a></td></tr><tr><td><a href=b>News</a></td></tr><tr><td><a href=b>Map</a></td></tr></table><div class=x><p>{3}</p><h2>Next</h2><p>{4}</p><ul><li>one</li><li>two</li></ul></div>", "{3}\nNext\n{4}\none\ntwo"),
    # names that only sound like boilerplate
    ("<article><h1>T</h1><p>{4}</p><section class=related-studies><p>{4}</p><p>{3}</p></section></article>", "T\n{4}\n{4}\n{3}"),
    ("<article><p>{4}</p><div class=related><ul><li><a href=a>Other</a><li><a href=b>Posts</a><li><a href=c>Here</a></ul></div></article>", "{4}"),
    # comments as long as the article, with no article tag
    ("<body><div class=post><h1>T</h1><p>{4}</p><p>{4}</p></div><div class=reader-feedback><p>{4}</p><p>{4}</p></div></body>", "T\n{4}\n{4}"),
    ("<body><nav><a href=a>Home</a></nav><div class=cookie-notice>{4}</div></body>", ""),
    ("<body><div><p>{4}</p><p>See <a href=x>the whole of it</a></p><p><a href=y>A link, alone.</a></p></div></body>", "{4}\nSee the whole of it\nA link, alone."),
    ('<body><div title="a>b"><p title=it\'s>{4}</p></div></body>', "{4}"),
]


def filled(s):
    return re.sub(r"\{(\d)\}", lambda m: (PARA * int(m[1])).strip(), s)


@pytest.mark.parametrize(("html", "text"), PLAIN_PAGES)
def test_pages_without_marks(html, text):
    assert main_text(filled(html)) == filled(text)


def brute_scores(found):
    """Scores and threshold as the module's text says, block by block."""
    paths = []
    for b in found:
        at, path = b.element, []
        while at:
            path.append(at.path)
            at = at.parent
        paths.append(tuple(path))
    of = {p: [b for b, q in zip(found, paths) if q == p] for p in paths}
    ratio = [sum(len(b.text) for b in of[p]) / len(of[p]) for p in paths]
    points = [sum(1 for b in of[p] for c in b.text if c in extraction.PUNCTUATION) / len(of[p]) for p in paths]

    def smooth(x, k):
        near = [x[min(max(k + d, 0), len(x) - 1)] for d in range(-2, 3)]
        return (near[0] + 2 * near[1] + 4 * near[2] + 2 * near[3] + near[4]) / 10

    scores, plain = [], []
    for k, (b, p) in enumerate(zip(found, paths)):
        value = (smooth(ratio, k) * (1 + smooth(points, k)) * ratio[k] * (1 + points[k])) ** 0.25
        links = sum(x.links for x in of[p]) >= 0.9 * sum(len(x.text) for x in of[p]) and len(of[p]) >= 3 and points[k] < 1
        weight, at = 0.02 if links else 1.0, b.element
        while at:
            weight, at = weight * at.own, at.parent
        scores.append(value * weight)
        if weight == 1:
            plain.append(value)
    return scores, 0.4 * (sum(x * x for x in plain) / len(plain)) ** 0.5 if plain else float("inf")


@pytest.mark.parametrize("html", [h for h, _ in PLAIN_PAGES])
def test_scores_by_brute_force(html):
    found, _ = extraction.blocks(filled(html))
    got, want = extraction._scores(found), brute_scores(found)
    assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])


def test_scores_decide(monkeypatch):
    """With scores dealt out at random, or turned around, other blocks are chosen."""
    own, rng = extraction._scores, np.random.default_rng(1)
    pages = [filled(h) for h, t in PLAIN_PAGES if t] * 5
    right = [main_text(h) for h in pages]
    for change in (rng.permutation, np.negative):
        monkeypatch.setattr(extraction, "_scores", lambda found, change=change: (change(own(found)[0]), own(found)[1]))
        assert sum(main_text(h) != t for h, t in zip(pages, right)) > 0.3 * len(pages)


@pytest.mark.parametrize("change", ["constant", "inverse", "shuffled"])
def test_ratios_decide_on_the_drivers_pages(monkeypatch, change):
    path = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("the driver's tables are not there")
    pages = pq.read_table(path, columns=["html"]).column(0).to_pylist()
    right = [main_text(h or "") for h in pages]
    own, rng = extraction._ratios, np.random.default_rng(1)
    to = {"constant": lambda f: np.ones(len(f)), "inverse": lambda f: 1 / np.maximum(f, 1e-9), "shuffled": rng.permutation}[change]
    monkeypatch.setattr(extraction, "_ratios", lambda found: to(own(found)))
    assert sum(main_text(h or "") != t for h, t in zip(pages, right)) > 0.2 * len(pages)


@pytest.mark.parametrize("name", ["social-history", "menu-planning", "notice-of-results", "ad-hoc-methods", "newsletter-archive", "methods", "comment-analysis", "footer-design"])
def test_a_name_alone_removes_no_prose(name):
    html = filled(f"<body><nav><ul><li><a href=a>Home</a></ul></nav><article><h1>T</h1><p>{{4}}</p><section class={name}><h2>Part</h2><p>{{3}}</p><p>{{4}}</p><p>Short end</p></section></article></body>")
    assert main_text(html) == filled("T\n{4}\nPart\n{3}\n{4}\nShort end")


@pytest.mark.parametrize("name", ["comments", "comment-list", "user-opinions", "talkback", "reader-reactions", "cookie-notice", "ad", "site-footer", "sidebar", "newsletter-signup-form"])
def test_comments_and_notices_go(name):
    html = filled(f"<body><article><h1>T</h1><p>{{4}}</p><div class={name}><p>{{2}}</p><p>{{2}}</p></div></article></body>")
    assert main_text(html) == filled("T\n{4}")


@pytest.mark.parametrize("part", ["<div>x", "<span>x", "<li><p>x", "<table><tr><td>x", "<b><p></p>", "<a 'x", "<!", "<i></b>", "<p>x</p></div>"])
def test_time_is_linear_in_length(part):
    spent = []
    for n in (4_000, 40_000):
        start = time.process_time()
        main_text(part * n)
        spent.append(time.process_time() - start)
    assert spent[1] < 30 * spent[0] + 0.5


def test_query(spark):
    long = "<article>" + "<p>word, word. " * 20_000 + "</article>"
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "v", ""), (3, "w", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = {(r.page_id, r.url, r.n_chars) for r in op2_html(df).collect()}
    assert got == {(1, "u", 1), (2, None, 0), (None, "v", 0), (3, "w", 20_000 * 12 - 1)}
    assert op2_html(df).count() == 5 and op2_html(df.limit(0)).count() == 0
