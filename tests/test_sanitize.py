"""The sanitizer: nesting, attributes, and equality with a recursive walk of trees that parse to themselves."""

import random
import re

import pytest

from readlake.operators import article
from readlake.operators.sanitize import DROP_TAGS, KEEP_TAGS, clean_page
from test_trees import Element, html_of, page

TOKEN = re.compile(r"<(/?)([a-z0-9]+)([^>]*)>")


def nested(html):
    """Whether every tag closes what was opened last and nothing stays open, all tags being allowed ones."""
    stack = []
    for close, tag, _ in TOKEN.findall(html):
        assert tag in KEEP_TAGS
        if tag in ("br", "hr", "img"):
            assert not close
        elif not close:
            stack.append(tag)
        elif not stack or stack.pop() != tag:
            return False
    return not stack


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p><b>bold<i>both</b>italic</i></p>", "<p><b>bold<i>both</i></b><i>italic</i></p>"),
        ("<ul><li>a<p>b</ul>c</p>", "<ul><li>a<p>b</p></li></ul>c"),
        ("<p><b>x</p>y</b>z", "<p><b>x</b></p><b>y</b>z"),
        ("<p>one<p>two<div>three</div>", "<p>one</p><p>two</p>three"),
        ("<table><tr><td>a<td><b>b<tr><td>c</table>d", "<table><tr><td>a</td><td><b>b</b></td></tr><tr><td>c</td></tr></table>d"),
        ("</b></p>x</i><li>y", "x<li>y</li>"),
        ("<a href='https://a/?x=1&y=2'>1<a href='javascript:x'>2</a>", '<a href="https://a/?x=1&amp;y=2">1</a><a>2</a>'),
        ("<form>gone <p>with</form>kept<iframe>x</iframe><svg><p>y</p></svg>", "kept"),
        ("<script>document.write('</p>')</script><style>p{}</style><p>x<input><br>y<hr>", "<p>x<br>y</p><hr>"),
        ("<custom><p>a</p> <u>b</u></custom><font color=red>c</font>", "<p>a</p> <u>b</u>c"),
        ("a &lt;b&gt; &amp; &nbsp;&quot;c&quot; <!-- no --> d", 'a &lt;b&gt; &amp; &nbsp;"c"  d'),
        ("<p> </p><p>\n</p>", ""),
        ("<h5>five</h5><h4 onclick=x id=y>four</h4>", "five<h4>four</h4>"),
        (None, ""), ("", ""), ("plain", "plain"), ("<b>", "<b></b>"), ("<", "&lt;"), ("x<p", "x&lt;p"),
    ],
)
def test_pages(html, want):
    got = clean_page(html)
    assert got == want and nested(got)


def test_attributes():
    inline = "data:image/png;base64,iVBORw0KGgo="
    assert clean_page(f"<img src='{inline}' alt='{'é' * 301}' width=3>") == f'<img src="{inline}" alt="{"é" * 300}">'
    assert clean_page("<p><img src='https://e/x.png' alt='a &lt; \"b\"'><img src=x></p>") == '<p>a &lt; "b"</p>'
    assert clean_page("<img src='data:image/svg+xml;base64,PHN2Zz4=' alt=v>") == "v"
    spans = "<table><tr><td colspan=2 rowspan=1>a</td><td colspan=100 rowspan='07'>b</td><th colspan='-3' rowspan=99>c</th><td colspan=0>d</td></tr></table>"
    assert clean_page(spans) == '<table><tr><td colspan="2">a</td><td rowspan="07">b</td><th rowspan="99">c</th><td>d</td></tr></table>'
    for href, kept in (("HTTPS://x", True), ("mailto:a@b", True), ("#top", True), (" http://y ", True), ("javascript:alert(1)", False), ("//host", False), ("data:text/html,x", False), ("/path", False)):
        assert ("href" in clean_page(f'<a href="{href}">x</a>')) == kept


def walk(e):
    """Recursive version over a tree."""
    out = ""
    for c in e.children:
        if not isinstance(c, Element):
            out += c
        elif c.tag not in DROP_TAGS:
            inner = walk(c)
            if c.tag == "img":
                continue
            attrs = f' href="{c.get("href")}"' if c.tag == "a" and c.get("href").startswith("#") else ""
            attrs += "".join(f' {k}="{c.get(k)}"' for k in ("colspan", "rowspan") if c.tag in ("td", "th") and c.get(k).isdigit() and int(c.get(k)) > 1)
            out += f"<{c.tag}{attrs}>{inner}</{c.tag}>" if c.tag in KEEP_TAGS else inner
    return out


@pytest.mark.parametrize("seed", range(80))
def test_trees_match_a_recursive_walk(seed):
    root = page(seed)
    got = clean_page(html_of(root))
    assert got == re.sub(r"<p>\s*</p>", "", walk(root)).strip() and nested(got)


def test_tag_soup_always_nests():
    rng = random.Random(9)
    tags = "p b i a u ul li table tr td th div span section form script h1 pre code br img svg blockquote caption select option".split()
    for _ in range(3000):
        soup = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "x ", " ", "&lt;", f"<{rng.choice(tags)} href='#a' "]) for _ in range(rng.randint(1, 40)))
        got = clean_page(soup)
        assert nested(got)
        again = clean_page(got)
        assert nested(again) and "".join(TOKEN.sub("", again).split()) == "".join(TOKEN.sub("", got).split())


def test_large_and_deep_pages():
    deep = clean_page("<b>" * 20_000 + "x")
    assert nested(deep) and deep.endswith("x" + "</b>" * 512)
    assert clean_page("<div>" * 20_000 + "<p>x").endswith("<p>x</p>")
    assert clean_page("<p>x" * 50_000).count("<p>x</p>") == 50_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a<b>b", 0), (2, None, 1), (3, "", 2), (1, "<p>a<b>b", 3)], "page_id long, html string, pos int")
    assert sorted(tuple(r) for r in article.sanitize_html(df).collect()) == [(1, "<p>a<b>b</b></p>"), (1, "<p>a<b>b</b></p>"), (2, ""), (3, "")]
    assert article.sanitize_html(df.limit(0)).collect() == []
