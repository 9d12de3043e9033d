"""The tree operators against recursive versions over a plain tree of dictionaries."""

import random
import re

import numpy as np
import pytest

from readlake.operators import trees as t

COMMA = re.compile("[,،﹐︐︑⹁⸴⸲，]")
BLOCK = {"blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Element:
    """A living tree: children are elements and texts, in order."""

    def __init__(self, tag, attrs=(), *children):
        self.tag, self.attrs, self.children, self.parent, self.number = tag, dict(attrs), list(children), None, None
        for c in children:
            if isinstance(c, Element):
                c.parent = self

    def html(self):
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        return f"<{self.tag}{attrs}>" + "".join(c.html() if isinstance(c, Element) else c for c in self.children) + f"</{self.tag}>"

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, Element):
                yield from c.walk()

    def below(self, *tags):
        return [e for e in list(self.walk())[1:] if e.tag in tags]

    def raw(self):
        return "" if self.tag in ("script", "style", "noscript", "template") else "".join(c.raw() if isinstance(c, Element) else c for c in self.children)

    def text(self):
        return " ".join(self.raw().split())

    def up(self, most=None):
        out, e = [], self.parent
        while e is not None and (most is None or len(out) < most):
            out.append(e)
            e = e.parent
        return out

    def pieces(self):
        for c in self.children:
            yield from c.pieces() if isinstance(c, Element) else [c]

    def get(self, name):
        return self.attrs.get(name, "")


def as_p(e):
    return e.tag == "p" or (e.tag == "div" and not e.below(*BLOCK))


def weight(e, on=True):
    return sum((25 if re.search(t.POSITIVE, e.get(a)) else 0) - (25 if re.search(t.NEGATIVE, e.get(a)) else 0) for a in ("class", "id")) if on else 0


def links(e):
    n = len(e.text())
    return sum(len(a.text()) * (0.3 if re.match("#.", a.get("href")) else 1) for a in e.below("a")) / n if n else 0


def unlikely(root, strict):
    for e in list(root.walk())[1:]:
        names, style = e.get("class") + " " + e.get("id"), e.get("style").replace(" ", "")
        gone = "hidden" in e.attrs or "display:none" in style or "visibility:hidden" in style or (e.get("aria-hidden") == "true" and "fallback-image" not in e.get("class"))
        gone |= e.get("aria-modal") == "true" and e.get("role") == "dialog"
        if strict:
            near = {x.tag for x in e.up(4)}
            gone |= bool(re.search(t.UNLIKELY, names) and not re.search(t.MAYBE, names) and not near & {"table", "code"} and e.tag not in ("body", "html", "a"))
            gone |= e.get("role") in t.UNLIKELY_ROLES
        if gone and root in e.up():
            yield e


def drop(root, strict):
    for e in list(unlikely(root, strict)):
        if root in e.up():
            cut(e)


def cut(e):
    """Takes ``e`` out; white space at the ends of its texts still parts what was around them."""
    e.parent.children[e.parent.children.index(e)] = " " if any(x != x.strip() for x in e.pieces()) else ""
    e.parent = None


def scores(root, on=True):
    out = {}
    for e in root.walk():
        if (e.tag in t.SCORED or e.p) and len(e.text()) >= 25:
            points = 2 + len(COMMA.findall(e.text())) + min(len(e.text()) // 100, 3)
            for level, a in enumerate(e.up(5)):
                if a.tag not in ("html", "#"):
                    out.setdefault(a, (0 if a.tag == "div" and a.p else t.TAG_START.get(a.tag, 0)) + weight(a, on))
                    out[a] += points / (1, 2, 6, 9, 12)[level]
    return out


def is_data(table):
    if table.get("role") == "presentation" or table.get("datatable") == "0":
        return False
    captions = table.below("caption")
    if table.get("summary") or (captions and captions[0].children) or table.below("col", "colgroup", "tfoot", "thead", "th"):
        return True
    if table.below("table"):
        return False
    rows = sum(int(r.get("rowspan") or 1) for r in table.below("tr"))
    columns = max((sum(int(d.get("colspan") or 1) for d in r.below("td")) for r in table.below("tr")), default=0)
    return rows >= 10 or columns > 4 or rows * columns > 10


def clean(root, tags=t.CLEANED, on=True):
    data = {e for e in root.walk() if e.tag == "table" and is_data(e)}
    for tag in tags:
        for e in [x for x in root.walk() if x.tag == tag and not (tag == "div" and x.p)][::-1]:
            if e in data or any(a in data for a in e.up()) or any(a.tag == "code" for a in e.up(4)):
                continue
            if fishy(e, tag, on):
                cut(e)


def fishy(e, tag, on):
    text, w = e.text(), weight(e, on)
    if w < 0:
        return True
    if text.count(",") >= 10:
        return False
    embeds = e.below("object", "embed", "iframe")
    if any(re.search(t.VIDEOS, v) for x in embeds for v in x.attrs.values()):
        return False
    p, img, li, inputs = sum(x.p for x in list(e.walk())[1:]), len(e.below("img")), len(e.below("li")), len(e.below("input"))
    is_list = tag in ("ul", "ol") or (bool(text) and sum(len(x.text()) for x in e.below("ul", "ol")) / len(text) > 0.9)
    heading = sum(len(x.text()) for x in e.below(*t.HEADINGS)) / len(text) if text else 0
    figure = any(a.tag == "figure" for a in e.up(4))
    remove = (
        (img > 1 and p / img < 0.5 and not figure) or (not is_list and li - 100 > p) or inputs > p // 3 or (not is_list and heading < 0.9 and len(text) < 25 and (img == 0 or img > 2) and not figure)
        or (not is_list and w < 25 and links(e) > 0.2) or (w >= 25 and links(e) > 0.5) or (len(embeds) == 1 and len(text) < 75) or len(embeds) > 1
    )
    if is_list and remove:
        own = [c for c in e.children if isinstance(c, Element)]
        if all(sum(isinstance(x, Element) for x in c.children) <= 1 for c in own) and img == li:
            return False
    return remove


WORDS = "alpha beta, gamma delta epsilon， zeta eta, theta iota kappa lambda mu".split()
CLASSES = ["", "", "", "content", "sidebar", "comment", "article-body", "footer", "main-menu", "share tool", "byline", "text", "x"]


def grow(rng, depth=0):
    """A random tree whose HTML parses to itself: blocks aren't put into paragraphs, links aren't nested."""
    tag = rng.choice("div div div section p p ul table figure form fieldset blockquote pre h2 article header".split()) if depth < 5 else "p"
    attrs = {}
    for name, values in (("class", CLASSES), ("id", CLASSES), ("role", ["", "", "", "", "menu", "dialog"]), ("style", ["", "", "", "", "", "display: none"]), ("aria-hidden", ["", "", "", "", "true"])):
        v = rng.choice(values)
        if v and rng.random() < 0.4:
            attrs[name] = v
    say = lambda most=14: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most)))

    def inline():
        kind = rng.choice(["text", "text", "a", "b", "img", "input", "code", "iframe", "embed", "span"])
        if kind == "text":
            return " " + say() + " "
        if kind in ("img", "input", "embed"):
            return Element(kind, {"src": rng.choice(["x", "https://www.youtube.com/embed/1"])} if kind == "embed" else {})
        return Element(kind, {"href": rng.choice(["#top", "/x"])} if kind == "a" else {}, *([" " + say(5) + " "] if kind != "iframe" else []))

    if tag in ("p", "h2", "pre"):
        return Element(tag, attrs, *(inline() for _ in range(rng.randint(0, 4))))
    if tag == "ul":
        return Element(tag, attrs, *(Element("li", {}, *(inline() for _ in range(rng.randint(1, 2)))) for _ in range(rng.randint(0, 6))))
    if tag == "table":
        if rng.random() < 0.2:
            attrs["summary"] = "s"
        if rng.random() < 0.2:
            attrs["role"] = "presentation"
        rows = [Element("tr", {"rowspan": "2"} if rng.random() < 0.1 else {}, *(Element("td", {"colspan": "3"} if rng.random() < 0.1 else {}, say(4), *([grow(rng, depth + 2)] if rng.random() < 0.2 else [])) for _ in range(rng.randint(1, 5)))) for _ in range(rng.randint(1, 5))]
        caption = [Element("caption", {}, *(["c"] if rng.random() < 0.5 else []))] if rng.random() < 0.2 else []
        return Element(tag, attrs, *caption, Element("tbody", {}, *rows))
    return Element(tag, attrs, *(inline() if rng.random() < 0.3 else grow(rng, depth + 1) for _ in range(rng.randint(0, 5))))


def page(seed):
    rng = random.Random(seed)
    root = Element("#", {}, Element("html", {}, Element("body", {}, *(grow(rng) for _ in range(rng.randint(1, 6))))))
    for k, e in enumerate(root.walk()):
        e.number = k - 1
    mark(root)
    return root


def mark(root):
    for e in root.walk():
        e.p = as_p(e)


def html_of(root):
    return "".join(c.html() for c in root.children)


SEEDS = range(60)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(s, html_of(page(s))) for s in SEEDS], "page_id long, html string").repartition(3)


@pytest.fixture(scope="module")
def grown(pages):
    return t.page_trees(pages).cache()


def kept(rows):
    out = {s: {} for s in SEEDS}
    for r in rows:
        out[r["page_id"]][r["node_id"]] = r
    return out


def by_page(change):
    """Node numbers and texts that a change of the living tree leaves, for each page."""
    out = {}
    for s in SEEDS:
        root = page(s)
        change(root)
        out[s] = {e.number: e for e in root.walk() if e.number >= 0}
    return out


def test_nodes_are_intervals_of_one_text(grown):
    texts = {r["page_id"]: r["text"] for r in grown.collect()}
    got = kept(t.html_nodes(grown).collect())
    for s in SEEDS:
        own = [e for e in page(s).walk() if e.number >= 0]
        assert sorted(got[s]) == [e.number for e in own]
        for e in own:
            r = got[s][e.number]
            assert (r["tag"], r["parent_id"], r["leave"]) == (e.tag, e.parent.number if e.parent.tag != "#" else -1, e.number + len(list(e.walk())))
            assert r["length"] == len(e.text()) and r["commas"] == len(COMMA.findall(e.text()))
            assert e.text() == (texts[s][r["start"] : r["start"] + r["length"]] if r["length"] else "")
            assert r["link_density"] == pytest.approx(links(e))


@pytest.mark.parametrize("strict", [True, False])
def test_unlikely_goes_with_all_under_it(grown, strict):
    want = by_page(lambda root: drop(root, strict))
    got = kept(t.drop_unlikely(grown, strict).collect())
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(v) for s, v in want.items()}
    assert any(len(v) < len(list(page(s).walk())) - 1 for s, v in got.items())


def test_byline_and_text_density(grown):
    lines = {r["page_id"]: r["byline"] for r in t.byline(grown).collect()}
    shares = {(r["page_id"], r["node_id"]): r["density"] for r in t.text_density(grown, ("h2", "li")).collect()}
    for s in SEEDS:
        own = [e for e in page(s).walk() if e.number >= 0]
        named = [e.text() for e in own if re.search(t.BYLINE, e.get("class") + " " + e.get("id")) and 0 < len(e.text()) < 100]
        assert lines.get(s) == (named[0] if named else None)
        for e in own:
            n = len(e.text())
            assert shares[s, e.number] == pytest.approx(sum(len(x.text()) for x in e.below("h2", "li")) / n if n else 0)


def test_scores_and_top_candidates(grown):
    got = {(r["page_id"], r["node_id"]): r["score"] for r in t.ancestor_score(grown).collect()}
    best = {}
    for r in t.top_candidates(grown, 3).orderBy("page_id", "place").collect():
        best.setdefault(r["page_id"], []).append((r["node_id"], r["final"], r["text"]))
    seen = 0
    for s in SEEDS:
        want = scores(page(s))
        assert {e.number: v for e, v in want.items()} == pytest.approx({n: v for (p, n), v in got.items() if p == s})
        final = sorted(((e.number, round(v * (1 - links(e)), 6), e.text()) for e, v in want.items()), key=lambda x: (-x[1], x[0]))[:3]
        assert [(n, pytest.approx(v), x) for n, v, x in final] == best.get(s, [])
        seen += len(final)
    assert seen > 60


def test_conditional_cleaning(grown):
    want = by_page(clean)
    got = kept(t.clean_conditionally(grown).collect())
    assert {s: sorted(v) for s, v in got.items()} == {s: sorted(v) for s, v in want.items()}
    for s in SEEDS:
        assert {n: r["length"] for n, r in got[s].items()} == {n: len(e.text()) for n, e in want[s].items()}


def climb(s, least):
    longest = None
    for k in range(4):
        root = page(s)
        drop(root, k == 0)
        if k < 3:
            clean(root)
        final = sorted(((-round(v * (1 - links(e)), 6), e.number, e.text()) for e, v in scores(root, k < 2).items()), key=lambda x: x[:2])
        if final and (longest is None or len(final[0][2]) > len(longest[1])):
            longest = k, final[0][2]
        if final and len(final[0][2]) >= least:
            return k, final[0][2]
    return longest


@pytest.mark.parametrize("least", [60, 500])
def test_ladder(grown, least):
    got = {r["page_id"]: (r["attempt"], r["text"]) for r in t.extract_ladder(grown, least).collect()}
    want = {s: climb(s, least) for s in SEEDS}
    assert got == {s: v for s, v in want.items() if v}
    assert len({k for k, _ in got.values()}) > 2


def test_rows_grow_into_the_same_trees(grown):
    """Rows of nodes, whole or with subtrees missing, give what the trees themselves give."""
    plain = lambda df: {(r["page_id"], r["node_id"]): r.asDict(True) for r in df.collect()}
    nodes = t.html_nodes(grown)
    assert plain(t.clean_conditionally(nodes)).keys() == plain(t.clean_conditionally(grown)).keys()
    assert sorted(t.extract_ladder(nodes, 60).collect()) == sorted(t.extract_ladder(grown, 60).collect())
    left = t.drop_unlikely(grown)
    got = {}
    for r in t.top_candidates(t.clean_conditionally(left), 1).collect():
        got[r["page_id"]] = r["final"], r["text"]
    for s in SEEDS:
        root = page(s)
        drop(root, True)
        clean(root)
        final = sorted(((-round(v * (1 - links(e)), 6), e.number, e.text()) for e, v in scores(root).items()), key=lambda x: x[:2])
        assert got.get(s) == (None if not final else (pytest.approx(-final[0][0]), final[0][2]))


def rows_of(spark, html):
    return [r.asDict() for r in t.html_nodes(t.page_trees(spark.createDataFrame([(1, html)], "page_id long, html string"))).orderBy("node_id").collect()]


def test_hostile_pages(spark):
    assert rows_of(spark, None) == [] and rows_of(spark, "") == [] and rows_of(spark, "<!-- x --><!doctype html>") == []
    assert [(r["tag"], r["length"]) for r in rows_of(spark, "just text <b>and</b> more")] == [("body", 18), ("b", 3)]
    assert [(r["tag"], r["parent_id"], r["length"]) for r in rows_of(spark, "<p>one<p>two<ul><li>a<li>b<ul><li>c</ul><li>d</ul></p>x")] == [("p", -1, 3), ("p", -1, 3), ("ul", -1, 4), ("li", 2, 1), ("li", 2, 2), ("ul", 4, 1), ("li", 5, 1), ("li", 2, 1), ("body", -1, 1)]
    assert [r["length"] for r in rows_of(spark, "<div>a<script>var x = '<p>no</p>'</script><style>b</style><noscript>c <i>d</i></noscript>e</div>")] == [2, 0, 0, 0, 0]
    deep = rows_of(spark, "<div>" * 3000 + "<i>end</i>")
    assert len(deep) == 3001 and all(r["leave"] <= 3001 for r in deep) and deep[0]["length"] == 3
    flat = rows_of(spark, "<div>" + "<p>w</p>" * 20_000 + "</div>")
    assert len(flat) == 20_001 and flat[0]["length"] == 20_000


def test_tables_code_figures_videos_and_image_lists_stay(spark):
    table = '<table summary="s" id="data"><caption>t</caption>' + "<tr>" + "<td><ul><li><a href=x>c</a></li></ul></td>" * 6 + "</tr></table>"
    cases = {
        1: f"<body><div>{'text ' * 30}{table}</div></body>",
        2: "<body><code><div><ul><li>x</li></ul><p>y</p></div></code></body>",
        3: "<body><div class=sidebar><p>gone</p></div><div><iframe src='https://player.vimeo.com/1'></iframe><p>kept</p></div></body>",
        4: "<body><ul>" + "<li><img></li>" * 5 + "</ul><ul>" + "<li><img><b>x</b></li>" * 5 + "</ul></body>",
        5: "<body><table><tr><td><div><p>layout</p><table><tr><td>x</td></tr></table></div></td></tr></table></body>",
    }
    trees = t.page_trees(spark.createDataFrame(list(cases.items()), "page_id long, html string"))
    left = {}
    for r in t.clean_conditionally(trees).orderBy("page_id", "node_id").collect():
        left.setdefault(r["page_id"], []).append(r["tag"])
    assert left[1].count("table") == 1 and left[1].count("ul") == 6
    assert "ul" in left[2] and "div" in left[2]
    assert left[3].count("div") == 1 and "iframe" in left[3]
    assert left[4].count("ul") == 1 and left[4].count("img") == 5
    assert "table" not in left[5]


def test_no_pages(spark, pages):
    none = t.page_trees(pages.limit(0))
    for rows in (t.html_nodes(none), t.byline(none), t.extract_ladder(none), t.clean_conditionally(none), t.top_candidates(none)):
        assert rows.collect() == []


def test_empty_forest_has_no_values():
    import pyarrow as pa

    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], t._NODES), pa.array([], t._RUNS)], names=["page_id", "text", "nodes", "runs"])
    forest = t.Forest(empty)
    forest.clean_conditionally()
    assert forest.n == 0 and len(forest.chars()) == 0 and t.ladder(forest)[1] == []
    assert isinstance(forest.weight(), np.ndarray)


def test_rules_see_pages_in_bounded_pieces(spark):
    import pyarrow as pa

    seen = lambda f: [f.page_id, pa.array([len(f.per_page)] * len(f.per_page), pa.int32()), pa.array([len(f.text.to_pylist()[0])] * len(f.per_page), pa.int32())]
    small = spark.createDataFrame([(k, f"<p>page {k}</p>") for k in range(1000)], "page_id long, html string").coalesce(1)
    for pages in (small, t.page_trees(small)):
        rows = t.by_batch(pages, seen, "page_id long, n int, chars int").collect()
        assert sorted(r["page_id"] for r in rows) == list(range(1000)) and max(r["n"] for r in rows) <= 256
    large = spark.createDataFrame([(k, "<p>" + "word " * 80_000) for k in range(9)] + [(9, None)], "page_id long, html string").coalesce(1)
    rows = t.by_batch(large, seen, "page_id long, n int, chars int").collect()
    assert sorted(r["page_id"] for r in rows) == list(range(10)) and max(r["n"] for r in rows) <= 3
