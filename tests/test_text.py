import random

import pytest
from pyspark.sql import functions as F

from readlake.functions import text as t
from readlake.operators import article, chat, pixels, registry


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("column", "wanted"),
    [
        (lambda: t.utf16_len(F.lit("a🙂b")), 4), (lambda: t.unescape_numeric(F.lit("&#65;&#x1F642;&#xD800;&#0;")), "A🙂&#xD800;&#0;"), (lambda: t.unescape_entities(F.lit("&amp;lt; &NBSP;x")), "&lt;  x"),
        (lambda: t.safe_href(F.lit(" JavaScript:x ")), ""), (lambda: t.safe_href(F.lit("#a"), anchors=False), ""), (lambda: t.safe_image_src(F.lit("data:image/png;base64,AA==")), "data:image/png;base64,AA=="), (lambda: t.safe_image_src(F.lit("https://e.org/a.png")), ""),
        (lambda: t.normalize_path(F.lit("a/b/c.x"), F.lit("../d%20e.x?q#f")), "a/d e.x"), (lambda: t.normalize_path(F.lit("a.x"), F.lit("../../b")), "b"), (lambda: t.absolutize(F.lit("https://h.org/a/b?x"), F.lit("../c?d")), "https://h.org/c?d"),
        (lambda: t.absolutize(F.lit("https://h.org/a"), F.lit("javascript:1")), ""), (lambda: t.column_index(F.lit("AB12")), 27), (lambda: t.row_index(F.lit("AB12")), 11), (lambda: t.cell_ref(F.lit(11), F.lit(27)), "AB12"), (lambda: t.cell_ref(F.lit(0), F.lit(702)), "AAA1"),
        (lambda: t.format_size(F.lit(1536)), "1KB"), (lambda: t.format_size(F.lit(1572864)), "1.5MB"), (lambda: t.format_number(F.lit(12.5)), "12.5"), (lambda: t.format_number(F.lit(1e6)), "1000000"),
        (lambda: t.file_ext(F.lit("A.B.TXT?x=1#y")), "txt"), (lambda: t.file_ext(F.lit("no")), ""), (lambda: t.file_stem(F.lit(".txt")), "untitled"),
        (lambda: t.line_title(F.lit("Title\n\nbody")), "Title"), (lambda: t.line_title(F.lit("only one line")), None), (lambda: t.text_to_html(F.lit("a<b\nc\n\n d ")), "<p>a&lt;b<br>c</p><p>d</p>"), (lambda: t.text_to_html(F.lit("")), "<p></p>"),
        (lambda: t.trim_result(F.lit("<p>aaaa</p><p>bbbb</p>"), 11, "!"), "<p>aaaa</p>!"), (lambda: t.markdown_inline(F.lit("**a** `b` [c](javascript:1)")), "<strong>a</strong> <code>b</code> c"),
        (lambda: t.html_title(F.lit("<META content='A &amp; B' property='og:title'><title>x</title>")), "A & B"), (lambda: t.clean_control_chars(F.lit("\x13 PAGE \x143\x15\x07x")), "3\tx"),
        (lambda: article.paragraph_score(F.lit("a, b, c " + "x" * 120)), 5), (lambda: article.class_weight(F.lit("article-body"), F.lit("sidebar")), 0),
    ],
)
def test_column(spark, column, wanted):
    assert value(spark, column()) == wanted


def test_natural_order(spark):
    names = ["第10页.png", "第2页.png", "第1页.png", "cover.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(t.natural_sort_key(F.col("n"))).collect()] == ["cover.png", "第1页.png", "第2页.png", "第10页.png"]


def test_sanitizer_balances_and_drops(spark):
    html = "<div><p>a<script>x()</script><b>b</p></i><a href='javascript:1' onclick=x>c</a><img src='http://x'><p> </p>&lt;"
    got = article.sanitize_html(spark.createDataFrame([(1, html)], "page_id long, html string")).first()["html"]
    assert got == "<p>a<b>b</b></p><b><a>c</a>&lt;</b>"


def test_nodes_scores_and_ladder(spark):
    body = "A sentence, with commas, and quite a few words in it to count. " * 4
    html = f"<html><body><div class='sidebar'><p>{body}</p></div><div id=main><p>{body}<p>{body}</div><div style='display: none'><p>{body}</p></div></body></html>"
    nodes = article.html_nodes(spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id long, html string")).cache()
    kept = article.drop_unlikely(nodes)
    assert kept.where("cls = 'sidebar' or hidden").count() == 0 and kept.where("tag = 'p'").count() == 2
    best = article.top_candidates(kept).where("place = 1").first()
    assert (best["tag"], best["page_id"]) == ("div", 1)
    got = article.extract_ladder(nodes, 100).first()
    assert got["attempt"] == 0 and got["text"].count("A sentence") == 8


def test_device_and_book_limits(spark):
    devices = spark.createDataFrame([("p", f"device-{i}", i) for i in range(14)], "owner string, name string, ts int")
    kept = registry.recent_n(devices, "owner", "ts", "name", 10).orderBy("place").collect()
    assert len(kept) == 10 and kept[0]["name"] == "device-13"
    books = spark.createDataFrame([("p", i, 10, 0, i, i) for i in range(24)], "owner string, uri int, total int, page int, time int, seq int")
    top = registry.upsert_books(books, 20)
    moves = spark.createDataFrame([("p", 23, 99, 100, 100)], "owner string, uri int, page int, time int, seq int")
    got = {r["uri"]: r["page"] for r in registry.book_progress(top, moves).collect()}
    assert len(got) == 20 and got[23] == 9


def test_links_resolve_as_in_browsers(spark):
    base = "https://e.org/a/b/c.html?q=1#f"
    want = {"d.html": "https://e.org/a/b/d.html", "../d%20e/": "https://e.org/a/d%20e/", "/x/./y/../z?k#h": "https://e.org/x/z?k#h", "../../../..": "https://e.org/", "?n": "https://e.org/a/b/c.html?n", "": "https://e.org/a/b/c.html?q=1", "#top": "https://e.org/a/b/c.html?q=1#top", "//h/p": "https://h/p", "http://o/": "http://o/", "javascript:x": "", ".": "https://e.org/a/b/"}
    df = spark.createDataFrame([(base, k) for k in want], "base string, link string")
    assert {r["link"]: r["a"] for r in df.select("link", t.absolutize(F.col("base"), F.col("link")).alias("a")).collect()} == want


def test_defaults_by_list_and_by_product(spark, monkeypatch):
    stored = spark.createDataFrame([("a", "size", 5.0), ("a", "other", 1.0), ("b", "size", None), ("c", "margin", 900.0)], "owner string, name string, value double")
    defaults = spark.createDataFrame([("size", 16.0, 8.0, 64.0), ("margin", 24.0, 0.0, 120.0)], "name string, value double, low double, high double")
    want = {("a", "size"): 8.0, ("a", "margin"): 24.0, ("b", "size"): 16.0, ("b", "margin"): 24.0, ("c", "size"): 16.0, ("c", "margin"): 120.0}
    for most in (1000, 1):
        monkeypatch.setattr(registry, "FEW_SETTINGS", most)
        assert {(r["owner"], r["name"]): r["value"] for r in registry.with_defaults(stored, defaults).collect()} == want
    assert registry.with_defaults(stored, defaults.limit(0)).collect() == [] and registry.with_defaults(stored.limit(0), defaults).collect() == []


def test_chat_context_keeps_the_last(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(25)] + [(1, 25, "user", "question")]
    got = chat.chat_context(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 20).orderBy("turn").collect()
    assert len(got) == 21 and got[0]["role"] == "system" and got[-1]["text"] == "question"


def test_numbers_at_every_size(spark):
    shown = {1e23: "1" + "0" * 23, 1e-12: "0.000000000001", 0.1 + 0.2: "0.3", -3.25: "-3.25", 123456789012345678.0: "123456789012346000", 2 / 3: "0.666666666666667", 999999999999999.9: "1" + "0" * 15, -0.0: "0", 0.05: "0.05", float("inf"): "Infinity"}
    df = spark.createDataFrame([(v,) for v in [*shown, None]], "x double")
    assert [r["s"] for r in df.select(t.format_number(F.col("x")).alias("s")).collect()] == [*shown.values(), None]


def test_commas_are_one_list():
    assert article._COMMA.findall("a,b،c﹐d︐e︑f⹁g⸴h⸲i，j.k、l") == list(",،﹐︐︑⹁⸴⸲，")


def test_ladder_is_the_four_attempts_one_by_one(spark, sf):
    """The one plan over four keys gives what the operators give one after another, where some pages fall through."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")
    body = "A sentence, with commas, and quite a few words in it to count. "
    odd = [(-1, f"<div class='sidebar'><p>{body * 9}</p></div><p>short, but over twenty-five characters</p>"), (-2, f"<div class='comment'><div class='promo'><p>{body * 9}</p></div></div>"), (-3, f"<ul><li>{body}</li></ul><form><input><p>{body * 9}</p></form>"), (-4, None), (-5, ""), (-6, f"<div class='popup'><p>{body * 9}</p></div><p>short, but over twenty-five characters</p>")]
    nodes = article.html_nodes(pages.unionByName(spark.createDataFrame(odd, pages.schema))).cache()
    tries = {}
    for k, (strict, weigh, clean) in enumerate([(True, True, True), (False, True, True), (False, False, True), (False, False, False)]):
        kept = article.drop_unlikely(nodes, strict)
        for r in article.top_candidates(article.clean_conditionally(kept) if clean else kept, 1, weigh).collect():
            tries.setdefault(r["page_id"], []).append((k, r["text"]))
    want = {p: min(own, key=lambda a: (0, a[0]) if len(a[1]) >= 500 else (1, -len(a[1]), a[0])) for p, own in tries.items()}
    got = {r["page_id"]: (r["attempt"], r["text"]) for r in article.extract_ladder(nodes).collect()}
    assert got == want and {a for a, _ in got.values()} >= {0, 1, 3}
    assert article.extract_ladder(nodes.limit(0)).collect() == []


def test_diffusion_is_pixel_by_pixel(spark):
    rng, rows, want = random.Random(3), [], {}
    for img, (w, h, levels) in enumerate([(8, 8, 4)] * 5 + [(1, 1, 4), (7, 3, 4), (3, 7, 4)]):
        grey = [[float(rng.randrange(256)) for _ in range(w)] for _ in range(h)]
        rows += [(img, x, y, grey[y][x]) for y in range(h) for x in range(w)]
        work = {(x, y): grey[y][x] for y in range(h) for x in range(w)}
        step = 255.0 / (levels - 1)
        for y in range(h):
            for x in range(w):
                old = work[x, y]
                new = int(min(max(int(old / step + 0.5), 0), levels - 1) * step + 0.5)
                want[img, x, y] = new
                for dx, dy, share in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                    if (x + dx, y + dy) in work:
                        work[x + dx, y + dy] += (old - new) * share / 16
    df = spark.createDataFrame(rows, "img long, x int, y int, grey double").repartition(3)
    assert {(r["img"], r["x"], r["y"]): r["q"] for r in pixels.diffuse_quantize(df, 4).collect()} == want
    assert pixels.diffuse_quantize(df.limit(0), 4).collect() == []


def test_costly_columns_are_made_once(spark, sf):
    from readlake.plans import all_queries

    plan = lambda name: all_queries()[0][name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("trim_result").count("split(") == 1
    assert plan("paragraph_score").count("&nbsp;") == 1
    assert "Aggregate" not in plan("text_similarity")


def test_similarity_counts_repeated_words(spark):
    from readlake.operators.article import similarity_pairs

    rows = [(0, "a b", "b b c c"), (1, "", "x"), (2, "x", None), (3, "A_1 é z", "a_1 é Z"), (4, "q", "w ww w")]
    got = dict(similarity_pairs(spark.createDataFrame(rows, "k int, a string, b string"), "k", "a", "b").collect())
    assert got == {0: round(1 - 3 / 7, 9), 1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0}


def test_strip_leaves_line_separators(spark):
    from readlake.functions.text import strip

    rows = [(" \t\x0b\x0c\r\na b  ", "a b  "), (" \n ", ""), (None, None), ("a\r\n", "a"), ("\xa0 x", "\xa0 x")]
    assert all(a == b for a, b in spark.createDataFrame(rows, "c string, want string").selectExpr("*").select(strip(F.col("c")), "want").collect())


def test_numbers_at_the_edges_of_the_plain_form(spark):
    from decimal import Decimal
    import random

    from readlake.functions.text import format_number

    pick = random.Random(3)
    values = [0.1, -0.1, 0.001, 0.000999, 9999999.0, 9999999.5, 1e7, -1234567.12345678, 0.1 + 0.2, 100.0, -5.0, 1 / 3, 1e-3 / 3, 123456.7890123456] + [round(pick.uniform(-1e6, 1e6), pick.randrange(10)) for _ in range(500)]
    for x, shown in spark.createDataFrame([(v,) for v in values], "x double").select("x", format_number(F.col("x"))).collect():
        want = format(Decimal(f"{x:.14e}"), "f")
        assert shown == (want.rstrip("0").rstrip(".") if "." in want else want), x
