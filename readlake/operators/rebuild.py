"""Documents put together again: reading orders, sheets, budgets and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.functions.text import escape_html, markdown_inline, natural_sort_key, strip
from readlake.operators.scans import running_sums
from readlake.scratch import written

HTML_MEDIA = ("application/xhtml+xml", "text/html")


def xml_rows(entries: DataFrame, local_name: str, xml: str = "xml") -> DataFrame:
    """One row for each element of that local name: path, pos and its text."""
    found = F.expr(f"xpath({xml}, \"//*[local-name()='{local_name}']/text()\")")
    return entries.select("path", F.posexplode(found).alias("pos", "text"))


def xml_attributes(entries: DataFrame, local_name: str, names: list[str], xml: str = "xml") -> DataFrame:
    """One row for each element with those attributes (by local name), in order.  Elements that lack one get empty text."""
    at = lambda name: F.expr(f"xpath({xml}, \"//*[local-name()='{local_name}']/@*[local-name()='{name}']\")").alias(name)
    return entries.select("path", F.posexplode(F.arrays_zip(*(at(n) for n in names))).alias("pos", "a")).select("path", "pos", *(F.coalesce(F.col(f"a.{n}"), F.lit("")).alias(n) for n in names))


def epub_spine(manifest: DataFrame, itemrefs: DataFrame, most: int = 600) -> DataFrame:
    """doc, n, href in reading order: references joined with HTML manifest items; where none is left, all HTML items
    by their order in the manifest.  ``manifest(doc, id, href, media, ord)``, ``itemrefs(doc, idref, ord)``."""
    pages = manifest.where(F.col("media").isin(*HTML_MEDIA))
    read = itemrefs.select("doc", F.col("idref").alias("id"), F.col("ord").alias("at")).join(pages.select("doc", "id", "href"), ["doc", "id"])
    rest = pages.join(read.select("doc").distinct(), "doc", "left_anti").select("doc", "id", F.col("ord").alias("at"), "href")
    every = read.select("doc", "id", "at", "href").unionByName(rest)
    n = F.row_number().over(Window.partitionBy("doc").orderBy("at", "id", "href"))
    return every.withColumn("n", n).where(F.col("n") <= most).select("doc", "n", "href")


def pptx_slides(slide_ids: DataFrame, rels: DataFrame, files: DataFrame) -> DataFrame:
    """doc, n, entry: slides in the order of the presentation's relationships, orphans left out; a presentation
    without usable relationships falls back to its slide files in numeric order."""
    inner = rels.where(F.coalesce(F.col("mode"), F.lit("")) != "External").select("doc", F.col("id").alias("rid"), F.col("target").alias("entry"))
    listed = slide_ids.join(inner, ["doc", "rid"]).join(files.select("doc", "entry"), ["doc", "entry"])
    number = F.regexp_extract("entry", r"slide([0-9]+)\.xml$", 1).try_cast("int")
    loose = files.where(number.isNotNull()).join(listed.select("doc").distinct(), "doc", "left_anti").select("doc", "entry", number.alias("ord"))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("ord", "entry"))
    return listed.select("doc", "entry", "ord").unionByName(loose).select("doc", n.alias("n"), "entry")


def pptx_text(shapes: DataFrame) -> DataFrame:
    """doc, n, title, body: the title placeholder or first block as the slide's title, the rest as paragraphs, tables
    after them.  ``shapes(doc, n, pos, kind, text)``; kind is title, text or table (tables come as HTML)."""
    filled = shapes.where(strip(F.col("text")) != "")
    rank = F.struct(F.when(F.col("kind") == "title", 0).otherwise(1), F.col("pos"))
    head = filled.where("kind <> 'table'").groupBy("doc", "n").agg(F.min_by(F.struct("pos", "text"), rank).alias("h")).select("doc", "n", F.col("h.pos").alias("title_pos"), F.col("h.text").alias("title"))
    both = filled.join(head, ["doc", "n"], "left")
    block = F.when(F.col("kind") == "table", F.col("text")).otherwise(F.concat(F.lit("<p>"), escape_html(F.col("text")), F.lit("</p>")))
    part = F.when(~F.col("pos").eqNullSafe(F.col("title_pos")), F.struct((F.col("kind") == "table").alias("last"), "pos", block.alias("html")))
    return both.groupBy("doc", "n").agg(F.first("title").alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["html"]), "").alias("body"))


def docx_blocks(paragraphs: DataFrame) -> DataFrame:
    """doc, pos, level, html: headings by style name (level 1 to 6), other paragraphs 0.  ``paragraphs(doc, pos, style, text)``."""
    level = F.coalesce(F.regexp_extract("style", r"(?i)^(?:heading|title)\s*([1-6])?", 1).try_cast("int"), F.when(F.col("style").rlike("(?i)^title"), 1), F.lit(0))
    tag = F.when(level > 0, F.concat(F.lit("h"), level.cast("string"))).otherwise("p")
    return paragraphs.where(strip(F.col("text")) != "").select("doc", "pos", level.alias("level"), F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("text")), F.lit("</"), tag, F.lit(">")).alias("html"))


def xlsx_sheets(sheets: DataFrame, rels: DataFrame) -> DataFrame:
    """doc, ord, name, entry: each sheet's file by relationship, else by its number."""
    own = rels.select("doc", F.col("id").alias("rid"), F.concat(F.lit("xl/"), F.regexp_replace("target", "^/?(xl/)?", "")).alias("entry"))
    usual = F.concat(F.lit("xl/worksheets/sheet"), F.col("ord").cast("string"), F.lit(".xml"))
    return sheets.join(own, ["doc", "rid"], "left").select("doc", "ord", "name", F.coalesce("entry", usual).alias("entry"))


def xlsx_cells(cells: DataFrame, strings: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Cells with their shown value; blank ones are dropped.

    Kinds: shared (looked up in ``strings(idx, text)``, where it has ``doc`` in the document's own), boolean (1 is TRUE), error (as it is) and plain.
    """
    kind = F.col("type") if kinds is None else F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("type")]
    shown = F.when(kind == "shared", F.col("text")).when(kind == "boolean", F.when(F.col("value") == "1", "TRUE").otherwise("FALSE")).otherwise(F.col("value"))
    both = cells.join(strings, ["doc", "idx"] if "doc" in strings.columns else "idx", "left").withColumn("shown", shown)
    return both.where(F.coalesce(strip(F.col("shown")), F.lit("")) != "").drop("text")


def clamp_range(cells: DataFrame, rows: int = 3000, cols: int = 200) -> DataFrame:
    """Cells inside the range and, for each, whether its sheet was cut.  The filter reaches the scan."""
    inside = (F.col("row") < rows) & (F.col("col") < cols)
    cut = cells.where(~inside).select("doc", "sheet").distinct().withColumn("cut", F.lit(True))
    return cells.where(inside).join(cut, ["doc", "sheet"], "left").withColumn("truncated", F.coalesce("cut", F.lit(False))).drop("cut")


def fill_grid(cells: DataFrame, max_cols: int = 256) -> DataFrame:
    """Every cell from the first to the last column of its row, empty text in the gaps."""
    inside = cells.where(F.col("col") < max_cols)
    row = ["doc", "sheet", "row"]
    spans = inside.groupBy(*row).agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    every = spans.select(*row, F.explode(F.sequence("lo", "hi")).alias("col"))
    return every.join(inside.groupBy(*row, "col").agg(F.min("value").alias("value")), [*row, "col"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def take_cells(cells: DataFrame, order: list[str], max_cells: int = 60_000, max_chars: int = 400_000, max_cell: int = 32_768) -> DataFrame:
    """The leading cells of a document until a limit is met; the cell on the border is cut.

    Running sums over ranges of cells, so a document of any number of cells spreads over tasks.
    """
    cut = cells.withColumn("value", F.substring("value", 1, max_cell))
    run = running_sums(cut, ["doc"], order, before=F.length("value"))
    kept = run.where((F.col("place") <= max_cells) & (F.col("before") < max_chars))
    return kept.withColumn("value", F.substr("value", F.lit(1), (F.lit(max_chars) - F.col("before")).cast("int"))).drop("before", "before_all")


def running_budget(parts: DataFrame, doc: str, order: str, text: str, limit: int, profile: str = "cut") -> DataFrame:
    """Parts of a document until ``limit`` characters: the last is cut (``cut``), left out (``drop``) or the whole
    document is left out (``fail``).  Sums run over ranges of parts, whatever one document's share of them."""
    run = running_sums(parts, [doc], [order], before=F.length(text))
    through = F.col("before") + F.coalesce(F.length(text), F.lit(0))
    if profile == "fail":
        kept = run.where(F.col("before_all") <= limit)
    elif profile == "drop":
        kept = run.where(through <= limit)
    else:
        room = (F.lit(limit) - F.col("before")).cast("int")
        kept = run.where((F.col("before") < limit) | (through == 0)).withColumns({"truncated": through > limit, text: F.substr(text, F.lit(1), room)})
    return kept.drop("place", "before", "before_all")


def islands(rows: DataFrame, doc: str, order: str, kind: Column) -> DataFrame:
    """``rows`` with ``run``: the number of the stretch of neighbouring rows with an equal ``kind``."""
    by = Window.partitionBy(doc).orderBy(order)
    marked = rows.withColumn("_kind", kind)
    change = F.when(F.lag("_kind").over(by).eqNullSafe(F.col("_kind")), 0).otherwise(1)
    return marked.withColumn("_new", change).withColumn("run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_kind", "_new")


def text_tables(lines: DataFrame, doc: str = "doc_id", order: str = "pos", text: str = "line") -> DataFrame:
    """doc, run, kind, html: neighbouring lines with tabs as one table, each other line as a paragraph."""
    tabbed = F.col(text).contains("\t")
    filled = lines.where(strip(F.col(text)) != "")
    runs = islands(filled, doc, order, F.when(tabbed, F.lit("t")).otherwise(F.col(order).cast("string")))
    cells = F.array_join(F.transform(F.split(escape_html(F.col(text)), "\t"), lambda c: F.concat(F.lit("<td>"), strip(c), F.lit("</td>"))), "")
    line = F.when(tabbed, F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))).otherwise(F.concat(F.lit("<p>"), strip(escape_html(F.col(text))), F.lit("</p>")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "")
    out = runs.groupBy(doc, "run").agg(F.bool_or(tabbed).alias("is_table"), joined.alias("inner"))
    return out.select(doc, "run", F.when(F.col("is_table"), "table").otherwise("p").alias("kind"), F.when(F.col("is_table"), F.concat(F.lit("<table>"), "inner", F.lit("</table>"))).otherwise(F.col("inner")).alias("html"))


def render_table(cells: DataFrame, header: bool = True) -> DataFrame:
    """doc, sheet, html: rows of cells as a table, the first row in header cells."""
    first = F.min("row").over(Window.partitionBy("doc", "sheet"))
    tag = F.when(F.lit(header) & (F.col("row") == F.col("first")), "th").otherwise("td")
    cell = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("value")), F.lit("</"), tag, F.lit(">"))
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"]), "")
    rows = cells.withColumn("first", first).groupBy("doc", "sheet", "row").agg(F.concat(F.lit("<tr>"), ordered("col", cell), F.lit("</tr>")).alias("tr"))
    return rows.groupBy("doc", "sheet").agg(F.concat(F.lit("<table>"), ordered("row", F.col("tr")), F.lit("</table>")).alias("html"))


def _heading(title: str, headed: Column, number: Column) -> Column:
    """The heading of a chapter, empty where it is ``headed`` by itself."""
    named = F.coalesce(F.nullif(F.col(title), F.lit("")), F.concat(F.lit("Chapter "), number.cast("string")))
    return F.when(headed, "").otherwise(F.concat(F.lit("<h2>"), escape_html(named), F.lit("</h2>")))


def _headed(body: str) -> Column:
    return F.col(body).rlike("(?i)<h[1-6]")


def _chapter(title: str, body: str, number: Column) -> Column:
    """A chapter's body, under a heading where it has none of its own."""
    return F.concat(_heading(title, _headed(body), number), body)


def assemble_chapters(chapters: DataFrame, owner: str, order: str, title: str, body: str) -> DataFrame:
    """owner, chapters, body: non-empty chapters numbered by position, a heading where one is missing, rules between.

    One value holds a whole owner; ``assemble_in_parts`` is for owners of any size.
    """
    filled = chapters.where(strip(F.col(body)) != "").withColumn("n", F.row_number().over(Window.partitionBy(owner).orderBy(order)))
    part = F.struct("n", _chapter(title, body, F.col("n")).alias("html"))
    return filled.groupBy(owner).agg(F.count(F.lit(1)).alias("chapters"), F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["html"]), "<hr>").alias("body"))


def assemble_in_parts(chapters: DataFrame, owner: str, order: str, title: str, body: str, part_chars: int = 1 << 20) -> DataFrame:
    """owner, part, body: what ``assemble_chapters`` gives, cut into parts of ``part_chars`` characters (the last may be
    shorter); parts in order joined give it back.  A chapter is cut where parts meet, so no value is longer."""
    made = written(chapters.select(owner, order, title, F.col(body).alias("_body"), F.monotonically_increasing_id().alias("_id")))
    # places and lengths are found without the bodies, which join them once
    filled = written(made.where(strip(F.col("_body")) != "").select(owner, order, title, "_id", F.length("_body").alias("_chars"), _headed("_body").alias("_headed")))
    numbered = running_sums(filled, [owner], [order])
    head = F.concat(F.when(F.col("place") > 1, "<hr>").otherwise(""), _heading(title, F.col("_headed"), F.col("place")))
    placed = running_sums(numbered.select(owner, F.col("place").alias("n"), "_id", "_chars", head.alias("_head")), [owner], ["n"], before=F.length("_head") + F.col("_chars"))
    run = placed.select(owner, "n", "before", "_id", "_head").join(made.select("_id", "_body"), "_id").select(owner, "n", "before", F.concat("_head", "_body").alias("html"))
    first, last = F.floor(F.col("before") / part_chars), F.floor((F.col("before") + F.length("html") - 1) / part_chars)
    pieces = run.select(owner, "n", "before", "html", F.explode(F.sequence(first, last)).alias("part"))
    begin = F.greatest(F.col("part") * part_chars - F.col("before"), F.lit(0))
    end = (F.col("part") + 1) * part_chars - F.col("before")
    cut = pieces.select(owner, F.col("part").cast("long").alias("part"), F.struct("n", F.substr("html", (begin + 1).cast("int"), (end - begin).cast("int")).alias("html")).alias("piece"))
    return cut.groupBy(owner, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["html"]), "").alias("body"))


def dedup_paragraphs(paragraphs: DataFrame, doc: str, order: str, text: str, least: int = 2) -> DataFrame:
    """The first copy of each paragraph of a document, ``least`` characters or more."""
    clean = paragraphs.withColumn(text, strip(F.col(text))).where(F.length(text) >= least)
    return clean.groupBy(doc, text).agg(F.min(order).alias(order))


def page_index(names: DataFrame, doc: str, name: str) -> DataFrame:
    """0-based page numbers of image names in natural order."""
    by = Window.partitionBy(doc).orderBy(natural_sort_key(F.col(name)), name)
    return names.withColumn("page", F.row_number().over(by) - 1)


def distinct_hrefs(links: DataFrame, doc: str, href: str, order: str) -> DataFrame:
    return links.groupBy(doc, href).agg(F.min(order).alias(order))


def markdown_blocks(lines: DataFrame, doc: str = "doc_id", order: str = "pos", text: str = "line") -> DataFrame:
    """Lines typed as heading, list, quote, code, blank or text, with the number of their block.

    A fence toggles code; fence lines themselves are left out.  Blocks are stretches of one type; headings stand alone.
    """
    fence = F.when(F.col(text).rlike("^\\s*```"), 1).otherwise(0)
    run = lines.withColumn("_f", fence).withColumn("_in", F.sum("_f").over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) % 2)
    kind = (
        F.when(F.col("_in") == 1, "code").when(F.col(text).rlike("^#{1,6} "), "heading").when(F.col(text).rlike("^\\s*([-*+]|[0-9]+[.)]) "), "list")
        .when(F.col(text).startswith(">"), "quote").when(strip(F.col(text)) == "", "blank").otherwise("text")
    )
    typed = run.where("_f = 0").withColumn("kind", kind)
    own = F.when(F.col("kind") == "heading", F.concat(F.lit("h"), F.col(order).cast("string"))).otherwise(F.col("kind"))
    return islands(typed, doc, order, own).withColumnRenamed("run", "block").drop("_f", "_in")


def markdown_to_html(lines: DataFrame, doc: str = "doc_id", order: str = "pos", text: str = "line") -> DataFrame:
    """doc, title, body: rendered blocks in order; the title is the first heading (null without one)."""
    blocks = markdown_blocks(lines, doc, order, text).where("kind <> 'blank'")
    raw = F.col(text)
    bare = F.when(F.col("kind") == "heading", F.regexp_replace(raw, "^#+ +", "")).when(F.col("kind") == "list", F.regexp_replace(raw, "^\\s*([-*+]|[0-9]+[.)]) +", "")).when(F.col("kind") == "quote", F.regexp_replace(raw, "^> ?", "")).otherwise(raw)
    inline = markdown_inline(escape_html(bare))
    level = F.length(F.regexp_extract(raw, "^(#+)", 1)).cast("string")
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), inline, F.lit("</h"), level, F.lit(">")))
        .when(F.col("kind") == "list", F.concat(F.lit("<li>"), inline, F.lit("</li>"))).when(F.col("kind") == "code", F.concat(escape_html(raw), F.lit("\n"))).otherwise(inline)
    )
    made = blocks.withColumns({"_line": line, "_bare": bare})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_line").alias("l")))), lambda x: x["l"])
    each = made.groupBy(doc, "block", "kind").agg(F.array_join(ordered, "<br>").alias("with_breaks"), F.array_join(ordered, "").alias("plain"))
    html = (
        F.when(F.col("kind") == "heading", F.col("plain")).when(F.col("kind") == "list", F.concat(F.lit("<ul>"), "plain", F.lit("</ul>")))
        .when(F.col("kind") == "code", F.concat(F.lit("<pre><code>"), "plain", F.lit("</code></pre>"))).when(F.col("kind") == "quote", F.concat(F.lit("<blockquote>"), "with_breaks", F.lit("</blockquote>")))
        .otherwise(F.concat(F.lit("<p>"), "with_breaks", F.lit("</p>")))
    )
    bodies = each.select(doc, "block", html.alias("html")).groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "html"))), lambda x: x["html"]), "").alias("body"))
    titles = made.where("kind = 'heading'").groupBy(doc).agg(F.min_by("_bare", order).alias("title"))
    return bodies.join(titles, doc, "left").select(doc, "title", "body")
