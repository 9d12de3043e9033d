"""Column functions over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlake.functions import text as t
from readlake.operators.article import similarity_pairs
from readlake.plans import sql as d
from readlake.plans.registry import Registry, table

registry = Registry()
add = registry.add

_LINKS = r"""(?is)<a\b[^>]*href\s*=\s*['"]([^'"]*)['"][^>]*>"""


def _doc(expression, name: str, sql: str, column: str = "value"):
    """A query of one expression over ``documents.text``."""
    add(name, lambda spark, sf: table(spark, sf, "documents").select("doc_id", expression(F.col("text")).alias(column)), f"select doc_id, {sql} as {column} from documents")


def _page(expression, name: str, sql: str, column: str = "value"):
    add(name, lambda spark, sf: table(spark, sf, "pages").select("page_id", expression(F.col("html")).alias(column)), f"select page_id, {sql} as {column} from pages")


_doc(t.utf16_len, "utf16_len", r"cast(length(text) + len(regexp_extract_all(text, '[\x{10000}-\x{10FFFF}]')) as integer)")
_page(t.escape_html, "escape_html", d.escape("html"))
_page(t.escape_attr, "escape_attr", f"""replace(replace({d.escape("html")}, '"', '&quot;'), '''', '&#39;')""")
_page(t.unescape_entities, "unescape_entities", d.entities("html"))
_page(lambda h: t.unescape_numeric(F.concat(h, F.lit("&#65;&#x42;&#0;"))), "unescape_numeric", "replace(replace(html || '&#65;&#x42;&#0;', '&#65;', 'A'), '&#x42;', 'B')")
_doc(t.normalize_newlines, "normalize_newlines", d.newlines("text"))
_doc(
    lambda c: t.clean_control_chars(F.concat(F.lit("a\x07b\x0b\x13 F \x14r\x15\x01"), c)), "clean_control_chars",
    d.sub(f"replace('a' || chr(9) || 'b' || chr(10) || 'r' || {d.sub('text', chr(13), chr(10))}, chr(7), chr(9))", "\n{3,}", "\n\n"),
)
_doc(t.collapse_ws, "collapse_ws", d.collapse("text"))
_page(t.strip_containers, "strip_containers", d.without_containers("html"))
_page(t.visible_text, "visible_text", f"array_to_string({d.visible('html')}, chr(10))")
# the html is a column of its own, so that it is made once
add("trim_result", lambda s, sf: table(s, sf, "documents").select("doc_id", t.text_to_html(F.col("text")).alias("html")).select("doc_id", t.trim_result(F.col("html"), 500, "<p>…</p>").alias("value")), f"""select doc_id, (with h as (select coalesce(nullif(array_to_string(list_transform({d.paragraphs('text')}, lambda p: '<p>' || replace({d.escape('p')}, chr(10), '<br>') || '</p>'), ''), ''), '<p></p>') as b)
  select case when length(b) <= 500 then b else substr(b, 1, case when position('>' in reverse(substr(b, 1, 500))) between 1 and 50 then 501 - position('>' in reverse(substr(b, 1, 500))) else 500 end) || '<p>…</p>' end from h) as value from documents""")
_doc(t.text_to_html, "text_to_html", f"coalesce(nullif(array_to_string(list_transform({d.paragraphs('text')}, lambda p: '<p>' || replace({d.escape('p')}, chr(10), '<br>') || '</p>'), ''), ''), '<p></p>')")
_doc(lambda c: t.short_title(c, 24, "untitled"), "short_title", f"coalesce(nullif({d.strip('substr(text, 1, 24)')}, ''), 'untitled')")
_page(t.html_title, "html_title", f"nullif({d.collapse(d.entities(d.sub("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)", '(?s)<[^>]*>', '')))}, '')")


@add.query("title_from_first_line", f"""
with n as (select doc_id, {d.newlines("text")} as b from documents),
l as (select *, {d.strip("string_split(b, chr(10))[1]")} as line from n),
m as (select *, contains(b, chr(10)) and length(line) between 1 and 30 as has from l)
select doc_id, case when has then line end as title, case when has then {d.strip(d.sub("b", "^[^\n]*\n", "", ""))} else b end as body from m""")
def title_from_first_line(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", t.line_title(c).alias("title"), t.body_after_title(c).alias("body"))


@add.query("paragraphs", f"""
select doc_id, cast(i - 1 as integer) as pos, p[i] as text from (select doc_id, {d.paragraphs("text")} as p from documents), lateral (select unnest(range(1, len(p) + 1)) as i)""")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(t.paragraph_list(F.col("text"))).alias("pos", "text"))


@add.query("safe_href", f"""
select page_id, h as href, case when regexp_matches({d.strip("h")}, '(?i)^(https?:|mailto:|#)') then {d.strip("h")} else '' end as safe
from (select page_id, unnest(list_concat(regexp_extract_all(html, {d.quote(_LINKS)}, 1), ['javascript:x()', 'mailto:a@b.c', '#top', ' HTTPS://e.org'])) as h from pages)""")
def safe_href(spark: SparkSession, sf: str) -> DataFrame:
    more = F.array(*map(F.lit, ("javascript:x()", "mailto:a@b.c", "#top", " HTTPS://e.org")))
    links = F.explode(F.concat(F.regexp_extract_all("html", F.lit(_LINKS), 1), more)).alias("href")
    return table(spark, sf, "pages").select("page_id", links).withColumn("safe", t.safe_href(F.col("href")))


_MORE_LINKS = ("../up/./a%20b.html?x=1#y", "/root/../z/", "//other.org/q", "?only=query", "#top", "", "javascript:x()", "mailto:a@b.c", "..", "a/b/")


def _resolved(parts: str) -> str:
    """Path segments folded to a path, the oracle's way."""
    return f"list_reduce(list_prepend('', {parts}), lambda a, q: case when q in ('', '.') then a when q = '..' then regexp_replace(a, '/[^/]*$', '') else a || '/' || q end)"


@add.query("absolutize_urls", f"""
with l as (select page_id, url, unnest(h) as href, cast(unnest(range(0, len(h))) as integer) as pos from (select page_id, url, list_concat(regexp_extract_all(html, {d.quote(_LINKS)}, 1), [{", ".join(map(d.quote, _MORE_LINKS))}]) as h from pages)),
b as (select *, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) as host, '/' || regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/?([^?#]*)', 1) as path, regexp_replace(href, '[?#].*$', '') as own from l),
p as (select *, string_split(case when starts_with(own, '/') then own else regexp_replace(path, '[^/]*$', '') || own end, '/') as parts from b)
select page_id, pos, href, case when regexp_matches(href, '(?i)^\\s*javascript:') then '' when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then href when starts_with(href, '//') then regexp_extract(url, '^([a-zA-Z]+):', 1) || ':' || href
 when href = '' or starts_with(href, '#') then regexp_replace(url, '#.*$', '') || href when starts_with(href, '?') then host || path || href
 else host || {_resolved("parts")} || case when parts[len(parts)] in ('', '.', '..') then '/' else '' end || regexp_extract(href, '([?#].*)$', 1) end as absolute,
 ltrim({_resolved("string_split('a/b/../' || url_decode(own), '/')")}, '/') as path from p""")
def absolutize_urls(spark: SparkSession, sf: str) -> DataFrame:
    every = F.concat(F.regexp_extract_all("html", F.lit(_LINKS), 1), F.array(*map(F.lit, _MORE_LINKS)))
    links = table(spark, sf, "pages").select("page_id", "url", F.posexplode(every).alias("pos", "href"))
    return links.select("page_id", "pos", "href", t.absolutize(F.col("url"), F.col("href")).alias("absolute"), t.normalize_path(F.lit("a/b/c.html"), F.concat(F.lit("../"), "href")).alias("path"))


@add.query("clean_site_title", f"""
with p as (select page_id, {d.strip("t")} as own, h1 from (
  select page_id, {d.sub("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)", "(?s)<[^>]*>", "")} || case page_id % 3 when 0 then ' | Site Name Here' when 1 then ': part two of it' else '' end as t,
    list_transform(regexp_extract_all(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1), lambda x: {d.collapse(d.sub("x", "(?s)<[^>]*>", ""))}) as h1 from pages)),
q as (select *, {d.sub("own", r"(?s)(.*)[|\-\\/>»] .*", r"\1", "g")} as l, {d.sub("own", r"(?s)[^|\-\\/>»]*[|\-\\/>»](.*)", r"\1", "g")} as r,
  string_split(own, ':')[-1] as last, string_split(own, ':')[1] as head from p),
s as (select *, case when regexp_matches(own, ' [|\\-\\\\/>»] ') then case when {d.words("l")} < 3 then r else l end
  when contains(own, ': ') then case when list_contains(h1, own) then own when {d.words("last")} < 3 then substr(own, length(head) + 2) when {d.words("head")} > 5 then own else last end
  when (length(own) > 150 or length(own) < 15) and len(h1) = 1 then h1[1] else own end as picked0 from q),
u as (select *, {d.sub(d.strip("picked0"), d.WS + "{2,}", " ")} as picked from s)
select page_id, case when {d.words("picked")} <= 4 and (not regexp_matches(own, ' [\\\\/>»] ') or {d.words("picked")} <> {d.words(d.sub("own", r"[|\-\\/>»]+", ""))} - 1) then own else picked end as title from u""".replace("\\\\b", "\\b").replace("\\\\s", "\\s"))
def clean_site_title(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.when(F.col("page_id") % 3 == 0, " | Site Name Here").when(F.col("page_id") % 3 == 1, ": part two of it").otherwise("")
    tags_off = lambda c: F.regexp_replace(c, "(?s)<[^>]*>", "")
    title = F.concat(tags_off(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), ending)
    heads = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"), 1), lambda h: F.struct(F.lit("h1").alias("tag"), t.collapse_ws(tags_off(h)).alias("text")))
    return table(spark, sf, "pages").select("page_id", t.clean_site_title(title, heads).alias("title"))


@add.query("text_similarity", r"""
with p as (select a.doc_id, list_filter(regexp_split_to_array(lower(a.text), '[^0-9A-Za-z_]+'), lambda w: w <> '') as wa, list_filter(regexp_split_to_array(lower(b.text), '[^0-9A-Za-z_]+'), lambda w: w <> '') as wb
  from documents a join documents b on b.doc_id = a.doc_id + 1)
select doc_id, round(case when len(wa) = 0 or len(wb) = 0 then 0.0 else 1 - length(array_to_string(list_filter(wb, lambda w: not list_contains(wa, w)), ' ')) / length(array_to_string(wb, ' ')) end, 9) as similarity from p""")
def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return similarity_pairs(a.join(b, "doc_id"), "doc_id", "text", "other")


@add.query("quote_selection", f"""
select conv_id, turn, 'Explain' || chr(10) || chr(10) || array_to_string(list_transform(string_split({d.strip("text")}, chr(10)), lambda x: '> ' || x), chr(10)) as asked from conversations""")
def quote_selection(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", t.quote_selection(F.lit(" Explain "), F.col("text")).alias("asked"))


@add.query("natural_sort_key", """
with n as (select p_partkey, p_brand || ' ' || p_size || '.png' as name from part)
select p_partkey, name, array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]') then lpad(coalesce(nullif(ltrim(x, '0'), ''), '0'), 20, '0') else x end), '') as sort_key from n""")
def natural_sort_key(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit(".png"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).withColumn("sort_key", t.natural_sort_key(F.col("name")))


@add.query("cell_ref", """
with c as (select l_orderkey, l_linenumber, cast(l_partkey % 300 as integer) as col from lineitem),
r as (select *, case when col >= 26 then chr(cast(col // 26 - 1 + 65 as integer)) else '' end || chr(cast(col % 26 + 65 as integer)) || cast(l_linenumber + 1 as varchar) as ref from c)
select l_orderkey, l_linenumber, ref, col as col_index, l_linenumber as row_index from r""")
def cell_ref(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.cell_ref(F.col("l_linenumber"), (F.col("l_partkey") % 300).cast("int")).alias("ref"))
    return refs.withColumns({"col_index": t.column_index(F.col("ref")), "row_index": t.row_index(F.col("ref"))})


@add.query("format_size", """
select doc_id, case when b >= 1048576 then format('{:.1f}', round(b / 1048576, 1)) || 'MB' when b >= 1024 then cast(b // 1024 as varchar) || 'KB' else cast(b as varchar) || 'B' end as size
from (select doc_id, n_chars * 37 as b from documents)""")
def format_size(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.format_size(F.col("n_chars") * 37).alias("size"))


@add.query("format_time", "select event_id, month(ts) || '/' || day(ts) || ' ' || strftime(ts, '%H:%M') as shown from events")
def format_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "M/d HH:mm").alias("shown"))


@add.query("format_number", "select l_orderkey, l_linenumber, printf('%.15g', l_extendedprice) as price, printf('%.15g', l_quantity) as quantity from lineitem")
def format_number(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.format_number(F.col("l_extendedprice")).alias("price"), t.format_number(F.col("l_quantity")).alias("quantity"))


@add.query("markdown_inline", f"""
with s as (select conv_id, turn, '**' || split_part({d.escape("text")}, ' ', 1) || '** `x` *y* ![alt](z.png) [site](https://e.org/a) [bad](javascript:1) ' || {d.escape("text")} as m from conversations)
select conv_id, turn, {d.sub(d.sub(d.sub(d.sub(d.sub(d.sub(d.sub("m", "`([^`]+)`", r"<code>\1</code>"), r"!\[([^\]]*)\]\([^)]*\)", r"\1"), r"(?i)\[([^\]]+)\]\(((?:https?:|mailto:)[^)\s]+)\)", r'<a href="\2">\1</a>'), r"\[([^\]]+)\]\([^)]*\)", r"\1"), r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), "__([^_]+)__", r"<strong>\1</strong>"), r"\*([^*]+)\*", r"<em>\1</em>")} as html from s""")
def markdown_inline(spark: SparkSession, sf: str) -> DataFrame:
    safe = t.escape_html(F.col("text"))
    made = F.concat(F.lit("**"), F.substring_index(safe, " ", 1), F.lit("** `x` *y* ![alt](z.png) [site](https://e.org/a) [bad](javascript:1) "), safe)
    return table(spark, sf, "conversations").select("conv_id", "turn", t.markdown_inline(made).alias("html"))


# every other text becomes an address: inline pictures, pictures elsewhere, and a type that isn't a picture's
_SRC = "case doc_id % 3 when 0 then concat('data:image/PNG;base64,', {hex}(text)) when 1 then concat('https://', source, '.org/a.png') else concat('data:text/html;base64,', {hex}(text)) end"


@add.query("safe_image_src", f"select doc_id, case when doc_id % 3 = 0 and text <> '' then {_SRC.format(hex='hex')} else '' end as src from documents")
def safe_image_src(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.safe_image_src(F.expr(_SRC.format(hex="hex"))).alias("src"))


@add.query("normalize_path", """
select p_partkey, case p_partkey % 4 when 0 then 'OEBPS/' || b || '/' || p_name when 1 then p_name when 2 then b || '/a b.png' else 'OEBPS/text/' || b end as path from (select *, replace(p_brand, '#', '-') as b from part)""")
def normalize_path(spark: SparkSession, sf: str) -> DataFrame:
    target = "case p_partkey % 4 when 0 then concat('../', b, '/./', p_name, '#top') when 1 then concat('../../../', p_name) when 2 then concat('/', b, '/a%20b.png?x=../y') else concat(b, '/x/..') end"
    return table(spark, sf, "part").withColumn("b", F.replace("p_brand", F.lit("#"), F.lit("-"))).select("p_partkey", t.normalize_path(F.lit("OEBPS/text/a.xhtml"), F.expr(target)).alias("path"))
