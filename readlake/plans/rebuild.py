"""Documents put together again, over the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions.text import text_to_html
from readlake.operators import rebuild as r
from readlake.plans import sql as d
from readlake.plans.adapters import adapter, oracle
from readlake.plans.registry import Registry, table

registry = Registry()
add = registry.add

_MEDIA = "case when p_size % 4 = 0 then 'image/png' else 'application/xhtml+xml' end"


def _spine(spark, sf):
    parts, lines = table(spark, sf, "part"), table(spark, sf, "lineitem")
    refs = lines.selectExpr("l_orderkey as doc", "l_partkey as idref", "l_linenumber as ord")
    manifest = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey as doc", "p_partkey as id", "p_name as href", f"{_MEDIA} as media", "l_linenumber + 100 as ord").dropDuplicates(["doc", "id", "ord"])
    return r.epub_spine(manifest.groupBy("doc", "id").agg(F.min_by(F.struct("href", "media", "ord"), "ord").alias("m")).select("doc", "id", "m.*"), refs.where("doc % 5 <> 0"))


add("epub_spine", _spine, f"""
with m as (select l_orderkey as doc, p_partkey as id, min(p_name) as href, min({_MEDIA}) as media, min(l_linenumber + 100) as ord from lineitem join part on l_partkey = p_partkey group by all),
p as (select * from m where media <> 'image/png'),
rd as (select l_orderkey as doc, l_partkey as id, l_linenumber as at_, href from lineitem join p on p.doc = l_orderkey and p.id = l_partkey where l_orderkey % 5 <> 0),
ev as (select doc, id, at_, href from rd union all select doc, id, ord, href from p where doc not in (select doc from rd))
select doc, cast(row_number() over (partition by doc order by at_, id, href) as integer) as n, href from ev""")
_KINDS = {"A": "shared", "N": "plain", "R": "boolean"}
add("xlsx_cells", lambda s, sf: r.xlsx_cells(adapter(s, sf, "cells"), table(s, sf, "part").selectExpr("p_partkey as idx", "p_name as text"), _KINDS).select("doc", "sheet", "row", "col", "shown"), oracle("cells") + """
select doc, sheet, row, col, case type when 'A' then p_name when 'R' then case when value = '1' then 'TRUE' else 'FALSE' end else value end as shown from cells left join part on p_partkey = idx where coalesce(trim(case type when 'A' then p_name when 'R' then 'x' else value end), '') <> ''""")
add("fill_grid", lambda s, sf: r.fill_grid(adapter(s, sf, "cells").where("doc % 10 = 0").withColumn("sheet", F.lit(1)).withColumn("row", F.lit(0))), oracle("cells") + """
, i as (select doc, 1 as sheet, 0 as row, col, min(value) as value from cells where doc % 10 = 0 and col < 256 group by all), s as (select doc, min(col) as lo, max(col) as hi from i group by doc),
e as (select doc, unnest(range(lo, hi + 1)) as col from s) select e.doc, 1 as sheet, 0 as row, cast(e.col as integer) as col, coalesce(value, '') as value from e left join i on i.doc = e.doc and i.col = e.col""")
add("fill_grid_whole", lambda s, sf: r.fill_grid(adapter(s, sf, "cells").withColumn("row", F.col("row") % 4)), oracle("cells") + """
, i as (select doc, sheet, row % 4 as row, col, min(value) as value from cells where col < 256 group by all), s as (select doc, sheet, row, min(col) as lo, max(col) as hi from i group by all),
e as (select doc, sheet, row, unnest(range(lo, hi + 1)) as col from s) select e.doc, e.sheet, e.row, cast(e.col as integer) as col, coalesce(value, '') as value from e left join i on i.doc = e.doc and i.sheet = e.sheet and i.row = e.row and i.col = e.col""")
add("clamp_range", lambda s, sf: r.clamp_range(adapter(s, sf, "cells"), 30, 200).select("doc", "sheet", "row", "col", "truncated"), oracle("cells") + "select doc, sheet, row, col, truncated from (select *, bool_or(row >= 30 or col >= 200) over (partition by doc, sheet) as truncated from cells) where row < 30 and col < 200")
_TC = "sheet, row, col, idx"
add("take_cells", lambda s, sf: r.take_cells(adapter(s, sf, "cells").withColumn("doc", F.col("doc") % 50), _TC.split(", "), 500, 700, 1).select("doc", *_TC.split(", "), "value"), oracle("cells") + f"""
, c as (select doc % 50 as doc, {_TC}, substr(value, 1, 1) as value from cells), w as (select *, row_number() over o as place, coalesce(sum(length(value)) over (partition by doc order by {_TC} rows between unbounded preceding and 1 preceding), 0) as b from c window o as (partition by doc order by {_TC}))
select doc, {_TC}, substr(value, 1, cast(700 - b as bigint)) as value from w where place <= 500 and b < 700""")
add("take_cells_whole", lambda s, sf: r.take_cells(adapter(s, sf, "cells").selectExpr("idx % 97 as doc", "doc as sheet", "sheet as row", "col", "idx", "value"), ["sheet", "row", "col", "idx"], 400, 700).select("doc", "sheet", "row", "col", "idx", "value"), oracle("cells") + """
, c as (select idx % 97 as doc, doc as sheet, sheet as row, col, idx, value from cells), w as (select *, row_number() over o as place, coalesce(sum(length(value)) over (partition by doc order by sheet, row, col, idx rows between unbounded preceding and 1 preceding), 0) as b from c window o as (partition by doc order by sheet, row, col, idx))
select doc, sheet, row, col, idx, substr(value, 1, cast(700 - b as bigint)) as value from w where place <= 400 and b < 700""")


def _parts(spark, sf):
    return table(spark, sf, "documents").select("source", "doc_id", F.substring("text", 1, 400).alias("part"))


_PARTS = "select source, doc_id, substr(text, 1, 400) as part, sum(length(substr(text, 1, 400))) over (partition by source order by doc_id) as through from documents"
add("running_budget", lambda s, sf: r.running_budget(_parts(s, sf), "source", "doc_id", "part", 3000), f"select source, doc_id, substr(part, 1, cast(3000 - through + length(part) as bigint)) as part, through > 3000 as truncated from ({_PARTS}) where through - length(part) < 3000 or through = 0")
add("running_budget_drop", lambda s, sf: r.running_budget(_parts(s, sf), "source", "doc_id", "part", 3000, "drop"), f"select source, doc_id, part from ({_PARTS}) where through <= 3000")
add("running_budget_fail", lambda s, sf: r.running_budget(_parts(s, sf), "source", "doc_id", "part", 19_500, "fail"), f"select source, doc_id, part from (select *, max(through) over (partition by source) as m from ({_PARTS})) where m <= 19500")
_WHOLE = "(select source, doc_id, text as part, coalesce(sum(length(text)) over (partition by source order by doc_id), 0) as through from documents)"
_all_parts = lambda s, sf: table(s, sf, "documents").select("source", "doc_id", F.col("text").alias("part"))
add("running_budget_whole", lambda s, sf: r.running_budget(_all_parts(s, sf), "source", "doc_id", "part", 40_000), f"select source, doc_id, substr(part, 1, cast(40000 - through + length(part) as bigint)) as part, through > 40000 as truncated from {_WHOLE} where through - length(part) < 40000 or through = 0")
add("running_budget_whole_drop", lambda s, sf: r.running_budget(_all_parts(s, sf), "source", "doc_id", "part", 40_000, "drop"), f"select source, doc_id, part from {_WHOLE} where through <= 40000")
add("running_budget_whole_fail", lambda s, sf: r.running_budget(table(s, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "part")), "doc_id", "pos", "part", 2_000, "fail").select("doc_id", F.col("pos").cast("long").alias("pos"), "part"), "with l as (select doc_id, i - 1 as pos, x[i] as part from (select doc_id, string_split(text, chr(10)) as x from documents), lateral (select unnest(range(1, len(x) + 1)) as i)) select doc_id, pos, part from (select *, sum(length(part)) over (partition by doc_id) as m from l) where m <= 2000")


def _lines(spark, sf, mapped="regexp_replace(line, ', ', '\t')"):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.expr(mapped))


_LINES = "l as (select doc_id, i - 1 as pos, x[i] as line from (select doc_id, string_split(text, chr(10)) as x from documents), lateral (select unnest(range(1, len(x) + 1)) as i))"
add("text_tables", lambda s, sf: r.text_tables(_lines(s, sf)), f"""
with {_LINES}, t as (select doc_id, pos, replace(line, ', ', chr(9)) as line from l where {d.strip("replace(line, ', ', chr(9))")} <> ''),
k as (select *, case when contains(line, chr(9)) then 't' else cast(pos as varchar) end as k from t),
c as (select *, case when lag(k) over (partition by doc_id order by pos) is not distinct from k then 0 else 1 end as n from k),
g as (select *, sum(n) over (partition by doc_id order by pos) as run from c)
select doc_id, cast(run as bigint) as run, case when bool_or(contains(line, chr(9))) then 'table' else 'p' end as kind,
 case when bool_or(contains(line, chr(9))) then '<table>' || string_agg('<tr>' || array_to_string(list_transform(string_split({d.escape("line")}, chr(9)), lambda q: '<td>' || {d.strip("q")} || '</td>'), '') || '</tr>', '' order by pos) || '</table>' else string_agg('<p>' || {d.strip(d.escape("line"))} || '</p>', '' order by pos) end as html from g group by doc_id, run""")
add("render_table", lambda s, sf: r.render_table(adapter(s, sf, "cells").where("doc % 20 = 0").select("doc", "sheet", "row", F.struct("col", "idx").alias("col"), "value")), oracle("cells") + """
, c as (select *, min(row) over (partition by doc, sheet) as f from cells where doc % 20 = 0),
t as (select doc, sheet, row, '<tr>' || string_agg(case when row = f then '<th>' || value || '</th>' else '<td>' || value || '</td>' end, '' order by col, idx) || '</tr>' as tr from c group by doc, sheet, row)
select doc, sheet, '<table>' || string_agg(tr, '' order by row) || '</table>' as html from t group by doc, sheet""")
add("assemble_chapters", lambda s, sf: r.assemble_chapters(table(s, sf, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.substring("lang", 1, 2)).alias("title"), text_to_html(F.substring("text", 1, 120)).alias("body")), "source", "doc_id", "title", "body"), f"""
with p as (select source, doc_id, case when doc_id % 3 = 0 then '' else lang end as title, coalesce(nullif(array_to_string(list_transform({d.paragraphs("substr(text, 1, 120)")}, lambda q: '<p>' || replace({d.escape("q")}, chr(10), '<br>') || '</p>'), ''), ''), '<p></p>') as body from documents),
n as (select *, row_number() over (partition by source order by doc_id) as n from p)
select source, count(*) as chapters, string_agg('<h2>' || coalesce(nullif(title, ''), 'Chapter ' || n) || '</h2>' || body, '<hr>' order by n) as body from n group by source""")
add("render_table_whole", lambda s, sf: r.render_table(adapter(s, sf, "cells").select("doc", "sheet", "row", F.struct("col", "idx").alias("col"), "value")), oracle("cells") + """
, c as (select *, min(row) over (partition by doc, sheet) as f from cells),
t as (select doc, sheet, row, '<tr>' || string_agg(case when row = f then '<th>' || value || '</th>' else '<td>' || value || '</td>' end, '' order by col, idx, value || '</') || '</tr>' as tr from c group by doc, sheet, row)
select doc, sheet, '<table>' || string_agg(tr, '' order by row) || '</table>' as html from t group by doc, sheet""")
add("assemble_in_parts", lambda s, sf: r.assemble_in_parts(table(s, sf, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("title"), text_to_html(F.col("text")).alias("body")), "source", "doc_id", "title", "body", 5_000), f"""
with p as (select source, doc_id, case when doc_id % 3 = 0 then '' else lang end as title, coalesce(nullif(array_to_string(list_transform({d.paragraphs("text")}, lambda q: '<p>' || replace({d.escape("q")}, chr(10), '<br>') || '</p>'), ''), ''), '<p></p>') as body from documents),
n as (select *, row_number() over (partition by source order by doc_id) as n from p),
w as (select source, string_agg('<h2>' || coalesce(nullif(title, ''), 'Chapter ' || n) || '</h2>' || body, '<hr>' order by n) as whole from n group by source)
select source, part, substr(whole, cast(part * 5000 + 1 as bigint), 5000) as body from (select source, whole, unnest(range(0, (length(whole) + 4999) // 5000)) as part from w)""")
add("dedup_paragraphs", lambda s, sf: r.dedup_paragraphs(_lines(s, sf, "line"), "doc_id", "pos", "line").select("doc_id", "line", F.col("pos").cast("long").alias("pos")), f"with {_LINES}, t as (select doc_id, pos, {d.strip('line')} as line from l) select doc_id, line, min(pos) as pos from t where length(line) >= 2 group by doc_id, line")
_NM = "p_brand || ' ' || p_size || '.png'"
_NKEY = "array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda x: case when regexp_matches(x, '^[0-9]') then lpad(coalesce(nullif(ltrim(x, '0'), ''), '0'), 20, '0') else x end), '')"
add("page_index", lambda s, sf: r.page_index(table(s, sf, "part").selectExpr("p_type as doc", f"{_NM} as name").distinct(), "doc", "name"), f"select doc, name, cast(row_number() over (partition by doc order by {_NKEY}, name) - 1 as integer) as page from (select distinct p_type as doc, {_NM} as name from part)")
_HREF = r"""(?is)<a\b[^>]*href\s*=\s*['"]([^'"]*)['"][^>]*>"""
add("distinct_hrefs", lambda s, sf: r.distinct_hrefs(table(s, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("pos", "href")), "page_id", "href", "pos"), f"select page_id, href, cast(min(i) - 1 as integer) as pos from (select page_id, unnest(range(1, len(x) + 1)) as i, unnest(x) as href from (select page_id, regexp_extract_all(html, {d.quote(_HREF)}, 1) as x from pages)) group by page_id, href")
_MARK = "case pos % 6 when 0 then '# ' || line when 1 then '- ' || line when 2 then '> ' || line when 3 then '```' else line end"
_BLOCKS = f"""with {_LINES}, m as (select doc_id, pos, {_MARK} as line from l),
f as (select *, case when starts_with(line, '```') then 1 else 0 end as f from m), n as (select *, sum(f) over (partition by doc_id order by pos) % 2 as code from f),
k as (select *, case when code = 1 then 'code' when regexp_matches(line, '^#{{1,6}} ') then 'heading' when regexp_matches(line, '^\\s*([-*+]|[0-9]+[.)]) ') then 'list' when starts_with(line, '>') then 'quote' when {d.strip("line")} = '' then 'blank' else 'text' end as kind from n where f = 0),
c as (select *, case when kind <> 'heading' and lag(kind) over (partition by doc_id order by pos) is not distinct from kind then 0 else 1 end as new from k),
b as (select *, sum(new) over (partition by doc_id order by pos) as block from c) """
add("markdown_blocks", lambda s, sf: r.markdown_blocks(_lines(s, sf, _MARK)).select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", "block"), _BLOCKS + "select doc_id, pos, kind, cast(block as bigint) as block from b")
_INL = d.sub(d.sub(d.sub(d.escape("bare"), "`([^`]+)`", r"<code>\1</code>"), r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), r"\*([^*]+)\*", r"<em>\1</em>")
add("markdown_to_html", lambda s, sf: r.markdown_to_html(_lines(s, sf, _MARK)), _BLOCKS + f""", r as (select *, case kind when 'heading' then regexp_replace(line, '^#+ +', '') when 'list' then regexp_replace(line, '^\\s*([-*+]|[0-9]+[.)]) +', '') when 'quote' then regexp_replace(line, '^> ?', '') else line end as bare from b where kind <> 'blank'),
h as (select *, case kind when 'heading' then '<h1>' || {_INL} || '</h1>' when 'list' then '<li>' || {_INL} || '</li>' when 'code' then {d.escape("line")} || chr(10) else {_INL} end as h from r),
g as (select doc_id, block, kind, string_agg(h, '' order by pos) as p, string_agg(h, '<br>' order by pos) as w from h group by all),
x as (select doc_id, string_agg(case kind when 'heading' then p when 'list' then '<ul>' || p || '</ul>' when 'code' then '<pre><code>' || p || '</code></pre>' when 'quote' then '<blockquote>' || w || '</blockquote>' else '<p>' || w || '</p>' end, '' order by block) as body from g group by doc_id)
select x.doc_id, t.title, x.body from x left join (select doc_id, arg_min(bare, pos) as title from r where kind = 'heading' group by doc_id) t using (doc_id)""")
