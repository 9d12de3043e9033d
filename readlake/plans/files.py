"""The saved store and recognized pages, over the adapters."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlake.operators import rebuild, routing
from readlake.plans.registry import Registry, table
from readlake.scratch import new_folder
from readlake.sources import files

registry = Registry()
add = registry.add

_OCR = """select doc_id, case when doc_id % 9 = 0 then '{{broken' else to_json(named_struct('result', named_struct('layoutParsingResults', transform(slice(split(text, '\\n'), 1, 3), p -> named_struct('markdown', named_struct('text', p)))))) end as line from {documents}"""
_OCR_SQL = "(select doc_id, unnest(range(0, len(x))) as pos, trim(unnest(x)) as text from (select doc_id, string_split(text, chr(10))[1:3] as x from documents where doc_id % 9 <> 0))"


def _ocr(spark, sf):
    return spark.sql(_OCR, documents=table(spark, sf, "documents"))


add("scan_ocr_jsonl", lambda s, sf: files.scan_ocr_jsonl(_ocr(s, sf), "doc_id"), f"select doc_id, cast(pos as integer) as pos, text from {_OCR_SQL} where text <> ''")
add("ocr_text", lambda s, sf: files.ocr_text(_ocr(s, sf), "doc_id"), f"with p as (select doc_id, string_agg(text, chr(10) || chr(10) order by pos) as text from {_OCR_SQL} where text <> '' group by doc_id) select d.doc_id, coalesce(p.text, '') as text, case when p.text is null then 'empty' else 'ok' end as status from documents d left join p using (doc_id)")


def _saved(spark, sf):
    return table(spark, sf, "events").selectExpr("user_id as id", "concat('page_', event_id % 30, case when event_id % 7 = 0 then '.txt' else '.png' end) as name", "cast(value * 100 as long) as size")


add("list_saved", lambda s, sf: files.list_saved(_saved(s, sf), table(s, sf, "documents").where("doc_id % 3 <> 0").selectExpr("doc_id as id", "case when doc_id % 5 = 0 then '' else lang end as title", "n_chars as time")), "select id, coalesce(nullif(title, ''), 'untitled') as title, time, cast(size as bigint) as size from (select user_id as id, sum(cast(trunc(value * 100) as bigint)) as size from events group by 1) join (select doc_id as id, case when doc_id % 5 = 0 then '' else lang end as title, n_chars as time from documents where doc_id % 3 <> 0) using (id)")
add("saved_pages", lambda s, sf: files.saved_pages(_saved(s, sf)), "with p as (select distinct user_id as id, cast(event_id % 30 as integer) as page from events where event_id % 7 <> 0) select id, page, page = min(page) over (partition by id) as is_first from p")
add("html_frames", lambda s, sf: files.html_frames(table(s, sf, "documents").selectExpr("doc_id as id", "lang as title", "source as body")), """select '{"type":"html","id":"' || doc_id || '","title":"' || lang || '","body":"' || source || '"}' as json from documents""")
_XML = "concat('<w:document xmlns:w=\"urn:w\"><w:body>', array_join(transform(slice(split(regexp_replace(text, '[<>&]', ''), '\\n'), 1, 4), p -> concat('<w:p><w:t>', trim(p), 'x</w:t></w:p>')), ''), '</w:body></w:document>')"
add("xml_rows", lambda s, sf: rebuild.xml_rows(table(s, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("path"), F.expr(_XML).alias("xml")), "t"), "select doc_id as path, cast(unnest(range(0, len(x))) as integer) as pos, trim(unnest(x)) || 'x' as text from (select doc_id, string_split(regexp_replace(text, '[<>&]', '', 'g'), chr(10))[1:4] as x from documents where lang = 'en')")
_STYLE = "case pos % 4 when 0 then 'Heading ' || (1 + pos % 6) when 1 then 'Title' else 'Normal' end"


def _docx(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rebuild.docx_blocks(rows.withColumn("style", F.expr(_STYLE)))


add("docx_blocks", _docx, f"""with r as (select doc_id as doc, cast(unnest(range(0, len(x))) as integer) as pos, unnest(x) as text from (select doc_id, string_split(text, chr(10)) as x from documents)),
s as (select doc, pos, text, cast(case pos % 4 when 0 then 1 + pos % 6 when 1 then 1 else 0 end as integer) as level from r where trim(text) <> '')
select doc, pos, level, '<' || case when level > 0 then 'h' || level else 'p' end || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || case when level > 0 then 'h' || level else 'p' end || '>' as html from s""")
_SH = "select l_orderkey as doc, l_linenumber as pos, min(l_partkey) % 3 as n, case min(l_partkey) % 4 when 0 then 'title' when 1 then 'table' else 'text' end as kind, min(l_returnflag || l_linestatus) as text from {lineitem} group by l_orderkey, l_linenumber"


def _shapes(spark, sf):
    return rebuild.pptx_text(spark.sql(_SH, lineitem=table(spark, sf, "lineitem")))


add("pptx_text", _shapes, f"""
with s as ({_SH.format(lineitem='lineitem')}), h as (select doc, n, arg_min(struct_pack(pos := pos, text := text), (case kind when 'title' then 0 else 1 end, pos)) as h from s where kind <> 'table' group by doc, n)
select s.doc, cast(s.n as bigint) as n, any_value(h.h.text) as title, coalesce(string_agg(case when kind = 'table' then s.text else '<p>' || s.text || '</p>' end, '' order by kind = 'table', s.pos) filter (h.h is null or s.pos <> h.h.pos), '') as body
from s left join h using (doc, n) group by s.doc, s.n""")
_OCR_ALL = "(select doc_id, unnest(range(0, len(x))) as pos, trim(unnest(x)) as text from (select doc_id, string_split(text, chr(10)) as x from documents where doc_id % 9 <> 0))"
add("ocr_text_whole", lambda s, sf: files.ocr_text(s.sql(_OCR.replace("slice(split(text, '\\n'), 1, 3)", "split(text, '\\n')"), documents=table(s, sf, "documents")), "doc_id"), f"with p as (select doc_id, string_agg(text, chr(10) || chr(10) order by pos) as text from {_OCR_ALL} where text <> '' group by doc_id) select d.doc_id, coalesce(p.text, '') as text, case when p.text is null then 'empty' else 'ok' end as status from documents d left join p using (doc_id)")
add("list_saved_whole", lambda s, sf: files.list_saved(_saved(s, sf), table(s, sf, "documents").selectExpr("doc_id as id", "case when doc_id % 5 = 0 then '' else lang end as title", "n_chars as time")), "select id, coalesce(nullif(title, ''), 'untitled') as title, time, cast(size as bigint) as size from (select user_id as id, sum(cast(trunc(value * 100) as bigint)) as size from events group by 1) join (select doc_id as id, case when doc_id % 5 = 0 then '' else lang end as title, n_chars as time from documents) using (id)")
add("html_frames_whole", lambda s, sf: files.html_frames(table(s, sf, "documents").selectExpr("doc_id as id", "lang as title", "text as body")).select(F.get_json_object("json", "$.type").alias("type"), F.get_json_object("json", "$.id").alias("id"), F.get_json_object("json", "$.title").alias("title"), F.get_json_object("json", "$.body").alias("body")), "select 'html' as type, cast(doc_id as varchar) as id, lang as title, text as body from documents")
add("xlsx_sheets", lambda s, sf: rebuild.xlsx_sheets(table(s, sf, "orders").selectExpr("o_custkey as doc", "o_orderkey as ord", "concat('r', o_orderkey) as rid", "o_orderpriority as name"), table(s, sf, "orders").where("o_orderkey % 3 <> 0").selectExpr("o_custkey as doc", "concat('r', o_orderkey) as id", "concat(case when o_orderkey % 2 = 0 then '/xl/' else '' end, 'worksheets/s', o_orderkey, '.xml') as target")), "select o_custkey as doc, o_orderkey as ord, o_orderpriority as name, case when o_orderkey % 3 <> 0 then 'xl/worksheets/s' || o_orderkey || '.xml' else 'xl/worksheets/sheet' || o_orderkey || '.xml' end as entry from orders")


def _slides(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey")
    files_ = orders.select("doc", F.expr("concat('ppt/slides/slide', o_orderkey, '.xml')").alias("entry"))
    rels = orders.where("doc % 4 <> 0").select("doc", F.expr("concat('r', o_orderkey)").alias("id"), F.expr("concat('ppt/slides/slide', o_orderkey, '.xml')").alias("target"), F.expr("case when o_orderkey % 5 = 0 then 'External' end").alias("mode"))
    return rebuild.pptx_slides(orders.select("doc", F.expr("concat('r', o_orderkey)").alias("rid"), (-F.col("o_orderkey")).alias("ord")), rels, files_)


add("pptx_slides", _slides, """with f as (select o_custkey as doc, o_orderkey as k, 'ppt/slides/slide' || o_orderkey || '.xml' as entry from orders), l as (select doc, entry, -k as ord from f where doc % 4 <> 0 and k % 5 <> 0),
a as (select * from l union all select doc, entry, k from f where doc not in (select doc from l)) select doc, cast(row_number() over (partition by doc order by ord, entry) as integer) as n, entry from a""")

_CODED = """case doc_id % 4 when 0 then encode(text, 'UTF-8') when 1 then concat(X'EFBBBF', encode(text, 'UTF-8')) when 2 then concat(X'FFFE', encode(text, 'UTF-16LE')) else concat(X'C328', encode(text, 'UTF-8')) end"""
add("decode_text", lambda s, sf: files.decode_text(table(s, sf, "documents").select("doc_id", F.expr(_CODED).alias("content"))).select("doc_id", "text", "status"), "select doc_id, case when doc_id % 4 < 3 then text end as text, case when doc_id % 4 < 3 and text is not null then 'ok' else 'invalid' end as status from documents")
add("decode_declared", lambda s, sf: table(s, sf, "documents").select("doc_id", files.decode_declared(F.expr("case when doc_id % 3 = 0 then encode(text, 'UTF-16') else encode(text, 'UTF-8') end"), F.expr("case doc_id % 3 when 0 then ' UTF-16 ' when 1 then 'no-such-charset' end")).alias("text")), "select doc_id, text from documents")
# What an archive holds by which its format is known.
_MARKS = ("word/document.xml", "ppt/presentation.xml", "xl/workbook.xml", "META-INF/container.xml")


@F.pandas_udf(T.BinaryType())
def _zipped(ids: pd.Series, texts: pd.Series) -> pd.Series:
    """An archive of a text, its mark and, for every fifth, a rights file."""

    def one(k: int, text: str | None) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(_MARKS[k % 4], text or "")
            z.writestr("notes.bin", b"1234")
            if k % 5 == 0:
                z.writestr("META-INF/rights.xml", b"")
        return out.getvalue()

    return pd.Series([one(int(k), t) for k, t in zip(ids, texts, strict=True)])


def _archives(spark, sf) -> DataFrame:
    """path, content: an archive for each document, but plain text for every sixth and an old office file for the next."""
    docs = table(spark, sf, "documents")
    plain, old = F.encode("text", "UTF-8"), F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.encode("text", "UTF-8"))
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.expr("doc_id % 6").alias("k"), F.when(F.expr("doc_id % 6 = 4"), plain).when(F.expr("doc_id % 6 = 5"), old).otherwise(_zipped("doc_id", "text")).alias("content"))


def _entries(spark, sf) -> DataFrame:
    return files.scan_archive(_archives(spark, sf), r"[.]xml$")


_MARK = "case doc_id % 4 " + " ".join(f"when {k} then '{m}'" for k, m in enumerate(_MARKS)) + " end"
_HELD = f"""with z as (select * from documents where doc_id % 6 < 4), e as (
select cast(doc_id as varchar) as path, {_MARK} as entry, 0 as ord, cast(strlen(coalesce(text, '')) as bigint) as size, coalesce(text, '') as text from z
union all select cast(doc_id as varchar), 'notes.bin', 1, 4, null from z union all select cast(doc_id as varchar), 'META-INF/rights.xml', 2, 0, '' from z where doc_id % 5 = 0)"""
add("scan_archive", lambda s, sf: _entries(s, sf).select("path", "entry", "ord", "size", F.col("content").cast("string").alias("text"), "status"), f"{_HELD} select path, entry, cast(ord as integer) as ord, size, text, 'ok' as status from e union all select cast(doc_id as varchar), null, null, null, null, 'corrupt' from documents where doc_id % 6 >= 4")
add("sniff_format", lambda s, sf: files.sniff_format(_archives(s, sf), _entries(s, sf)), "select cast(doc_id as varchar) as path, case when doc_id % 6 = 4 then case when text <> '' then 'text' end when doc_id % 6 = 5 then case when text is not null then 'ole' end else case doc_id % 4 when 0 then 'docx' when 1 then 'pptx' when 2 then 'xlsx' else 'epub' end end as format from documents")


def _drm(spark, sf):
    locked = table(spark, sf, "documents").where("doc_id % 7 < 2").selectExpr("cast(doc_id as string) as path", "case doc_id % 7 when 0 then 'http://www.idpf.org/2008/embedding' else 'http://www.w3.org/2001/04/xmlenc#aes256-cbc' end as algorithm")
    return routing.drm_gate(_entries(spark, sf).where("status = 'ok'"), locked)


add("drm_gate", _drm, "select cast(doc_id as varchar) as path, doc_id % 5 = 0 or doc_id % 7 = 1 as drm from documents where doc_id % 6 < 4")


def _stored(spark, sf):
    folder = new_folder(spark)
    files.write_saved(table(spark, sf, "documents").selectExpr("lang as kind", "doc_id as id", "source as title", "n_chars as time", "text as body"), folder)
    return spark.read.parquet(folder).select("kind", "id", "title", "time", "body")


add("write_saved", _stored, "select lang as kind, doc_id as id, source as title, n_chars as time, text as body from documents")


def _read_back(spark, sf):
    """Frames written as text files of at most 10,000 lines, scanned as files and taken apart again."""
    folder = new_folder(spark)
    frames = files.html_frames(table(spark, sf, "pages").selectExpr("page_id as id", "url as title", "html as body"))
    frames.write.option("maxRecordsPerFile", 10_000).text(folder)
    lines = files.decode_text(files.scan_files(spark, f"{folder}/part-*")).where("status = 'ok'").select(F.explode(F.split("text", "\n")).alias("json")).where("json <> ''")
    field = lambda name: F.get_json_object("json", f"$.{name}").alias(name)
    return lines.select(field("id"), field("title"), field("body"))


add("scan_files", _read_back, "select cast(page_id as varchar) as id, url as title, html as body from pages")


def _sunk(spark, sf):
    """Pages as a stream of files into frames, read back."""
    folder, stream = new_folder(spark), new_folder(spark)
    pages = table(spark, sf, "pages")
    items = spark.readStream.schema(pages.schema).parquet(f"{sf}/pages.parquet*").selectExpr("page_id as id", "url as title", "html as body")
    files.sink_html(items, folder, stream).awaitTermination()
    return spark.read.text(folder).select(F.get_json_object("value", "$.id").alias("id"), F.length(F.get_json_object("value", "$.body")).alias("n_chars"))


add("sink_html", _sunk, "select cast(page_id as varchar) as id, cast(length(html) as integer) as n_chars from pages")
_ALL_LINES = _OCR.replace("slice(split(text, '\\n'), 1, 3)", "split(text, '\\n')")
add("scan_ocr_whole", lambda s, sf: files.scan_ocr_jsonl(s.sql(_ALL_LINES, documents=table(s, sf, "documents")), "doc_id"), f"select doc_id, cast(pos as integer) as pos, text from {_OCR_SQL.replace('[1:3]', '')} where text <> ''")
_WHOLE_XML = _XML.replace("slice(split(regexp_replace(text, '[<>&]', ''), '\\n'), 1, 4)", "split(regexp_replace(text, '[<>&]', ''), '\\n')")
add("xml_rows_whole", lambda s, sf: rebuild.xml_rows(table(s, sf, "documents").select(F.col("doc_id").alias("path"), F.expr(_WHOLE_XML).alias("xml")), "t"), "select doc_id as path, cast(unnest(range(0, len(x))) as integer) as pos, trim(unnest(x)) || 'x' as text from (select doc_id, string_split(regexp_replace(text, '[<>&]', '', 'g'), chr(10)) as x from documents)")
