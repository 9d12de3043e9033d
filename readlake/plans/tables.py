"""Routing, gates, registries and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions.text import file_ext, file_stem
from readlake.operators import chat, routing
from readlake.operators import registry as reg
from readlake.plans import sql as d
from readlake.plans.adapters import adapter, oracle
from readlake.plans.registry import Registry, table

registry = Registry()
add = registry.add

_EXT = "lower(regexp_extract(regexp_replace(%s, '[?#].*$', ''), '\\.([A-Za-z0-9]{1,10})$', 1))"
_FMT = "case %s " + " ".join(f"when '{k}' then '{v}'" for k, v in routing.FORMATS.items()) + " end"
_MIME = "case lower(trim(split_part(coalesce(mime, ''), ';', 1))) " + " ".join(f"when '{k}' then '{v}'" for k, v in routing.MIME_FORMATS.items()) + " end"
_DETECT = f"coalesce({_FMT % (_EXT % 'name')}, {_FMT % (_EXT % 'uri')}, {_FMT % (_EXT % 'url_decode(uri)')}, {_MIME}, case when starts_with(mime, 'text/') then 'text' end)"
_READABLE = f"({_FMT % (_EXT % 'name')} is not null or {_MIME} is not null or starts_with(mime, 'text/'))"

add("scan_pages", lambda s, sf: routing.keep_pages(table(s, sf, "pages")).select("page_id", F.octet_length("html").cast("long").alias("bytes")), "select page_id, cast(strlen(html) as bigint) as bytes from pages where (starts_with(url, 'http://') or starts_with(url, 'https://')) and strlen(html) <= 5242880")
add("file_ext", lambda s, sf: adapter(s, sf, "files").select("file_id", file_ext(F.col("uri")).alias("ext")), oracle("files") + f"select file_id, {_EXT % 'uri'} as ext from files")
add("file_stem", lambda s, sf: adapter(s, sf, "files").select("file_id", file_stem(F.col("name")).alias("stem")), oracle("files") + "select file_id, coalesce(nullif(trim(regexp_replace(name, '\\.[^./\\\\]+$', '')), ''), 'untitled') as stem from files")
add("detect_format", lambda s, sf: adapter(s, sf, "files").select("file_id", routing.detect_format(F.col("name"), F.col("mime"), F.col("uri")).alias("format")), oracle("files") + f"select file_id, {_DETECT} as format from files")
add("is_readable", lambda s, sf: adapter(s, sf, "files").select("file_id", routing.is_readable(F.col("name"), F.col("mime")).alias("web"), routing.is_readable(F.col("name"), F.col("mime"), F.col("uri"), "android").alias("android")), oracle("files") + f"select file_id, {_READABLE} as web, ({_DETECT} is not null or mime = 'application/octet-stream') as android from files")


def _routes(spark, sf):
    files = adapter(spark, sf, "files")
    return files.select("file_id", *(routing.route_item(F.col("name"), F.col("mime"), F.col("uri"), p).alias(p) for p in ("web", "android")))


_E = _EXT % "name"
_ROUTE_SQL = oracle("files") + f"""select file_id, case when {_READABLE} then 'readable' when starts_with(mime, 'image/') then 'image' when mime = 'application/pdf' or {_E} = 'pdf' then 'pdf' else 'unsupported' end as web,
  case when starts_with(mime, 'image/') then 'image' when {_E} in ('cbz', 'cbr', 'rar') or {_E} = 'zip' and mime <> 'application/pdf' then 'comic' when mime = 'application/pdf' or {_E} = 'pdf' then 'pdf'
  when {_DETECT} is not null or mime = 'application/octet-stream' then 'readable' else 'unsupported' end as android from files"""
add("route_item", _routes, _ROUTE_SQL)
add("route_counts", lambda s, sf: _routes(s, sf).groupBy(F.col("web").alias("channel")).agg(F.count(F.lit(1)).alias("n")), f"select web as channel, count(*) as n from ({_ROUTE_SQL}) group by web")
add("is_url", lambda s, sf: table(s, sf, "pages").select("page_id", routing.is_url(F.concat("url", F.when(F.col("page_id") % 2 == 0, " x").otherwise(""))).alias("web"), routing.is_url(F.col("url"), "android").alias("android")), "select page_id, regexp_matches(url || case when page_id % 2 = 0 then ' x' else '' end, '^https?://\\S+$') as web, starts_with(url, 'http://') or starts_with(url, 'https://') as android from pages")
add("size_gate", lambda s, sf: adapter(s, sf, "files").select("file_id", *(routing.size_gate(F.col("size"), p).alias(p) for p in routing.SIZE_LIMITS)), oracle("files") + "select file_id, " + ", ".join(f"case when size > {v} then 'too-large' else 'ok' end as {k}" for k, v in routing.SIZE_LIMITS.items()) + " from files")


def _entries(spark, sf):
    cells = adapter(spark, sf, "cells")
    return cells.select(F.col("doc").alias("path"), (F.col("idx") * 20_000 - 1000).alias("size"), F.when(F.col("idx") % 97 == 0, 1).otherwise(0).alias("flags"), F.when(F.col("idx") % 53 == 0, 99).otherwise(8).alias("method"))


_PRE = oracle("cells") + """, e as (select doc as path, idx * 20000 - 1000 as size, case when idx % 97 = 0 then 1 else 0 end as flags, case when idx % 53 = 0 then 99 else 8 end as method from cells),
s as (select path, count(*) as entries, cast(sum(size) as bigint) as total, max(size) as largest, bool_or(size < 0) as bad, bool_or(flags % 2 = 1) as locked, bool_or(method not in (0, 8)) as odd from e group by path)
select path, entries, total, case when bad then 'corrupt' when entries > 12000 or largest > 33554432 or total > 230686720 then 'too-large' when locked then 'encrypted' when odd then 'unsupported' else 'ok' end as status from s"""
add("archive_preflight", lambda s, sf: routing.archive_preflight(_entries(s, sf)), _PRE)
add("quarantine", lambda s, sf: routing.quarantine(routing.archive_preflight(_entries(s, sf)))[2], f"select status, count(*) as n from ({_PRE}) group by status")
add("quarantine_failed", lambda s, sf: routing.quarantine(routing.archive_preflight(_entries(s, sf)))[1].select("path", "status"), f"select path, status from ({_PRE}) where status <> 'ok'")
_LEN16 = r"(length(body) + len(regexp_extract_all(body, '[\x{10000}-\x{10FFFF}]')))"
add("history_eligible", lambda s, sf: routing.history_eligible(adapter(s, sf, "items"), most=4000).select("owner", "id"), oracle("items") + f"select owner, id from items where {_LEN16} <= 4000")
add("oversize_frames", lambda s, sf: routing.oversize_frames(adapter(s, sf, "items"), max_bytes=20_000, max_units=15_000).select("id", "title"), oracle("items") + f"select cast(id as varchar) as id, title from items where strlen(body) <= 20000 and {_LEN16} <= 15000")
add("new_clips", lambda s, sf: routing.new_clips(adapter(s, sf, "items")).select("owner", "id", "title"), oracle("items") + ", l as (select *, lag(title) over (partition by owner order by id) as b from items where length(title) >= 6) select owner, id, title from l where b is distinct from title")
add("drop_unknown_types", lambda s, sf: routing.drop_unknown_types(adapter(s, sf, "frames").withColumn("type", F.when(F.col("k") == 3, "future").otherwise(F.col("type")))).groupBy("type").agg(F.count(F.lit(1)).alias("n")), oracle("frames") + "select type, count(*) as n from frames where k <> 3 group by type")
_NAMES = "case when p_partkey % 7 = 0 then '__MACOSX/' when p_partkey % 5 = 0 then 'a/.' else 'a/' end || p_brand || case when p_partkey % 3 = 0 then '.txt' else '.PNG' end"
add("image_entries", lambda s, sf: routing.image_entries(table(s, sf, "part").select("p_partkey", F.expr(_NAMES).alias("entry"))), f"select * from (select p_partkey, {_NAMES} as entry from part) where p_partkey % 7 <> 0 and p_partkey % 5 <> 0 and p_partkey % 3 <> 0")

_TOP = "row_number() over (partition by {0} order by {1} desc, {2} desc)"
add("recent_n", lambda s, sf: reg.recent_n(table(s, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 10), f"select * from (select user_id, ts, event_id, cast({_TOP.format('user_id', 'ts', 'event_id')} as integer) as place from events) where place <= 10")
_DEV = "event_id, user_id % 40 as host, user_id % 7 as port, value, ts"
add("upsert_device", lambda s, sf: reg.recent_n(reg.latest(table(s, sf, "events").where("event_type in ('signup', 'purchase')").selectExpr(*_DEV.split(", ")), ["port", "host"], ["ts", "event_id"]), "port", "ts", "event_id", 10).drop("value"), f"""
with d as (select {_DEV} from events where event_type in ('signup', 'purchase')), l as (select port, host, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from d group by all)
select * from (select port, host, ts, event_id, cast({_TOP.format('port', 'ts', 'event_id')} as integer) as place from l) where place <= 10""")
_BOOK = """, p as (select *, last_value(nullif(page, 0) ignore nulls) over (partition by owner, uri order by time, seq rows between unbounded preceding and unbounded following) as pg,
  row_number() over (partition by owner, uri order by time desc, seq desc) as rn from books),
up as (select * from (select owner, uri, time, seq, coalesce(pg, 0) as page, total, cast(row_number() over (partition by owner order by time desc, seq desc) as integer) as place from p where rn = 1) where place <= 20)"""
add("upsert_book", lambda s, sf: reg.upsert_books(adapter(s, sf, "books")), oracle("books") + _BOOK + "select * from up")
add("book_progress", lambda s, sf: reg.book_progress(reg.upsert_books(adapter(s, sf, "books")), adapter(s, sf, "books").where("seq % 3 = 0").withColumn("page", F.col("page") * 3 - 20)), oracle("books") + _BOOK + """,
m as (select owner, uri, arg_max(page * 3 - 20, (time, seq)) as moved, max(time) as mt from books where seq % 3 = 0 group by all)
select owner, uri, total, greatest(least(coalesce(moved, page), total - 1), 0) as page, coalesce(mt, time) as time from up left join m using (owner, uri)""")
_CUT = "timestamp '2024-01-30 12:00:00'"
add("merge_devices", lambda s, sf: reg.merge_devices(table(s, sf, "events").where(f"event_type = 'click' and ts > {_CUT}").selectExpr("user_id as host"), table(s, sf, "events").where("event_type in ('signup', 'purchase')").selectExpr("user_id as host")), f"""
with f as (select distinct user_id as host from events where event_type = 'click' and ts > {_CUT}), s as (select distinct user_id as host from events where event_type in ('signup', 'purchase'))
select host, true as online from f union all select host, false from s where host not in (select host from f)""")
add("orphan_files", lambda s, sf: reg.orphan_files(adapter(s, sf, "books").selectExpr("concat(owner, '-', uri) as file"), reg.upsert_books(adapter(s, sf, "books"), 5).selectExpr("concat(owner, '-', uri) as file"), "file"), oracle("books") + _BOOK + "select distinct owner || '-' || uri as file from books except select owner || '-' || uri from up where place <= 5")
add("inbox_fifo", lambda s, sf: reg.inbox_fifo(table(s, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 30), f"select user_id, ts, event_id, {_TOP.format('user_id', 'ts', 'event_id')} <= 30 as kept from events")
add("acknowledge", lambda s, sf: reg.acknowledge(table(s, sf, "events").select("event_id", "user_id"), table(s, sf, "events").where("event_type = 'view'").select("event_id"), "event_id"), "select event_id, user_id from events where event_type <> 'view'")
add("uniqued", lambda s, sf: reg.uniqued(table(s, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"]), "select user_id, event_type, min(event_id) as event_id, arg_min(value, event_id) as value from events group by all")
add("recast", lambda s, sf: reg.recast(adapter(s, sf, "items"), "owner", 2, "untitled").select("owner", "id", "title"), oracle("items") + f"select owner, id, case when title = 'untitled' then '' else title end as title from (select *, {_TOP.format('owner', 'ts', 'id')} as place from items) where place = 3")
add("active_config", lambda s, sf: reg.active_config(table(s, sf, "customer").selectExpr("c_nationkey as owner", "c_custkey as id", "c_acctbal > 5000 as has_key"), table(s, sf, "nation").selectExpr("n_nationkey as owner", "cast(n_nationkey * 7 as bigint) as id"), "owner"), """
with c as (select c_nationkey as owner, c_custkey as id, c_acctbal > 5000 as has_key, c_nationkey * 7 as wish from customer where c_nationkey in (select n_nationkey from nation))
select owner, arg_min(id, (case when id = wish then 0 else 1 end, id)) as id from (select * from c union all select c_nationkey, c_custkey, c_acctbal > 5000, null from customer where c_nationkey not in (select n_nationkey from nation)) where id = wish or has_key group by owner""")


def _defaults(spark, sf):
    stored = table(spark, sf, "events").where("event_type <> 'error'").groupBy(F.col("user_id").alias("owner"), F.col("event_type").alias("name")).agg(F.max_by("value", "event_id").alias("value"))
    names = spark.createDataFrame([("view", 16.0, 8.0, 64.0), ("click", 1.5, 1.0, 400.0), ("margin", 24.0, 0.0, 120.0)], "name string, value double, low double, high double")
    return reg.with_defaults(stored, names)


add("with_defaults", _defaults, """
with d(name, def, low, high) as (values ('view', 16.0, 8.0, 64.0), ('click', 1.5, 1.0, 400.0), ('margin', 24.0, 0.0, 120.0)),
s as (select user_id as owner, event_type as name, arg_max(value, event_id) as value from events where event_type <> 'error' group by all)
select o.owner, d.name, cast(greatest(least(coalesce(s.value, d.def), d.high), d.low) as double) as value from (select distinct owner from s) o cross join d left join s on s.owner = o.owner and s.name = d.name""")

_C = "conversations"
add("chat_context", lambda s, sf: chat.chat_context(table(s, sf, _C), 3), "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as b from conversations where role <> 'system') where b <= 3 union all select distinct conv_id, cast(-1 as bigint), 'system', 'You are a helpful assistant.' from conversations")
add("keep_last", lambda s, sf: chat.keep_last(table(s, sf, _C), 4), "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) as b from conversations) where b <= 4")
add("in_flight_gate", lambda s, sf: chat.in_flight_gate(table(s, sf, _C)), f"select conv_id, turn, role, text from (select *, lag(role) over (partition by conv_id order by turn) as b from conversations where role <> 'system' and {d.strip('text')} <> '') where role = 'user' and coalesce(b, '') <> 'user'")
add("ask_reply_pairs", lambda s, sf: chat.ask_reply_pairs(table(s, sf, _C)), "select conv_id, turn, text as ask, case when nr = 'assistant' then nt end as reply from (select *, lead(role) over w as nr, lead(text) over w as nt from conversations window w as (partition by conv_id order by turn)) where role = 'user'")
add("last_assistant", lambda s, sf: chat.last_assistant(table(s, sf, _C)), "select conv_id, arg_max(text, turn) as text from conversations where role = 'assistant' group by conv_id")
add("sink_chat", lambda s, sf: chat.transcript(table(s, sf, _C)).select("conv_id", F.get_json_object("body", "$[0].role").alias("first_role"), F.size(F.from_json("body", "array<struct<role:string,text:string>>")).alias("n"), F.length(F.get_json_object("body", "$[0].text")).alias("len")), "select conv_id, arg_min(role, turn) as first_role, cast(count(*) as integer) as n, cast(length(arg_min(text, turn)) as integer) as len from conversations group by conv_id")
_MD = d.sub(d.sub(d.sub(d.escape("text"), "`([^`]+)`", r"<code>\1</code>"), r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), r"\*([^*]+)\*", r"<em>\1</em>")
add("transcript_html", lambda s, sf: chat.transcript(table(s, sf, _C), as_html=True), f"select conv_id, string_agg(case when role = 'user' then '<p>' || {d.escape('text')} || '</p>' else '<div>' || {_MD} || '</div>' end, '' order by turn) as body from conversations group by conv_id")
add("since_clear", lambda s, sf: chat.since_clear(table(s, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error"), "select user_id, event_id, event_type from (select *, max(case when event_type = 'error' then event_id end) over (partition by user_id) as c from events) where c is null or event_id > c")
