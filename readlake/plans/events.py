"""Event frames and pixel tables, over the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.operators import events as e
from readlake.operators import pixels as px
from readlake.plans.adapters import adapter, oracle
from readlake.plans.registry import Registry, table

registry = Registry()
add = registry.add

_F = oracle("frames")
_JSON = """case when k % 9 = 0 then 'not json' when k % 10 = 0 then '{"id": "no type"}' else '{"type": "' || type || '", "page": ' || k || ', "grayscale": ' || (k * 5) || ', "screen": {"width": ' || (1400 + k) || '}, "x": 0.5}' end"""


def _frames(spark, sf):
    return adapter(spark, sf, "frames")


def _lines(spark, sf):
    return _frames(spark, sf).withColumn("json", F.expr(_JSON)).select("conn", "seq", "json")


def _content(spark, sf):
    """Frames with content ids: a receipt names the content begun last, or now and then a wrong one."""
    from pyspark.sql import Window

    begun = F.last(F.when(F.col("type") == "content.begin", F.col("seq")), ignorenulls=True).over(Window.partitionBy("conn").orderBy("seq"))
    ident = F.when(F.col("type") == "content.begin", F.col("seq")).when(F.col("k") % 7 == 0, -1).otherwise(begun)
    return _frames(spark, sf).withColumn("content_id", ident).withColumnRenamed("k", "page")


_CF = _F + """, g as (select *, last_value(case when type = 'content.begin' then seq end ignore nulls) over (partition by conn order by seq) as begun from frames),
c as (select conn, seq, type, k as page, begun, case when type = 'content.begin' then seq when k % 7 = 0 then -1 else begun end as content_id from g) """
add("scan_frames", lambda s, sf: e.parse_frames(_lines(s, sf)).select("conn", "seq", "type", "page", "grayscale", F.col("screen.width").alias("width")), _F + "select conn, seq, type, k as page, k * 5 as grayscale, 1400 + k as width from frames where k % 9 <> 0 and k % 10 <> 0")
add("parse_events", lambda s, sf: e.parse_events(e.parse_frames(_lines(s, sf))).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("page").alias("pages")), _F + "select case when type in ('rendered', 'nav') then 'receipt' when type = 'content.begin' then 'begin' else type end as event, count(*) as n, cast(sum(k) as bigint) as pages from frames where k % 9 <> 0 and k % 10 <> 0 group by 1")
add("hello_caps", lambda s, sf: e.parse_frames(_lines(s, sf)).where("type = 'hello'").select("seq", *e.hello_caps(F.col("screen.width"), F.col("screen.height"), F.col("grayscale"), "android")), _F + "select seq, 1400 + k as width, 1872 as height, greatest(least(k * 5, 16), 2) as grayscale from frames where type = 'hello' and k % 9 <> 0 and k % 10 <> 0")
add("handshake_gate", lambda s, sf: e.handshake_gate(_frames(s, sf)).select("conn", "seq", "type"), _F + "select conn, seq, type from (select *, min(case when type = 'hello' then seq end) over (partition by conn) as h from frames) where seq >= h")


def _with_binary(spark, sf):
    f = _frames(spark, sf).select("conn", (F.col("seq") * 2).alias("seq"), "type", "k")
    binary = f.where("type = 'page' and k % 3 <> 0").select("conn", (F.col("seq") + 1).alias("seq"), F.lit("binary").alias("type"), "k")
    return f.unionByName(binary)


add("pair_page_binary", lambda s, sf: e.pair_page_binary(_with_binary(s, sf)), _F + """, b as (select conn, seq * 2 as seq, type from frames where type = 'page' union all select conn, seq * 2 + 1, 'binary' from frames where type = 'page' and k % 3 <> 0)
select conn, seq, ms as meta_seq from (select *, lag(type) over w as bt, lag(seq) over w as ms from b window w as (partition by conn order by seq)) where type = 'binary' and bt = 'page'""")
add("current_content", lambda s, sf: e.current_content(_content(s, sf)).select("conn", "seq", "page", "content_id"), _CF + "select conn, seq, page, content_id from c where type = 'rendered' and content_id = begun")
add("page_state", lambda s, sf: e.page_state(_content(s, sf)), _CF + "select conn, content_id, arg_max(page, seq) as page, max(seq) as seq from c where type in ('rendered', 'nav') group by conn, content_id")
add("clamp_nav", lambda s, sf: _frames(s, sf).where("type = 'nav'").select("seq", e.clamp_page(F.col("k") - 10, F.lit(40)).alias("page")), _F + "select seq, greatest(least(k - 10, 39), 0) as page from frames where type = 'nav'")
_VIEW = "v as (select conn, arg_max(k, seq) as page from frames where type = 'rendered' group by conn)"


def _views(spark, sf):
    return _frames(spark, sf).where("type = 'rendered'").groupBy("conn").agg(F.max_by("k", "seq").alias("page"))


def _sent(spark, sf):
    return _frames(spark, sf).where("type = 'page'").selectExpr("conn", "k as page").distinct()


add("prefetch_pages", lambda s, sf: e.prefetch_pages(_views(s, sf), _sent(s, sf), 100), _F + f", {_VIEW}, w as (select conn, unnest([page, page + 1, page - 1, page + 2]) as page, unnest([0, 1, 2, 3]) as priority from v) select conn, page, cast(priority as integer) as priority from w where page between 0 and 99 and not exists (select 1 from frames f where f.type = 'page' and f.conn = w.conn and f.k = w.page)")
add("evict_pages", lambda s, sf: e.evict_pages(_sent(s, sf), _views(s, sf)), _F + f", {_VIEW} select distinct f.conn, f.k as page from frames f join v on v.conn = f.conn where f.type = 'page' and abs(f.k - v.page) <= 3")
add("keep_ratio", lambda s, sf: _frames(s, sf).select("seq", e.keep_ratio(F.col("k"), F.lit(100), F.lit(37)).alias("page")), _F + "select seq, cast(greatest(least(floor(k / 99.0 * 36 + 0.5), 36), 0) as integer) as page from frames")
add("ack_throttle", lambda s, sf: e.ack_throttle(_frames(s, sf).where("type in ('rendered', 'page')").select("conn", "seq", (F.unix_millis(F.col("ts").cast("timestamp")) / 10000).cast("long").alias("ms"), "type")), _F.replace("with ", "with recursive ") + """
, n as (select conn, seq, type = 'rendered' as receipt, epoch_ms(ts) // 10000 as ms from frames where type in ('rendered', 'page')),
r as (select *, row_number() over (partition by conn order by ms, seq) as nth from n),
t(conn, nth, last, busy, seq, receipt, sent) as (select distinct conn, cast(0 as bigint), cast(null as bigint), false, cast(null as bigint), true, false from r
 union all select conn, nth, case when send then ms else last end, send or (still and not receipt), seq, receipt, send from (
  select *, not receipt and not still and (last is null or ms - last >= 500) as send from (
   select r.conn, r.nth, t.last, r.seq, r.receipt, r.ms, t.busy and not r.receipt and r.ms - t.last <= 1200 as still from t join r on r.conn = t.conn and r.nth = t.nth + 1)))
select conn, seq, sent from t where not receipt""")
add("drop_on_backlog", lambda s, sf: e.drop_on_backlog(_frames(s, sf).withColumn("queued", F.col("value") * 1000), "queued", 256 * 1024).groupBy("conn").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped")), _F + "select conn, count(*) filter (value * 1000 <= 262144) as kept, count(*) filter (value * 1000 > 262144) as dropped from frames group by conn")
add("full_refresh_marks", lambda s, sf: e.full_refresh_marks(_frames(s, sf).where("type = 'page'").select("conn", "seq"), 4), _F + "select conn, seq, row_number() over (partition by conn order by seq) % 4 = 0 as \"full\" from frames where type = 'page'")
add("live_sessions", lambda s, sf: e.live_sessions(_frames(s, sf)), _F + "select conn, cast(session as bigint) as session, count(*) as frames, count(*) filter (type = 'rendered') as shown from (select *, sum(case when type = 'content.begin' then 1 else 0 end) over (partition by conn order by seq) as session from frames) where session > 0 group by conn, session")
add("replay_latest", lambda s, sf: e.replay_latest(_frames(s, sf)), _F + "select type, arg_max(conn, seq) as conn, max(seq) as seq from frames where type in ('hello', 'content.begin') group by type")
add("connection_count", lambda s, sf: e.connection_count(_frames(s, sf).where("type in ('hello', 'page')").select("ts", "seq", F.when(F.col("type") == "hello", 1).otherwise(-1).alias("change"))), _F + "select ts, seq, cast(sum(case type when 'hello' then 1 else -1 end) over (order by ts, seq) as bigint) as open from frames where type in ('hello', 'page')")
add("reconnect_schedule", lambda s, sf: e.reconnect_schedule(_frames(s, sf).withColumn("type", F.when(F.col("type") == "page", "error").otherwise(F.col("type")))).select("conn", "seq", "failures", "delay"), _F + """, h as (select *, sum(case when type = 'hello' then 1 else 0 end) over (partition by conn order by seq) as h from frames),
f as (select conn, seq, cast(row_number() over (partition by conn, h order by seq) as integer) as failures from h where type = 'page') select conn, seq, failures, cast(least(15, 2 << least(failures, 3)) as integer) as delay from f""")
add("job_status", lambda s, sf: e.job_status(table(s, sf, "events").selectExpr("concat(user_id, '-', event_id % 9) as job", "ts", "event_id as seq", "case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'running' end as state"), 2_000_000), """
with p as (select user_id || '-' || event_id % 9 as job, ts, event_id as seq, case event_type when 'purchase' then 'done' when 'error' then 'failed' else 'running' end as state from events),
s as (select job, arg_max(state, (ts, seq)) as state, epoch_us(max(ts)) - epoch_us(min(ts)) as span from p group by job) select job, case when state in ('done', 'failed') then state when span >= 2000000000000 then 'timeout' else 'running' end as state from s""")
_X, _Y = "(value / 490 * 1.2 - 0.1)", "(k / 100.0)"
_xy = lambda: (F.expr(_X), F.expr("k / 100.0D"))
add("touch_kind", lambda s, sf: _frames(s, sf).select("seq", e.touch_kind(*_xy(), _xy()[0] + F.col("k") / 1000.0, _xy()[1], 1404, 1872).alias("kind")), _F + f"select seq, case when abs(k / 1000.0 * 1404) > 40 then 'swipe' when {_X} between 0 and 1 and {_Y} between 0 and 1 then 'tap' end as kind from frames where k <> 28 and k <> 29 union all select seq, null from frames where false union all select seq, case when k = 29 then 'swipe' when {_X} between 0 and 1 then 'tap' end from frames where k in (28, 29)")


def _touches(spark, sf):
    u, v = e.touch_to_source(*_xy(), (1404, 1872), (1080, 2400))
    return _frames(spark, sf).select("seq", F.round(u, 6).alias("u"), F.round(v, 6).alias("v")).where("u is not null")


add("touch_to_source", _touches, _F + f""", p as (select seq, ({_X} * 1404 - (1404 - 1080 * 0.78) / 2) / 0.78 as u, (cast(k as double) / 100 * 1872 - 0) / 0.78 as v from frames) select seq, round(u, 6) as u, round(v, 6) as v from p where u >= 0 and u < 1080 and v >= 0 and v < 2400""")
add("tap_action", lambda s, sf: _frames(s, sf).select(e.tap_action(_xy()[0]).alias("app"), e.tap_action(_xy()[0], "reader", True).alias("reader")).groupBy("app", "reader").agg(F.count(F.lit(1)).alias("n")), _F + f"select case when {_X} < 0.40 then 'prev' when {_X} > 0.60 then 'next' else 'panel' end as app, case when {_X} < 0.35 then 'next' when {_X} > 0.65 then 'prev' else 'panel' end as reader, count(*) as n from frames group by 1, 2")
add("swipe_action", lambda s, sf: _frames(s, sf).select("seq", e.swipe_action(F.expr(f"{_X} - 0.5"), F.expr("k / 200.0D - 0.25")).alias("action")), _F + f"select seq, case when abs({_X} - 0.5) > 1.5 * abs(cast(k as double) / 200 - 0.25) and abs({_X} - 0.5) > 0.08 then case when {_X} - 0.5 < 0 then 'next' else 'prev' end end as action from frames")

_P = oracle("pixels")
_G = "(0.299::double * r + 0.587::double * g + 0.114::double * b)"
_grey = lambda: px.luma(F.col("r"), F.col("g"), F.col("b"))
add("luma", lambda s, sf: adapter(s, sf, "pixels").select("img", "pos", F.round(_grey(), 6).alias("grey")), _P + f"select img, pos, round({_G}, 6) as grey from pixels")
_STEP = "17.0"
_Q = f"cast(floor(greatest(least(floor(({_G} + [" + ", ".join(str((v + 0.5) / 16 - 0.5) for v in px.BAYER) + f"][(y & 3) * 4 + (x & 3) + 1] * {_STEP}) / {_STEP} + 0.5), 15), 0) * {_STEP} + 0.5) as integer)"


def _bayer(spark, sf):
    return adapter(spark, sf, "pixels").select("img", "pos", "x", "y", _grey().alias("grey")).withColumn("q", px.bayer_quantize(F.col("grey"), F.col("x"), F.col("y"), 16))


add("bayer_quantize", lambda s, sf: _bayer(s, sf).select("img", "pos", "q"), _P + f"select img, pos, {_Q} as q from pixels")
add("image_stats", lambda s, sf: px.image_stats(_bayer(s, sf), "grey", "q", 16), _P + f"select img, count(distinct q) as used, round(avg(q - grey), 6) as shift, bool_and(q % 17 = 0) as on_levels from (select img, {_G} as grey, {_Q} as q from pixels) group by img")
add("diffuse_quantize", lambda s, sf: px.diffuse_quantize(adapter(s, sf, "pixels").select("img", "x", "y", _grey().alias("grey")), 16), _P.replace("with ", "with recursive ") + f"""
, w as (select img, list({_G} order by pos) as work from pixels group by img),
t(img, p, x, y, q, work) as (select img, -1, 0, 0, 0, work from w
 union all select img, p, p % 8, p // 8, q, list_transform(work, lambda v, i: case when i = p + 2 and p % 8 < 7 then v + off * 7 / 16 when i = p + 8 and p % 8 > 0 then v + off * 3 / 16 when i = p + 9 then v + off * 5 / 16 when i = p + 10 and p % 8 < 7 then v + off / 16 else v end) from (
  select *, work[p + 1] - q as off from (select img, t.p + 1 as p, work, cast(floor(greatest(least(trunc(work[t.p + 2] / 17.0 + 0.5), 15), 0) * 17 + 0.5) as integer) as q from t where t.p < 63)))
select img, cast(x as integer) as x, cast(y as integer) as y, q from t where p >= 0""")
add("contrast", lambda s, sf: adapter(s, sf, "pixels").select("img", "pos", F.round(px.contrast(_grey(), 3), 6).alias("grey")), _P + f"select img, pos, round(greatest(least(({_G} - 128) * 1.36 + 128, 255.0), 0.0), 6) as grey from pixels")
_SIZES = "p_partkey, p_size * 40 as w, cast(p_retailprice as int) as h"
add("fit_box", lambda s, sf: table(s, sf, "part").selectExpr(*_SIZES.split(", ")).select("p_partkey", *px.fit_box(F.col("w"), F.col("h"), 1404, 1872)), f"""
with p as (select p_partkey, p_size * 40 as w, cast(floor(p_retailprice) as int) as h from part), t as (select p_partkey, w > h as turned, least(w, h) * 1.0 as mn, case when w > h then h else w end as sw, case when w > h then w else h end as sh from p),
s as (select *, least(1404.0::double / sw, 1872.0::double / sh) as sc from t) select p_partkey, turned, round(sc, 9) as scale, cast(floor((1404 - sw * sc) / 2 + 0.5) as integer) as left, cast(floor((1872 - sh * sc) / 2 + 0.5) as integer) as top from s""")
add("sample_factor", lambda s, sf: table(s, sf, "part").selectExpr(*_SIZES.split(", ")).select("p_partkey", px.sample_factor(F.col("w"), F.col("h"), 100, 120).alias("factor")), "with p as (select p_partkey, least(p_size * 40 / 100.0::double, floor(p_retailprice) / 120.0::double) as r from part) select p_partkey, cast(case when r < 1 then 1 else pow(2, floor(log2(r))) end as integer) as factor from p")


def _turned(spark, sf):
    x, y = px.rotate_pixels(F.col("x"), F.col("y"), 8, 8, 90)
    return adapter(spark, sf, "pixels").select("img", x.alias("x"), y.alias("y"), "r")


add("rotate_pixels", _turned, _P + "select img, cast(7 - y as integer) as x, x as y, r from pixels")


def _stream(spark, sf, grey):
    return px.frame_arrays(adapter(spark, sf, "pixels"), grey).withColumn("stream", F.col("img") % 4)


_FR = _P + """, f as (select img, img % 4 as stream, list({0} order by pos) as v from pixels group by img), l as (select *, lag(v) over (partition by stream order by img) as b from f), n as (select img, b, list_sum(list_transform(list_zip(v, b), lambda p: case when abs(p[1] - p[2]) > {1} then 1 else 0 end)) as n from l) select img, b is null or {2} as changed from n"""
_W = "cast(floor((3 * r + 4 * g + b) / 8) as integer)"
add("frame_diff_web", lambda s, sf: e.frame_diff(_stream(s, sf, F.floor((3 * F.col("r") + 4 * F.col("g") + F.col("b")) / 8).cast("int")), "img", "values", 24, share=0.5).select("img", "changed"), _FR.format(_W, 24, "n > 32.0"))
add("frame_diff_grid", lambda s, sf: e.frame_diff(_stream(s, sf, _grey()), "img", "values", 12, cells=48).select("img", "changed"), _FR.format(_G, 12, "n >= 48"))
add("frame_diff_one_stream", lambda s, sf: e.frame_diff(px.frame_arrays(adapter(s, sf, "pixels"), _grey()).withColumn("stream", F.lit("all")), "img", "values", 12, cells=48).select("img", "changed"), _FR.replace("img % 4 as stream", "'all' as stream").format(_G, 12, "n >= 48"))
