"""Article extraction over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlake.functions.text import BLOCK_TAGS, collapse_ws
from readlake.operators import article as a
from readlake.operators import trees as t
from readlake.plans import sql as d
from readlake.plans.registry import Registry, table

registry = Registry()
add = registry.add

_OFF = lambda x: d.sub(x, "(?s)<[^>]*>", "")
_WEB = "html"
for _p in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?is)<noscript.*?</noscript>", r"(?s)<!--.*?-->"):
    _WEB = d.sub(_WEB, _p, "")
_WEB = f"list_filter(list_transform(string_split({d.entities(_OFF(d.sub(d.sub(_WEB, f'(?i)<({BLOCK_TAGS})[^>]*>', chr(10)), f'(?i)</({BLOCK_TAGS})>', chr(10))))}, chr(10)), lambda q: {d.strip('q')}), lambda q: q <> '')"
_WEB_ROWS = f"(select page_id, title, unnest(range(0, len(x))) as pos, unnest(x) as text from (select page_id, {d.strip(_OFF("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))} as title, {_WEB} as x from pages))"
add("web_extract", lambda s, sf: a.web_extract(table(s, sf, "pages")), f"select page_id, title, cast(pos as integer) as pos, text from {_WEB_ROWS}")
_L = d.quote(a.LINK)
_INNER = d.collapse(d.entities(_OFF("i")))
add("extract_links", lambda s, sf: a.extract_links(table(s, sf, "pages")), f"select page_id, cast(pos as integer) as pos, href, {_INNER} as anchor from (select page_id, unnest(range(0, len(h))) as pos, unnest(h) as href, unnest(x) as i from (select page_id, regexp_extract_all(html, {_L}, 1) as h, regexp_extract_all(html, {_L}, 2) as x from pages))")
add("article_candidates", lambda s, sf: a.article_candidates(table(s, sf, "pages")), f"""
with c as (select page_id, {d.without_containers("html")} as h from pages),
e as (select page_id, h, list_concat(regexp_extract_all(h, '(?is)<article\\b[^>]*>(.*?)</article\\s*>', 1), regexp_extract_all(h, '(?is)<main\\b[^>]*>(.*?)</main\\s*>', 1)) as b from c),
u as (select page_id, unnest(b) as b, unnest(range(0, len(b))) as i from e), n as (select page_id, b, i, length(array_to_string({d.visible("b")}, chr(10))) as n from u),
t as (select page_id, arg_max(b, (n, -i)) as b, max(n) as n from n group by page_id)
select c.page_id, case when t.n >= 80 then 'article' when regexp_extract(h, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1) <> '' then 'body' else 'page' end as source,
  case when t.n >= 80 then t.b when regexp_extract(h, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1) <> '' then regexp_extract(h, '(?is)<body\\b[^>]*>(.*)</body\\s*>', 1) else h end as body from c left join t using (page_id)""")
_P = r"(?is)<p\b[^>]*>(.*?)</p\s*>"
_BLOCKS = f"(select page_id, unnest(range(0, len(x))) as pos, unnest(x) as i from (select page_id, regexp_extract_all(html, {d.quote(_P)}, 1) as x from pages))"


def _scores(spark, sf):
    # cleaned before the explode, so that neither score nor filter does it again
    bare = F.transform(F.regexp_extract_all("html", F.lit(_P), 1), a._tags_off)
    texts = F.transform(bare, lambda x: collapse_ws(F.when(x.contains("&"), a.unescape_entities(x)).otherwise(x)))
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(texts).alias("pos", "text")).where(F.length("text") >= 25)
    return rows.select("page_id", "pos", a.paragraph_score(F.col("text")).alias("score"))


add("paragraph_score", _scores, f"select page_id, cast(pos as integer) as pos, cast(2 + len(regexp_extract_all(t, '{t.COMMAS}')) + least(length(t) // 100, 3) as integer) as score from (select page_id, pos, {_INNER} as t from {_BLOCKS}) where length(t) >= 25")
_CLS = """(select page_id, unnest(regexp_extract_all(html, '(?is)<[a-z0-9]+\\s+class="([^"]*)"', 1)) as cls from pages)"""
_ONE = lambda c: f"case when {c} = '' then 0 else case when regexp_matches({c}, '{t.NEGATIVE}') then -25 else 0 end + case when regexp_matches({c}, '{t.POSITIVE}') then 25 else 0 end end"


def _weights(spark, sf):
    names = F.explode(F.concat(F.regexp_extract_all("html", F.lit(r"""(?is)<[a-z0-9]+\s+class="([^"]*)\""""), 1), F.array(F.lit("post-footer"), F.lit("main text")))).alias("cls")
    return table(spark, sf, "pages").select("page_id", names).select("page_id", "cls", a.class_weight(F.col("cls"), F.concat("cls", F.lit("-1"))).alias("weight"))


add("class_weight", _weights, f"select page_id, cls, cast({_ONE('cls')} + {_ONE("(cls || '-1')")} as integer) as weight from (select * from {_CLS} union all select page_id, unnest(['post-footer', 'main text']) from pages)")
add("link_density", lambda s, sf: table(s, sf, "pages").select("page_id", F.round(a.link_density(F.col("html")), 9).alias("density")), f"""
with l as (select page_id, sum(length({_INNER}) * case when starts_with(h, '#') then 0.3 else 1.0 end) as n from (select page_id, unnest(regexp_extract_all(html, {_L}, 1)) as h, unnest(regexp_extract_all(html, {_L}, 2)) as i from pages) group by page_id)
select page_id, round(cast(coalesce(n, 0) as double) / length({d.collapse(d.entities(_OFF('html')))}), 9) as density from pages left join l using (page_id)""")
_META = lambda flip: "regexp_extract_all(html, " + d.quote(a._META_BACK if flip else a._META) + ", {})"
_TAGS = f"""t as (select page_id, replace({d.sub("lower(k)", "[ \t\n]", "")}, '.', ':') as k, {d.strip(d.entities("v"))} as v, i from (
 select page_id, unnest({_META(False).format(1)}) as k, unnest({_META(False).format(2)}) as v, 0 as o, unnest(range(0, len({_META(False).format(1)}))) as i from pages
 union all select page_id, unnest({_META(True).format(2)}), unnest({_META(True).format(1)}), 1, 100000 + unnest(range(0, len({_META(True).format(1)}))) from pages)),
m as (select page_id, k, arg_max(v, i) as v from t where v <> '' group by all)"""
_FIELD = lambda names: "coalesce(" + ", ".join(f"max(case when k = '{n}' then v end)" for n in names) + ", null)"
add("page_metadata", lambda s, sf: a.page_metadata(table(s, sf, "pages").withColumn("html", F.concat("html", F.expr("concat('<meta name=\"author\" content=\"A ', page_id, '\"><meta content=\"D&amp;', page_id, '\" property=\"og:description\">')")))), f"""
with pages as (select page_id, html || '<meta name="author" content="A ' || page_id || '"><meta content="D&amp;' || page_id || '" property="og:description">' as html from pages), {_TAGS}
select p.page_id, {", ".join(f"{_FIELD(n)} as {f}" for f, n in a.META_FIELDS.items())} from pages p left join m using (page_id) group by p.page_id""")
add("excerpt", lambda s, sf: a.excerpt(table(s, sf, "pages")), f"""
with {_TAGS}, f as (select page_id, arg_min(text, pos) as f from {_WEB_ROWS} where length(text) >= 25 group by page_id)
select p.page_id, coalesce({_FIELD(a.META_FIELDS["excerpt"])}, any_value(f)) as excerpt from pages p left join m using (page_id) left join f using (page_id) group by p.page_id""")
_HT = d.sub("html", "(?s)<!--.*?-->", "")
for _t in a.DROP_TAGS:
    _HT = d.sub(_HT, rf"(?is)<{_t}\b[^>]*>.*?</{_t}\s*>", "")
_ACT = "case when tag in (" + ", ".join(f"'{t}'" for t in a.KEEP_TAGS) + ") then 'keep' when tag in (" + ", ".join(f"'{t}'" for t in a.DROP_TAGS) + ") then 'drop' else 'unwrap' end"
_HREF = r"""regexp_extract(token, '(?is)\bhref\s*=\s*[''"]([^''"]*)[''"]', 1)"""
add("sanitize_report", lambda s, sf: a.sanitize_report(table(s, sf, "pages")), f"""
with k as (select page_id, unnest(regexp_extract_all({_HT}, '(?s)<[^>]*>|[^<]+')) as token from pages), t as (select page_id, token, lower(regexp_extract(token, '^<\\s*/?\\s*([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from k where starts_with(token, '<')),
x as (select *, {_ACT} as action, {_HREF} as href from t)
select page_id, count(*) filter (action = 'keep') as keep, count(*) filter (action = 'drop') as drop, count(*) filter (action = 'unwrap') as unwrap,
 count(*) filter (tag = 'a' and href <> '' and not regexp_matches({d.strip("href")}, '(?i)^(https?:|mailto:|#)')) as unsafe_links from x group by page_id""")
_SAFE = f"case when regexp_matches({d.strip(_HREF)}, '(?i)^(https?:|mailto:|#)') then {d.strip(_HREF)} else '' end"
add("sanitize_html_tokens", lambda s, sf: a.sanitize_html(table(s, sf, "pages"), balance=False), f"""
with k as (select page_id, unnest(x) as token, unnest(range(0, len(x))) as pos from (select page_id, regexp_extract_all({_HT}, '(?s)<[^>]*>|[^<]+') as x from pages)),
t as (select *, case when starts_with(token, '<') then lower(regexp_extract(token, '^<\\s*/?\\s*([a-zA-Z][a-zA-Z0-9]*)', 1)) end as tag, regexp_matches(token, '^<\\s*/') as closing from k),
o as (select page_id, pos, case when tag is null then {d.escape(d.entities("token"))} when closing then '</' || tag || '>' when tag = 'a' and {_SAFE} <> '' then '<a href="' || replace({_SAFE}, '"', '&quot;') || '">' else '<' || tag || '>' end as o from t where tag is null or ({_ACT} = 'keep' and not (closing and tag in ('br', 'hr', 'img'))))
select page_id, {d.strip(d.sub("string_agg(o, '' order by pos)", r"(?is)<p>\s*</p>", ""))} as html from o group by page_id""")
add("sanitize_html", lambda s, sf: a.sanitize_html(table(s, sf, "pages")), None)
_pages = lambda s, sf: table(s, sf, "pages")
add("html_nodes", lambda s, sf: t.html_nodes(_pages(s, sf)), None)
add("page_texts", lambda s, sf: t.page_trees(_pages(s, sf)).select("page_id", "text"), None)
add("drop_unlikely", lambda s, sf: t.drop_unlikely(_pages(s, sf)).groupBy("page_id").agg(F.count(F.lit(1)).alias("kept")), None)
add("byline", lambda s, sf: t.byline(_pages(s, sf).withColumn("html", F.concat(F.lit("<div class='byline'>By A. Writer</div>"), "html"))), None)
add("text_density", lambda s, sf: t.text_density(_pages(s, sf), ("h1", "h2", "h3")).where("density > 0"), None)
add("ancestor_score", lambda s, sf: t.ancestor_score(_pages(s, sf)).withColumn("score", F.round("score", 6)), None)
add("top_candidates", lambda s, sf: t.top_candidates(_pages(s, sf)), None)
add("clean_conditionally", lambda s, sf: t.clean_conditionally(_pages(s, sf)).groupBy("page_id").agg(F.count(F.lit(1)).alias("kept")), None)
add("extract_ladder", lambda s, sf: t.extract_ladder(_pages(s, sf)), None)
add("jsonld_metadata", lambda s, sf: a.jsonld_metadata(table(s, sf, "pages").withColumn("html", F.concat(F.expr("""concat('<script type="application/ld+json">{"@context":"https://schema.org","@type":"NewsArticle","headline":"H ', page_id, '","author":[{"name":"W"}],"publisher":{"name":"P"}}</script>')"""), "html"))), "select page_id, 'H ' || page_id as title, 'W' as byline, cast(null as varchar) as excerpt, 'P' as site, cast(null as varchar) as published from pages")
add("article_table", lambda s, sf: a.article_table(table(s, sf, "pages")), None)
