"""Tables that the operators expect, as projections of the given ones.

Each adapter is one SELECT that Spark and DuckDB both run; ``{…}`` marks the few spellings that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# File kinds dealt to the documents, by remainder of the id.
_EXT = "md txt docx epub mobi azw3 pptx xlsx doc ppt xls pdf png cbz zip rar".split()
_MIME = (
    "text/markdown text/plain application/octet-stream application/epub+zip application/x-mobipocket-ebook application/octet-stream "
    "application/octet-stream application/octet-stream application/msword application/vnd.ms-powerpoint application/vnd.ms-excel "
    "application/pdf image/png application/octet-stream application/zip application/x-rar-compressed"
).split()


def _case(by: str, values: list[str]) -> str:
    return f"case {by} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


_K = "cast(regexp_extract(props, '\"k\": ?([0-9]+)', 1) as int)"

ADAPTERS: dict[str, str] = {
    "files": f"""select doc_id as file_id, 'doc ' || cast(doc_id as varchar(20)) || case when doc_id % 11 = 0 then '' else '.' || {_case("doc_id % 16", _EXT)} end as name,
      {_case("doc_id % 16", _MIME)} as mime, 'content://store/doc%20' || cast(doc_id as varchar(20)) || '.' || {_case("doc_id % 16", _EXT)} || '?v=1' as uri,
      n_chars * 100000 as size from documents""",
    "frames": f"""select user_id as conn, event_id as seq, ts, value, {_K} as k,
      case event_type when 'signup' then 'hello' when 'purchase' then 'content.begin' when 'click' then 'nav' when 'view' then 'rendered' else 'page' end as type from events""",
    "items": "select source as owner, doc_id as id, substr(text, 1, 20) as title, text as body, doc_id as ts from documents",
    "books": "select o_custkey as owner, o_orderkey % 40 as uri, o_orderkey as seq, o_orderdate as time, o_orderkey % 97 as page, 50 + o_orderkey % 60 as total from orders",
    "cells": """select l_orderkey as doc, l_linenumber as sheet, cast(l_suppkey % 40 as int) as row, cast(l_partkey % 300 as int) as col,
      l_partkey as idx, l_returnflag as type, cast(cast(l_quantity as int) as varchar(20)) as value from lineitem""",
    "pixels": """select vec_id as img, p as pos, cast(p % 8 as int) as x, cast(floor(p / 8) as int) as y,
      cast(floor(least(greatest((e + 0.5) * 255, 0), 255)) as int) as r, cast(floor(least(greatest((e + 0.4) * 255, 0), 255)) as int) as g, cast(floor(least(greatest((e + 0.6) * 255, 0), 255)) as int) as b
      from {exploded}""",
}
_EXPLODED = {
    "spark": "(select vec_id, pos as p, cast(e as double) as e from embeddings lateral view posexplode(embedding) t as pos, e)",
    "duckdb": "(select vec_id, unnest(range(0, len(embedding))) as p, cast(unnest(embedding) as double) as e from embeddings)",
}
_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter's rows on Spark."""
    text = ADAPTERS[name].replace("{exploded}", _EXPLODED["spark"])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"from {t}" in text}
    for t in used:
        text = text.replace(f"from {t}", f"from {{{t}}}")
    return spark.sql(text, **used)


def oracle(*names: str) -> str:
    """``with`` clauses of the adapters, for DuckDB."""
    return "with " + ", ".join(f"{n} as ({ADAPTERS[n].replace('{exploded}', _EXPLODED['duckdb'])})" for n in names) + " "
