"""Files, archives, JSON lines and the saved store."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from readlake.functions.text import or_default, strip

# Declared charsets and the codecs that read them.
CHARSETS = {"gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5", "windows-1252": "cp1252", "iso-8859-1": "cp1252", "latin1": "cp1252", "utf-8": "utf-8", "utf-16": "utf-16"}


def scan_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """path, name, size, content of files; a size limit reaches the reader, so larger files are never opened."""
    files = spark.read.format("binaryFile").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size"), "content")


def decode_text(files: DataFrame) -> DataFrame:
    """``files`` with text and status: byte-order marks first, then strict UTF-8; anything else is ``invalid``."""
    head, c = F.hex(F.substring("content", 1, 3)), F.col("content")
    wide = lambda name: F.decode(F.expr("substring(content, 3)"), name)
    text = F.when(head == "EFBBBF", F.try_validate_utf8(F.expr("substring(content, 4)").cast("string"))).when(head.startswith("FFFE"), wide("UTF-16LE")).when(head.startswith("FEFF"), wide("UTF-16BE")).otherwise(F.try_validate_utf8(c.cast("string")))
    return files.withColumn("text", text).withColumn("status", F.when(F.col("text").isNull(), "invalid").otherwise("ok"))


@F.arrow_udf(T.StringType())
def decode_declared(content: pa.Array, charset: pa.Array) -> pa.Array:
    """Bytes by their declared charset, else UTF-8, else Windows-1252 with what doesn't fit replaced.

    Spark's own decoder knows neither GB 18030, Big 5 nor Windows-1252, so this one runs in Arrow batches, of which
    256 values at a time are Python objects.
    """

    def one(data: bytes | None, name: str | None) -> str | None:
        if data is None:
            return None
        codec = CHARSETS.get((name or "").strip().lower(), "utf-8")
        for c in (codec, "utf-8"):
            try:
                return data.decode(c)
            except (UnicodeDecodeError, LookupError):
                continue
        return data.decode("cp1252", "replace")

    part = lambda at: pa.array(map(one, content.slice(at, 256).to_pylist(), charset.slice(at, 256).to_pylist()), pa.string())
    return pa.concat_arrays([part(at) for at in range(0, len(content), 256)] or [pa.array([], pa.string())])


#: What reading a damaged archive or entry raises.
BROKEN = (zipfile.BadZipFile, zlib.error, OSError, EOFError, ValueError, RuntimeError, NotImplementedError, struct.error)


def read_entry(z: zipfile.ZipFile, i: zipfile.ZipInfo, wanted: re.Pattern, most: int) -> tuple[bytes | None, str]:
    """An entry's bytes, if its name is wanted, and its status."""
    if i.flag_bits & 1:
        return None, "encrypted"
    if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None, "unsupported"
    if not wanted.search(i.filename):
        return None, "ok"
    if i.file_size > most:
        return None, "too-large"
    try:
        with z.open(i) as data:
            content = data.read(most + 1)  # headers may lie about sizes
    except BROKEN:
        return None, "corrupt"
    return (None, "too-large") if len(content) > most else (content, "ok")


ENTRY = "path string, entry string, ord int, size long, flags int, method int, content binary, status string"
_ENTRY_COLUMNS = (("path", pa.string()), ("entry", pa.string()), ("ord", pa.int32()), ("size", pa.int64()), ("flags", pa.int32()), ("method", pa.int32()), ("content", pa.binary()), ("status", pa.string()))
#: Bytes of entries that a worker collects before it hands them on.
_HELD_BYTES = 4 << 20


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _ENTRY_COLUMNS, strict=True)], names=[n for n, _ in _ENTRY_COLUMNS])


def entry_batches(batches: Iterable[pa.RecordBatch], accept: str = ".*", max_entry: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of ``scan_archive`` for batches of (path, content), many archives a batch, within ``_HELD_BYTES`` and an entry."""
    wanted = re.compile(accept)

    def entries(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content if content is not None else b"")) as z:
                for k, i in enumerate(z.infolist()):
                    yield (path, i.filename, k, i.file_size, i.flag_bits, i.compress_type, *read_entry(z, i, wanted, max_entry))
        except BROKEN:
            yield path, None, None, None, None, None, None, "corrupt"

    rows, held = [], 0
    for batch in batches:
        # one archive at a time becomes a Python object
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            for row in entries(path.as_py(), content.as_py()):
                rows.append(row)
                held += len(row[6] or b"")
                if len(rows) >= 4096 or held >= _HELD_BYTES:
                    yield _entry_batch(rows)
                    rows, held = [], 0
    if rows:
        yield _entry_batch(rows)


def scan_archive(files: DataFrame, accept: str = ".*", max_entry: int = 32 << 20) -> DataFrame:
    """One row for each archive entry: path, entry, ord, size, flags, method, content, status.

    Only entries whose name matches ``accept`` are read; others have headers alone, as have ``encrypted`` ones, ones
    packed by an ``unsupported`` method and ones ``too-large``.  An entry whose bytes are damaged is one ``corrupt``
    row, the others of its archive are not touched by it; a file without a readable directory is one ``corrupt`` row.
    """
    return files.select("path", "content").mapInArrow(lambda batches: entry_batches(batches, accept, max_entry), ENTRY)


def sniff_format(files: DataFrame, entries: DataFrame) -> DataFrame:
    """path and format by content: book and office signatures, archives by what they hold, else text when the first
    4 KiB are UTF-8 without NUL.  ``entries`` is ``scan_archive``'s rows for the same files."""
    has = lambda name: F.bool_or(F.lower("entry") == name)
    inner = entries.where("entry is not null").groupBy("path").agg(has("word/document.xml").alias("docx"), has("ppt/presentation.xml").alias("pptx"), has("xl/workbook.xml").alias("xlsx"), has("meta-inf/container.xml").alias("epub"))
    head = F.col("content").substr(1, 4096)
    signature = F.hex(F.col("content").substr(1, 8))
    cut = F.regexp_replace(F.hex(head), "(?:[C-F][0-9A-F](?:[89AB][0-9A-F]){0,2})$", "")  # a character cut at 4 KiB
    textual = ~F.hex(head).rlike("^(?:..)*00") & F.coalesce(F.try_validate_utf8(F.unhex(F.when(F.length("content") > 4096, cut).otherwise(F.hex(head))).cast("string")).isNotNull(), F.lit(False))
    by_entries = F.when(F.col("docx"), "docx").when(F.col("pptx"), "pptx").when(F.col("xlsx"), "xlsx").when(F.col("epub"), "epub").otherwise("zip")
    kind = (
        F.when(F.hex(F.col("content").substr(61, 8)) == "424F4F4B4D4F4249", "mobi").when(signature == "D0CF11E0A1B11AE1", "ole")
        .when(signature.startswith("504B0304"), by_entries).when(textual & (F.length("content") > 0), "text")
    )
    return files.join(inner, "path", "left").select("path", kind.alias("format"))


def scan_ocr_jsonl(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """key, pos, text: pages' texts from nested layout results, blocks joined by blank lines; bad lines are skipped."""
    schema = "result struct<layoutParsingResults:array<struct<markdown:struct<text:string>>>>"
    pages = lines.select(key, F.from_json(line, schema).alias("r")).select(key, F.posexplode("r.result.layoutParsingResults").alias("pos", "page"))
    return pages.select(key, "pos", strip(F.col("page.markdown.text")).alias("text")).where("text <> ''")


def ocr_text(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """key, text, status: all pages in order; ``empty`` without text."""
    pages = scan_ocr_jsonl(lines, key, line)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda p: p["text"]), "\n\n")
    both = lines.select(key).distinct().join(pages.groupBy(key).agg(joined.alias("text")), key, "left")
    return both.select(key, F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("text").isNull(), "empty").otherwise("ok").alias("status"))


def write_saved(items: DataFrame, folder: str) -> None:
    """Items (kind, id, title, time, body …) as Parquet, a folder for each kind."""
    items.write.mode("append").partitionBy("kind").parquet(folder)


def list_saved(files: DataFrame, meta: DataFrame) -> DataFrame:
    """id, title, time, size of items with metadata, newest first; the size sums the item's files."""
    sizes = files.groupBy("id").agg(F.sum("size").alias("size"))
    return sizes.join(meta.select("id", or_default(F.col("title"), "untitled").alias("title"), "time"), "id").select("id", "title", "time", "size").orderBy(F.desc("time"), F.desc("id"))


def saved_pages(files: DataFrame) -> DataFrame:
    """id, page: numbers of ``page_N.png`` files, and whether it is the item's first."""
    number = F.regexp_extract("name", "^page_([0-9]+)[.]png$", 1).try_cast("int")
    rows = files.select("id", number.alias("page")).where("page is not null").distinct()
    firsts = rows.groupBy("id").agg(F.min("page").alias("first"))
    return rows.join(firsts, "id").select("id", "page", (F.col("page") == F.col("first")).alias("is_first"))


def html_frames(items: DataFrame) -> DataFrame:
    """JSON frames ``{type: html, id, title, body}``."""
    return items.select(F.to_json(F.struct(F.lit("html").alias("type"), F.col("id").cast("string").alias("id"), "title", "body")).alias("json"))


def sink_html(items: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of items as frame files; each micro-batch is written once under its number."""

    def write(batch: DataFrame, number: int) -> None:
        html_frames(batch).write.mode("overwrite").text(f"{folder}/batch={number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

