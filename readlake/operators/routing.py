"""Filters, routing and gates over file, page and entry tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.functions.text import file_ext, utf16_len

MIB = 1 << 20
# Formats by extension and by media type.
FORMATS = {
    "md": "markdown", "markdown": "markdown", "txt": "text", "docx": "docx", "epub": "epub", "mobi": "mobi", "azw": "mobi",
    "azw3": "mobi", "pptx": "pptx", "xlsx": "xlsx", "doc": "doc", "ppt": "ppt", "xls": "xls",
}
MIME_FORMATS = {
    "text/markdown": "markdown", "text/x-markdown": "markdown", "text/md": "markdown", "application/markdown": "markdown",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/epub+zip": "epub",
    "application/x-mobipocket-ebook": "mobi", "application/x-mobi8-ebook": "mobi", "application/vnd.amazon.ebook": "mobi",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/msword": "doc",
    "application/vnd.ms-powerpoint": "ppt", "application/vnd.ms-excel": "xls",
}
# Size limits in bytes.
SIZE_LIMITS = {"web": 150 * MIB, "native": 64 * MIB, "bitmap": 512 * MIB}
IMAGE_EXT = ("png", "jpg", "jpeg", "gif", "webp", "bmp")
FRAME_TYPES = ("hello", "content.begin", "nav", "rendered", "page", "state", "touch", "ask", "html", "image")


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def _plain_mime(mime: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))


def detect_format(name: Column, mime: Column, uri: Column) -> Column:
    """By the name's extension, then the address's (plain and decoded), then the media type; null when none is known."""
    hints = [name, F.try_url_decode(name), uri, F.try_url_decode(uri)]
    by_ext = F.coalesce(*(_lookup(file_ext(h), FORMATS) for h in hints))
    kind = _plain_mime(mime)
    return F.coalesce(by_ext, _lookup(kind, MIME_FORMATS), F.when(kind.startswith("text/"), "text"))


def is_readable(name: Column, mime: Column, uri: Column | None = None, profile: str = "web") -> Column:
    """Whether an importer would try the file; the Android profile also tries unnamed octet streams."""
    kind = _plain_mime(mime)
    known = F.coalesce(_lookup(file_ext(name), FORMATS).isNotNull(), F.lit(False)) | kind.isin(*MIME_FORMATS) | kind.startswith("text/")
    if profile == "web":
        return known
    return detect_format(name, mime, uri if uri is not None else F.lit("")).isNotNull() | (kind == "application/octet-stream")


def route_item(name: Column, mime: Column, uri: Column | None = None, profile: str = "web") -> Column:
    """The channel a file goes to.  The order of the tests differs: the web reads text first, Android images first."""
    ext, kind, readable = file_ext(name), _plain_mime(mime), is_readable(name, mime, uri, profile)
    image, pdf = kind.startswith("image/"), (kind == "application/pdf") | (ext == "pdf")
    if profile == "web":
        return F.when(readable, "readable").when(image, "image").when(pdf, "pdf").otherwise("unsupported")
    comic = ext.isin("cbz", "cbr", "rar") | (ext == "zip") & (kind != "application/pdf")
    return F.when(image, "image").when(comic, "comic").when(pdf, "pdf").when(readable, "readable").otherwise("unsupported")


def is_url(text: Column, profile: str = "web") -> Column:
    return text.rlike("^https?://\\S+$") if profile == "web" else text.startswith("http://") | text.startswith("https://")


def size_gate(size: Column, profile: str = "web") -> Column:
    return F.when(size > SIZE_LIMITS[profile], "too-large").otherwise("ok")


def keep_pages(pages: DataFrame, max_bytes: int = 5 * MIB) -> DataFrame:
    """Pages with a web address that fit the fetch limit."""
    return pages.where(is_url(F.col("url"), "android") & (F.octet_length("html") <= max_bytes))


def archive_preflight(entries: DataFrame, path: str = "path", max_entries: int = 12_000, max_entry: int = 32 * MIB, max_total: int = 220 * MIB) -> DataFrame:
    """One status an archive from its entry headers (size, flags, method): corrupt, too-large, encrypted or ok."""
    sums = entries.groupBy(path).agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("total"), F.max("size").alias("largest"), F.bool_or(F.col("size") < 0).alias("bad"), F.bool_or(F.col("flags") % 2 == 1).alias("locked"), F.bool_or(~F.col("method").isin(0, 8)).alias("odd"))
    large = (F.col("entries") > max_entries) | (F.col("largest") > max_entry) | (F.col("total") > max_total)
    status = F.when(F.col("bad"), "corrupt").when(large, "too-large").when(F.col("locked"), "encrypted").when(F.col("odd"), "unsupported").otherwise("ok")
    return sums.select(path, "entries", "total", status.alias("status"))


def drm_gate(entries: DataFrame, encrypted: DataFrame, path: str = "path") -> DataFrame:
    """``entries``' archives with ``drm``: a licence or rights file is there, or an encrypted item isn't a font's
    standard obfuscation.  ``encrypted`` has (path, algorithm)."""
    fonts = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")
    rights = entries.groupBy(path).agg(F.bool_or(F.lower("entry").isin("meta-inf/rights.xml", "meta-inf/license.lcpl")).alias("rights"))
    locked = encrypted.groupBy(path).agg(F.bool_or(~F.col("algorithm").isin(*fonts)).alias("locked"))
    return rights.join(locked, path, "left").select(path, (F.col("rights") | F.coalesce("locked", F.lit(False))).alias("drm"))


def quarantine(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows, failed rows and the number of each status."""
    good = F.coalesce(F.col(status) == "ok", F.lit(False))
    return df.where(good), df.where(~good), df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def history_eligible(df: DataFrame, body: str = "body", most: int = 65_536) -> DataFrame:
    return df.where(utf16_len(F.col(body)) <= most)


def oversize_frames(df: DataFrame, body: str = "body", max_bytes: int = 24 * MIB, max_units: int = 4 * MIB) -> DataFrame:
    """Frames within the limits, ids and titles cut to 256 and 1,024 characters."""
    fits = df.where((F.octet_length(body) <= max_bytes) & (utf16_len(F.col(body)) <= max_units))
    return fits.withColumns({"id": F.substring(F.col("id").cast("string"), 1, 256), "title": F.substring("title", 1, 1024)})


def new_clips(clips: DataFrame, owner: str = "owner", order: str = "id", text: str = "title", least: int = 6) -> DataFrame:
    """Clips of ``least`` characters or more that differ from the owner's clip before."""
    from pyspark.sql import Window

    long = clips.where(F.length(text) >= least)
    before = F.lag(text).over(Window.partitionBy(owner).orderBy(order))
    return long.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(text))).drop("before")


def drop_unknown_types(frames: DataFrame, known: tuple[str, ...] = FRAME_TYPES) -> DataFrame:
    return frames.where(F.col("type").isin(*known))


def image_entries(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Image entries of an archive without resource forks and hidden files."""
    base = F.substring_index(entry, "/", -1)
    ext = F.lower(F.regexp_extract(base, r"\.([A-Za-z0-9]+)$", 1))
    return entries.where(ext.isin(*IMAGE_EXT) & ~F.col(entry).startswith("__MACOSX/") & ~base.startswith("."))
