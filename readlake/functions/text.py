"""Text, HTML and name functions on columns.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities that are read.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "ldquo": "“", "rdquo": "”",
    "lsquo": "‘", "rsquo": "’", "hellip": "…", "mdash": "—", "ndash": "–", "middot": "·", "amp": "&",
}
# Containers that never hold article text, and tags that end a line.
CONTAINERS = ("script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", "form")
BLOCK_TAGS = "p|div|br|h[1-6]|li|tr|section|article|blockquote"
_WS = r"[ \t\n\x0b\f\r]"


def strip(c: Column) -> Column:
    """White space off both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def collapse_ws(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{_WS}+", " "))


def or_default(c: Column, default: Column | str) -> Column:
    """``default`` where ``c`` is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def escape_html(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def escape_attr(c: Column) -> Column:
    return F.replace(F.replace(escape_html(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def unescape_entities(c: Column) -> Column:
    """Named entities, any case; ``&amp;`` last, so that what it uncovers stays text."""
    for name, value in ENTITIES.items():
        c = F.regexp_replace(c, f"(?i)&{name};", value)
    return c


def unescape_numeric(c: Column) -> Column:
    """``&#65;`` and ``&#x41;``; numbers outside Unicode stay as they are."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"), 0))

    def one(text: Column, token: Column) -> Column:
        digits = F.regexp_extract(token, "&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(F.lower(token).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(good, F.replace(text, token, char)).otherwise(text)

    return F.aggregate(found, c, one)


def normalize_newlines(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "^\\x{FEFF}", ""), "\r\n?", "\n"))


def clean_control_chars(c: Column) -> Column:
    """Word-processor control characters: cell marks to tabs, breaks to newlines, field codes to their results.

    Fields may hold fields: innermost ones go first, in as many passes as begin marks are open at once.
    """
    c = F.regexp_replace(c, r"[\x02\x05\x08]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\x07", "\t"), r"[\x0b\x0c\x0d]", "\n")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = F.greatest(state["open"] + F.when(mark == "\x13", 1).otherwise(-1), F.lit(0))
        return F.struct(now.alias("open"), F.greatest(state["most"], now).alias("most"))

    depth = F.aggregate(F.regexp_extract_all(c, F.lit(r"[\x13\x15]"), F.lit(0)), start, step, lambda state: state["most"])
    field = r"\x13[^\x13\x14\x15]*\x14?([^\x13\x14\x15]*)\x15"
    c = F.aggregate(F.array_repeat(F.lit(0), depth), c, lambda text, _: F.regexp_replace(text, field, "$1"))
    c = F.regexp_replace(c, r"[\x00-\x06\x0e-\x1f]", "")
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def safe_href(c: Column, anchors: bool = True) -> Column:
    """The link if its scheme is http, https or mailto (or it is a fragment), else empty."""
    pattern = "(?i)^(https?:|mailto:" + ("|#)" if anchors else ")")
    return F.when(F.coalesce(strip(c).rlike(pattern), F.lit(False)), strip(c)).otherwise("")


def safe_image_src(c: Column) -> Column:
    """Inline raster images only."""
    return F.when(F.coalesce(c.rlike("(?i)^data:image/(png|jpe?g|gif|webp);base64,[a-z0-9+/=\\s]+$"), F.lit(False)), c).otherwise("")


def normalize_path(base: Column, target: Column) -> Column:
    """``target`` against the folder of ``base``, with ``.`` and ``..`` resolved and query and fragment off."""
    clean = F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(target, "[?#].*$", ""), r"\\", "/")), target)
    folder = F.regexp_replace(F.regexp_replace(base, r"\\", "/"), "[^/]*$", "")
    full = F.when(clean.startswith("/"), clean).otherwise(F.concat(folder, clean))

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/")


def absolutize(base: Column, link: Column) -> Column:
    """``link`` as an absolute address on the page ``base``, escapes as they are; script links become empty."""
    scheme, host = F.regexp_extract(base, "^([a-zA-Z]+):", 1), F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1)
    path = F.concat(F.lit("/"), F.regexp_extract(base, "^[a-zA-Z]+://[^/?#]+/?([^?#]*)", 1))
    own, tail = F.regexp_replace(link, "[?#].*$", ""), F.regexp_extract(link, "([?#].*)$", 1)
    parts = F.split(F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(path, "[^/]*$", ""), own)), "/")

    def step(done: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), done).when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), part))

    # a path that ends in a folder keeps its slash
    resolved = F.concat(F.aggregate(parts, F.lit(""), step), F.when(F.element_at(parts, -1).isin("", ".", ".."), "/").otherwise(""))
    return (
        F.when(link.rlike("(?i)^\\s*javascript:"), F.lit(""))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when((link == "") | link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(host, path, link))
        .otherwise(F.concat(host, resolved, tail))
    )


def strip_containers(c: Column, tags: tuple[str, ...] = CONTAINERS) -> Column:
    for tag in tags:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return c


def visible_lines(c: Column) -> Column:
    """The non-empty lines of the text a reader would see."""
    text = F.regexp_replace(F.regexp_replace(c, rf"(?is)<\s*/?\s*({BLOCK_TAGS})\b[^>]*>", "\n"), "(?s)<[^>]*>", "")
    return F.filter(F.transform(F.split(unescape_entities(text), "\n"), strip), lambda line: line != "")


def visible_text(c: Column) -> Column:
    return F.array_join(visible_lines(c), "\n")


def trim_result(body: Column, limit: int, notice: str) -> Column:
    """At most ``limit`` characters, cut back to the last ``>`` of the final tenth, with ``notice`` behind."""
    cut = F.substring(body, 1, limit)
    from_end = F.instr(F.reverse(cut), ">")
    at = F.when((from_end > 0) & (from_end <= limit // 10), F.lit(limit + 1) - from_end).otherwise(limit)
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(F.substr(cut, F.lit(1), at), F.lit(notice)))


def first_line(text: Column) -> Column:
    return strip(F.substring_index(normalize_newlines(text), "\n", 1))


def line_title(text: Column, most: int = 30) -> Column:
    """The first line, where it is 1 to ``most`` characters long and more follows; else null."""
    plain, line = normalize_newlines(text), first_line(text)
    return F.when(plain.contains("\n") & F.length(line).between(1, most), line)


def body_after_title(text: Column, most: int = 30) -> Column:
    plain = normalize_newlines(text)
    rest = strip(F.regexp_replace(plain, "^[^\n]*\n", ""))
    return F.when(line_title(text, most).isNotNull(), rest).otherwise(plain)


def short_title(text: Column, n: int, default: str) -> Column:
    return or_default(strip(F.substring(text, 1, n)), default)


def paragraph_list(text: Column, any_newline: bool = False) -> Column:
    cut = "\n" if any_newline else "\n[ \t\x0b\f\r]*\n"
    return F.filter(F.transform(F.split(normalize_newlines(text), cut), strip), lambda p: p != "")


def text_to_html(text: Column) -> Column:
    """Paragraphs in ``<p>``, their line ends as ``<br>``."""
    made = F.transform(paragraph_list(text), lambda p: F.concat(F.lit("<p>"), F.replace(escape_html(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    return or_default(F.array_join(made, ""), "<p></p>")


def html_title(html: Column) -> Column:
    """The social-preview title in either attribute order, else the title element; null where neither has text."""
    og = r"""(?:property|name)\s*=\s*['"]og:title['"]"""
    content = r"""content\s*=\s*['"]([^'"]+)['"]"""
    found = [F.regexp_extract(html, rf"(?is)<meta\b[^>]*{og}[^>]*{content}[^>]*>", 1), F.regexp_extract(html, rf"(?is)<meta\b[^>]*{content}[^>]*{og}[^>]*>", 1), F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)]
    return F.coalesce(*(F.nullif(collapse_ws(unescape_entities(F.regexp_replace(t, "(?s)<[^>]*>", ""))), F.lit("")) for t in found))


def word_count(c: Column) -> Column:
    return F.size(F.split(c, f"{_WS}+"))


def clean_site_title(title: Column, headings: Column) -> Column:
    """A page title without its site's name.

    A separator between blanks ends the title; a colon does when no heading is the title; a very short or long title
    gives way to the only h1.  ``headings`` is an array of (tag, text).
    """
    mark, own = r"[|\-\\/>»]", strip(title)
    left = F.regexp_replace(own, rf"(?s)(.*){mark} .*", "$1")
    right = F.regexp_replace(own, rf"(?s)[^|\-\\/>»]*{mark}(.*)", "$1")
    split_title = F.when(word_count(left) < 3, right).otherwise(left)
    after_last = F.substring_index(own, ":", -1)
    before_first = F.substring_index(own, ":", 1)
    after_first = F.substr(own, F.length(before_first) + 2)
    by_colon = F.when(word_count(after_last) < 3, after_first).when(word_count(before_first) > 5, own).otherwise(after_last)
    known = F.exists(headings, lambda h: h["text"] == own)
    h1 = F.filter(headings, lambda h: h["tag"] == "h1")
    odd = (F.length(own) > 150) | (F.length(own) < 15)
    picked = (
        F.when(own.rlike(rf" {mark} "), split_title)
        .when(own.contains(": "), F.when(known, own).otherwise(by_colon))
        .when(odd & (F.size(h1) == 1), F.element_at(h1, 1)["text"])
        .otherwise(own)
    )
    picked = F.regexp_replace(strip(picked), f"{_WS}{{2,}}", " ")
    levels = own.rlike(r" [\\/>»] ")
    short = (word_count(picked) <= 4) & (~levels | (word_count(picked) != word_count(F.regexp_replace(own, rf"{mark}+", "")) - 1))
    return F.when(short, own).otherwise(picked)


def markdown_inline(c: Column) -> Column:
    """Code, images as their text, links to safe addresses, bold and italic of already escaped text."""
    c = F.regexp_replace(c, "`([^`]+)`", "<code>$1</code>")
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?i)\[([^\]]+)\]\(((?:https?:|mailto:)[^)\s]+)\)", '<a href="$2">$1</a>')
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), "__([^_]+)__", "<strong>$1</strong>")
    return F.regexp_replace(c, r"\*([^*]+)\*", "<em>$1</em>")


def quote_selection(prompt: Column, selection: Column) -> Column:
    lines = F.transform(F.split(strip(selection), "\n"), lambda line: F.concat(F.lit("> "), line))
    return F.concat(strip(prompt), F.lit("\n\n"), F.array_join(lines, "\n"))


def natural_sort_key(name: Column, width: int = 20) -> Column:
    """A string that sorts as the name does when runs of digits count as numbers."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), 0)
    zero = lambda p: F.lpad(or_default(F.regexp_replace(p, "^0+", ""), "0"), width, "0")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]") & (F.length(p) <= width), zero(p)).otherwise(p)), "")


def column_index(ref: Column) -> Column:
    """0-based column of a sheet reference: A is 0, AB is 27."""
    letters = F.split(F.upper(F.regexp_extract(ref, "^([A-Za-z]+)", 1)), "")
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda n, x: (n * 26 + F.ascii(x) - 64).cast("int")) - 1


def row_index(ref: Column) -> Column:
    return F.regexp_extract(ref, "([0-9]+)$", 1).try_cast("int") - 1


def cell_ref(row: Column, col: Column) -> Column:
    """The reference of a 0-based row and column, up to three letters."""
    letter = lambda n: F.char(n % 26 + 65)
    one, two = col, F.floor(col / 26) - 1
    three = F.floor(two / 26) - 1
    return F.concat(F.when(three >= 0, letter(three)).otherwise(""), F.when(two >= 0, letter(F.greatest(two, F.lit(0)))).otherwise(""), letter(one), (row + 1).cast("string"))


def format_size(n: Column) -> Column:
    mb = F.concat(F.format_string("%.1f", F.round(n / 1048576, 1)), F.lit("MB"))
    return F.when(n >= 1048576, mb).when(n >= 1024, F.concat(F.floor(n / 1024).cast("string"), F.lit("KB"))).otherwise(F.concat(n.cast("string"), F.lit("B")))


def format_number(x: Column) -> Column:
    """Up to 15 significant digits, never with an exponent, without trailing zeros; whole numbers without a point.

    Null stays null; NaN and infinities are written as Spark casts them.
    """
    x = x.cast("double")
    # what Spark casts to a plain number of at most 15 digits is it already
    cast = x.cast("string")
    short = F.abs(x).between(1e-3, 9_999_999) & (F.length(cast) <= F.when(x < 0, 17).otherwise(16))
    shown = F.format_string("%.14e", x)
    power = F.regexp_extract(shown, "e([+-][0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(shown, "^-?([0-9.]+)e", 1), "[.]", ""), "0+$", "")
    whole = F.when(power < 0, "0").otherwise(F.rpad(digits, power + 1, "0"))
    part = F.when(power < 0, F.concat(F.repeat(F.lit("0"), -power - 1), digits)).otherwise(F.substr(digits, power + 2))
    plain = F.concat(F.when(x < 0, "-").otherwise(""), whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(x.isNull(), None).when(x == 0, "0").when(short, F.when(cast.endswith(".0"), F.substring_index(cast, ".", 1)).otherwise(cast)).when(power.isNull(), x.cast("string")).otherwise(plain)


def file_ext(name: Column) -> Column:
    """Lower-case extension of 1 to 10 characters, query and fragment cut off; else empty."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, "[?#].*$", ""), r"\.([A-Za-z0-9]{1,10})$", 1))


def file_stem(name: Column, default: str = "untitled") -> Column:
    return or_default(strip(F.regexp_replace(name, r"\.[^./\\]+$", "")), default)
