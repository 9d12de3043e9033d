"""Whitelisted, well-formed HTML by a stack of open elements over a page's tokens.

What is opened last closes first: a closing tag closes all that is open inside its element, one without an open
element is ignored, and blocks end the paragraphs, items and cells they can't be in.  Inline marks that end only
because something around them does open again before the next text, as browsers have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.operators.trees import _BLOCKS, _CLOSES, MOST_DEPTH, VOID

# Tags that stay, tags that go with their content, and what attributes may hold.
KEEP_TAGS = "p h1 h2 h3 h4 ul ol li blockquote strong em b i u s br hr pre code figure figcaption img a table thead tbody tfoot tr th td sup sub section".split()
DROP_TAGS = "script style iframe noscript form button input select textarea object embed video audio svg canvas meta link base template".split()
_HREF = re.compile(r"(?i)https?://|mailto:|#")
_IMAGE = re.compile(r"(?i)data:image/(?:png|jpe?g|gif|webp);base64,[a-z0-9+/=\s]+")
_SPAN = re.compile("[0-9]{1,2}")
ALT_LENGTH = 300
#: Inline marks that open again, and elements that keep those of their inside to themselves.
_MARKS = frozenset("a b code em i s strong u".split())
_CELLS = frozenset("td th caption".split())
_KEEP, _DROP = frozenset(KEEP_TAGS), frozenset(DROP_TAGS)
_EMPTY = re.compile(r"(?i)<p>\s*</p>")


def _text(value: str) -> str:
    return value.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def kept_attributes(tag: str, attrs: dict[str, str]) -> str:
    """The attributes that stay, as HTML: a safe href, an inline image with its alt, spans of 2 to 99."""
    kept = []
    if tag == "a" and _HREF.match(attrs.get("href", "").strip()):
        kept.append(("href", attrs["href"].strip()))
    if tag == "img":
        kept += [("src", attrs["src"].strip())] if _IMAGE.fullmatch(attrs.get("src", "").strip()) else []
        kept += [("alt", attrs["alt"][:ALT_LENGTH])] if attrs.get("alt") else []
    if tag in ("td", "th"):
        kept += [(k, attrs[k]) for k in ("colspan", "rowspan") if _SPAN.fullmatch(attrs.get(k, "")) and int(attrs[k]) > 1]
    return "".join(' {}="{}"'.format(k, v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")) for k, v in kept)


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, str]] = []  # tag, its opening as it was written
        self.again: list[tuple[str, str]] = []  # marks to open before the next text
        self.muted = 0

    def _write(self, text: str) -> None:
        if not self.muted:
            self.out.append(text)

    def _push(self, tag: str, opening: str) -> None:
        self.open.append((tag, opening))
        self.muted += tag in _DROP
        self._write(opening)

    def _close(self, at: int, ended: str = "") -> None:
        """Closes what is open from ``at`` on; marks among it open again, but for the one that ``ended``."""
        marks = [] if self.muted else [own for k, own in enumerate(self.open[at:]) if own[0] in _MARKS and not (k == 0 and own[0] == ended)]
        for tag, opening in reversed(self.open[at:]):
            if tag in _CELLS:
                marks, self.again = [], []
            self._write(f"</{tag}>" if opening else "")
            self.muted -= tag in _DROP
        del self.open[at:]
        self.again = marks + self.again

    def _reopen(self) -> None:
        if self.again and not self.muted:
            marks, self.again = self.again, []
            for tag, opening in marks:
                if len(self.open) < MOST_DEPTH:
                    self._push(tag, opening)

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        ends, walls = _CLOSES.get(tag, (frozenset(), frozenset()))
        last = None
        for k in range(len(self.open) - 1, -1, -1) if ends else ():
            name = self.open[k][0]
            if name in walls or name in _DROP:
                break
            if name in ends:
                last = k
        if last is not None:
            self._close(last)
        if tag == "a" and any(t == "a" for t, _ in self.open) and not self.muted:
            self.handle_endtag("a")  # links don't nest
        if tag in VOID:
            if tag in _KEEP:
                self._void(tag, own)
            return
        if tag not in _BLOCKS and tag not in _CLOSES:
            self._reopen()
        if len(self.open) >= MOST_DEPTH:
            again = self.again
            self._close(MOST_DEPTH - 1)
            self.again = again
        self._push(tag, f"<{tag}{kept_attributes(tag, own)}>" if tag in _KEEP else "")

    def _void(self, tag: str, attrs: dict[str, str]) -> None:
        kept = kept_attributes(tag, attrs)
        if tag == "img" and " src=" not in kept:
            if attrs.get("alt"):
                self._reopen()
                self._write(_text(attrs["alt"][:ALT_LENGTH]))
            return
        if tag != "hr":
            self._reopen()
        self._write(f"<{tag}{kept}>")

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                self._close(k, ended=tag)
                return
            if name in _DROP:  # nothing inside closes what is around it
                return
        at = next((k for k in range(len(self.again) - 1, -1, -1) if self.again[k][0] == tag), None)
        if at is not None and not self.muted:
            del self.again[at]

    def handle_data(self, data):
        if data and not self.muted:
            if not data.isspace():
                self._reopen()
            self.out.append(_text(data))


def clean_page(html: str | None) -> str:
    parser = _Cleaner()
    parser.feed(html or "")
    parser.close()
    parser.again = []
    parser._close(0)
    return _EMPTY.sub("", "".join(parser.out)).strip()


def well_formed(pages: DataFrame) -> DataFrame:
    """page_id, html: every page's whitelisted tags with safe attributes, properly nested and closed; other tags are
    unwrapped, active ones go with their content, images without inline data leave their alt.  Null pages give ''."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(list(map(clean_page, batch.column("html").to_pylist())), pa.string())], names=["page_id", "html"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(clean, "page_id long, html string")
