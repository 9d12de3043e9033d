"""Pages as trees, and the scoring rules over them: a page is one row, and nothing is shuffled.

``page_trees`` numbers a page's elements in document order, so that the elements under one are an interval, and keeps
the visible text once, cut into runs that belong to an element each; an element's text is an interval of runs.  The
operators work on a batch of pages at a time: the arrays of all its trees lie end to end, whatever asks about a
subtree is the difference of two prefix sums, and a subtree that goes is an interval that is marked.

White space counts as one blank between two texts, whichever element holds it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Class and id words of the scoring rules, as regular expressions.
UNLIKELY = r"(?i)-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote"
MAYBE = r"(?i)and|article|body|column|content|main|shadow"
POSITIVE = r"(?i)article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story"
NEGATIVE = r"(?i)-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|foot|footer|footnote|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|tool|widget"
BYLINE = r"(?i)byline|author|dateline|writtenby|p-author"
COMMAS = r"[\x{002C}\x{060C}\x{FE50}\x{FE10}\x{FE11}\x{2E41}\x{2E34}\x{2E32}\x{FF0C}]"
VIDEOS = r"(?i)//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq)\.com|(archive|upload\.wikimedia)\.org|player\.twitch\.tv)"
UNLIKELY_ROLES = ("menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog")
TAG_START = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
SCORED = ("section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
DATA_TABLE_TAGS = ("col", "colgroup", "tfoot", "thead", "th")
CLEANED = ("form", "fieldset", "table", "ul", "div")
# Fixed values of HTML: elements without content, and those whose text is never shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style noscript template".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What makes a div a block itself.
_PARTING = frozenset("blockquote dl div img ol p pre table ul".split())
#: What opens ends these open elements, as far up as the second set allows.
_CLOSES = {
    **{t: (frozenset({"p"}), frozenset({"button", "td", "th", "table", "caption"})) for t in _BLOCKS},
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
    **{t: (frozenset({"tr", "td", "th", "p", "thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Elements nested deeper become siblings at this depth, as browsers have it; nothing is dropped.
MOST_DEPTH = 512

_NODE = "parent: int, leave: int, tag: string, cls: string, id: string, role: string, href: string, hidden: boolean, dialog: boolean, author: boolean, video: boolean, table: int, span: int, filled: boolean, as_p: boolean, first_run: int, last_run: int, begin: int, end: int"
_RUN = "node: int, start: int, length: int, gap: boolean, commas: int, plain: int"
TREE = f"page_id long, text string, nodes array<struct<{_NODE}>>, runs array<struct<{_RUN}>>"
_COMMA = re.compile(re.sub(r"\\x\{(....)\}", r"\\u\1", COMMAS))
_VIDEO = re.compile(VIDEOS)


class TreeBuilder(HTMLParser):
    """The nodes and text runs of one page.  Unclosed paragraphs, items and cells end where the next one begins, a
    closing tag closes what is open inside its element, and one without an open element is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.runs: list[dict] = []
        self.text: list[str] = []
        self.open: list[int] = []
        self.size, self.gap, self.unseen = 0, False, 0

    def _close(self, at: int) -> None:
        for k in self.open[at:]:
            node = self.nodes[k]
            node["leave"], node["last_run"], node["end"] = len(self.nodes), len(self.runs), self.size
            self.unseen -= node["tag"] in UNSEEN
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        ends, walls = _CLOSES.get(tag, (frozenset(), frozenset()))
        last = None
        for k in range(len(self.open) - 1, -1, -1) if ends else ():
            name = self.nodes[self.open[k]]["tag"]
            if name in walls:
                break
            if name in ends:
                last = k
        if last is not None:
            self._close(last)
        if len(self.open) >= MOST_DEPTH:
            self._close(MOST_DEPTH - 1)
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        style = a.get("style", "").replace(" ", "").lower()
        cls = a.get("class", "")
        unseen = a.get("aria-hidden") == "true" and "fallback-image" not in cls
        table = -1 if a.get("role") == "presentation" or a.get("datatable") == "0" else 1 if a.get("summary") else 0
        span = a.get("colspan" if tag == "td" else "rowspan", "")
        self.nodes.append({
            "parent": self.open[-1] if self.open else -1, "leave": len(self.nodes) + 1, "tag": tag, "cls": cls, "id": a.get("id", ""), "role": a.get("role", ""), "href": a.get("href", ""),
            "hidden": "hidden" in a or unseen or "display:none" in style or "visibility:hidden" in style, "dialog": a.get("aria-modal") == "true" and a.get("role") == "dialog",
            "author": a.get("rel") == "author" or "author" in a.get("itemprop", ""), "video": any(map(_VIDEO.search, a.values())), "table": table,
            "span": int(span) if re.fullmatch("[0-9]{1,4}", span) and int(span) else 1, "filled": False, "first_run": len(self.runs), "last_run": len(self.runs), "begin": self.size, "end": self.size,
        })
        if self.open:
            self.nodes[self.open[-1]]["filled"] = True
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.unseen += tag in UNSEEN

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.nodes[self.open[k]]["tag"] == tag), None)
        if at is not None:
            self._close(at)

    def handle_data(self, data):
        words = data.split()
        if not self.open and words:
            self.handle_starttag("body", [])  # text around all elements is the body's
        if self.open:
            self.nodes[self.open[-1]]["filled"] = True
        if self.unseen or not data:
            return
        if not words:
            self.gap = True
            return
        shown = " ".join(words)
        gap = (self.gap or data[0].isspace()) and self.size > 0
        self.size += gap
        self.runs.append({"node": self.open[-1], "start": self.size, "length": len(shown), "gap": gap, "commas": len(_COMMA.findall(shown)), "plain": shown.count(",")})
        self.text.append(" " + shown if gap else shown)
        self.size += len(shown)
        self.gap = data[-1].isspace()

    def done(self) -> TreeBuilder:
        self.close()
        self._close(0)
        blocks = [False] * (len(self.nodes) + 1)
        for at in range(len(self.nodes) - 1, -1, -1):
            node = self.nodes[at]
            # a div without blocks is a paragraph, whatever goes later
            node["as_p"] = node["tag"] == "p" or (node["tag"] == "div" and not blocks[at])
            blocks[node["parent"]] |= blocks[at] or node["tag"] in _PARTING
        return self


def parse_page(html: str | None) -> TreeBuilder:
    out = TreeBuilder()
    out.feed(html or "")
    return out.done()


_NODES, _RUNS = (
    pa.list_(pa.struct([(n, {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[k]) for n, k in (f.split(": ") for f in ddl.split(", "))])) for ddl in (_NODE, _RUN)
)


#: What a worker holds as trees at a time: pages, and bytes of their html.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches`` in pieces of neighbours that keep within both sizes, or of one row beyond."""
    for batch in batches:
        through = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = through[at - 1] if at else 0
            end = int(np.searchsorted(through, before + PIECE_BYTES, "right"))
            end = max(at + 1, min(end, at + PIECE_ROWS))
            yield batch.slice(at, end - at)
            at = end


def _grown(part: pa.RecordBatch, keep: tuple[str, ...]) -> pa.RecordBatch:
    built = [parse_page(html) for html in part.column("html").to_pylist()]
    columns = [part.column("page_id"), pa.array(["".join(b.text) for b in built], pa.string()), pa.array([b.nodes for b in built], _NODES), pa.array([b.runs for b in built], _RUNS)]
    return pa.RecordBatch.from_arrays([*columns, *map(part.column, keep)], names=["page_id", "text", "nodes", "runs", *keep])


def _plain_pages(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"), *keep)


def page_trees(pages: DataFrame, *keep: str) -> DataFrame:
    """(page_id, text, nodes, runs) of each of ``pages(page_id, html)``, and columns to ``keep``; a null page has none.

    A node is a position in ``nodes``: its parent's position (-1 at the top), the position after its last descendant,
    tag, attributes and marks, and its interval of ``runs``; a run is a place in ``text``, which is kept once.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html"):
            yield _grown(part, keep)

    schema = StructType([*StructType.fromDDL(TREE).fields, *pages.select(*keep).schema.fields])
    return _plain_pages(pages, keep).mapInArrow(build, schema)


class Forest:
    """The trees of a batch end to end; every method gives one value a node."""

    def __init__(self, batch: pa.RecordBatch):
        self.page_id, self.text = batch.column("page_id"), batch.column("text")
        nodes, runs = batch.column("nodes"), batch.column("runs")
        self.per_page = np.diff(nodes.offsets.to_numpy())
        run_count = np.diff(runs.offsets.to_numpy())
        self.page = np.repeat(np.arange(len(self.per_page)), self.per_page)
        self.base = np.concatenate([[0], np.cumsum(self.per_page)]).astype(np.int64)
        run_base = np.concatenate([[0], np.cumsum(run_count)])
        flat, flat_runs = nodes.flatten(), runs.flatten()
        number = lambda s, name: s.field(name).to_numpy(zero_copy_only=False)
        off = self.base[self.page]
        self.n = len(flat)
        self.enter = np.arange(self.n)
        parent = number(flat, "parent").astype(np.int64)
        self.parent = np.where(parent < 0, -1, parent + off)
        self.leave = number(flat, "leave") + off
        self.first_run, self.last_run = number(flat, "first_run") + run_base[self.page], number(flat, "last_run") + run_base[self.page]
        self.tag, self.cls, self.id, self.role, self.href = (flat.field(c) for c in ("tag", "cls", "id", "role", "href"))
        self.begin, self.end = (number(flat, c) for c in ("begin", "end"))
        self.hidden, self.dialog, self.author, self.video, self.table, self.span, self.filled, self.as_p = (number(flat, c) for c in ("hidden", "dialog", "author", "video", "table", "span", "filled", "as_p"))
        self.run_page = np.repeat(np.arange(len(run_count)), run_count)
        self.run_node = number(flat_runs, "node") + self.base[self.run_page]
        self.start, self.length, self.gap, self.run_commas, self.run_plain = (number(flat_runs, c) for c in ("start", "length", "gap", "commas", "plain"))
        self.dead = np.zeros(self.n, bool)
        self.div = self.is_tag("div") & ~self.as_p
        self.names = pc.binary_join_element_wise(self.cls, self.id, " ")

    def is_tag(self, *tags: str) -> np.ndarray:
        return pc.is_in(self.tag, pa.array(tags)).to_numpy(zero_copy_only=False)

    def like(self, column: pa.Array, pattern: str) -> np.ndarray:
        return pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)

    def inside(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over each node's living descendants."""
        total = np.concatenate([[0], np.cumsum(np.where(self.dead, 0, values))])
        return total[self.leave] - total[self.enter + 1]

    def under(self, mask: np.ndarray, itself: bool) -> np.ndarray:
        """Whether a node has an ancestor in ``mask``, or is in it, if ``itself``."""
        depth = np.zeros(self.n + 1, np.int64)
        np.add.at(depth, self.enter[mask] + (not itself), 1)
        np.add.at(depth, self.leave[mask], -1)
        return np.cumsum(depth)[:-1] > 0

    def near(self, mask: np.ndarray, levels: int = 4) -> np.ndarray:
        """Whether one of a node's nearest ``levels`` ancestors is in ``mask``."""
        out, up = np.zeros(self.n, bool), self.parent
        for _ in range(levels):
            out |= (up >= 0) & mask[up]
            up = np.where(up >= 0, self.parent[up], -1)
        return out

    def kill(self, mask: np.ndarray) -> None:
        """Takes the nodes of ``mask`` out with all that is under them."""
        self.dead |= self.under(mask & ~self.dead, itself=True)

    def chars(self) -> np.ndarray:
        """Characters of each node's living text, white space at its ends left out."""
        alive = np.flatnonzero(~self.dead[self.run_node])
        gaps = np.cumsum(self.gap)[alive]
        joint = np.diff(gaps, prepend=0) > 0
        total = np.concatenate([[0], np.cumsum(self.length[alive] + joint)])
        a, b = np.searchsorted(alive, self.first_run), np.searchsorted(alive, self.last_run)
        lead = np.concatenate([joint, [False]])[np.minimum(a, len(joint))]
        return np.where(b > a, total[b] - total[a] - lead, 0)

    def starts(self) -> np.ndarray:
        """Where each node's living text begins, -1 without any."""
        alive = np.flatnonzero(~self.dead[self.run_node])
        a, b = np.searchsorted(alive, self.first_run), np.searchsorted(alive, self.last_run)
        return np.where(b > a, np.concatenate([self.start[alive], [0]])[a], -1)

    def commas(self, per_run: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(np.where(self.dead[self.run_node], 0, per_run))])
        return total[self.last_run] - total[self.first_run]

    def link_density(self, chars: np.ndarray) -> np.ndarray:
        weight = np.where(self.like(self.href, "^#."), 0.3, 1.0)
        return self.inside(np.where(self.is_tag("a"), chars * weight, 0.0)) / np.maximum(chars, 1)

    def weight(self) -> np.ndarray:
        """25 for each of class and id that looks like content, less 25 for each that looks like clutter."""
        return sum(25 * (self.like(c, POSITIVE).astype(int) - self.like(c, NEGATIVE)) for c in (self.cls, self.id))

    def drop_unlikely(self, strict: np.ndarray | bool = True) -> None:
        clutter = self.like(self.names, UNLIKELY) & ~self.like(self.names, MAYBE) & ~self.is_tag("body", "html", "a")
        clutter &= ~self.near(self.is_tag("table")) & ~self.near(self.is_tag("code"))
        self.kill(self.hidden | self.dialog | (strict & (clutter | pc.is_in(self.role, pa.array(UNLIKELY_ROLES)).to_numpy(zero_copy_only=False))))

    def scores(self, weigh: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a block scores for a node, the node's score, and its characters."""
        chars = self.chars()
        blocks = np.flatnonzero((self.is_tag(*SCORED) | self.as_p) & (chars >= 25) & ~self.dead)
        points = 2 + self.commas(self.run_commas)[blocks] + np.minimum(chars[blocks] // 100, 3)
        given, scored = np.zeros(self.n), np.zeros(self.n, bool)
        up, top = self.parent[blocks], self.is_tag("html")
        for level in range(5):
            has = (up >= 0) & ~top[up]
            np.add.at(given, up[has], points[has] / (1 if level == 0 else 2 if level == 1 else level * 3))
            scored[up[has]] = True
            up = np.where(up >= 0, self.parent[up], -1)
        start = np.zeros(self.n)
        for tag, value in TAG_START.items():
            start[self.div if tag == "div" else self.is_tag(tag)] = value
        return scored, given + start + np.where(weigh, self.weight(), 0), chars

    def data_tables(self) -> np.ndarray:
        """Tables that hold data rather than layout: by attributes, caption, marker tags, no table inside, then size."""
        table, tr, td = self.is_tag("table"), self.is_tag("tr"), self.is_tag("td")
        out = table & (self.table == 0) & ((self.inside(self.is_tag(*DATA_TABLE_TAGS)) > 0) | self._first_caption_filled(table))
        sized = table & (self.table == 0) & ~out & (self.inside(table) == 0)
        rows = self.inside(np.where(tr, self.span, 0))
        wide = np.where(tr, self.inside(np.where(td, self.span, 0)), 0)
        at = np.flatnonzero(sized)
        columns = np.zeros(self.n, np.int64)
        # tables of this kind hold no other, so their rows are dealt to them once
        rowed = np.flatnonzero(tr & ~self.dead)
        if len(at) and len(rowed):
            own = np.searchsorted(at, rowed, "right") - 1
            ok = (own >= 0) & (self.leave[at[own]] > rowed)
            np.maximum.at(columns, at[own[ok]], wide[rowed[ok]])
        return out | (table & (self.table == 1)) | (sized & ((rows >= 10) | (columns > 4) | (rows * columns > 10)))

    def _first_caption_filled(self, table: np.ndarray) -> np.ndarray:
        caption = np.flatnonzero(self.is_tag("caption") & ~self.dead)
        if not len(caption):
            return np.zeros(self.n, bool)
        first = caption[np.minimum(np.searchsorted(caption, self.enter, "right"), len(caption) - 1)]
        return table & (first > self.enter) & (first < self.leave) & self.filled[first]

    def clean_conditionally(self, tags: tuple[str, ...] = CLEANED) -> None:
        """Takes out blocks that look like clutter, tag by tag, inner ones before what is around them."""
        data, weight = self.data_tables(), self.weight()
        spared, figure = self.under(data, itself=False) | self.near(self.is_tag("code")), self.near(self.is_tag("figure"))
        counted = {name: self.is_tag(*own) for name, own in (("img", ("img",)), ("li", ("li",)), ("input", ("input",)), ("head", HEADINGS), ("list", ("ul", "ol")), ("embed", ("object", "embed", "iframe")))}
        video = counted["embed"] & self.video
        for tag in tags:
            asked = (self.div if tag == "div" else self.is_tag(tag)) & ~spared
            if tag == "table":
                asked &= ~data
            while True:
                chars = self.chars()
                n = {name: self.inside(own) for name, own in counted.items() if name not in ("head", "list")}
                p = self.inside(self.as_p)
                size = np.maximum(chars, 1)
                heading = np.where(chars > 0, self.inside(np.where(counted["head"], chars, 0)) / size, 0)
                is_list = (tag in ("ul", "ol")) | ((chars > 0) & (self.inside(np.where(counted["list"], chars, 0)) / size > 0.9))
                links = self.link_density(chars)
                remove = (
                    ((n["img"] > 1) & (p / np.maximum(n["img"], 1) < 0.5) & ~figure) | (~is_list & (n["li"] - 100 > p)) | (n["input"] > p // 3)
                    | (~is_list & (heading < 0.9) & (chars < 25) & ((n["img"] == 0) | (n["img"] > 2)) & ~figure)
                    | (~is_list & (weight < 25) & (links > 0.2)) | ((weight >= 25) & (links > 0.5)) | ((n["embed"] == 1) & (chars < 75)) | (n["embed"] > 1)
                )
                # a list of one image an item may stay
                children = np.bincount(self.parent[(self.parent >= 0) & ~self.dead], minlength=self.n)
                crowded = np.zeros(self.n, bool)
                child = np.flatnonzero((self.parent >= 0) & ~self.dead & (children > 1))
                crowded[self.parent[child]] = True
                remove &= ~(is_list & ~crowded & (n["img"] == n["li"]))
                remove &= (self.commas(self.run_plain) < 10) & (self.inside(video) == 0)
                flagged = asked & ~self.dead & ((weight < 0) | remove)
                # what is inside goes first: it may change what is around it
                inner = flagged & (self.inside(flagged) == 0)
                if not inner.any():
                    break
                self.kill(inner)

    def texts(self, nodes: np.ndarray) -> list[str]:
        """The living text of each of some nodes."""
        out = []
        pages, dead = self.text.to_pylist(), self.dead
        gaps = np.cumsum(self.gap)
        for v in nodes.tolist():
            runs = np.arange(self.first_run[v], self.last_run[v])
            runs = runs[~dead[self.run_node[runs]]]
            page = pages[self.page[v]]
            parts, before = [], None
            for r in runs.tolist():
                if before is not None and gaps[r] > gaps[before]:
                    parts.append(" ")
                parts.append(page[self.start[r] : self.start[r] + self.length[r]])
                before = r
            out.append("".join(parts))
        return out

    def best(self, n: int, weigh: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with the ``n`` best scores of each page, their places from 1, and all scores less link density."""
        scored, score, chars = self.scores(weigh)
        final = np.round(score * (1 - self.link_density(chars)), 6)
        at = np.flatnonzero(scored & ~self.dead)
        at = at[np.lexsort((at, -final[at], self.page[at]))]
        place = np.arange(len(at)) - np.searchsorted(self.page[at], self.page[at]) + 1
        keep = place <= n
        return at[keep], place[keep], final

    def bylines(self) -> tuple[np.ndarray, list[str]]:
        """Each page's first author-like node of 1 to 99 characters, and its text."""
        chars = self.chars()
        named = np.flatnonzero((self.author | self.like(self.names, BYLINE)) & (chars > 0) & (chars < 100))
        _, first = np.unique(self.page[named], return_index=True)
        return named[first], self.texts(named[first])

    def local(self, nodes: np.ndarray) -> np.ndarray:
        return nodes - self.base[self.page[nodes]]

    def page_ids(self, nodes: np.ndarray) -> pa.Array:
        return self.page_id.take(pa.array(self.page[nodes]))


def by_batch(pages: DataFrame, rule: Callable[[Forest], list], schema: str, *keep: str) -> DataFrame:
    """The columns that ``rule`` gives for each batch of pages; one row a page where columns are kept.

    ``pages`` are pages with html, trees, or rows of nodes, which come together by page first.  Trees of pages with html
    are grown and judged by the same worker, a piece at a time, so they never travel and no batch of them is held.
    """
    names = StructType.fromDDL(schema).names
    html = "html" in pages.columns
    trees = _plain_pages(pages, keep) if html else pages if "nodes" in pages.columns else regrown(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "html" if html else "text"):
            columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in rule(Forest(_grown(part, ()) if html else part))]
            yield pa.RecordBatch.from_arrays([*columns, *map(part.column, keep)], names=[*names, *keep])

    return trees.mapInArrow(run, StructType([*StructType.fromDDL(schema).fields, *trees.select(*keep).schema.fields]))


_MARKS = ("dialog", "author", "video", "table", "span", "filled", "as_p", "begin", "end")
_OWN = "array<struct<start: int, gap: boolean, commas: int, plain: int, text: string>>"
_ROW = (
    "page_id long, node_id int, parent_id int, leave int, tag string, cls string, id string, role string, hidden boolean, href string, start int, length int, link_density double, commas int, "
    f"marks struct<dialog: boolean, author: boolean, video: boolean, table: int, span: int, filled: boolean, as_p: boolean, begin: int, end: int>, own {_OWN}"
)


def _rows(f: Forest) -> list:
    """The living nodes as rows; texts of their own runs, and white space that dead ones leave behind."""
    at = np.flatnonzero(~f.dead)
    chars = f.chars()
    take = lambda c: c.take(pa.array(at))
    parent = np.where(f.parent[at] < 0, -1, f.parent[at] - f.base[f.page[at]])
    leave = f.leave[at] - f.base[f.page[at]]
    runs = np.flatnonzero(~f.dead[f.run_node])
    gap = np.diff(np.cumsum(f.gap)[runs], prepend=0) > 0
    order = np.argsort(f.run_node[runs], kind="stable")
    runs, gap = runs[order], gap[order]
    texts = f.text.to_pylist()
    shown = [texts[p][a : a + n] for p, a, n in zip(f.run_page[runs].tolist(), f.start[runs].tolist(), f.length[runs].tolist(), strict=True)]
    fields = {"start": pa.array(f.start[runs], pa.int32()), "gap": pa.array(gap), "commas": pa.array(f.run_commas[runs], pa.int32()), "plain": pa.array(f.run_plain[runs], pa.int32()), "text": pa.array(shown, pa.string())}
    bounds = np.concatenate([[0], np.cumsum(np.bincount(f.run_node[runs], minlength=f.n)[at])]) if f.n else np.zeros(1)
    own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    marks = pa.StructArray.from_arrays([pa.array(getattr(f, c)[at]) for c in _MARKS], list(_MARKS))
    return [
        f.page_ids(at), f.local(at).astype(np.int32), parent.astype(np.int32), leave.astype(np.int32), *map(take, (f.tag, f.cls, f.id, f.role)), f.hidden[at], take(f.href), f.starts()[at].astype(np.int32),
        chars[at].astype(np.int32), f.link_density(chars)[at], f.commas(f.run_commas)[at].astype(np.int32), marks, own,
    ]


def regrown(rows: DataFrame) -> DataFrame:
    """The trees of rows of ``html_nodes`` from which whole subtrees may be missing, numbered anew: one shuffle by page."""
    node = F.struct("node_id", "parent_id", "leave", "tag", "cls", "id", "role", "hidden", "href", "marks", "own")
    pages = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(node)).alias("rows"))

    def one(page: list[dict]) -> tuple[str, list[dict], list[dict]]:
        ids = [r["node_id"] for r in page]
        place = {number: at for at, number in enumerate(ids)}
        runs = sorted(({**run, "node": at} for at, r in enumerate(page) for run in r["own"]), key=lambda run: run["start"])
        starts, text, size = [run["start"] for run in runs], [], 0
        for run in runs:
            run["gap"] &= size > 0
            text.append(" " * run["gap"] + run.pop("text"))
            run["start"], run["length"] = size + run["gap"], len(text[-1]) - run["gap"]
            size += len(text[-1])
        nodes = []
        for r in page:
            marks = r["marks"]
            first, last = bisect_left(starts, marks["begin"]), bisect_left(starts, marks["end"])
            edge = lambda k: runs[k]["start"] - runs[k]["gap"] if k < len(runs) else size
            nodes.append({**r, **marks, "parent": place.get(r["parent_id"], -1), "leave": bisect_left(ids, r["leave"]), "first_run": first, "last_run": last, "begin": edge(first), "end": edge(last)})
        return "".join(text), nodes, runs

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text, nodes, runs = zip(*map(one, part.column("rows").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(text, pa.string()), pa.array(nodes, _NODES), pa.array(runs, _RUNS)], names=["page_id", "text", "nodes", "runs"])

    return pages.mapInArrow(build, TREE)


def html_nodes(pages: DataFrame) -> DataFrame:
    """One row for each element: ids in document order, the id after its last descendant, attributes, and where its
    text lies in the page's (-1 and 0 without any).  ``own`` has the texts that are in no element below, so that all
    rows of a page together hold its text once.  Pages, trees or rows come in, as in all operators here."""
    return by_batch(pages, _rows, _ROW)


def drop_unlikely(pages: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of ``html_nodes`` without hidden nodes and, if ``strict``, ones whose class, id or role marks clutter, unless
    they are near inside a table or code; descendants go along, lengths are of what is left."""

    def rule(f: Forest) -> list:
        f.drop_unlikely(strict)
        return _rows(f)

    return by_batch(pages, rule, _ROW)


def byline(pages: DataFrame) -> DataFrame:
    """page_id, byline: the first author-like node's text of 1 to 99 characters."""

    def rule(f: Forest) -> list:
        at, lines = f.bylines()
        return [f.page_ids(at), pa.array(lines, pa.string())]

    return by_batch(pages, rule, "page_id long, byline string")


def text_density(pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """page_id, node_id, density: characters of each node's descendants with ``tags`` over its own; nested ones each count."""

    def rule(f: Forest) -> list:
        chars = f.chars()
        density = np.where(chars > 0, f.inside(np.where(f.is_tag(*tags), chars, 0)) / np.maximum(chars, 1), 0.0)
        return [f.page_ids(f.enter), f.local(f.enter).astype(np.int32), density]

    return by_batch(pages, rule, "page_id long, node_id int, density double")


def ancestor_score(pages: DataFrame, weigh_classes: bool = True) -> DataFrame:
    """page_id, node_id, score: what scored blocks give up to five ancestors (all, half, then a third of the level) on
    top of the ancestors' own start by tag and class.  A div without blocks in it is a paragraph."""

    def rule(f: Forest) -> list:
        scored, score, _ = f.scores(weigh_classes)
        at = np.flatnonzero(scored)
        return [f.page_ids(at), f.local(at).astype(np.int32), score[at]]

    return by_batch(pages, rule, "page_id long, node_id int, score double")


def top_candidates(pages: DataFrame, n: int = 5, weigh_classes: bool = True) -> DataFrame:
    """The ``n`` best nodes of each page by score × (1 − link density); ties to the earlier node."""

    def rule(f: Forest) -> list:
        at, place, final = f.best(n, weigh_classes)
        return [f.page_ids(at), place.astype(np.int32), f.local(at).astype(np.int32), f.tag.take(pa.array(at)), final[at], pa.array(f.texts(at), pa.string())]

    return by_batch(pages, rule, "page_id long, place int, node_id int, tag string, final double, text string")


def clean_conditionally(pages: DataFrame, tags: tuple[str, ...] = CLEANED) -> DataFrame:
    """Rows of ``html_nodes`` without blocks of ``tags`` that look like clutter by weight, commas and the mix of what they
    hold.  Data tables and what is in them, code, figures, allowed videos and lists of images stay."""

    def rule(f: Forest) -> list:
        f.clean_conditionally(tags)
        return _rows(f)

    return by_batch(pages, rule, _ROW)


def ladder(f: Forest, least: int = 500) -> tuple[np.ndarray, list[str]]:
    """The attempt that counts (-1: none) and its text for every page of a batch."""
    pages = len(f.per_page)
    attempt, text, longest = np.full(pages, -1), [""] * pages, np.full(pages, -1)
    done = np.zeros(pages, bool)
    for k in range(4):
        f.dead = done[f.page]
        f.drop_unlikely(k == 0)
        if k < 3:
            f.clean_conditionally()
        at, _, _ = f.best(1, k < 2)
        size = f.chars()[at]
        for v, n, own in zip(at.tolist(), size.tolist(), f.texts(at), strict=True):
            page = f.page[v]
            done[page] = n >= least
            if done[page] or n > longest[page]:
                attempt[page], text[page], longest[page] = k, own, n
        if done.all():
            break
    return attempt, text


def extract_ladder(pages: DataFrame, least: int = 500) -> DataFrame:
    """page_id, attempt, text: the best candidate of the strictest of four attempts that leaves ``least`` characters;
    where none does, the longest, the stricter of equal ones.  Attempts relax clutter removal, class weights, then
    conditional cleaning, which comes before the scores.  Pages without a scored block are left out."""

    def rule(f: Forest) -> list:
        attempt, text = ladder(f, least)
        at = np.flatnonzero(attempt >= 0)
        return [f.page_id.take(pa.array(at)), attempt[at].astype(np.int32), pa.array([text[i] for i in at], pa.string())]

    return by_batch(pages, rule, "page_id long, attempt int, text string")
