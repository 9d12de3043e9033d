"""Event frames: typed views, gates, page state, prefetch, change detection and throttling.

Frames are (conn, seq, ts, type, …).  Everything here is the batch form; ``readlake.streaming`` runs the same rules on
streams.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from readlake.operators.scans import with_previous
from readlake.scratch import written

# One schema for all frame kinds; what a kind lacks is null.
FRAME_SCHEMA = (
    "type string, id string, kind string, page int, pages int, device string, screen struct<width:int,height:int,dpi:int>, grayscale int, color boolean, protocol int, "
    "renderer array<string>, x double, y double, x2 double, y2 double, text string, title string, body string"
)


def _conn() -> WindowSpec:
    return Window.partitionBy("conn").orderBy("seq")


def _so_far() -> WindowSpec:
    return _conn().rowsBetween(Window.unboundedPreceding, 0)


def parse_frames(lines: DataFrame, json: str = "json") -> DataFrame:
    """Typed columns of JSON text frames; malformed lines and ones without a type are dropped."""
    rest = [c for c in lines.columns if c != json]
    typed = lines.select(*rest, F.from_json(json, FRAME_SCHEMA).alias("f")).where("f.type is not null")
    return typed.select(*rest, "f.*")


def parse_events(frames: DataFrame, known: tuple[str, ...] = ("hello", "content.begin", "nav", "rendered", "page", "state", "touch", "chat.ask")) -> DataFrame:
    """Frames of known types with the event they stand for: state-like kinds share one, pages only where they count."""
    event = F.when(F.col("type").isin("state", "rendered", "nav"), "receipt").when(F.col("type") == "chat.ask", "ask").when(F.col("type") == "content.begin", "begin").otherwise(F.col("type"))
    return frames.where(F.col("type").isin(*known)).withColumn("event", event)


def hello_caps(width: Column, height: Column, grayscale: Column, profile: str = "ios") -> list[Column]:
    """Capabilities with their defaults; grey levels within 2 and 256 (iOS) or 16 (Android)."""
    most = 256 if profile == "ios" else 16
    return [F.coalesce(width, F.lit(1404)).alias("width"), F.coalesce(height, F.lit(1872)).alias("height"), F.greatest(F.least(F.coalesce(grayscale, F.lit(16)), F.lit(most)), F.lit(2)).alias("grayscale")]


def handshake_gate(frames: DataFrame) -> DataFrame:
    """Frames of a connection from its first hello on."""
    said = F.max((F.col("type") == "hello").cast("int")).over(_so_far())
    return frames.withColumn("_said", said).where("_said = 1").drop("_said")


def pair_page_binary(frames: DataFrame) -> DataFrame:
    """conn, seq, meta_seq: each binary frame with the page frame right before it; a newer page frame takes an unused
    one's place, and each is used once."""
    both = frames.where(F.col("type").isin("page", "binary"))
    before = both.withColumns({"before": F.lag("type").over(_conn()), "meta_seq": F.lag("seq").over(_conn())})
    return before.where("type = 'binary' and before = 'page'").select("conn", "seq", "meta_seq")


def current_content(frames: DataFrame) -> DataFrame:
    """Receipts whose content id is the one begun last on their connection."""
    begun = F.last(F.when(F.col("type") == "content.begin", F.col("content_id")), ignorenulls=True).over(_so_far())
    return frames.withColumn("current", begun).where((F.col("type") == "rendered") & (F.col("content_id") == F.col("current"))).drop("current")


def page_state(frames: DataFrame) -> DataFrame:
    """The latest page of each connection and content."""
    return frames.where(F.col("type").isin("rendered", "nav")).groupBy("conn", "content_id").agg(F.max_by(F.struct("page", "seq"), "seq").alias("s")).select("conn", "content_id", "s.page", "s.seq")


def clamp_page(page: Column, pages: Column) -> Column:
    return F.greatest(F.least(page, pages - 1), F.lit(0))


def prefetch_pages(views: DataFrame, sent: DataFrame, pages: Column | int) -> DataFrame:
    """conn, page, priority: the current page, the next, the one before and the one after next, unless sent."""
    total = F.lit(pages) if isinstance(pages, int) else pages
    offer = F.posexplode(F.array(F.col("page"), F.col("page") + 1, F.col("page") - 1, F.col("page") + 2)).alias("priority", "wanted")
    near = views.withColumn("_pages", total).select("conn", "_pages", offer).where((F.col("wanted") >= 0) & (F.col("wanted") < F.col("_pages")))
    return near.select("conn", F.col("wanted").alias("page"), "priority").join(sent.select("conn", "page"), ["conn", "page"], "left_anti")


def evict_pages(cached: DataFrame, views: DataFrame, near: int = 3) -> DataFrame:
    """Cached pages within ``near`` of the connection's current page."""
    now = views.select("conn", F.col("page").alias("now"))
    return cached.join(now, "conn").where(F.abs(F.col("page") - F.col("now")) <= near).drop("now")


def keep_ratio(page: Column, pages: Column, new_pages: Column) -> Column:
    """The page at the same place in a new page count; halves round up."""
    ratio = F.when(pages > 1, page / (pages - 1)).otherwise(0.0)
    return F.greatest(F.least(F.floor(ratio * (new_pages - 1) + 0.5), new_pages - 1), F.lit(0)).cast("int")


def frame_diff(frames: DataFrame, order: str, value: str, over: int, share: float | None = None, cells: int | None = None) -> DataFrame:
    """Frames (arrays of grey values) with ``changed``: more than ``share`` of the samples, or ``cells`` of them or
    more, differ by more than ``over``.  The first frame, and one of another size, counts as changed.

    The frame before comes from a scan over ranges, so that a stream of any length spreads over tasks.
    """
    pair = with_previous(frames, ["stream"], [order], value, "_before")
    apart = F.aggregate(F.zip_with(value, "_before", lambda a, b: (F.abs(a - b) > over).cast("int")), F.lit(0), lambda n, x: n + x)
    enough = apart > share * F.size(value) if share is not None else apart >= cells
    fresh = F.col("_before").isNull() | (F.size("_before") != F.size(value))
    return pair.withColumn("changed", F.when(fresh, True).otherwise(enough)).drop("_before")


class Throttle:
    """The sends of a run of frames in order of time, from whatever was sent before it.

    A frame is sent when none is in flight (its receipt came, or ``wait`` passed) and ``gap`` has passed since the last
    one.  After a send the state is the same whatever came before, so a run is a set of chains: each frame leads to
    the next that would be sent after it, and the state before the run only picks the frame where it enters.
    """

    def __init__(self, ms: np.ndarray, receipt: np.ndarray, gap: int, wait: int):
        self.ms, self.gap, self.late, self.n = ms, gap, max(gap, wait + 1), len(ms)
        at = np.arange(self.n + 1)
        ahead = lambda mask: np.minimum.accumulate(np.append(np.where(mask, at[:-1], self.n), self.n)[::-1])[::-1]
        self.next_frame, self.next_receipt = ahead(~receipt), ahead(receipt)

    def after(self, last: int, busy: bool, at: int) -> int:
        """The first frame from position ``at`` on that is sent, or the run's length."""
        free = at
        if busy:
            free = int(self.next_receipt[at])
            timed_out = int(self.next_frame[max(at, int(np.searchsorted(self.ms, last + self.late)))])
        else:
            timed_out = self.n
        return min(timed_out, int(self.next_frame[max(free, int(np.searchsorted(self.ms, last + self.gap)))]))

    def end(self, last: int, busy: bool, at: int) -> tuple[int, bool]:
        """The state when nothing is sent from ``at`` on."""
        return last, busy and int(self.next_receipt[at]) == self.n

    def sends(self, last: int | None, busy: bool) -> np.ndarray:
        """The positions of frames sent."""
        at = int(self.next_frame[0]) if last is None else self.after(last, busy, 0)
        out = []
        while at < self.n:
            out.append(at)
            at = self.after(int(self.ms[at]), True, at + 1)
        return np.array(out, np.int64)

    def entries(self) -> list[dict]:
        """Every frame at which some earlier state could enter, with the state that it leads to at the end."""
        ends: dict[int, tuple[int, bool]] = {}
        out = []
        at = int(self.next_frame[0])
        while at < self.n:
            chain, now = [], at
            while now < self.n and now not in ends:
                chain.append(now)
                now = self.after(int(self.ms[now]), True, now + 1)
            final = ends.get(now) or self.end(int(self.ms[chain[-1]]), True, chain[-1] + 1)
            ends.update(dict.fromkeys(chain, final))
            out.append({"ms": int(self.ms[at]), "free": int(self.next_receipt[0]) < at, "last": final[0], "busy": final[1]})
            if self.ms[at] >= self.ms[0] + self.late:  # open to any state
                break
            at = int(self.next_frame[at + 1])
        return out


_THROTTLED = "conn long, seq long, ms long, receipt boolean, sent boolean, part int, entries array<struct<ms: long, free: boolean, last: long, busy: boolean>>, any_receipt boolean"


def ack_throttle(frames: DataFrame, gap_ms: int = 500, wait_ms: int = 1200) -> DataFrame:
    """conn, seq, sent for every live frame: one is in flight until its receipt or ``wait_ms``, and two are ``gap_ms``
    apart.  Frames without connection or time have no place in the order and are left out.

    A connection's frames are cut into ranges of time.  Each range is a function of the state before it, small because
    only frames of its first moments can be where a state enters; the functions are applied one after another, and
    the ranges that another state reaches run again from it.  So one busy connection spreads over tasks.
    """
    rows = frames.where("conn is not null and ms is not null").select(F.col("conn").cast("long"), F.col("seq").cast("long"), F.col("ms").cast("long"), F.coalesce(F.col("type") == "rendered", F.lit(False)).alias("receipt"))

    throttled, done = to_arrow_schema(StructType.fromDDL(_THROTTLED)), "conn long, seq long, receipt boolean, sent boolean"
    resumed = to_arrow_schema(StructType.fromDDL(done))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for conn, table in _runs(batches, ["conn"]):
            ms, receipt = table.column("ms").to_numpy(), table.column("receipt").to_numpy()
            run = Throttle(ms, receipt, gap_ms, wait_ms)
            sent = np.zeros(len(ms), bool)
            sent[run.sends(None, False)] = True
            yield _columns(throttled, conn=table.column("conn"), seq=table.column("seq"), ms=table.column("ms"), receipt=table.column("receipt"), sent=sent, part=np.full(len(ms), part))
            yield _columns(throttled, conn=conn, part=[part], entries=[run.entries()], any_receipt=[bool(receipt.any())])

    keys = ["conn", "ms", "seq"]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(ranges, _THROTTLED))
    maps = placed.where("entries is not null").select("conn", "part", "entries", "any_receipt")
    several = maps.groupBy("conn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conn")

    def follow(ranges: pd.DataFrame) -> pd.DataFrame:
        last, busy, out = None, False, []
        for row in ranges.sort_values("part").itertuples(index=False):
            out.append((row.conn, row.part, last, busy))
            entry = next((e for e in row.entries if last is None or e["ms"] >= last + (gap_ms if e["free"] or not busy else max(gap_ms, wait_ms + 1))), None)
            last, busy = (entry["last"], entry["busy"]) if entry else (last, busy and not row.any_receipt)
        return pd.DataFrame(out, columns=["conn", "part", "last", "busy"]).astype({"last": "Int64"})

    # a row for each range of a connection that has several
    states = maps.join(several, "conn").groupBy("conn").applyInPandas(follow, "conn long, part int, last long, busy boolean").where("last is not null")
    states = written(states)
    first = placed.where("entries is null").join(states, ["conn", "part"], "left_anti").select("conn", "seq", "receipt", "sent")
    again = placed.where("entries is null").join(states, ["conn", "part"]).select("conn", "part", "seq", "ms", "receipt", "last", "busy")

    def resume(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in _runs(batches, ["conn", "part"]):
            run = Throttle(table.column("ms").to_numpy(), table.column("receipt").to_numpy(), gap_ms, wait_ms)
            sent = np.zeros(table.num_rows, bool)
            sent[run.sends(table.column("last")[0].as_py(), table.column("busy")[0].as_py())] = True
            yield _columns(resumed, conn=table.column("conn"), seq=table.column("seq"), receipt=table.column("receipt"), sent=sent)

    later = again.repartition("conn", "part").sortWithinPartitions("conn", "part", "ms", "seq").mapInArrow(resume, done)
    return first.unionByName(later).where("not receipt").select("conn", "seq", "sent")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list, pa.Table]]:
    """The key and rows of each stretch of a partition with equal ``keys``, none of them null."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            own = batch.column(k).to_numpy()
            change[1:] |= own[1:] != own[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in itertools.pairwise(edges):
            key = [batch.column(k)[a].as_py() for k in keys]
            if key != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _columns(schema: pa.Schema, **values) -> pa.RecordBatch:
    """A batch of the given columns, nulls in the others."""
    n = len(next(iter(values.values())))
    made = []
    for f in schema:
        v = values.get(f.name)
        v = pa.nulls(n, f.type) if v is None else v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v, f.type)
        made.append(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)
    return pa.RecordBatch.from_arrays(made, schema=schema)


def drop_on_backlog(frames: DataFrame, queued: str, most: int = 256 * 1024) -> DataFrame:
    return frames.withColumn("kept", F.col(queued) <= most)


def full_refresh_marks(shown: DataFrame, every: int = 24) -> DataFrame:
    """Shown frames with ``full``: each ``every``-th of a connection."""
    return shown.withColumn("full", F.row_number().over(_conn()) % every == 0)


def live_sessions(frames: DataFrame) -> DataFrame:
    """conn, session, frames, shown: a begin opens a session; what comes before any begin is left out."""
    session = F.sum((F.col("type") == "content.begin").cast("int")).over(_so_far())
    return frames.withColumn("session", session).where("session > 0").groupBy("conn", "session").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("type") == "rendered").alias("shown"))


def replay_latest(frames: DataFrame, topics: tuple[str, ...] = ("hello", "content.begin")) -> DataFrame:
    """The last frame of each topic that late subscribers get."""
    return frames.where(F.col("type").isin(*topics)).groupBy("type").agg(F.max_by(F.struct("conn", "seq"), "seq").alias("s")).select("type", "s.*")


def connection_count(changes: DataFrame, hours: int = 1) -> DataFrame:
    """ts, seq, open: connections open after each change (+1 or −1).

    A running sum over all changes in time order: sums per time bucket first, then within buckets, so that only one
    row a bucket passes through a single task.
    """
    bucket = F.date_trunc("hour" if hours == 1 else "day", "ts")
    rows = changes.withColumn("_b", bucket)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_b").agg(F.sum("change").alias("s")).select("_b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("_b").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, "_b").withColumn("open", F.col("base") + F.sum("change").over(within)).select("ts", "seq", "open")


def reconnect_schedule(attempts: DataFrame) -> DataFrame:
    """Failed attempts with the wait before the next: 2 s doubled with each failure since the last hello, 15 s at most."""
    hellos = F.sum((F.col("type") == "hello").cast("int")).over(_so_far())
    fails = attempts.withColumn("_h", hellos).where("type = 'error'")
    n = F.row_number().over(Window.partitionBy("conn", "_h").orderBy("seq"))
    return fails.withColumn("failures", n).withColumn("delay", F.least(F.lit(15), F.expr("shiftleft(2, least(failures, 3))"))).drop("_h")


def job_status(polls: DataFrame, limit_s: int) -> DataFrame:
    """job, state: done, failed, or timeout when the last poll is ``limit_s`` or more after the first; else running."""
    sums = polls.groupBy("job").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    late = F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp")) >= limit_s * 1_000_000
    return sums.select("job", F.when(F.col("state").isin("done", "failed"), F.col("state")).when(late, "timeout").otherwise("running").alias("state"))


def touch_kind(x: Column, y: Column, x2: Column, y2: Column, width: int, height: int, move: float = 40.0) -> Column:
    """tap or swipe by how far the finger moved in pixels; a tap outside the screen is dropped (null)."""
    far = F.sqrt(F.pow((F.coalesce(x2, x) - x) * width, F.lit(2)) + F.pow((F.coalesce(y2, y) - y) * height, F.lit(2)))
    inside = x.between(0, 1) & y.between(0, 1)
    return F.when(far > move, "swipe").when(inside, "tap")


def touch_to_source(x: Column, y: Column, view: tuple[int, int], source: tuple[int, int], rotated: bool = False) -> tuple[Column, Column]:
    """A touch on the view as a point of the source picture that was fitted into it; null in the margins."""
    sw, sh = source[::-1] if rotated else source
    scale = min(view[0] / sw, view[1] / sh)
    u, v = (x * view[0] - (view[0] - sw * scale) / 2) / scale, (y * view[1] - (view[1] - sh * scale) / 2) / scale
    inside = (u >= 0) & (u < sw) & (v >= 0) & (v < sh)
    a, b = (v, F.lit(float(sw)) - u) if rotated else (u, v)
    return F.when(inside, a), F.when(inside, b)


def tap_action(x: Column, profile: str = "app", rtl: bool = False) -> Column:
    low, high = (0.40, 0.60) if profile == "app" else (0.35, 0.65)
    back, ahead = ("next", "prev") if rtl else ("prev", "next")
    return F.when(x < low, back).when(x > high, ahead).otherwise("panel")


def swipe_action(dx: Column, dy: Column, rtl: bool = False) -> Column:
    """A page turn when the swipe goes along more than 1.5 times across and more than 0.08; else nothing (null)."""
    turn = (F.abs(dx) > 1.5 * F.abs(dy)) & (F.abs(dx) > 0.08)
    return F.when(turn & ((dx < 0) != F.lit(rtl)), "next").when(turn, "prev")
