"""Scans over ranges: owners with most of the rows, and what is built on them."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.functions import text
from readlake.operators import events, pixels, rebuild, scans


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables stay in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows(spark):
    """One owner with most of the rows, small ones, one with a null name, null texts, an extra column named like a sum."""
    rng = random.Random(1)
    out = [("hot", k, "x" * rng.randint(0, 9), -1) for k in range(3000)] + [(f"o{k % 40}", k, "y" * rng.randint(0, 5), -2) for k in range(400)] + [(None, k, "z", -3) for k in range(50)] + [("hot", 5000, None, -4)]
    rng.shuffle(out)
    return out, spark.createDataFrame(out, "owner string, pos long, text string, rank int").repartition(7)


def by_owner(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_sums(rows):
    data, df = rows
    got = {(r["owner"], r["pos"]): (r["place"], r["before"], r["before_all"], r["rank"]) for r in scans.running_sums(df, ["owner"], ["pos"], before=F.length("text")).collect()}
    want = {}
    for owner, own in by_owner(data).items():
        total = sum(len(r[2] or "") for r in own)
        so_far = 0
        for place, r in enumerate(own):
            want[owner, r[1]] = (place + 1, so_far, total, r[3])
            so_far += len(r[2] or "")
    assert got == want


def test_one_owner_spreads_over_ranges(rows):
    _, df = rows
    parts = scans.in_ranges(df, ["owner"], ["pos"], lambda batches: ([] for _ in batches), [])
    assert parts.where("owner = 'hot'").select("_part").distinct().count() > 1


def test_previous(rows):
    data, df = rows
    got = {(r["owner"], r["pos"]): r["previous"] for r in scans.with_previous(df.withColumn("text", F.coalesce("text", F.lit("-"))), ["owner"], ["pos"], "text").collect()}
    want = {(o, r[1]): (own[k - 1][2] or "-" if own[k - 1][2] is None else own[k - 1][2]) if k else None for o, own in by_owner(data).items() for k, r in enumerate(own)}
    assert got == want
    none = df.limit(0)
    assert scans.with_previous(none, ["owner"], ["pos"], "text").collect() == [] and scans.running_sums(none, ["owner"], ["pos"], n=F.lit(1)).collect() == []


@pytest.mark.parametrize(("profile", "limit"), [("cut", 500), ("drop", 500), ("fail", 40), ("cut", 0)])
def test_budget(rows, profile, limit):
    data, df = rows
    got = {(r["owner"], r["pos"]): r["text"] for r in rebuild.running_budget(df, "owner", "pos", "text", limit, profile).collect()}
    want = {}
    for owner, own in by_owner(data).items():
        through = 0
        for r in own:
            before, through = through, through + len(r[2] or "")
            if profile == "fail" and sum(len(x[2] or "") for x in own) <= limit:
                want[owner, r[1]] = r[2]
            elif profile == "drop" and through <= limit:
                want[owner, r[1]] = r[2]
            elif profile == "cut" and (before < limit or through == 0):
                want[owner, r[1]] = r[2] and r[2][: limit - before]
    assert got == want


def test_chapters_in_parts_join_to_the_whole(spark):
    rng = random.Random(2)
    chapters = [("book", k, "" if k % 3 else f"t<{k}>", "<p>" + "w" * rng.choice([0, 3, 50, 400]) + "</p>" if k % 7 else "  ") for k in range(120)] + [("one", 1, None, "<h1>own</h1>" + "v" * 1000), ("none", 1, "t", "")]
    df = spark.createDataFrame(chapters, "owner string, pos int, title string, body string").repartition(5)
    whole = {r["owner"]: r["body"] for r in rebuild.assemble_chapters(df, "owner", "pos", "title", "body").collect()}
    parts = {}
    for r in rebuild.assemble_in_parts(df, "owner", "pos", "title", "body", 64).orderBy("owner", "part").collect():
        parts.setdefault(r["owner"], []).append((r["part"], r["body"]))
    assert {o: "".join(b for _, b in own) for o, own in parts.items()} == whole
    for own in parts.values():
        assert [p for p, _ in own] == list(range(len(own))) and {len(b) for _, b in own[:-1]} <= {64}


def fold(frames, gap=500, wait=1200):
    """The rule frame by frame."""
    out, conn = [], object()
    for c, seq, ms, kind in sorted(frames, key=lambda f: (f[0], f[2], f[1])):
        if c != conn:
            conn, last, busy = c, None, False
        if kind == "rendered":
            busy = False
            continue
        if busy and ms - last > wait:
            busy = False
        send = not busy and (last is None or ms - last >= gap)
        if send:
            last, busy = ms, True
        out.append((c, seq, send))
    return sorted(out)


@pytest.mark.parametrize("pace", [3, 40, 700])
def test_throttle_splits_one_connection(spark, pace):
    """A connection with most of the frames, in several ranges, dense and sparse, with and without receipts."""
    rng = random.Random(pace)
    frames, ms = [], 0
    for k in range(6000):
        ms += rng.choice([0, 0, 1, pace, pace * 3])
        if 2000 < k < 2600:
            kind = "page"  # no receipts at all
        elif 3500 < k < 4000:
            kind = "rendered"  # nothing else
        else:
            kind = rng.choice(["page", "page", "rendered"])
        frames.append((1, k, ms, kind))
    frames += [(c, 10_000 + c * 100 + k, k * rng.choice([100, 600]), rng.choice(["page", "rendered"])) for c in range(2, 60) for k in range(rng.randint(1, 30))]
    df = spark.createDataFrame(frames + [(None, 1, 1, "page"), (1, 1, None, "page")], "conn long, seq long, ms long, type string").repartition(6)
    assert sorted(map(tuple, events.ack_throttle(df).collect())) == fold(frames)
    for gap, wait in ((0, 0), (1500, 1200), (1, 5000)):
        assert sorted(map(tuple, events.ack_throttle(df.where("conn < 5"), gap, wait).collect())) == fold([f for f in frames if f[0] < 5], gap, wait)
    assert events.ack_throttle(df.limit(0)).collect() == []


def test_entries_cover_every_state():
    rng = random.Random(4)
    for _ in range(60):
        ms = np.sort(np.array([rng.randrange(5000) for _ in range(rng.randint(1, 60))]))
        receipt = np.array([rng.random() < 0.3 for _ in ms])
        run = events.Throttle(ms, receipt, 500, 1200)
        for last, busy in ((int(ms[0]) - rng.randrange(3000), bool(rng.randrange(2))) for _ in range(20)):
            entry = next((e for e in run.entries() if e["ms"] >= last + (500 if e["free"] or not busy else 1201)), None)
            sent = run.sends(last, busy)
            if not len(sent):
                assert entry is None
                continue
            assert (entry["last"], entry["busy"]) == run.end(int(ms[sent[-1]]), True, int(sent[-1]) + 1)


def test_fields_at_any_depth(spark):
    deep = "r"
    for k in range(50):
        deep = f"\x13 CODE{k} \x14<{deep}>\x15"
    cases = {deep: "<" * 50 + "r" + ">" * 50, "\x15a\x13b\x14c": "abc", "\x13x\x15y\x13\x14z\x15": "yz", "\x13" * 5 + "a\x15": "a", "plain": "plain", "a\x07b\x0cc\r\n\n\n": "a\tb\nc\n\n", None: None}

    def fixed_point(t):
        if t is None:
            return None
        t = re.sub("[\x02\x05\x08]", "", t).replace("\x07", "\t")
        t, before = re.sub("[\x0b\x0c\x0d]", "\n", t), None
        while t != before:
            before, t = t, re.sub("\x13[^\x13\x14\x15]*\x14?([^\x13\x14\x15]*)\x15", r"\1", t)
        return re.sub("\n{3,}", "\n\n", re.sub("[\x00-\x06\x0e-\x1f]", "", t))

    rng = random.Random(6)
    soup = ["".join(rng.choice("\x13\x14\x15ab ") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*cases, *soup]], "t string")
    got = [tuple(r) for r in df.select("t", text.clean_control_chars(F.col("t"))).collect()]
    assert all(g == fixed_point(t) for t, g in got)
    assert dict(got)[deep] == cases[deep]


def test_diffusion_of_a_reader_page(spark):
    """1404 x 1788 pixels in seconds, and equal to the pass pixel by pixel on a strip of it."""
    w, h = 1404, 1788
    grey = (F.col("id") * 7919 % 256).cast("double")
    df = spark.range(w * h).select(F.lit(1).cast("long").alias("img"), (F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"), grey.alias("grey"))
    began = time.perf_counter()
    got = pixels.diffuse_quantize(df, 4).where("y < 3").collect()
    assert time.perf_counter() - began < 60
    work = {(k % w, k // w): float(k * 7919 % 256) for k in range(w * 3)}
    want = {}
    for y in range(3):
        for x in range(w):
            old = work[x, y]
            want[x, y] = int(min(max(int(old / 85 + 0.5), 0), 3) * 85 + 0.5)
            for dx, dy, share in ((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)):
                if (x + dx, y + dy) in work:
                    work[x + dx, y + dy] += (old - want[x, y]) * share / 16
    assert {(r["x"], r["y"]): r["q"] for r in got} == want
