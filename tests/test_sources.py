import io
import zipfile

from pyspark.sql import functions as F

from readlake.operators import routing
from readlake.sources import archives, files


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def test_scan_files_decodes_and_gates(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfplain")
    (tmp_path / "b.txt").write_bytes("wide é".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes(b"\xff\x00\xfe bad \xc3")
    (tmp_path / "d.txt").write_bytes(b"x" * 2000)
    rows = {r["name"]: r for r in files.decode_text(files.scan_files(spark, str(tmp_path), 1000)).collect()}
    assert (rows["a.txt"]["text"], rows["b.txt"]["text"]) == ("plain", "wide é")
    assert rows["c.txt"]["status"] == "invalid" and "d.txt" not in rows


def test_declared_charsets(spark):
    rows = [("汉字".encode("gb18030"), "GBK"), ("漢字".encode("big5"), "big5"), (b"caf\xe9 \x93q\x94", "windows-1252"), (b"plain", None), (None, "gbk")]
    df = spark.createDataFrame([(k, bytearray(c) if c else None, n) for k, (c, n) in enumerate(rows)], "k int, content binary, charset string")
    got = [r[0] for r in df.orderBy("k").select(files.decode_declared("content", "charset")).collect()]
    assert got == ["汉字", "漢字", "café “q”", "plain", None]


def test_archives_are_listed_sniffed_and_gated(spark):
    made = {
        "doc": archive({"word/document.xml": "<a/>", "x.png": b"1"}), "book": archive({"META-INF/container.xml": "<c/>", "META-INF/rights.xml": "<r/>"}),
        "bad": b"PK\x03\x04 broken", "text": "grüße".encode(), "old": bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 10,
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")
    entries = files.scan_archive(df, r"\.xml$").cache()
    got = {(r["path"], r["entry"]): r for r in entries.collect()}
    assert bytes(got["doc", "word/document.xml"]["content"]) == b"<a/>" and got["doc", "x.png"]["content"] is None
    assert got["bad", None]["status"] == "corrupt"
    assert {r["path"]: r["format"] for r in files.sniff_format(df, entries).collect()} == {"doc": "docx", "book": "epub", "bad": "zip", "text": "text", "old": "ole"}
    fonts = spark.createDataFrame([("doc", "http://www.idpf.org/2008/embedding")], "path string, algorithm string")
    drm = {r["path"]: r["drm"] for r in routing.drm_gate(entries.where("entry is not null"), fonts).collect()}
    assert drm == {"doc": False, "book": True}


def test_a_damaged_entry_is_its_own_row(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("a.xml", "b.xml", "c.xml", "d.png"):
            z.writestr(name, f"<{name}>" + "".join(chr(97 + (k * k) % 26) for k in range(400)))
        places = {i.filename: i.header_offset for i in z.infolist()}
    whole = bytearray(out.getvalue())
    flipped = bytearray(whole)
    for k in range(places["b.xml"] + 36, places["b.xml"] + 60):
        flipped[k] ^= 0xFF
    odd = bytearray(whole)
    at = odd.rindex(b"PK\x01\x02", 0, odd.rindex(b"PK\x01\x02"))  # the directory's c.xml
    odd[at + 10] = 99
    locked = bytearray(whole)
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    cases = {"whole": whole, "flipped": flipped, "odd": odd, "locked": locked, "cut": whole[:200], "none": None, "empty": bytearray()}
    df = spark.createDataFrame(list(cases.items()), "path string, content binary")
    got = {(r["path"], r["entry"]): r["status"] for r in files.scan_archive(df, r"[.]xml$", 2000).collect()}
    assert {e: s for (p, e), s in got.items() if p == "whole"} == dict.fromkeys(("a.xml", "b.xml", "c.xml", "d.png"), "ok")
    assert {e: s for (p, e), s in got.items() if p == "flipped"} == {"a.xml": "ok", "b.xml": "corrupt", "c.xml": "ok", "d.png": "ok"}
    assert got["odd", "c.xml"] == "unsupported" and got["odd", "b.xml"] == "ok"
    assert got["locked", "a.xml"] == "encrypted" and got["locked", "b.xml"] == "ok"
    assert got["cut", None] == got["none", None] == got["empty", None] == "corrupt"
    assert {r["status"] for r in files.scan_archive(df.where("path = 'whole'"), r"[.]xml$", 100).where("entry <> 'd.png'").collect()} == {"too-large"}


def test_archives_are_read_by_entry(spark, tmp_path):
    names = [f"dir/{k:03}.xml" for k in range(40)]
    data = {n: bytes((k * 31 + j * j) % 251 for j in range(3000)) for k, n in enumerate(names)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "large.zip").write_bytes(archive(data))
    (tmp_path / "in" / "small.zip").write_bytes(archive({"a.xml": b"<a/>", "b.png": b"1"}))
    (tmp_path / "in" / "no.zip").write_bytes(b"PK\x03\x04 broken" * 3000)
    damaged = bytearray(archive(data))
    damaged[damaged.index(data[names[7]][:500]) + 9] ^= 1
    (tmp_path / "in" / "damaged.zip").write_bytes(damaged)
    df = archives.read_archives(spark, f"file://{tmp_path}/in", r"[.]xml$", split_bytes=20_000)
    assert df.rdd.getNumPartitions() >= 12
    got = {(r["path"].rsplit("/", 1)[1], r["entry"]): r for r in df.collect()}
    assert len(got) == 40 + 2 + 1 + 40
    assert all(bytes(got["large.zip", n]["content"]) == data[n] and got["large.zip", n]["ord"] == k for k, n in enumerate(names))
    assert {n for n in names if got["damaged.zip", n]["status"] == "corrupt"} == {names[7]}
    assert got["no.zip", None]["status"] == "corrupt" and got["small.zip", "b.png"]["content"] is None
    same = files.scan_archive(files.scan_files(spark, f"file://{tmp_path}/in"), r"[.]xml$")
    assert {(r["path"].rsplit("/", 1)[1], r["entry"]): (r["ord"], r["size"], r["flags"], r["method"], r["content"], r["status"]) for r in same.collect()} == {k: (r["ord"], r["size"], r["flags"], r["method"], r["content"], r["status"]) for k, r in got.items()}
    (tmp_path / "none").mkdir()
    assert archives.read_archives(spark, f"file://{tmp_path}/none").collect() == []


def test_filters_reach_the_archive_reader(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(archive({"x/1.xml": b"1" * 10, "x/2.xml": b"2" * 2000, "y/3.xml": b"3"}))
    df = archives.read_archives(spark, f"file://{tmp_path}/a.zip").where("entry like 'x/%' and size <= 100")
    assert [r["entry"] for r in df.collect()] == ["x/1.xml"]
    assert " Filter (" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r["entry"] for r in archives.read_archives(spark, f"file://{tmp_path}/a.zip").where("length(entry) > 3 and method = 0 and entry <> 'x/1.xml'").collect()] == ["x/2.xml", "y/3.xml"]


def test_preflight_at_its_limits(spark):
    mib = 1 << 20
    rows = [("ok", 32 * mib, 0, 8)] * 6 + [("ok", 28 * mib, 0, 8)] + [("over", 32 * mib, 0, 8)] * 6 + [("over", 28 * mib + 1, 0, 8)] + [("locked", 1, 1, 8), ("bad", -1, 0, 8), ("odd", 1, 0, 14)]
    df = spark.createDataFrame(rows, "path string, size long, flags int, method int")
    got = {r["path"]: r["status"] for r in routing.archive_preflight(df).collect()}
    assert got == {"ok": "ok", "over": "too-large", "locked": "encrypted", "bad": "corrupt", "odd": "unsupported"}


def test_saved_store_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("text", 1, "t", "body"), ("image", 2, "i", "b")], "kind string, id long, title string, body string")
    files.write_saved(items, str(tmp_path / "s"))
    assert {(r["kind"], r["id"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("text", 1), ("image", 2)}


def test_sink_html_writes_each_batch_once(spark, tmp_path):
    source = spark.createDataFrame([(1, "T", "B")], "id long, title string, body string")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    files.sink_html(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).select("value").collect()] == ['{"type":"html","id":"1","title":"T","body":"B"}']


def test_size_limit_reaches_the_reader(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    plan = files.scan_files(spark, str(tmp_path), 10)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(length,10)" in plan


def test_routing_reads_only_needed_columns(spark, sf):
    plan = spark.read.parquet(f"{sf}/pages.parquet").where(routing.is_url(F.col("url"))).select("page_id")._jdf.queryExecution().toString()
    assert "html" not in plan.split("ReadSchema")[-1]


def test_many_archives_share_a_batch():
    import pyarrow as pa

    content = [archive({"a.xml": b"x" * k, "b.bin": b"1"}) if k % 3 else b"none" if k % 2 else None for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(3000)]), pa.array(content, pa.binary())], names=["path", "content"])
    out = list(files.entry_batches([batch], r"[.]xml$"))
    rows = [r for b in out for r in b.to_pylist()]
    assert len(out) <= 4 and [r["path"] for r in rows if r["ord"] in (None, 0)] == [str(k) for k in range(3000)]
    assert all((r["content"] == b"x" * int(r["path"])) == (r["entry"] == "a.xml") and (r["status"] == "corrupt") == (r["entry"] is None) for r in rows)
    assert max(b.nbytes for b in out) < 3 * files._HELD_BYTES


def test_declared_charsets_stay_arrow():
    import pyarrow as pa

    content = [None, b"caf\xe9", "汉字".encode("gbk")] * 400
    got = files.decode_declared.func(pa.array(content, pa.binary()), pa.array([None, "latin1", " GBK "] * 400, pa.string()))
    assert got.to_pylist() == [None, "café", "汉字"] * 400
    assert files.decode_declared.func(pa.array([], pa.binary()), pa.array([], pa.string())).to_pylist() == []
