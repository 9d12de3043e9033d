"""Stream and batch forms give the same rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from readlake.operators import events as e
from readlake.plans.adapters import adapter
from readlake.streaming import frames as s


@pytest.fixture(scope="module")
def rows(spark, sf, tmp_path_factory):
    """Frames with content ids and binaries, batch, and the folder they stream from."""
    f = adapter(spark, sf, "frames").where("conn < 12").select("conn", (F.col("seq") * 2).alias("seq"), "ts", "type", "k")
    binary = f.where("type = 'page' and k % 3 <> 0").select("conn", (F.col("seq") + 1).alias("seq"), "ts", F.lit("binary").alias("type"), "k")
    both = f.unionByName(binary).withColumns({"content_id": F.when(F.col("type") == "content.begin", F.col("seq")).otherwise(F.col("seq") - F.col("k") % 3 * 2), "page": F.col("k"), "ms": F.unix_millis(F.col("ts").cast("timestamp"))})
    path = str(tmp_path_factory.mktemp("frames") / "f")
    both.coalesce(1).write.parquet(path)
    return spark.read.parquet(path), path


def run(spark, stream, mode="append", timers=False):
    """The stream's output once it has read everything; processing-time timers would keep it going without data."""
    name = "q" + uuid.uuid4().hex
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not timers).lower())
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def stream_of(spark, rows):
    return spark.readStream.schema(rows[0].schema).parquet(rows[1])


@pytest.mark.parametrize(("processor", "batch"), [(s.HandshakeGate, e.handshake_gate), (s.PairPageBinary, e.pair_page_binary), (s.CurrentContent, e.current_content)])
def test_stateful_rules(spark, rows, processor, batch):
    got = run(spark, s.by_connection(stream_of(spark, rows), processor()), timers=True)
    want = batch(rows[0]).select(*processor.COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()


def test_ack_throttle(spark, rows):
    live = "type in ('page', 'rendered')"
    got = run(spark, s.by_connection(stream_of(spark, rows).where(live), s.AckThrottle()), timers=True)
    want = e.ack_throttle(rows[0].where(live))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_latest_per_key(spark, rows):
    got = run(spark, s.page_state(stream_of(spark, rows)), "update")
    want = rows[0].where("type in ('rendered', 'nav')").groupBy("conn").agg(F.max("seq"))
    assert {(r["conn"], r["seq"]) for r in got.collect()} == {tuple(r) for r in want.collect()}
    again = run(spark, s.replay_latest(stream_of(spark, rows)), "update")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in e.replay_latest(rows[0]).collect()}


def test_watermarked_rules_run(spark, rows):
    timed = s.with_event_time(stream_of(spark, rows))
    assert run(spark, s.unique_frames(timed)).count() == rows[0].count()
    assert run(spark, s.activity(timed), "append").count() > 0


def test_in_flight_gate(spark, tmp_path):
    turns = [(1, 0, "user"), (1, 1, "user"), (1, 2, "assistant"), (1, 3, "user"), (2, 0, "assistant"), (2, 1, "user")]
    df = spark.createDataFrame(turns, "conn long, seq long, type string")
    df.write.parquet(str(tmp_path / "t"))
    got = run(spark, s.by_connection(spark.readStream.schema(df.schema).parquet(str(tmp_path / "t")), s.InFlightGate()), timers=True)
    assert {tuple(r) for r in got.collect()} == {(1, 0), (1, 3), (2, 1)}


def test_frames_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"conn": 1, "seq": 1, "json": "{\\"type\\": \\"hello\\"}"}\n{"conn": 1, "seq": 2, "json": "not json"}\n')
    assert run(spark, s.read_frames(spark, str(tmp_path)).select("conn", "seq", "type")).collect() == [(1, 1, "hello")]


def test_a_silent_job_times_out(spark, tmp_path):
    """Job a says nothing after its first poll; the others' polls move the watermark past its limit."""
    at = lambda second: f"2024-01-01 00:{second // 60:02}:{second % 60:02}"
    polls = [("a", at(0), 1, "running"), ("b", at(0), 2, "running"), ("c", at(1), 3, "running"), ("b", at(50), 4, "done"), ("d", at(90), 5, "running"), ("c", at(95), 6, "failed"), ("e", at(400), 7, "running"), ("d", at(410), 8, "done")]
    schema = "job string, ts string, seq long, state string"
    for k in range(0, len(polls), 2):
        spark.createDataFrame(polls[k : k + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p")).withColumn("ts", F.to_timestamp("ts"))
        got = run(spark, s.job_status(stream, 100), "update").collect()
    finally:
        spark.conf.unset(key)
    assert {("a", "running"), ("a", "timeout"), ("b", "done"), ("c", "failed"), ("e", "running")} <= {tuple(r) for r in got}
    assert ("b", "timeout") not in {tuple(r) for r in got} and ("c", "timeout") not in {tuple(r) for r in got}
