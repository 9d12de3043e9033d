"""Token ids in length-delimited binary files with an offset index.

A data file is a run of frames::

    u64 payload length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

(little-endian; the mask turns the CRC-32 right by 15 bits and adds 0xA282EAD8, so that a checksum stored inside
checked data stays sound).  A payload is ``u8 has_id, i64 doc_id, u8 width, u8 codec, u64 n_tokens`` and the ids in
``width`` bytes each, stored (codec 0) or zstd (codec 1).  Beside each data file lies an index file of
``u64 offset, u64 frame length`` per record: a reader that wants record k of a file seeks there, in any order.

Files are named by task attempt and only those in the manifest count, so a task that runs again after a lost executor
writes a new file and can't spoil one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm.encode import encoder
from readlake.llm.shared import shared_dir, written
from readlake.llm.textkit import text_bytes

_HEAD = struct.Struct("<BqBBQ")
_FRAME = struct.Struct("<QI")
_INDEX = np.dtype([("offset", "<u8"), ("length", "<u8")])
MANIFEST = "shard int, path string, records long, tokens long, bytes long"
RECORDS = "shard int, record long, doc_id long, start long, n_tokens long, ids binary"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next begins; ValueError when a checksum or length is off."""
    if len(data) < at + _FRAME.size:
        raise ValueError(f"record header cut at byte {at}")
    size, crc = _FRAME.unpack_from(data, at)
    if masked_crc(bytes(data[at : at + 8])) != crc:
        raise ValueError(f"bad length checksum at byte {at}")
    begin = at + _FRAME.size
    payload = bytes(data[begin : begin + size])
    if len(payload) < size or len(data) < begin + size + 4 or masked_crc(payload) != struct.unpack_from("<I", data, begin + size)[0]:
        raise ValueError(f"bad payload at byte {at}")
    return payload, begin + size + 4


def pack_ids(doc_id: int | None, ids: np.ndarray, width: int, compress=None) -> bytes:
    raw = ids.astype("<u2" if width == 2 else "<u4").tobytes()
    head = _HEAD.pack(doc_id is not None, doc_id or 0, width, compress is not None, len(ids))
    return head + (compress(raw) if compress else raw)


def unpack_ids(payload: bytes, decompress=None) -> tuple[int | None, np.ndarray]:
    has_id, doc_id, width, codec, n = _HEAD.unpack_from(payload)
    raw = payload[_HEAD.size :]
    if codec:
        raw = decompress(raw, n * width)
    ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4")
    if len(ids) != n:
        raise ValueError("token count differs from the header")
    return (doc_id if has_id else None), ids.astype("<u4")


def write_token_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write every text's ids and ``end_id`` in ascending doc_id order; returns the manifest, one row per file.

    Rows are ordered by (doc_id, text): null ids come first, repeated rows are written as often as they come, null
    texts count as empty.  Order across files is the order of ``shard``.  An empty table gives no files.
    """
    folder = folder or shared_dir(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task, enc = TaskContext.get(), encoder(tokenizer)
        width = 2 if enc.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
        store, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{task.partitionId():06d}-{task.taskAttemptId()}.rec"
        compress = zstandard.ZstdCompressor(level=1).compress
        records = tokens = at = 0
        data = index = None
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = batch.slice(k, 1000)
                if data is None:
                    store.create_dir(base, recursive=True)
                    data, index = store.open_output_stream(path), store.open_output_stream(f"{path}.idx")
                ids, counts = enc.encode_with_end(*text_bytes(rows.column("text")), end_id)
                frames = [frame(pack_ids(d, own, width, compress)) for d, own in zip(rows.column("doc_id").to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
                sizes = np.fromiter(map(len, frames), np.int64, len(frames))
                spots = np.zeros(len(frames), _INDEX)
                spots["offset"], spots["length"] = at + np.cumsum(sizes) - sizes, sizes
                data.write(b"".join(frames))
                index.write(spots.tobytes())
                records, tokens, at = records + len(frames), tokens + int(counts.sum()), at + int(sizes.sum())
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((task.partitionId(), pa.int32()), (path, pa.string()), (records, pa.int64()), (tokens, pa.int64()), (at, pa.int64()))], names=["shard", "path", "records", "tokens", "bytes"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(write, MANIFEST).withColumn("path", F.concat(F.lit(folder.split("://")[0] + "://" if "://" in folder else ""), "path"))
    return written(manifest)


def read_token_records(manifest: DataFrame) -> DataFrame:
    """All records of the manifest's files: shard, record, doc_id, start, n_tokens, ids (little-endian u32).

    ``start`` counts the ids of all records before.  The running total is over one row per file.  Every frame's
    checksums, the index and the manifest's counts must agree, else the task fails with a ValueError.  A file is a task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        unzip = lambda raw, size: decompress(raw, max_output_size=size)
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), _INDEX)
                if len(index) != row["records"]:
                    raise ValueError(f"{path}: index and manifest differ")
                start = row["before"]
                with store.open_input_stream(path) as f:
                    for k in range(0, len(index), 500):
                        some = index[k : k + 500]
                        block, at = f.read(int(some["length"].sum())), 0
                        got = []
                        for spot in some:
                            if at + int(some["offset"][0]) != spot["offset"]:
                                raise ValueError(f"{path}: the index doesn't follow the frames")
                            payload, at = unframe(block, at)
                            got.append(unpack_ids(payload, unzip))
                        n = np.fromiter((len(ids) for _, ids in got), np.int64, len(got))
                        begins = start + np.cumsum(n) - n
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["shard"]] * len(got), pa.int32()), pa.array(np.arange(k, k + len(got))), pa.array([d for d, _ in got], pa.int64()), pa.array(begins), pa.array(n), pa.array([ids.tobytes() for _, ids in got], pa.binary())],
                            names=["shard", "record", "doc_id", "start", "n_tokens", "ids"],
                        )
                if start != row["before"] + row["tokens"]:
                    raise ValueError(f"{path}: token count and manifest differ")

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return files.repartition(max(1, manifest.count())).mapInArrow(read, RECORDS)


def read_record(path: str, k: int) -> tuple[int | None, np.ndarray]:
    """Record ``k`` of one data file by its index: the shuffled read that a loader makes."""
    import zstandard

    store, own = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{own}.idx") as f:
        spot = np.frombuffer(f.read_at(_INDEX.itemsize, k * _INDEX.itemsize), _INDEX)[0]
    with store.open_input_file(own) as f:
        payload, _ = unframe(f.read_at(int(spot["length"]), int(spot["offset"])), 0)
    return unpack_ids(payload, lambda raw, size: zstandard.ZstdDecompressor().decompress(raw, max_output_size=size))
