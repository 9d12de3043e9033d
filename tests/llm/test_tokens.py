"""Packing and token files."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from readlake.llm import packing, records
from readlake.llm.encode import Encoder
from readlake.llm.textkit import text_bytes

public = pytest.importorskip("public_tokenizers")
WORD, BYTE = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.json")
FRESH = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ENCODERS = {p: Encoder(p, max_known=500) for p in (WORD, BYTE)}


def plain_ids(path, text):
    return ENCODERS[path].lib.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é'sßİ \n\t.,!|0129日🙂  　Σ\r\x1c"), max_size=40), min_size=1, max_size=8))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_gives_the_librarys_ids(path, texts):
    ids, n = ENCODERS[path].encode_with_end(*text_bytes(pa.array(texts, pa.string())), 7)
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert [p.tolist() for p in parts] == [[*plain_ids(path, t), 7] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "endoftext", "|>", "a", " ", "é", "\n", "."]), max_size=12).map("".join), min_size=1, max_size=6))
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_added_tokens_have_the_librarys_ids(path, texts):
    """Against an untouched tokenizer: the texts of added tokens are ids of their own, across rows they aren't."""
    fresh = FRESH[path]
    ids, n = ENCODERS[path].encode_with_end(*text_bytes(pa.array(texts, pa.string())), 7)
    parts = np.split(ids, np.cumsum(n)[:-1])
    assert [p.tolist() for p in parts] == [[*fresh.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    assert FRESH[BYTE].encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]


def best_fit_decreasing(lengths, size):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(left) if room >= n]
        if fit:
            left[min(fit, key=lambda k: left[k])] -= n
        else:
            left.append(size - n)
    return len(left)


@pytest.mark.parametrize("seed", range(20))
def test_rules_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 50, 128])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 300))]
    counts = Counter(lengths)
    spots = defaultdict(list)
    for length, a, b, per_bin, first, fill in packing.best_fit_rules(counts, size):
        for r in range(b - a):
            spots[first + r // per_bin].append((fill + r % per_bin * length, length))
    assert Counter(n for own in spots.values() for _, n in own) == counts
    for own in spots.values():
        at = 0
        for begin, n in sorted(own):
            assert begin == at
            at += n
        assert at <= size
    assert len(spots) == best_fit_decreasing(lengths, size)


def test_packing_end_to_end(docs, messy):
    packed = packing.pack_documents(docs, WORD, 64, 0)
    rows = packed.collect()
    want = Counter()
    for d, t in messy:
        ids = [*plain_ids(WORD, t), 0]
        want.update((d, k, k * 64, tuple(ids[k * 64 : k * 64 + 64])) for k in range(-(-len(ids) // 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        assert sum(n for _, n in own) <= 64 and all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and min(own)[0] == 0
    assert len(bins) == best_fit_decreasing([r["length"] for r in rows], 64)
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    first = rows[0]
    assert bytes(whole[first["sequence_id"]]["ids"])[first["offset"] * 4 : (first["offset"] + first["length"]) * 4] == bytes(first["ids"])


def test_packing_nothing(none):
    assert packing.pack_documents(none, WORD, 64, 0).collect() == []


def test_record_files_round_trip(docs, messy, none):
    manifest = records.write_token_records(docs, BYTE, 2)
    rows = sorted(records.read_token_records(manifest).collect(), key=lambda r: (r["shard"], r["record"]))
    order = sorted(messy, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r["doc_id"] for r in rows] == [d for d, _ in order]
    start = 0
    for r, (_, t) in zip(rows, order, strict=True):
        ids = [*plain_ids(BYTE, t), 2]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (start, len(ids), ids)
        assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = manifest.first()
    doc_id, ids = records.read_record(some["path"], some["records"] - 1)
    own = [r for r in rows if r["shard"] == some["shard"]][-1]
    assert (doc_id, ids.tobytes()) == (own["doc_id"], bytes(own["ids"]))
    assert records.read_token_records(records.write_token_records(none, BYTE, 2)).collect() == []


def test_damaged_frames_are_noticed():
    good = records.frame(b"payload")
    assert records.unframe(good, 0) == (b"payload", len(good))
    for k in range(len(good)):
        with pytest.raises(ValueError):
            records.unframe(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :], 0)
    with pytest.raises(ValueError):
        records.unframe(good[:-1], 0)
