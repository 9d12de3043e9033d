"""Secrets in texts, confirmed by their structure.

Three plain patterns (assignments, access keys, hex runs) report as they match.  Beyond them, encoded candidates count
only when their content parses: a PEM block whose base64 is DER with nested lengths that add up (or the OpenSSH key
format), base64 or hex runs that decode to a private key's DER, and three-part signed tokens whose header is JSON with
an algorithm.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.shared import give_back

# The patterns and least lengths of the base kinds.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: The order in which kinds are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "token")
# No pattern reads a stretch of text more than a fixed number of times: a body ends at five dashes, and of a run of
# token letters only the first header is tried, as no later one can end elsewhere.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,.]|-(?!----))*+)-----END \1-----")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))([A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+)")
_HEX_ANY = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
SPANS = "array<struct<kind:string,begin:int,finish:int>>"


def der_parts(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The (tag, content) elements that fill ``data`` exactly; None when a length doesn't fit."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or len(data) - at < n:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if len(data) - at < size:
            return None
        out.append((tag, data[at : at + size]))
        at += size
        if tag & 0x20 and depth < 6 and der_parts(out[-1][1], depth + 1) is None:
            return None
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted) or EC private key: one sequence, lengths nested right, the fields in place."""
    top = der_parts(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    fields = der_parts(top[0][1]) or []
    tags = [t for t, _ in fields]
    if tags[:1] == [0x02] and len(fields[0][1]) == 1 and fields[0][1][0] <= 1:
        rsa = len(tags) >= 9 and set(tags[:9]) == {0x02}
        return rsa or tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04]
    return tags == [0x30, 0x04] and (der_parts(fields[0][1]) or [(0, b"")])[0][0] == 0x06


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's private key format: its magic, then four length-prefixed strings and as many keys as it states."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), 0
    while at + 4 <= len(data) and fields < 3:
        at += 4 + struct.unpack_from(">I", data, at)[0]
        fields += 1
    if fields < 3 or at + 4 > len(data):
        return False
    keys = struct.unpack_from(">I", data, at)[0]
    at += 4
    for _ in range(min(keys, 64) + 1):
        if at + 4 > len(data):
            return False
        at += 4 + struct.unpack_from(">I", data, at)[0]
    return keys > 0 and at <= len(data)


def _decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_token(text: str) -> bool:
    """header.payload.signature: the header is a JSON object with ``alg``, the payload JSON, a signature unless alg is none."""
    header, payload, signature = text.split(".")
    try:
        head, body = json.loads(_decoded(header, True) or b""), json.loads(_decoded(payload, True) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str) or not isinstance(body, dict):
        return False
    return head["alg"] == "none" or len(_decoded(signature, True) or b"") >= 16


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain patterns' matches, leftmost and non-overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Encoded secrets whose content parses."""
    out = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            body = re.split(r"\n\s*\n", m[2])[-1]  # headers of an encrypted key end at a blank line
            data = _decoded(re.sub(r"\s", "", body))
            if data and (is_der_key(data) or is_ssh_key(data) or "Proc-Type" in m[2]):
                out.append(("pem", *m.span()))
    for m in _BASE64.finditer(text):
        data = _decoded(m[0]) if m[0][0] == "M" or m[0].startswith("b3BlbnNzaC1rZXk") else None  # 0x30 0x80-0x83 begins with M
        if data and (is_der_key(data) or is_ssh_key(data)) and not any(k == "pem" and b <= m.start() < e for k, b, e in out):
            out.append(("der", *m.span()))
    if "30" in text:
        out += [("der", *m.span()) for m in _HEX_ANY.finditer(text) if m[0].startswith("30") and is_der_key(bytes.fromhex(m[0]))]
    if "eyJ" in text:
        out += [("token", *m.span(1)) for m in _TOKEN.finditer(text) if is_token(m[1])]
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by one ``[secret:kind]``, the kind of its first span."""
    out, done, reach = [], 0, -1
    for kind, begin, finish in ordered(spans):
        if begin >= reach:
            out += [text[done:begin], f"[secret:{kind}]"]
            done = reach = finish
        else:
            done = reach = max(reach, finish)
    return "".join(out) + text[done:]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and confirmed (arrays of kind, begin, finish) and redacted text, for every row.

    Null texts count as empty: no spans.  Repeated rows and null ids are kept; other columns are not read.
    """
    rows = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("finish", pa.int32())]))
    as_rows = lambda spans: [dict(zip(("kind", "begin", "finish"), s, strict=True)) for s in spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [ordered(base_spans(t)) for t in texts]
            more = [ordered(confirmed_spans(t)) for t in texts]
            clean = [redacted(t, b + m) if b or m else t for t, b, m in zip(texts, base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([as_rows(s) for s in base], rows), pa.array([as_rows(s) for s in more], rows), pa.array(clean, pa.string())], names=["doc_id", "base", "confirmed", "redacted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, f"doc_id long, base {SPANS}, confirmed {SPANS}, redacted string")


def span_text(spans: F.Column) -> F.Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["finish"].cast("string"))), ",")


def in_order(spans: F.Column) -> F.Column:
    """Spans by start, then by the order of ``KINDS``."""
    rank = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["begin"].alias("b"), F.array_position(rank, s["kind"]).alias("k"), s["finish"].alias("f"), s["kind"].alias("n")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["n"].alias("kind"), s["b"].alias("begin"), s["f"].alias("finish")))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_secrets``."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(in_order(F.concat("base", "confirmed"))).alias("spans"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{b}:{e}" for k, b, e in ordered(spans)).encode()).hexdigest()


def with_redactions(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in ``text``; ``length``, where present, counts the new text of changed rows.

    Every row stays, and all other columns; null texts stay null.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = [base_spans(t) + confirmed_spans(t) if t else [] for t in texts]
            if any(found):
                clean = [redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                batch = batch.set_column(batch.schema.get_field_index(text), text, pa.array(clean, batch.column(text).type))
                if length in batch.schema.names:
                    sizes = [len(c) if s else n for c, s, n in zip(clean, found, batch.column(length).to_pylist(), strict=True)]
                    batch = batch.set_column(batch.schema.get_field_index(length), length, pa.array(sizes, batch.column(length).type))
            yield batch
        give_back()

    return docs.mapInArrow(scan, docs.schema)
