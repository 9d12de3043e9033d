"""Chat formatting of logged conversations, snapshots collapsed.

Chat logs often store a conversation again after every turn.  A conversation is dropped when another one begins with
all of its turns and goes on; of equal conversations the smallest id stays.  What is left is rendered.

Turns are compared by a rolling hash of the prefix up to each turn (two 64-bit polynomials).  A scan over range
partitions builds it: each task hashes its own rows and one row for each task and conversation carries the hash on,
so a conversation of any length spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.shared import written
from readlake.llm.textkit import U64

_BASES = (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)
_MASK = 0xFFFFFFFFFFFFFFFF


def tidy_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: null ids out, null role ``user``, null text empty, equal rows once."""
    return (
        conversations.where("conv_id is not null")
        .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .distinct()
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``k`` (1 and up within a conversation, by turn, role, text) and the prefix hash ``h1, h2``."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, k = TaskContext.get().partitionId(), None, 0
        sums, powers = [0, 0], [1, 1]
        for batch in batches:
            out = np.zeros((2, batch.num_rows), U64)
            at = np.zeros(batch.num_rows, np.int64)
            ids = batch.column("conv_id").to_pylist()
            values = [batch.column(f"x{j}").to_numpy().view(U64).tolist() for j in (1, 2)]
            for n, own in enumerate(ids):
                if own != conv:
                    conv, k, sums, powers = own, 0, [0, 0], [1, 1]
                for j in (0, 1):
                    sums[j] = (sums[j] + values[j][n] * powers[j]) & _MASK
                    powers[j] = powers[j] * _BASES[j] & _MASK
                    out[j, n] = sums[j]
                k += 1
                at[n] = k
            cols = [batch.column(c) for c in ("conv_id", "turn", "role", "text")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(ids), part, np.int32)), pa.array(at), pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64))], names=["conv_id", "turn", "role", "text", "part", "k", "h1", "h2"])

    hashed = turns.withColumns({"x1": F.xxhash64(F.lit(1), "role", "text"), "x2": F.xxhash64(F.lit(2), "text", "role")})
    order = ["conv_id", "turn", "role", "text"]
    mine = written(hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, "conv_id long, turn long, role string, text string, part int, k long, h1 long, h2 long"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, sums = None, 0, [0, 0]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, n, sums = row["conv_id"], 0, [0, 0]
                factor = [pow(b, n, 1 << 64) for b in _BASES]
                rows.append([conv, row["part"], n, *sums, *factor])
                sums = [(s + f * (row[h] & _MASK)) & _MASK for s, f, h in zip(sums, factor, ("h1", "h2"), strict=True)]
                n += row["k"]
            signed = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], *[[v - (1 << 64) if v >> 63 else v for v in (r[c] for r in rows)] for c in range(3, 7)]]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == 1 else pa.int64()) for c, v in enumerate(signed)], names=["conv_id", "part", "n", "s1", "s2", "f1", "f2"])

    ends = mine.groupBy("conv_id", "part").agg(F.max(F.struct("k", "h1", "h2")).alias("e")).select("conv_id", "part", "e.*")
    split = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    shift = ends.join(split, "conv_id").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(carry, "conv_id long, part int, n long, s1 long, s2 long, f1 long, f2 long")

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {x: batch.column(x).to_numpy() for x in ("k", "h1", "h2", "n", "s1", "s2", "f1", "f2")}
            u = {x: v.view(U64) for x, v in c.items()}
            keep = [batch.column(x) for x in ("conv_id", "turn", "role", "text")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(c["k"] + c["n"]), *[pa.array((u[f"s{j}"] + u[f"f{j}"] * u[f"h{j}"]).view(np.int64)) for j in (1, 2)]], names=["conv_id", "turn", "role", "text", "k", "h1", "h2"])

    zero = {"n": 0, "s1": 0, "s2": 0, "f1": 1, "f2": 1}
    joined = mine.join(shift, ["conv_id", "part"], "left").withColumns({c: F.coalesce(c, F.lit(v).cast("long")) for c, v in zero.items()})
    return joined.select("conv_id", "turn", "role", "text", "k", "h1", "h2", *zero).mapInArrow(moved, "conv_id long, turn long, role string, text string, k long, h1 long, h2 long")


def maximal_turns(conversations: DataFrame) -> DataFrame:
    """The turns (conv_id, k, role, text) of conversations that no other one continues.

    Hashes are counted per prefix before they meet, so a first turn that all conversations share is one row.
    """
    turns = written(prefix_hashes(tidy_turns(conversations)))
    whole = turns.groupBy("conv_id").agg(F.max(F.struct("k", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    key = ["k", "h1", "h2"]
    passing = turns.groupBy(*key).agg(F.count(F.lit(1)).alias("passing"))
    ending = whole.groupBy(*key).agg(F.count(F.lit(1)).alias("ending"), F.min("conv_id").alias("conv_id"))
    continued = passing.join(ending.select(*key, "ending"), key).where("passing > ending").select(*key)
    kept = ending.join(continued, key, "left_anti").select("conv_id", F.col("k").alias("n_turns"))
    return turns.join(kept, "conv_id").select("conv_id", "n_turns", "k", "role", "text")


def render_chats(conversations: DataFrame, turns_per_row: int = 512) -> DataFrame:
    """conv_id, part, n_turns, text: maximal conversations as marked-up text.

    ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn; a ``<|`` inside a role or text becomes ``< |``.  A row
    holds ``turns_per_row`` turns at most; the parts of a conversation, in order, are its whole text.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|im_start|>"), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit("<|im_end|>\n"))
    lines = maximal_turns(conversations).select("conv_id", "n_turns", F.expr(f"(k - 1) div {turns_per_row}").alias("part"), "k", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "")
    return lines.groupBy("conv_id", "part").agg(F.first("n_turns").alias("n_turns"), text.alias("text"))


ORACLE = """
with t as (select distinct cast(conv_id as bigint) conv_id, cast(turn as bigint) turn, coalesce(role, 'user') as role, coalesce(text, '') as text
           from conversations where conv_id is not null),
k as (select *, row_number() over w as k, count(*) over (partition by conv_id) as n_turns,
        string_agg(md5(role || chr(31) || text), ',') over (partition by conv_id order by turn nulls first, role, text rows unbounded preceding) as prefix
      from t window w as (partition by conv_id order by turn nulls first, role, text)),
whole as (select conv_id, n_turns, prefix from k where k = n_turns),
longer as (select distinct prefix from k where k < n_turns),
kept as (select min(conv_id) as conv_id from whole where prefix not in (select prefix from longer) group by prefix)
select conv_id, cast((k - 1) // 512 as bigint) as part, cast(n_turns as bigint) as n_turns,
  string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' order by k) as text
from k join kept using (conv_id) group by all
"""
