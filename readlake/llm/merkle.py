"""A Merkle manifest of a table: a tree of content-addressed records, and proofs by descent from the root.

Leaves are ranked within their tree by a range sort and sums over its partitions.  A block of 2^8 neighbours becomes
eight levels of the tree at once: one record, named by the digest of its top, that holds the children of every digest
in it.  The tops are the leaves of the next round, so a tree of 2^40 leaves takes five rounds, and no task ever holds
more than a block, however large one tree is.

A proof is a descent.  Requests start at the root with the digits of their rank; all requests that share a prefix go
down together, one record at a time, and take along the children that the digits don't select.  At the bottom, a
request's path is its record segments in reverse, nearest first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm.shared import written

#: Levels of one record, unless given.
LEVELS = 8
_RECORD = "tree long, round int, block long, n long, digest binary, children binary"


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value's text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*columns: Column) -> Column:
    """Lower-case hex SHA-256 of the encoded columns, one after another."""
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def parent(children: list[str]) -> str:
    """The digest over digests in hex."""
    return sha256("".join(children).encode()).hexdigest()


def ranked(rows: DataFrame, group: str | None, order: list[Column | str]) -> DataFrame:
    """``rows`` with tree (the group's number in order, null first), trees (how many), rank in the tree and its n.

    By a range sort over group and ``order``.  A tree may span any number of partitions: what is summed over is one
    row for each group and partition, and a group's number goes along with those.  Without a group all is tree 0.
    """
    keys = ([F.asc_nulls_first(group)] if group else []) + list(order)
    # the id counts up within a partition of the sorted rows, with the partition in its upper bits
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))
    by = [group] if group else []
    part = F.shiftright("place", 33)
    runs = placed.groupBy(*by, part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    # without a group there is one row for each partition
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("n", F.sum("rows").over(Window.partitionBy(*by)))
    number = [F.lit(0).cast("long").alias("tree"), F.lit(1).cast("long").alias("trees")]
    if group:
        runs = written(runs)
        groups = ranked(runs.select(group).distinct(), None, [F.asc_nulls_first(group)]).select(group, F.col("rank").alias("tree"), F.col("n").alias("trees"))
        runs = runs.alias("r").join(groups.alias("g"), F.col(f"r.{group}").eqNullSafe(F.col(f"g.{group}"))).select("r.*", "tree", "trees")
        number = [F.col("tree"), F.col("trees")]
    same = F.shiftright("l.place", 33) == F.col("r.part")
    if group:
        same &= F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}"))
    return placed.alias("l").join(runs.alias("r"), same).select(*(F.col(f"l.{c}") for c in rows.columns), *number, (F.col("before") + F.col("place") - F.col("first")).alias("rank"), "n")


def _levels(leaves: list[str], height: int) -> list[list[str]]:
    """The nodes of each level under a top ``height`` levels up, leaves first, the top last."""
    out = [leaves]
    for _ in range(height):
        below = out[-1]
        out.append([parent(below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def height_of(n: int) -> int:
    """Levels above ``n`` leaves: none for a lone one."""
    return max(n - 1, 0).bit_length()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """Rows of sorted batches by (tree, block)."""
    now, own = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != now:
                if own:
                    yield now, own
                now, own = row[:2], []
            own.append(row[2:])
    if own:
        yield now, own


def build(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The records of all trees of ``leaves(tree, rank, n, digest as binary)``, and (tree, digest) of their roots.

    A record is (tree, round, block, n leaves of its round, digest of its top, children: the 32-byte digests of its
    levels, leaves first).  Trees without a second leaf have no record, their root is the leaf.
    """
    spark = leaves.sparkSession
    records, roots, level = [], [], 0
    now = leaves.select("tree", "rank", "n", "digest")
    while True:
        roots.append(now.where("n = 1").select("tree", "digest"))
        more = now.where("n > 1").select("tree", F.shiftright("rank", levels).alias("block"), "rank", "n", "digest")

        def climb(batches: Iterator[pa.RecordBatch], level=level) -> Iterator[pa.RecordBatch]:
            for (tree, block), rows in _blocks(batches):
                n = rows[0][1]
                nodes = _levels([d.hex() for *_, d in rows], min(levels, height_of(n)))
                children = bytes.fromhex("".join(d for below in nodes[:-1] for d in below))
                yield _batch([(tree, level, block, n, bytes.fromhex(nodes[-1][0]), children)], _RECORD)

        made = written(more.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").mapInArrow(climb, _RECORD))
        if made.isEmpty():
            break
        records.append(made)
        now = made.select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / (1 << levels)).cast("long").alias("n"), "digest")
        level += 1
    every = records[0] if records else spark.createDataFrame([], _RECORD)
    for r in records[1:]:
        every = every.unionByName(r)
    tops = roots[0]
    for r in roots[1:]:
        tops = tops.unionByName(r)
    return every, tops


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def descend(record: bytes, width: int, height: int, digits: int) -> tuple[list[bytes], bytes]:
    """The children that ``digits`` (highest first) don't select on the way down a record of ``width`` leaves, top
    first, and the one where the way ends."""
    at, widths = len(record), [width]
    for _ in range(height - 1):
        widths.append(-(-widths[-1] // 2))
    left, node = [], b""
    for level in range(height - 1, -1, -1):
        at -= 32 * widths[level]
        place = digits >> level
        node = record[at + 32 * place : at + 32 * place + 32]
        other = place ^ 1
        # a last run may lack the other child
        left.append(record[at + 32 * other : at + 32 * other + 32] if other < widths[level] else b"")
    return left, node


def descents(requests: DataFrame, records: DataFrame, starts: DataFrame, carry: str, finish: Callable, out: str, levels: int = LEVELS) -> DataFrame:
    """``finish(tree, rank, *carry, root digest, path)`` for each of ``requests(tree, rank, n, <carry>)``, as rows of ``out``.

    ``starts(tree, digest, path)`` are the roots with the path from there on.  A path has the siblings from the leaf
    up, 33 bytes a level: 0 where there is none, 1 where the sibling is on the left, 2 on the right, then its digest.
    Requests that share all but their last ``levels`` digits descend as one row; ``carry`` is the DDL of their columns.
    """
    deepest = records.agg(F.max("round")).first()[0] or 0
    way = written(starts.select("tree", F.lit(0).cast("long").alias("block"), "digest", "path", F.col("digest").alias("root")))
    for level in range(deepest, 0, -1):

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, block, digest, path, root, children, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if children is None:  # a lower tree: its root waits for its round
                        yield _batch([(tree, block, digest, path, root)], _WAY)
                        continue
                    width = min(n - (block << levels), 1 << levels)
                    rows = []
                    for digits in range(width):
                        left, node = descend(children, width, min(levels, height_of(n)), digits)
                        rows.append((tree, (block << levels) + digits, node, _segment(left, digits) + path, root))
                    yield _batch(rows, _WAY)

        own = records.where(F.col("round") == level).select("tree", "block", "digest", "children", "n")
        way = written(way.join(own, ["tree", "block", "digest"], "left").select("tree", "block", "digest", "path", "root", "children", "n").mapInArrow(step, _WAY))
    own = records.where("round = 0").select("tree", "block", "digest", "children")
    fields = [c.split() for c in carry.split(", ")]
    none = lambda kind: F.lit(None).cast(kind)
    met = way.join(own, ["tree", "block", "digest"], "left").select("tree", "block", F.lit(-1).cast("long").alias("rank"), none("long").alias("n"), "path", "root", "children", *(none(k).alias(c) for c, k in fields))
    asked = requests.select("tree", F.shiftright("rank", levels).alias("block"), "rank", "n", *(none("binary").alias(c) for c in ("path", "root", "children")), *(c for c, _ in fields))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in _blocks(batches):
            _, _, above, root, children, *_ = rows[0]  # rank -1 sorts first: where the descent came to this block
            found = []
            for rank, n, _, _, _, *more in rows[1:]:
                width, digits = min(n - (block << levels), 1 << levels), rank & ((1 << levels) - 1)
                left = descend(children, width, min(levels, height_of(n)), digits)[0] if n > 1 else []
                found.append(finish(tree, rank, *more, root, _segment(left, digits) + above))
            if found:
                yield _batch(found, out)

    return met.unionByName(asked).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").mapInArrow(answer, out)


_WAY = "tree long, block long, digest binary, path binary, root binary"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _segment(left: list[bytes], digits: int) -> bytes:
    """Unselected children, given top first, as steps from the bottom up."""
    out = []
    for level, sibling in enumerate(reversed(left)):
        side = b"\0" if not sibling else b"\1" if digits >> level & 1 else b"\2"
        out.append(side + (sibling or bytes(32)))
    return b"".join(out)


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf and its path's siblings give."""
    for at in range(0, len(path), 33):
        side, sibling = path[at], path[at + 1 : at + 33].hex()
        leaf = parent([leaf] if side == 0 else [sibling, leaf] if side == 1 else [leaf, sibling])
    return leaf


def siblings(path: bytes) -> list[str]:
    return [path[at + 1 : at + 33].hex() for at in range(0, len(path), 33) if path[at]]


def manifest(rows: DataFrame, ident: str, group: str, leaf: Column, forged: Column, levels: int = LEVELS) -> DataFrame:
    """ident, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    One tree for each value of ``group``, its leaves by ``ident``; one tree over their roots, by group, null first.
    Null ids come first, rows with one id follow their leaves' digests, and equal rows are neighbours.  ``forged`` is
    the leaf to be verified, null where that is ``leaf``.  No rows give no rows.  Columns of any other name are ignored.
    """
    own = rows.select(F.col(ident).cast("long").alias("ident"), F.col(group).cast("string").alias("grp"), F.unhex(leaf).alias("digest"), F.unhex(forged).alias("forged"))
    leaves = written(ranked(own, "grp", [F.asc_nulls_first("ident"), "digest"]).drop("grp"))
    records, tops = build(leaves, levels)
    upper = written(leaves.where("rank = 0").select("tree", "trees").join(tops, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("trees").alias("n"), "digest"))
    above, top = build(upper, levels)
    top = top.first()
    if top is None:
        return rows.sparkSession.createDataFrame([], f"{ident} long, {_PROOF}")
    root = top["digest"].hex()
    start = rows.sparkSession.createDataFrame([(0, top["digest"], b"")], "tree long, digest binary, path binary")
    starts = descents(upper, above, start, "digest binary", lambda _, rank, digest, root, path: (rank, digest, path), "tree long, digest binary, path binary", levels)

    def prove(tree: int, rank: int, ident: int | None, digest: bytes, forged: bytes | None, subroot: bytes, path: bytes) -> tuple:
        folded = fold((forged or digest).hex(), path)
        return ident, digest.hex(), subroot.hex(), root, parent(siblings(path)), folded, folded == root

    return descents(leaves, records, starts, "ident long, digest binary, forged binary", prove, f"ident long, {_PROOF}", levels).withColumnRenamed("ident", ident)


_PROOF = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def document_manifest(docs: DataFrame, forged_by: int = 7, levels: int = LEVELS) -> DataFrame:
    """``manifest`` of documents by lang; rows whose id's checksum ``forged_by`` divides are verified with one
    character more than they have (a null number stays, a null id is never forged)."""
    columns = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*columns[:3], docs["n_chars"].cast("long") + 1, columns[4]]
    hit = (F.crc32(docs["doc_id"].cast("string").cast("binary")) % forged_by == 0) & docs["n_chars"].isNotNull()
    return manifest(docs, "doc_id", "lang", row_digest(*columns), F.when(hit, row_digest(*more)), levels)


#: DuckDB has no crc32: eight steps of the polynomial for each character of the id's decimal text.
_CRC = "list_reduce(list_transform(range(0, length(doc_id::varchar) + 1), lambda i: cast(case when i = 0 then 4294967295 else ascii(substr(doc_id::varchar, i, 1)) end as bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"
_ENC = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
ORACLE = f"""
with recursive l as (select doc_id, lang, sha256(a || {_ENC("n_chars")} || z) as leaf, case when n_chars is not null and xor({_CRC}, 4294967295) % 7 = 0 then sha256(a || {_ENC("(n_chars + 1)")} || z) end as forged
  from (select *, {_ENC("doc_id")} || {_ENC("source")} || {_ENC("lang")} as a, {_ENC("text")} as z from documents)),
g as (select lang, row_number() over (order by lang nulls first) - 1 as tree from (select distinct lang from documents)),
p as materialized (select doc_id, tree, leaf, forged, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as rank, count(*) over (partition by tree) as n from l join g on l.lang is not distinct from g.lang),
t(level, tree, i, h, n) as (select 0, tree, rank, leaf, n from p union all select level + 1, tree, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from t where n > 1 group by level, tree, i // 2, n),
s as materialized (select * from t), o as materialized (select tree, h, count(*) over () as n from s where n = 1),
u(level, i, h, n) as (select 0, tree, h, n from o union all select level + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from u where n > 1 group by level, i // 2, n),
v as materialized (select * from u),
w as (select p.tree, p.rank, s.level, s.i & 1 as side, b.h from p join s on s.tree = p.tree and s.i = p.rank >> s.level and s.n > 1 left join s b on b.tree = s.tree and b.level = s.level and b.i = xor(s.i, 1)
 union all select p.tree, p.rank, 1000 + v.level, v.i & 1, b.h from p join v on v.i = p.tree >> v.level and v.n > 1 left join v b on b.level = v.level and b.i = xor(v.i, 1)),
x as materialized (select tree, rank, list(coalesce(h, '') order by level) as hs, list(side order by level) as sides from w group by tree, rank),
f(tree, rank, k, h) as (select tree, rank, 0, coalesce(forged, leaf) from p
 union all select f.tree, f.rank, k + 1, sha256(case when sides[k + 1] = 1 then hs[k + 1] || h else h || hs[k + 1] end) from f join x on f.tree = x.tree and f.rank = x.rank where k < len(hs)),
e as (select tree, rank, arg_max(h, k) as folded_root from f group by all)
select doc_id, leaf, o.h as subroot, r.h as root, sha256(coalesce(array_to_string(hs, ''), '')) as proof_sha256, folded_root, folded_root = r.h as verified
from p join o using (tree) join e on e.tree = p.tree and e.rank = p.rank left join x on x.tree = p.tree and x.rank = p.rank cross join (select h from v where n = 1) r
"""
