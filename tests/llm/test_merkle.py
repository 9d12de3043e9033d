"""The Merkle manifest against a tree built by loops."""

from hashlib import sha256
from zlib import crc32

import duckdb
import pytest

from readlake.llm import merkle

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc, source, lang, n, text = row
    values = (doc, source, lang, None if n is None else n + more, text)
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    """The root, and for each leaf its siblings with their side (None: no sibling), by levels of runs of two."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    proofs = []
    for i in range(len(leaves)):
        steps = []
        for nodes in levels[:-1]:
            steps.append((nodes[i ^ 1] if (i ^ 1) < len(nodes) else None, i & 1))
            i //= 2
        proofs.append(steps)
    return levels[-1][0], proofs


def brute(rows):
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in groups}
    trees = {g: tree([leaf_of(r) for r in own[g]]) for g in groups}
    if not groups:
        return []
    root, above = tree([trees[g][0] for g in groups])
    out = []
    for g, steps_up in zip(groups, above, strict=True):
        for r, steps in zip(own[g], trees[g][1], strict=True):
            hit = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(r, int(hit))
            for sibling, right in [*steps, *steps_up]:
                node = digest([node] if sibling is None else [sibling, node] if right else [node, sibling])
            out.append((r[0], leaf_of(r), trees[g][0], root, digest(s for s, _ in [*steps, *steps_up] if s), node, node == root))
    return sorted(out, key=str)


def made(rows, spark, levels):
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int").repartition(3)
    return sorted((tuple(r) for r in merkle.document_manifest(table, levels=levels).collect()), key=str)


def sample():
    rows = [(k, "s", ("en", "de", None, "é", "z")[(k * k) % 5 if k % 3 else 0], k, f"text {k} ä🙂") for k in range(130)]
    rows += [(500, None, "only", None, None), (501, "", "", 0, ""), (7, "s", "en", 3, "again"), (7, "s", "en", 3, "again"), (7, "t", "de", 3, "other")]
    return rows + [(None, "s", "en", 1, "no id"), (None, None, None, None, None), (600, "s", "long", 9, "w " * 300_000), (601, "s", "en", None, "nul\0 byte")]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_matches_loops(spark, levels):
    assert made(sample(), spark, levels) == brute(sample())


def test_small_trees(spark):
    for n in (0, 1, 2, 3, 5):
        rows = [(k, "s", "en", k, "t") for k in range(n)]
        assert made(rows, spark, 2) == brute(rows)
    rows = [(k, "s", f"g{k:03}", k, "t") for k in range(37)]  # one leaf in each of many trees
    assert made(rows, spark, 2) == brute(rows)


def test_many_equal_rows(spark):
    rows = [(1, "s", "en", 4, "same")] * 3000 + [(k, "s", "en", 4, "t") for k in range(2, 200)]
    assert made(rows, spark, 4) == brute(rows)


def test_tampering_is_found_and_nothing_else(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = merkle.document_manifest(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["verified"] == (crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(merkle.ORACLE)
    assert [d[0] for d in cur.description] == list(rows[0].asDict())
    assert sorted(cur.fetchall()) == sorted(map(tuple, rows))
