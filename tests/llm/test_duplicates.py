"""Jaccard groups, components, decontamination, neighbours and chats against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

from readlake.llm import chats, decontaminate, jaccard, neighbours
from readlake.llm.components import components

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text.translate(LOW))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(5, 5), (70, 71), (71, 70)]
    rng.shuffle(pairs)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{1000 + k: 1000 for k in range(1, 40)}, 71: 70}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_a_long_chain_take_few_jobs(spark):
    order = list(range(3000))
    random.Random(3).shuffle(order)
    pairs = [*zip(order[:2000], order[1:2000]), *((order[2000], x) for x in order[2000:])]
    random.Random(4).shuffle(pairs)
    links = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    links.count()
    context = spark.sparkContext
    context.setJobGroup("chain", "components of a chain and a star")
    stars = components(links)
    jobs = len(context.statusTracker().getJobIdsForGroup("chain"))
    context.setLocalProperty("spark.jobGroup.id", None)
    least, other = min(order[:2000]), min(order[2000:])
    assert sorted(map(tuple, stars.collect())) == sorted([*((x, least) for x in order[:2000] if x != least), *((x, other) for x in order[2000:] if x != other)])
    assert jobs <= 40


@pytest.mark.parametrize("block", [3, 256])
def test_groups_match_brute_force(spark, block):
    """Families of near copies larger than a block, chains, shared passages and odd texts."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    texts, n = {}, 0
    for size, edits in ((12, 2), (5, 8), (2, 1), (9, 0)):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts[n] = " ".join(own)
            n += 1
    step = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(8):  # a chain: neighbours link, ends don't
        step[rng.randrange(200)] = rng.choice(vocabulary)
        step[rng.randrange(200)] = rng.choice(vocabulary)
        texts[n] = " ".join(step)
        n += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(20):
        texts[n] = passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 80])))
        n += 1
    for t in (None, "", " ", "a", "A", "a b", "a  B", "b a", "x " * 30, "x " * 31):
        texts[n] = t
        n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = jaccard.brute_force_groups(texts, 3, 90, split_words)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.shingle_groups(df, block=block).collect()}
    assert got == want


def test_groups_of_messy_rows(docs, messy, none):
    rows = jaccard.shingle_groups(docs).collect()
    want = jaccard.brute_force_groups({d: t for d, t in messy if d is not None}, 3, 90, split_words)
    assert len(rows) == len(messy)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    kept = jaccard.one_of_each(docs, jaccard.shingle_groups(docs))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(d for d in ids if d is not None) == sorted({d for d, (_, c) in want.items() if c == d}) and ids.count(None) == 2
    assert jaccard.shingle_groups(none).collect() == []


def test_parity_maps_never_part_what_can_link():
    rng = np.random.default_rng(0)
    for n in (3, 40, 700, 9000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        off = max(1, n // 25)
        other = np.concatenate([base[off:], rng.integers(0, 1 << 63, off).astype(np.uint64)])
        maps = [jaccard.parity_maps(k, np.array([len(k)]))[0].tobytes() for k in (base, other, rng.integers(0, 1 << 63, n).astype(np.uint64))]
        near, _, far = jaccard.folded(maps, len(maps[0]))
        apart = [int(np.bitwise_count(jaccard.folded(maps, len(maps[0]))[0] ^ m).sum()) for m in jaccard.folded(maps, len(maps[0]))[1:]]
        assert apart[0] <= 2 * off
        assert n < 100 or not jaccard.can_link(n, n, apart[1], 90)


def brute_leaks(texts, items, percent=80):
    from collections import Counter

    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    out = set()
    for d, t in texts:
        w = split_words(t or "")
        for i, item in items:
            iw = split_words(item)
            k = min(5, len(iw))
            if not iw:
                continue
            own = Counter(grams(iw, k))
            for a in range(max(1, len(w) - len(iw) + 1)):
                other = Counter(grams(w[a : a + len(iw)], k))
                if other and sum((own & other).values()) * 100 >= percent * sum((own | other).values()):
                    out.add((d, i))
                    break
    return out


def test_leaks_match_brute_force(spark, docs, messy, none):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([14, 30, 59])))) for k in range(12)] + [(50, "two words"), (51, ""), (52, "ha ha ha ha ha ha ha ha")]
    texts = [(100 + k, " ".join(word() for _ in range(80))) for k in range(10)]
    for k in range(24):
        w = items[k % 12][1].split()
        if k >= 12:
            w[rng.choice([0, 1, len(w) - 1])] = "changed"
        texts.append((200 + k, " ".join([*(word() for _ in range(k)), *(x.upper() for x in w), *(word() for _ in range(k % 5))])))
    texts += [(300, "say two  words now"), (301, items[0][1] + " " + items[1][1]), (302, "ha " * 40)]
    bench = spark.createDataFrame([*items, (None, "null id"), (60, None)], "item_id long, text string")
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontaminate.find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(texts, items)
    assert all(r["similarity"] >= 0.8 for r in got)
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()) == sorted(d for d, _ in texts if d not in {r["doc_id"] for r in got})
    assert decontaminate.find_leaks(docs, bench).collect() == [] and decontaminate.find_leaks(none, bench).collect() == []
    assert decontaminate.find_leaks(df, bench.limit(0)).collect() == []


def test_leaks_in_several_passes(spark, monkeypatch):
    bench = spark.createDataFrame([(k, f"item number {k} has some words of its very own {k}") for k in range(9)], "item_id long, text string")
    df = spark.createDataFrame([(1, "x item number 4 has some words of its very own 4 y"), (2, "nothing")], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 100)
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).where("similarity = 1").collect()] == [(1, 4)]


def exact_neighbours(rows, asked, k):
    out = {}
    for q, v in asked:
        scored = []
        for i, w in rows:
            if i != q:
                scored.append((-float(np.dot(v, w) / (np.sqrt((np.array(v) ** 2).sum()) * np.sqrt((np.array(w) ** 2).sum()))), i))
        out[q] = [(i, round(-s, 9)) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def test_neighbours_exact_at_factor_one_and_near_below(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # equal vectors: ties by id
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (2004, [None] * 8), (None, rows[0][1]), (2005, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, shard string")
    vectors = neighbours.usable(table, "vec_id", "embedding")
    asked = vectors.where("id % 50 = 0")
    want = exact_neighbours(rows, [r for r in rows if r[0] % 50 == 0], 5)
    for factor, least in ((1.0, 1.0), (0.5, 0.9)):
        got = {}
        for r in neighbours.nearest(vectors, asked, 5, factor, least_rows=100).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in own}) for q, own in want.items())
        assert hits >= least * sum(map(len, want.values()))
        if factor == 1.0:
            assert got == want
    assert neighbours.nearest(vectors.limit(0), asked.limit(0)).collect() == []
    assert len(neighbours.nearest(vectors.where("id < 3"), vectors.where("id = 0")).collect()) == 2


def test_chats_keep_maximal_conversations(spark):
    turns = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "x", 6: "a" * 1100, 7: "a" * 600, 8: "b"}
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t) for c, own in turns.items() for k, t in enumerate(own)]
    rows += [(9, 0, None, None), (9, 1, "assistant", "<|im_end|>"), (None, 0, "user", "lost"), (5, 0, "user", "x"), (10, None, "user", "first"), (10, 5, "user", "then")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, k int, part int")
    got = chats.render_chats(df).collect()
    assert sorted({r["conv_id"] for r in got}) == [2, 4, 5, 6, 8, 9, 10]
    whole = "".join(r["text"] for r in sorted((r for r in got if r["conv_id"] == 6), key=lambda r: r["part"]))
    assert whole.count("<|im_start|>") == 1100 and {r["n_turns"] for r in got if r["conv_id"] == 6} == {1100}
    assert next(r["text"] for r in got if r["conv_id"] == 9) == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n< |im_end|><|im_end|>\n"
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas())
    assert sorted(con.execute(chats.ORACLE).fetchall()) == sorted((r["conv_id"], r["part"], r["n_turns"], r["text"]) for r in got)
    assert chats.render_chats(df.limit(0)).collect() == []


def test_one_of_each_goes_by_row(spark):
    base = [f"w{k}" for k in range(300)]
    text = " ".join(base)
    near, other = " ".join([*base[:299], "changed"]), " ".join(f"o{k}" for k in range(50))
    rows = [(5, text, 1), (5, other, 2), (6, near, 3), (6, "quite another text here", 4), (None, text, 5), (None, "only null ids", 6), (None, "only null ids", 7), (None, None, 8), (7, "", 9), (7, "", 10), (5, text, 11), (4, text.upper(), 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy int")
    kept = jaccard.one_of_each(df, jaccard.shingle_groups(df, shingle=5, percent=80))
    got = [tuple(r) for r in kept.collect()]
    assert kept.schema == df.schema
    assert sorted(k for *_, k in got if k not in (6, 7)) == [2, 4, 8, 9, 10, 12]
    assert sum(k in (6, 7) for *_, k in got) == 1
    again = df.where("copy in (1, 2, 11)")
    assert sorted(t[:2] for t in (r["text"] for r in jaccard.one_of_each(again, jaccard.shingle_groups(again)).collect())) == ["o0", "w0"]
    none = df.limit(0)
    assert jaccard.one_of_each(none, jaccard.shingle_groups(none)).collect() == []


def test_one_of_each_with_names_of_its_own(spark):
    rows = [(1, "a b c d e f", 7, "p"), (2, "a b c d e f", 8, "q"), (2, "a b c d e f", 9, "r"), (3, "g h i", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, its_id long, its_copy string")
    kept = jaccard.one_of_each(df, jaccard.shingle_groups(df, shingle=5, percent=80))
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[3]]
    again = df.where("doc_id = 2")
    assert len(jaccard.one_of_each(again, jaccard.shingle_groups(again)).collect()) == 1


def test_parity_maps_at_a_lower_bound():
    """At 80 % maps are wide enough that unrelated sets of any size are told apart, and linked ones never are."""
    rng = np.random.default_rng(3)
    for n in (40, 500, 1000, 1024, 5000):
        base, off = rng.integers(0, 1 << 63, n).astype(np.uint64), n // 10
        near = np.concatenate([base[off:], rng.integers(0, 1 << 63, off).astype(np.uint64)])
        maps = [jaccard.parity_maps(k, np.array([len(k)]), 80)[0].tobytes() for k in (base, near, rng.integers(0, 1 << 63, n).astype(np.uint64))]
        whole = jaccard.folded(maps, len(maps[0]))
        apart = [int(np.bitwise_count(whole[0] ^ m).sum()) for m in whole[1:]]
        assert jaccard.can_link(n, n, apart[0], 80) and (n < 100 or not jaccard.can_link(n, n, apart[1], 80))
