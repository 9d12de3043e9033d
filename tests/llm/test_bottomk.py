"""Bottom-k sketch groups against brute force."""

import random
import re

import numpy as np
import pytest

from readlake.llm import bottomk, jaccard

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text.translate(LOW))


def family_texts(rng):
    """Families of near copies larger than a block, chains, sets about as large as a sketch, passages that don't link."""
    vocabulary = [f"w{k}" for k in range(400)]
    texts, n = {}, 0
    for size, edits, length in ((14, 2, 150), (5, 9, 120), (6, 1, 62), (4, 1, 68), (9, 0, 90), (4, 3, 700), (3, 1, 30)):
        base = [rng.choice(vocabulary) for _ in range(length)]
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
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))
    for _ in range(25):
        texts[n] = passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 12, 80])))
        n += 1
    for t in (None, "", " ", "a", "A", "a b", "a  B", "b a", "x " * 30, "x " * 31, "a b c d e", "A b c d e"):
        texts[n] = t
        n += 1
    return texts


@pytest.mark.parametrize("block", [3, 256])
def test_groups_match_brute_force(spark, block):
    texts = family_texts(random.Random(11))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = jaccard.brute_force_groups(texts, 5, 85, split_words)
    rows = bottomk.sketch_groups(df, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows) and len(rows) == len(texts)


def test_groups_of_messy_rows(docs, messy, none):
    rows = bottomk.sketch_groups(docs).collect()
    want = jaccard.brute_force_groups({d: t for d, t in messy if d is not None}, 5, 85, split_words)
    assert len(rows) == len(messy)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    assert all(r["kept"] for r in rows if r["doc_id"] is None)
    assert bottomk.sketch_groups(none).collect() == []


def test_whole_table_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = jaccard.brute_force_groups({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}, 5, 85, split_words)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in bottomk.sketch_groups(docs).collect()} == want


def test_bounds_keep_the_chance():
    from math import comb

    for k, percent in ((64, 85), (64, 80), (32, 90)):
        bound = bottomk.SketchBound(k, percent, unions=400)
        for u in (k, k + 1, k + 9, 2 * k, 390):
            shared, least = -(-percent * u // 100), int(bound.shared(np.array([u]))[0])
            tail = sum(comb(shared, x) * comb(u - shared, k - x) for x in range(max(0, k - u + shared), least)) / comb(u, k)
            assert tail <= 1e-12
        far = sum(comb(k, x) * (percent / 100) ** x * (1 - percent / 100) ** (k - x) for x in range(bound.far))
        assert far <= 1e-12 and bound.far <= bound.least[-1]
        # all that may differ is less than the draw: no chance is left
        assert bound.shared(np.array([k + 1]))[0] == k - (k + 1 - -(-percent * (k + 1) // 100))


def test_prefixes_of_linked_sets_meet():
    """Every pair at the bound or above shares a value of its prefixes, whatever the common order."""
    rng, bound = np.random.default_rng(4), bottomk.SketchBound(64, 85)
    seen = 0
    for n in (1, 3, 12, 40, 58, 64, 70, 76, 130, 300, 6000):
        for _ in range(40):
            base = rng.integers(1, 1 << 62, n).astype(np.uint64)
            off = int(rng.integers(0, max(1, int(0.08 * n)) + 1))
            sets = [np.sort(base), np.sort(np.concatenate([base[off:], rng.integers(1, 1 << 62, int(rng.integers(0, off + 1))).astype(np.uint64)]))]
            shared = len(np.intersect1d(*sets))
            if 100 * shared < 85 * (len(sets[0]) + len(sets[1]) - shared):
                continue
            seen += 1
            values = bottomk.padded([s[:64].tobytes() for s in sets], 64)
            size = np.array([len(s) for s in sets])
            one, other = np.array([0]), np.array([1])
            assert bound.may_link(values, size, one, other).all()
            maps = [bottomk.parity_maps(s, np.array([len(s)]))[0].tobytes() for s in sets]
            assert len(bound.open_pairs(values, size, maps, np.ones((2, 2), bool))[0]) == 1
            assert bottomk.maps_allow(maps, size, one, other, 85).all()
            take = bound.prefix_length(size)
            order = lambda s: sorted(s[:64].tolist(), key=lambda v: (v * 2654435761) % 1000003)
            assert set(order(sets[0])[: take[0]]) & set(order(sets[1])[: take[1]])
    assert seen > 200


def test_estimate_counts_the_smallest_of_the_union():
    values = bottomk.padded([np.array(v, np.uint64).tobytes() for v in ([1, 3, 5, 7], [1, 2, 5, 6], [9])], 4)
    shared, low = bottomk.estimate(values, np.array([0, 0]), np.array([1, 2]), 4)
    assert shared.tolist() == [2, 0] and low.tolist() == [2, 0]
    assert bottomk.estimate(values, np.array([0]), np.array([1]), 3)[1].tolist() == [1]


def test_only_texts_that_meet_others_bring_sketches(spark, monkeypatch):
    """Sketches are joined again in every round, so texts that share no listed value stay out of their table."""
    seen, confirmed = [], bottomk._confirmed

    def watched(members, nodes, *more):
        seen.append(nodes.count())
        return confirmed(members, nodes, *more)

    monkeypatch.setattr(bottomk, "_confirmed", watched)
    alone = [(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(40)]
    pair = " ".join(f"p{i}" for i in range(100))
    rows = [*alone, (50, pair), (51, pair + " more")]
    got = {r["doc_id"]: r for r in bottomk.sketch_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen and set(seen) == {2}
    assert got[51]["component_id"] == 50 and not got[51]["kept"] and all(got[k]["kept"] for k in (*range(40), 50))
