"""Secrets, classifiers, the language model and the pipeline."""

import base64
import json
import math
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readlake.llm import pitman_yor, quality, queries, secrets, toxicity

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | len(n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


NUMBER = der(2, b"\x01" * 64)
RSA = der(0x30, der(2, b"\0"), *[NUMBER] * 8)
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x86\x48")), der(4, RSA))
EC = der(0x30, der(2, b"\x01"), der(4, b"\x07" * 32))


def wrapped(data, label="RSA PRIVATE KEY"):
    text = base64.b64encode(data).decode()
    return f"-----BEGIN {label}-----\n" + "\n".join(text[k : k + 64] for k in range(0, len(text), 64)) + f"\n-----END {label}-----"


def token(header, signature=b"s" * 32):
    part = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    return ".".join((part(json.dumps(header).encode()), part(b'{"sub":"1"}'), part(signature)))


def test_structures():
    assert all(map(secrets.is_der_key, (RSA, PKCS8, EC)))
    assert not any(map(secrets.is_der_key, (RSA[:-1], RSA + b"\0", b"", b"\x30\x03abc", der(0x30, der(2, b"\x05"), der(4, b"x")))))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"pub") + field(b"private")
    assert secrets.is_ssh_key(ssh) and not secrets.is_ssh_key(ssh[:-1]) and not secrets.is_ssh_key(b"x")
    assert secrets.is_token(token({"alg": "HS256"})) and not secrets.is_token(token({"typ": "JWT"})) and not secrets.is_token(token({"alg": "HS256"}, b"short"))


def brute_base(text):
    """The contract's patterns as they stand, with failing matches dropped."""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_query_matches_brute_force(spark, docs, messy, none):
    texts = [
        'PassWord": "hunter2hunter2" x', "token:token:longvalue123", "api_key=short secret = abcdefgh", "🙂 AKIA" + "A" * 11 + " AKIA" + "B" * 12 + "é" + "a0" * 16 + "g" + "f" * 31, wrapped(RSA), "x " + base64.b64encode(PKCS8).decode() + " y",
        RSA.hex(), token({"alg": "HS256"}), wrapped(b"not a key at all, just bytes"), "ſecret=abcdefgh1", "", None, "secret=" + "x" * 300_000,
    ]
    rows = [(900 + k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = secrets.secret_digest(secrets.find_secrets(df)).collect()
    want = Counter()
    for d, t in rows + messy:
        base = brute_base(t or "")
        n = Counter(k for k, _, _ in base)
        want[d, n["assign"], n["access"], n["hex"], secrets.sha256_of(base)] += 1
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    kinds = {r["doc_id"]: {s.split(":")[0] for s in r["spans"].split(",") if s} for r in got}
    assert [kinds[904], kinds[905], kinds[906], kinds[907], kinds[908]] == [{"pem"}, {"der"}, {"hex", "der"}, {"token"}, set()]
    assert secrets.find_secrets(none).collect() == []


def test_redaction_keeps_rows_and_columns(spark, docs):
    out = secrets.with_redactions(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    df = spark.createDataFrame([(1, "a password=abcdefghij b", 23), (2, None, 0), (3, "clean", 99)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.with_redactions(df).collect()}
    assert got == {1: ("a [secret:assign] b", 19), 2: (None, 0), 3: ("clean", 99)}


def brute_marginals(crf, emit):
    """P(good) of each line by all assignments."""
    n, total, good = len(emit), 0.0, np.zeros(len(emit))
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        w = math.exp(sum(e for e, v in zip(emit, y, strict=True) if v) + crf.start * y[0] + sum(crf.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        good += w * np.array(y)
    return good / total


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    crf = quality.LineCRF(np.zeros(1), rng.normal(size=(2, 2)), 0.3)
    sizes = [5, 1, 3, 7]
    emit = rng.normal(size=sum(sizes)) * 2
    got, expected = crf.marginals(emit, np.repeat(np.arange(4), sizes), pairs=True)
    at = np.cumsum([0, *sizes])
    for a, b in zip(at[:-1], at[1:], strict=True):
        assert np.allclose(got[a:b], brute_marginals(crf, emit[a:b]))
    assert np.isclose(expected.sum(), sum(n - 1 for n in sizes))


def test_lines():
    import pyarrow as pa

    from readlake.llm.textkit import text_bytes

    texts = ["a\nbb", "", None, "\n", "x\n\ny\n"]
    buf, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, ends, rows = quality.line_spans(buf, offsets)
    got = defaultdict(list)
    for a, b, r in zip(starts, ends, rows, strict=True):
        got[r].append(buf[a:b].tobytes().decode())
    assert {k: v for k, v in got.items()} == {0: ["a", "bb"], 1: [""], 2: [""], 3: [""], 4: ["x", "", "y"]}


def accuracy(rows, labels, wanted, held):
    both = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and r["held_out"] == held]
    return sum(p == y for p, y in both) / max(len(both), 1), len(both)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_line_quality(spark, sf).collect()
    good, n = accuracy(rows, labels, 1, True)
    assert n > 50 and good > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, sf).collect()
    good, n = accuracy(rows, labels, 1, True)
    assert n > 500 and good > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxic_phrase_of_ordinary_words(spark):
    """A rare phrase of words that both classes have is toxic; a long clean text with its words apart isn't."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    phrase = vocabulary[7:13]
    rows = [(k, " ".join([*text(rng.choice((5, 40, 150, 400))), *phrase * (k % 4 == 0), *text(20)]), int(k % 4 == 0)) for k in range(1200)]
    rows += [(5000 + k, " ".join([*text(20), *phrase, *text(20)]), None) for k in range(20)] + [(6000 + k, " ".join(text(400)), None) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.where("toxic is not null").select("doc_id", "toxic")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels)).collect()}
    assert sum(got[5000 + k] for k in range(20)) >= 18 and sum(got[6000 + k] for k in range(20)) <= 2


@pytest.mark.parametrize("fit", [(quality.fit_quality, quality.score_quality, "quality"), (toxicity.fit_toxicity, toxicity.score_toxicity, "toxic")])
def test_classifiers_on_odd_tables(spark, docs, messy, none, fit):
    train, score, label = fit
    labels = spark.createDataFrame([(k, k % 2, k % 2, "x") for k in range(40)] + [(3, None, None, "x"), (3, 1, 1, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, text string")
    rows = score(docs, train(docs, labels)).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in messy) and all(0 <= r["score"] <= 1 for r in rows)
    assert score(none, train(docs, labels)).collect() == []
    assert len(score(docs, train(docs, labels.limit(0))).collect()) == len(messy)
    assert len(score(docs, train(none, labels)).collect()) == len(messy)


def test_accepted_keeps_columns(docs):
    crf = quality.LineCRF(np.zeros(3 * len(quality.FEATURES) * 18), np.zeros((2, 2)), 0.0)
    assert quality.accepted(docs, crf, 0.5).count() == docs.count() and quality.accepted(docs, crf, 0.51).count() == 0
    assert quality.accepted(docs, crf, 0.5).schema == docs.schema


def test_base_scores_and_both_plans(spark, docs, messy, none):
    split = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)), "\n"]
    learned = [(d, t) for d, t in messy if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(w for _, t in learned for w in split(t))
    total, kinds = sum(counts.values()), len(counts)
    fast = pitman_yor.score_texts(docs).collect()
    slow = pitman_yor.score_texts(docs, broadcast_rows=0).collect()
    value = lambda r: (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6), round(r["open_score"], 6))
    assert Counter(map(value, fast)) == Counter(map(value, slow)) and len(fast) == len(messy)
    want = Counter()
    for d, t in messy:
        w = split(t)
        want[d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w), 6)] += 1
    assert Counter(value(r)[:6] for r in fast) == want
    assert pitman_yor.score_texts(none).collect() == []


def test_word_probabilities_sum_to_one(spark, docs):
    """Known words and the one outcome for all others; and the spelling model over all next bytes."""
    own = docs.select("doc_id", "text")
    from pyspark.sql import functions as F

    words = pitman_yor.word_counts(own, F.lit(True)).cache()
    kinds, total = words.count(), words.agg(F.sum("n")).first()[0]
    model, top = pitman_yor.fit_spelling(pitman_yor.gram_counts(words, 5), 5)
    tables = pitman_yor._in_arrays(model, top)
    for context in (b"\n\n\n\n", b"\n\nan", b"zzzz"):
        key = int.from_bytes(context, "big") << 8
        assert np.isclose(tables.probability(key + np.arange(256)).sum(), 1)
    spelled = pitman_yor._spelled_in_tasks(words, spark.sparkContext.broadcast(tables))
    book, unknown = pitman_yor.lexicon(spelled, total, kinds, 0.7)
    assert np.isclose(sum(10 ** r["open_value"] for r in book.collect()) + 10**unknown, 1, atol=1e-6)


def test_every_customer_is_seated_again(spark):
    """Tables of frequent words grow as one-by-one seating makes them, and don't depend on partitions or batches."""
    rng, n, parent, discount, others = np.random.default_rng(0), 3000, 0.02, 0.5, 500
    one_by_one = []
    for _ in range(200):
        t = 1
        for c in range(1, n):
            new = (1 + discount * (others + t)) * parent
            t += rng.random() * (new + c - discount * t) < new
        one_by_one.append(t)
    k = 400
    got = pitman_yor.reseat(np.full(k, n), np.full(k, parent), np.full(k, others), discount, np.arange(k), 3)
    assert abs(got.mean() - np.mean(one_by_one)) < 1.5 and got.min() > 13 and got.std() > 1
    rows = [(f"w{i}".encode(), 1 + i * i, -3.0 - i / 50) for i in range(300)]
    df = spark.createDataFrame(rows, "word binary, n long, spelled double")
    total = sum(r[1] for r in rows)
    first, second = ({r["key"]: r["open_value"] for r in pitman_yor.lexicon(df.repartition(parts), total, 300, 0.7)[0].collect()} for parts in (1, 7))
    assert first.keys() == second.keys() and all(math.isclose(first[w], second[w], rel_tol=1e-9) for w in first)


def test_scores_depend_on_word_order(spark, monkeypatch):
    """A phrase of the training texts scores above its scrambled words, in all plans."""
    import random

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.sample(vocabulary, 30))) for k in range(300)]
    learned = next(t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2).split()
    held = [k for k in range(300, 400) if zlib.crc32(str(k).encode()) % 7 == 2]
    scrambled = learned[:]
    rng.shuffle(scrambled)
    rows += [(held[0], " ".join(learned)), (held[1], " ".join(scrambled)), (held[2], ""), *((d, w) for d, w in zip(held[3:], vocabulary, strict=False))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plans = [pitman_yor.score_texts(df), pitman_yor.score_texts(df, broadcast_rows=0)]
    monkeypatch.setattr(pitman_yor, "_HOT", 50)
    plans.append(pitman_yor.score_texts(df))
    got = [{r["doc_id"]: r for r in p.collect()} for p in plans]
    for g in got:
        assert g[held[0]]["score"] > g[held[1]]["score"] + 1 and g[held[0]]["base_score"] == pytest.approx(g[held[1]]["base_score"])
        assert all(g[d]["score"] == pytest.approx(got[0][d]["score"], abs=1e-6) for d, _ in rows)


def test_held_out_texts_score_above_the_base(spark):
    rows = [r for r in queries.op4_pitman_yor(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_pipeline_stage_by_stage(spark, tmp_path):
    import shutil

    import corpus_pipeline as p
    from readlake.llm import decontaminate, jaccard

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = docs
    for k, (_, stage) in enumerate(p.STAGES):
        before = {r["doc_id"]: r["text"] for r in seen.collect()}
        stage(spark, seen, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == docs.columns
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        if k == 0:
            assert sum(labels.get(d) == 1 for d in ids) >= 0.95 * sum(labels.get(d) == 1 for d in before) and sum(labels.get(d) == 0 for d in ids) <= 0.2 * sum(labels.get(d) == 0 for d in before)
        elif k == 1:
            groups = jaccard.brute_force_groups(before, 5, 80, lambda t: re.findall("[^\x20\x09-\x0d]+", t.translate(LOW)))
            assert sorted(ids) == sorted(d for d, (_, c) in groups.items() if c == d)
        elif k == 2:
            leaks = {r["doc_id"] for r in decontaminate.find_leaks(seen, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert sorted(ids) == sorted(set(before) - leaks)
        elif k == 3:
            got = {r["doc_id"]: r["text"] for r in after.collect()}
            assert {d: secrets.redacted(t, secrets.base_spans(t) + secrets.confirmed_spans(t)) for d, t in before.items()} == got
        else:
            assert set(ids) == set(before) and after.count() >= len(before)
        seen = after
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_leaks_go_by_row(spark):
    from readlake.llm import decontaminate

    item = " ".join(f"q{k}" for k in range(20))
    rows = [(None, f"a b {item} c"), (None, "clean text"), (5, f"{item} d"), (5, "another clean text"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate.without_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.schema == df.schema and {tuple(r) for r in out.collect()} == {(None, "clean text"), (5, "another clean text"), (6, None)}


def test_secret_patterns_read_long_texts_in_linear_time():
    """Openings without an end, headers without a dot and runs of letters: megabytes take seconds, and keys after them are found."""
    import time

    key, signed = wrapped(RSA), token({"alg": "HS256"})
    hostile = ["eyJ" * 1_700_000, "-----BEGIN RSA PRIVATE KEY-----\n" * 150_000, "eyJa." * 1_000_000, "token " * 800_000, "30" * 2_500_000, "a" * 5_000_000 + "eyJ", "-" * 5_000_000]
    for text in hostile:
        began = time.monotonic()
        spans = secrets.base_spans(text) + secrets.confirmed_spans(text + " " + key + " " + signed)
        assert time.monotonic() - began < 20
        assert ("pem", len(text) + 1, len(text) + 1 + len(key.strip())) in spans or ("pem", len(text) + 1, len(text) + 1 + len(key)) in spans
        assert ("token", len(text) + len(key) + 2, len(text) + len(key) + len(signed) + 2) in spans


def test_tokens_as_the_plain_pattern_finds_them():
    """The linear pattern has the matches of the plain one."""
    import random

    plain = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(["eyJ", "ey", "J", ".", "a", "-", " ", "é"]) for _ in range(rng.randint(0, 24)))
        assert [m.span(1) for m in secrets._TOKEN.finditer(text)] == [m.span() for m in plain.finditer(text)], text


def test_stages_with_extra_columns_and_empty_tables(spark, tmp_path):
    """Clashing names, null ids and texts, repeated rows; each stage alone, and on no rows at all."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    some = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(12)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "no id", "en", "s", 5), (-1, "", "en", "s", 0), (-2, "\u00e9 \ud83d\ude42 \u65e5\u672c".encode("utf-16", "surrogatepass").decode("utf-16"), "en", "s", 6)], some.schema)
    docs = some.unionByName(some.limit(2)).unionByName(odd)
    wide = docs.selectExpr("*", "'x' as node", "1 as copy", "2 as its_id", "'y' as its_copy", "3 as piece", "'z' as keys").repartition(3)
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, wide, sf)
        rows = out.collect()
        assert rows, name
        assert stage(spark, wide.limit(0), sf).collect() == [], name
        if k < 4:
            assert out.columns == wide.columns
        else:
            places = {}
            for r in rows:
                places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for own in places.values():
                at = 0
                for offset, length in sorted(own):
                    assert offset == at
                    at += length
                assert at <= 2048
            assert len(rows) >= wide.count()


def test_word_counts_gather_different_words_only(spark):
    """A task's memory goes with the different words of its texts, not with their length."""

    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            self.work = work
            return self

        groupBy = agg = select

    rows, text = Rows(), " ".join(f"w{k % 997}" for k in range(100_000))
    pitman_yor.word_counts(rows, F.lit(True))
    batch = pa.RecordBatch.from_pydict({"text": [text] * 40, "learn": [True] * 40})
    tracemalloc.start()
    found = {w: n for out in rows.work(iter([batch])) for w, n in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20
    assert found[b"\n"] == 40 and found[b"w0"] == 40 * text.split().count("w0") and len(found) == 998


def test_word_sums_in_spans_match_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(pitman_yor, "_SPAN", 16)
    named = pitman_yor.word_counts(docs, F.lit(True)).select("word", "n", F.lit(-1.0).alias("spelled"))
    pairs = pitman_yor.WordPairs(docs, F.lit(True), pitman_yor._keyed(named), 1000)
    counts = {}
    for row in docs.select("text").collect():
        words = [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), row["text"] or "")), None]
        for pair in zip(["start", *words[:-1]], words, strict=True):
            counts[pair] = counts.get(pair, 0) + 1
    by = lambda at, value: sorted(Counter(v for pair, n in counts.items() for v in [pair[at]] * value(n)).values())
    positive = lambda x: sorted(x[x > 0].tolist())
    assert positive(pairs.tables) == by(0, lambda n: 1)
    assert positive(pairs.contexts) == by(1, lambda n: 1)
    assert positive(pairs.customers) == by(0, lambda n: n)


def test_the_language_model_runs_one_python_worker_a_task(docs, monkeypatch):
    stages, write = [], pitman_yor.written

    def written(df, *more):
        stages.extend(re.split("Exchange", df._jdf.queryExecution().executedPlan().toString()))
        return write(df, *more)

    monkeypatch.setattr(pitman_yor, "written", written)
    last = pitman_yor.score_texts(docs)
    stages.extend(re.split("Exchange", last._jdf.queryExecution().executedPlan().toString()))
    assert sum("MapInArrow" in x for x in stages) > 5
    assert max(x.count("MapInArrow") for x in stages) == 1


def test_a_lexicon_in_ranges_gives_the_same_scores(spark, docs, monkeypatch):
    """Many ranges and small chunks; the table twice, so that chunks of texts come twice as well; few frequent words and pairs."""
    twice = docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    value = lambda r: (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5), round(r["open_score"], 5))
    want = Counter(map(value, pitman_yor.score_texts(twice).collect()))
    assert set(want.values()) >= {2}
    for k, v in (("_RANGE_WORDS", 60), ("_BUCKET_TOKENS", 100), ("_CHUNK_TOKENS", 900), ("_HOT", 40)):
        monkeypatch.setattr(pitman_yor, k, v)
    assert Counter(map(value, pitman_yor.score_texts(twice, broadcast_rows=0).collect())) == want


def test_places_of_keys_with_equal_upper_halves():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, 500), (rng.integers(-4, 4, 60) << 32) + rng.integers(0, 1 << 32, 60), [1, -(1 << 63)]]))
    edges = np.array([0, np.searchsorted(keys, 0), np.searchsorted(keys, 0), len(keys)])
    parts = []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        tops = keys[i:j] >> 32
        alike = np.flatnonzero([(tops == t).sum() > 1 for t in tops])
        parts.append({pitman_yor._TOPS: pitman_yor._packed(np.diff(tops, prepend=0)), pitman_yor._ALIKE: pitman_yor._packed(keys[i:j][alike]), pitman_yor._ALIKE_AT: pitman_yor._packed(alike)} if i < j else {})
    asked = rng.permutation(len(keys))
    assert (pitman_yor._Places(parts, edges).find(keys[asked]) == asked).all()


@pytest.mark.parametrize("broadcast_rows", [5_000_000, 0])
def test_the_language_model_leaves_no_shuffle_files(spark, docs, broadcast_rows):
    """What its jobs dealt out goes with them, so that the disk need not hold all of it to the end."""
    blocks = lambda: {b.name() for b in iter_java(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if b.isShuffle()}

    def iter_java(found):
        return [found.apply(k) for k in range(found.size())]

    before = blocks()
    scored = pitman_yor.score_texts(docs.select("doc_id", "text"), broadcast_rows=broadcast_rows)
    end = time.monotonic() + 20
    while (left := blocks() - before) and time.monotonic() < end:
        time.sleep(0.2)
    assert not left
    assert scored.count() == docs.count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
