"""Operators against brute-force versions, exact round trips and held-out accuracy."""

import base64
import bisect
import collections
import functools
import hashlib
import pickle
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import automaton, op1_language, op2_shard, op3_fingerprint, op4_toxicity, op5_decontaminate, op6_sentencepiece, op7_tokens, op8_jaccard, op9_secrets, op10_binary, ranges, registry, textbuf, units
from cairn.llm.spm_model import BYTE, CONTROL, NORMAL, UNKNOWN
from tests.compare import same


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    same(registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df())


def words(text):
    return [w.decode() for w in op5_decontaminate.normalised(text)]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_word_hashes_agree_with_a_plain_split(docs):
    texts = [*docs.values(), "Éa É", "", "a" * 5000]
    data, offsets = textbuf.buffers(pa.array(texts))
    starts, ends, doc, h = textbuf.words(data, offsets)
    got = collections.defaultdict(list)
    low = textbuf.LOWER[data].tobytes()
    for s, e, d in zip(starts, ends, doc, strict=True):
        got[int(d)].append(low[s:e].decode())
    assert [got[i] for i in range(len(texts))] == [words(t) for t in texts]
    by = collections.defaultdict(set)
    for s, e, x in zip(starts, ends, h, strict=True):
        by[int(x)].add(low[s:e])
    assert all(len(v) == 1 for v in by.values())


def test_much_text_in_pieces(docs, monkeypatch):
    """Words, tokens and ids of long texts do not depend on the pieces that they are looked at in."""
    texts = pa.array([*docs.values(), "", "x" * 5000, "é" * 3000, " ".join(docs.values()), None, "日本 " * 900, "", "a\n\nb   c" * 400])
    data, offsets = textbuf.buffers(texts)
    codec, encoder = op6_sentencepiece.Codec(op6_sentencepiece.model_path()), op10_binary.unit_encoder(op7_tokens.tokenizer_path())
    whole, ids, other = textbuf.words(data, offsets), codec.encode(texts), encoder.run(data, offsets)
    one = pa.array([" ".join(docs.values())])
    alone = codec.encode(one)
    spelled = codec.decode(*ids)
    for size in (1000, 4096):
        monkeypatch.setattr(textbuf, "PIECE_BYTES", size)
        monkeypatch.setattr(units, "PIECE_BYTES", size)
        monkeypatch.setattr(units, "LOOK", 64)
        monkeypatch.setattr(op6_sentencepiece, "DECODED_IDS", size // 10)
        for x, y in zip(textbuf.words(data, offsets), whole, strict=True):
            assert np.array_equal(x, y)
        for got, want in ((codec.encode(texts), ids), (encoder.run(data, offsets), other), (codec.encode(one), alone)):
            assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
        assert codec.decode(*ids) == spelled == [(t or "").encode() for t in texts.to_pylist()]


def test_language_held_out(spark, sf):
    got = op1_language.op1(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.collect())


def _plain_score(model, text):
    """The log probability of each language: every segmentation of every word, by plain recursion."""
    p = {t: model.prob[i] for i, t in enumerate(model.pieces.texts) if t}

    @functools.cache
    def total(s):
        return np.ones(len(model.languages)) if not s else sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    return sum((np.log(total(b" " + w)) for w in op5_decontaminate.normalised(text) if re.search(rb"[a-z\x80-\xff]", w)), np.zeros(len(model.languages)))


def test_forward_algorithm_sums_all_segmentations():
    model = op1_language.learn([("a", "banana ananas"), ("b", "tomato potato")], op1_language.vocabulary_path(), rounds=1)
    for word in ("banana", "internationalisation", "Überraschung", "x" * 50):
        data, offsets = textbuf.buffers(pa.array([word]))
        low, starts, lengths, _, _ = op1_language.units(data, offsets)
        assert np.allclose(op1_language.log_scores(low, starts, lengths, model.pieces, model.prob)[0], _plain_score(model, word))
    assert max(model.pieces.lengths) > 20


def test_long_words_are_parted_between_characters():
    for text in ("日本語" * 100, "aé😀" * 60, "x" * 1000 + "é", "é" * 31 + "a"):
        data, offsets = textbuf.buffers(pa.array(["a b", text]))
        low, starts, lengths, code, doc = op1_language.units(data, offsets)
        got = [low[starts[c] : starts[c] + lengths[c]].tobytes() for c, d in zip(code, doc, strict=True) if d == 1]
        assert b"".join(got) == text.encode() and max(map(len, got)) <= op1_language.UNIT
        assert all(x.decode() for x in got)


def test_language_query_against_plain_scores(spark, sf, docs):
    """Every row of the query, from the same model, by plain recursion."""
    model = op1_language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    got = {r["doc_id"]: r for r in op1_language.op1(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text or ""):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
        elif max(map(len, op5_decontaminate.normalised(text)), default=0) < op1_language.UNIT - 3:
            total = _plain_score(model, text)
            post = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
            assert got[d]["lang_pred"] == model.languages[int(post.argmax())] and np.isclose(got[d]["score"], post.max(), atol=1e-6)


def test_samples_are_bounded_and_whole(spark):
    """However often an id or a row repeats, some texts of each language are learned, and no more than the bound."""
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    ids = [i for i in range(100) if not held(i)]
    rows = [(ids[0], f"one id {k}", "aa") for k in range(3000)] + [(ids[k % 9], "the same row", "bb") for k in range(3000)] + [(i, f"text {i}", "cc") for i in ids]
    rows += [(None, "no id", "dd"), (ids[1], None, "aa"), (ids[2], "no language", None), (next(i for i in range(99) if held(i)), "held out", "ee")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    count = collections.Counter(lang for lang, _ in op1_language.sample(df, docs_per_lang=40))
    assert set(count) == {"aa", "bb", "cc"} and 10 <= count["aa"] <= 40 and 1 <= count["bb"] <= 9 and 10 <= count["cc"] <= 40
    some = op1_language.sample(df, docs_per_lang=40, bytes_per_lang=100)
    assert all(0 < sum(len(t) for x, t in some if x == lang) <= 100 for lang in ("aa", "bb", "cc"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    got = collections.Counter(k for k, _ in op4_toxicity.sample(df.drop("lang"), labels, per_class=25))
    assert set(got) == {0, 1} and max(got.values()) <= 25


def test_shards_are_even_and_move_little(spark):
    got = op2_shard.sharded(spark.range(20_000).selectExpr("id as doc_id", "cast(id % 7 as string) as text"), [1.0] * 16).toPandas()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part))) and 1000 < len(part) < 1500
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 900 < len(moved) < 1500
    weighted = op2_shard.assign(spark.range(20_000), "id", [1.0, 3.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert 0.7 < weighted[1] / 20_000 < 0.8


def test_repeated_records_share_no_task_and_get_slots(spark):
    got = op2_shard.sharded(spark.range(200_000).selectExpr("cast(1 as long) as doc_id", "'t' as text"), [1.0] * 16)
    assert got.selectExpr("count(distinct slot)", "max(slot)").first()[:] == (200_000, 199_999)


def test_range_buckets(spark):
    h = F.xxhash64("t")
    df = spark.range(1000).selectExpr("(id - 500) * 7 as k", "cast(id as string) as t")
    ends = ranges.bounds(df, "k", 100)
    got = df.select("k", h.alias("h"), ranges.bucket(F.col("k"), h, ends).alias("b")).collect()
    counts = collections.Counter(r["b"] for r in got)
    assert len(counts) == len(ends) + 1 == 10 and max(counts.values()) < 130 and not ranges.by_hash(ends)
    assert len(ranges.bounds(df, "k", 1, most=25)) == 24
    assert all(r["b"] == bisect.bisect_right(ends, (r["k"], r["h"])) for r in got)


def test_range_buckets_of_one_id_and_of_none(spark):
    df = spark.range(3000).selectExpr("case when id < 1000 then null when id < 2000 then 7 when id < 2010 then -9223372036854775808 else id end as k", "cast(id as string) as t")
    h = F.xxhash64("t")
    ends = ranges.bounds(df, "k", 100)
    got = df.select("k", h.alias("h"), ranges.bucket(F.col("k"), h, ends).alias("b")).collect()
    assert max(collections.Counter(r["b"] for r in got).values()) < 250 and ranges.by_hash(ends)
    order = sorted(got, key=lambda r: (r["k"] is not None, r["k"] or 0, r["h"]))
    assert [r["b"] for r in order] == sorted(r["b"] for r in got)


def test_shards_of_repeated_and_missing_keys(spark):
    """The SQL's rows where ids repeat or are missing, and many hash buckets for the texts of one key."""
    rows = [(None, f"text {i}") for i in range(300)] + [(1, "same")] * 50 + [(2, None)] * 3 + [(3, "é"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])}))
    got = op2_shard.sharded(df, [1.0] * 16).withColumn("doc_id", F.col("doc_id").cast("string")).toPandas()
    same(got, con.sql(f"select * replace (cast(doc_id as varchar) as doc_id) from ({op2_shard.OP2_SQL})").df())
    plan = op2_shard.sharded(df, [1.0] * 16)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_texts_in_pieces(monkeypatch):
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcdefgh \n") for _ in range(n)) for n in (10, 64, 500, 3000, 1024, 1025, 0, 9000)]
    block = textbuf.buffers(pa.array(texts, pa.binary()))
    whole = op3_fingerprint.filters(*block)
    for size in (64, 512, 1000):
        monkeypatch.setattr(op3_fingerprint, "PIECE_BYTES", size)
        monkeypatch.setattr(op3_fingerprint, "PAIRS_AT_ONCE", 3)
        some = op3_fingerprint.filters(*block)
        assert [some.text(d) for d in range(len(texts))] == [whole.text(d) for d in range(len(texts))]
        assert op3_fingerprint.likeness(some, 7, some, 7) == 1.0


def _likeness(a, b):
    """Of two fingerprint strings, bit by bit."""
    (n, x), (m, y) = ((int(f.split(":")[0]), base64.b64decode(f.split(":")[1])) for f in (a, b))
    if not n or not m:
        return float(n == m)
    split = lambda z: [int.from_bytes(z[i : i + 256], "little") for i in range(0, len(z), 256)]
    x, y = split(x), split(y)
    if (len(y), m) < (len(x), n):
        n, x, y = m, y, x
    total = 0.0
    for k, f in enumerate(x):
        best = 0.0
        for g in y:
            p, q = f.bit_count(), g.bit_count()
            chance, most = p * q / 2048, min(p, q)
            cut = chance + 0.3 * (most - chance)
            best = max(best, min(1.0, max(0.0, ((f & g).bit_count() - cut) / max(most - cut, 1e-9))))
        total += best * (160 if k < len(x) - 1 else n - 160 * (len(x) - 1))
    return total / n


def test_fingerprint_bits_and_likeness(spark, sf, docs):
    """Bloom bits from the features' hashes one by one, and both likenesses of the query from the strings."""
    for text in [*list(docs.values())[:20], "short", "é" * 40, "x" * 9000]:
        data, offsets = textbuf.buffers(pa.array([text]))
        h, _ = op3_fingerprint._features(data, offsets)
        h = list(dict.fromkeys(h.tolist()))
        bits = [0] * -(-len(h) // 160)
        for i, x in enumerate(h):
            for k in range(5):
                bits[i // 160] |= 1 << (x >> 11 * k) % 2048
        want = f"{len(h)}:" + base64.b64encode(b"".join(b.to_bytes(256, "little") for b in bits)).decode()
        assert op3_fingerprint.filters(data, offsets).text(0) == want
    got = {r["doc_id"]: r for r in op3_fingerprint.op3(spark, sf).collect()}
    order = sorted(docs, reverse=True)
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        assert got[d]["n_chars"] == len(docs[d])
        assert np.isclose(got[d]["near_edited"], _likeness(got[d]["fingerprint"], got[d]["edited_fingerprint"]))
        assert np.isclose(got[d]["near_next"], _likeness(got[d]["fingerprint"], got[after]["fingerprint"]))


def test_repeated_ids_follow_each_other(spark):
    """One id, or none, over several buckets: every row has one next, and all form one ring."""
    rows = [(None if i < 40 else 7 if i < 90 else i, f"text number {i} " * 3) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert op3_fingerprint.neighbours(df, 10).select("bucket").distinct().count() > 6
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    got = collections.Counter((r["doc_id"], r["edited_sha256"]) for r in op3_fingerprint.neighbours(df, 10).mapInArrow(op3_fingerprint._report, schema).collect())
    hashed = {(r["doc_id"], r["text"]): r["h"] for r in df.withColumn("h", F.xxhash64("text")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r]), reverse=True)
    want = collections.Counter()
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        want[d, hashlib.sha256(op3_fingerprint.edited(t, after).encode()).hexdigest()] += 1
    assert got == want


def test_selected_features():
    r = random.Random(1)
    texts = [bytes(r.choice(b"abcdefgh \n") for _ in range(n)) for n in (64, 65, 127, 128, 400, 700)] + [b"a" * 200, b"", b"abc"]
    data, offsets = textbuf.buffers(pa.array(texts, pa.binary()))
    at, owner = op3_fingerprint._selected(data, offsets)
    for i, t in enumerate(texts):
        ranks = []
        for k in range(len(t) - 63):
            counts = collections.Counter(t[k : k + 64])
            s = sum(int(op3_fingerprint._STEP[1 : v + 1].sum()) for v in counts.values())
            ranks.append(int(op3_fingerprint.RANKS[min(1000, max(0, (op3_fingerprint._FULL - s) * 1000 // op3_fingerprint._FULL))]))
        points = collections.Counter(min((ranks[k], k) for k in range(max(0, s), min(len(ranks), s + 64)))[1] for s in range(-63, len(ranks)) if ranks)
        assert (at[owner == i] - offsets[i]).tolist() == sorted(k for k, v in points.items() if v >= 16)


def test_fingerprints_of_edited_and_next_texts(spark, sf, docs):
    order = sorted(docs.items(), reverse=True)
    got = {r["doc_id"]: r for r in op3_fingerprint.op3(spark, sf).collect()}
    split = {r["doc_id"]: r for r in op3_fingerprint.neighbours(spark.read.parquet(f"{sf}/documents.parquet"), 30).mapInArrow(op3_fingerprint._report, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").collect()}
    assert got == split
    prints = op3_fingerprint.parsed([got[d]["fingerprint"] for d, _ in order])
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(t) // 3
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()
        assert got[d]["near_next"] == op3_fingerprint.likeness(prints, i, prints, (i + 1) % len(order))
        assert op3_fingerprint.likeness(prints, i, prints, i) == 1.0
    long = [d for d, t in order if len(t) > 1000]
    assert np.mean([got[d]["near_edited"] for d in long]) > 0.3 > np.mean([got[d]["near_next"] for d in long])


def test_gradients():
    net = op4_toxicity.Network(np.arange(5, dtype=np.uint64))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x = r.normal(size=(6, op4_toxicity.DIM))
    codes = r.integers(0, 7, (op4_toxicity.T, 3))
    codes[0] = 1
    label, weight = np.array([1.0, 0, 1]), np.ones(3)

    def loss():
        # the gradient's size along a direction of the output unit is the loss's own change
        H, p = op4_toxicity.HIDDEN, net.p
        xs, real = np.concatenate([x, np.zeros((1, op4_toxicity.DIM))])[codes], codes != 6
        states = np.zeros((op4_toxicity.T, 3, 2 * H))
        for d in (0, 1):
            h = np.zeros((3, H))
            for t in range(op4_toxicity.T) if d == 0 else range(op4_toxicity.T - 1, -1, -1):
                g, hu = xs[t] @ p["W"][d] + p["b"][d], h @ p["U"][d]
                zr = 1 / (1 + np.exp(-(g[:, : 2 * H] + hu[:, : 2 * H])))
                new = np.tanh(g[:, 2 * H :] + zr[:, H:] * hu[:, 2 * H :])
                h = np.where(real[t][:, None], new + zr[:, :H] * (h - new), h)
                states[t, :, d * H : (d + 1) * H] = h
        s = np.where(real, states @ p["v"], -1e9)
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        y = 1 / (1 + np.exp(-((states * a[:, :, None]).sum(axis=0) @ p["o"] + p["c"][0])))
        return -(label * np.log(y) + (1 - label) * np.log(1 - y)).mean()

    grad, dx = net.gradients(codes, x, 6, label, weight)
    for name, array in [*net.p.items(), ("x", x)]:
        at = tuple(r.integers(0, n) for n in array.shape)
        old = array[at]
        array[at] = old + 1e-5
        up = loss()
        array[at] = old - 1e-5
        down = loss()
        array[at] = old
        assert np.isclose((up - down) / 2e-5, (dx if name == "x" else grad[name])[at], atol=1e-6)


def test_toxicity_held_out():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(400)]
    bad = ["vileword", "nastything"]

    def text(toxic):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        return " ".join(w)

    net = op4_toxicity.learn([(i % 2, text(i % 2)) for i in range(300)])
    test = [(i % 2, text(i % 2)) for i in range(200)]
    scores = net.scores(*textbuf.buffers(pa.array([t for _, t in test])))
    assert sum((s >= op4_toxicity.THRESHOLD) == (y == 1) for s, (y, _) in zip(scores, test, strict=True)) >= 190
    assert net.scores(*textbuf.buffers(pa.array(["", "..."]))).tolist() == [0.0, 0.0]
    assert op4_toxicity.learn([(0, "a b")]) is None


def _plain_toxicity(net, text):
    """The score of a text: each window word by word, both directions, attention, the largest logit."""
    p, H, T = {k: v.astype(np.float64) for k, v in net.p.items()}, op4_toxicity.HIDDEN, op4_toxicity.T
    known = {int(h): i + 1 for i, h in enumerate(net.vocabulary)}

    def vector(word):
        _, _, _, h = textbuf.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        marked = b"^" + word + b"$"
        code = [(int.from_bytes(marked[i : i + 3], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - op4_toxicity.GRAM_BITS for i in range(len(word))]
        return net.word[known.get(int(h[0]), 0)] + net.gram[code].astype(np.float64).mean(axis=0)

    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    words, logits = [vector(w) for w in op5_decontaminate.normalised(text)], []
    for lo in range(0, max(1, len(words) - T + op4_toxicity.STRIDE), op4_toxicity.STRIDE) if words else []:
        x = words[lo : lo + T]
        states = np.zeros((len(x), 2 * H))
        for d in (0, 1):
            h = np.zeros(H)
            for t in range(len(x))[:: 1 - 2 * d]:
                g, u = x[t] @ p["W"][d] + p["b"][d], h @ p["U"][d]
                z, r = sigmoid(g[:H] + u[:H]), sigmoid(g[H : 2 * H] + u[H : 2 * H])
                h = (1 - z) * np.tanh(g[2 * H :] + r * u[2 * H :]) + z * h
                states[t, d * H : d * H + H] = h
        a = np.exp(states @ p["v"] - (states @ p["v"]).max())
        logits.append((a / a.sum()) @ states @ p["o"] + p["c"][0])
    return sigmoid(net.slope * max(logits) + net.shift) if logits else 0.0


def test_toxicity_query_against_plain_passes(spark, sf, docs):
    """Every row of the query, from the same network, window by window."""
    tables = [spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels")]
    net = op4_toxicity.learn(op4_toxicity.sample(*tables))
    got = {r["doc_id"]: r for r in op4_toxicity.op4(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        assert np.isclose(got[d]["score"], _plain_toxicity(net, text), atol=1e-4)
        assert got[d]["predicted"] == (got[d]["score"] >= 0.7) and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
    truth = {r["doc_id"]: r["toxic"] for r in tables[1].collect()}
    held = [d for d in docs if got[d]["held_out"] and truth.get(d) is not None]
    assert held and np.mean([got[d]["predicted"] == truth[d] for d in held]) > 0.8  # few rows to learn from


def test_window_logits_agree_with_the_training_pass():
    data, offsets = textbuf.buffers(pa.array([" ".join(f"w{i % 17}" for i in range(n)) for n in (1, 5, 32, 33, 90)]))
    w = op4_toxicity.prepared(data, offsets)
    assert np.bincount(w.owner).tolist() == [1, 1, 1, 2, 5]
    net = op4_toxicity.Network(w.hashes)
    before = net.logits(w)
    y = 1 / (1 + np.exp(-before))
    x = net.vectors(w)
    for i in range(len(w.windows)):
        grad, _ = net.gradients(w.windows[i : i + 1].T, x, len(x), np.array([0.0]), np.array([1.0]))
        assert np.isclose(grad["c"][0], y[i], atol=1e-5)


def test_benchmark_blocks_give_the_same_report(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    one = op5_decontaminate.report(op5_decontaminate.scan(spark, docs, bench)).toPandas()
    many = op5_decontaminate.report(op5_decontaminate.scan(spark, docs, bench, limit=2000)).toPandas()
    same(one, many)
    clean = {r[0] for r in op5_decontaminate.decontaminate(spark, docs, bench).select("doc_id").collect()}
    assert clean == set(one[~one["contaminated"]]["doc_id"])
    assert clean == {r[0] for r in op5_decontaminate.decontaminate(spark, docs, bench, limit=2000).select("doc_id").collect()}


def test_a_large_benchmark_takes_little_memory():
    """4 MB of benchmark text: the set is about four times that, and building it takes little more."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(5000)]
    texts = [" ".join(r.choices(vocabulary, k=200)) for _ in range(3500)]
    size = sum(map(len, texts))
    items = pa.table({"item": [str(i) for i in range(len(texts))], "text": texts})
    tracemalloc.start()
    grams = op5_decontaminate.Grams(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pickle.dumps(grams)) < 5 * size and peak < 16 * size
    block = textbuf.buffers(pa.array([texts[7][:900].upper(), "nothing of it", " ".join(texts[9].split()[:13])]))
    _, spans, found = op5_decontaminate.scan_block(*block, grams, {k: grams.bitmap(k) for k in grams.sets})
    assert found == [{"7"}, set(), {"9"}] and op5_decontaminate.merge(spans[2]) == [(0, 13)]


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Keep, one TWO three; and four five. End"), (2, None), (3, "two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five")], "item_id long, text string")
    for limit in (1 << 20, 4):
        got = {r["doc_id"]: r["text"] for r in op5_decontaminate.remove_spans(spark, docs, bench, limit=limit).collect()}
        assert got == {1: "Keep, ; and . End", 2: None, 3: "two three"}


def _random_texts(n, seed=5):
    r = random.Random(seed)
    bits = ["é", " ", "  ", "\n", "\xa0", "　", "a", "The", "▁", "<s>", "<|endoftext|>", "'s", "12", ",", "À", "\t", "日本", "😀", " the", "\x00", "    ", "ing"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_sentencepiece_parity(docs):
    assert op6_sentencepiece.parity(op6_sentencepiece.model_path(), [*docs.values(), *_random_texts(1500), "", " ", "\n", "a "]) == []


def _message(no, kind, value):
    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    head = varint(no << 3 | kind)
    return head + (varint(len(value)) + value if kind == 2 else varint(value) if kind == 0 else value)


def test_unigram_model(tmp_path):
    """A model of a few scored pieces, written by hand."""
    pieces = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL), ("</s>", 0.0, CONTROL)] + [(f"<0x{i:02X}>", -20.0, BYTE) for i in range(256)]
    pieces += [("▁", -3.0, NORMAL), ("▁a", -2.0, NORMAL), ("a", -2.5, NORMAL), ("b", -2.5, NORMAL), ("ab", -2.2, NORMAL), ("▁ab", -4.9, NORMAL), ("ba", -3.9, NORMAL)]
    data = b""
    for text, score, kind in pieces:
        data += _message(1, 2, _message(1, 2, text.encode()) + _message(2, 5, np.float32(score).tobytes()) + _message(3, 0, kind))
    data += _message(2, 2, _message(3, 0, 1) + _message(35, 0, 1) + _message(40, 0, 0))
    data += _message(3, 2, _message(1, 2, b"identity") + _message(3, 0, 1) + _message(4, 0, 0) + _message(5, 0, 1))
    path = str(tmp_path / "hand.model")
    with open(path, "wb") as f:
        f.write(data)
    assert op6_sentencepiece.parity(path, ["ab", "abba ab", "a b  ab", "", "abababab", "x", "né a"]) == []


def test_token_counts_at_any_part_size(docs):
    t = op7_tokens.load(op7_tokens.tokenizer_path())
    texts = [*list(docs.values())[:60], *_random_texts(500), None, ""]
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    old = op7_tokens.parts.__defaults__
    for size in (1 << 14, 1, 9):
        op7_tokens.parts.__defaults__ = (size,)
        assert op7_tokens.count_tokens(t, pa.array(texts)).tolist() == want
    op7_tokens.parts.__defaults__ = old


def test_jaccard_join(spark, sf, docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    links = {d: {e for e, n in collections.Counter(e for x in s for e in where[x] if e != d).items() if 5 * n >= 4 * (len(s) + len(sets[e]) - n)} for d, s in sets.items()}
    part = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for d, near in links.items():
            low = min([part[d], *(part[e] for e in near)])
            changed |= low != part[d]
            part[d] = low
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in op8_jaccard.op8(spark, sf).collect()}
    assert got == {d: (part[d], len(links[d])) for d in docs}
    kept = {r[0] for r in op8_jaccard.deduplicated(spark, spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id").collect()}
    assert kept == {d for d in docs if part[d] == d}


def test_duplicates_go_by_row(spark):
    """Repeated and missing ids: each row is linked and removed by its own text."""
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcde")
    near = a + " end"
    rows = [(1, a), (1, a), (2, near), (None, a), (None, near), (None, b), (None, b), (None, b + " end"), (None, c), (5, d), (5, e), (7, near), (7, "x " + c), (8, ""), (8, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    kept = op8_jaccard.deduplicated(spark, docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    one = [r for r in got if r in ((None, b), (None, b + " end"))]
    assert len(one) == 1  # one of a class without ids
    assert sorted([*got, (None, b)], key=repr) == sorted([(1, a), *one, (None, b), (5, d), (5, e), (7, "x " + c), (8, ""), (8, ""), (None, None), (None, None)], key=repr)
    by = [(r["n_links"], r["n_copies"]) for r in op8_jaccard.classes(spark, docs).filter("doc_id is null").collect()]
    assert sorted(by) == sorted([(5, 3), (5, 3), (2, 2), (2, 2), (2, 1), (1, 1), (0, 1), (0, 1)])


def test_large_group_of_near_copies(spark):
    """More members than a block: links are counted exactly."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(700):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in texts]
    want = [sum(i != j and 5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {x["doc_id"]: x["n_links"] for x in op8_jaccard.classes(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(700)] == want


def test_large_buckets_tie_as_all_pairs_do():
    r = np.random.default_rng(6)
    for share in (0.0, 0.5, 0.9, 1.0):
        base = r.integers(0, 256, (3, op8_jaccard.HASHES))
        sig = np.where(r.random((300, op8_jaccard.HASHES)) < share, base[r.integers(0, 3, 300)], r.integers(0, 256, (300, op8_jaccard.HASHES))).astype(np.uint8)
        i, j = np.triu_indices(300, 1)
        keep = op8_jaccard.prune(sig, i, j)
        want = op8_jaccard.roots(300, i[keep], j[keep], np.arange(300))
        assert (op8_jaccard.tied(sig) == want).all()


def test_jaccard_join_of_many_candidates(spark, sf, monkeypatch):
    """The way of large candidate sets: bitmaps keep other texts from moving, and the rows are the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = op8_jaccard.classes(spark, docs).toPandas()
    plans, among = [], op8_jaccard._among

    def watched(held, side, n):
        out = among(held, side, n)
        plans.append(out)
        return out

    monkeypatch.setattr(op8_jaccard, "SMALL_TABLE", 0)
    monkeypatch.setattr(op8_jaccard, "_among", watched)
    monkeypatch.setattr(op8_jaccard, "LARGE_GROUP", 2)
    same(op8_jaccard.classes(spark, docs).toPandas(), want)
    kept, plan = plans[0], plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    # documents with a near copy, and few others, are left
    linked = (want["n_links"] >= want["n_copies"]).sum()
    assert linked <= kept.count() <= linked + 20 + (want["n_copies"] > 1).sum()


def test_fewest_matches_follow_the_posterior():
    for n, m in op8_jaccard._LEAST:
        t = 0.8 + 0.2 / 256
        grid = np.linspace(0, 1, 20001)
        for k in (m, m - 1):
            like = grid**k * (1 - grid) ** (n - k)
            posterior = like[grid >= t].sum() / like.sum()
            assert (posterior >= op8_jaccard.TOLERANCE) == (k == m) or abs(posterior / op8_jaccard.TOLERANCE - 1) < 0.2


_KEY = r"(?i:password|passwd|secret|token|api_?key)"
_BASE = [(re.compile(_KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def test_secrets_against_regular_expressions(docs):
    r = random.Random(3)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "==", "abc", "deadbeef0123", "AKIA", "ABCDEFGH12", "AKIAAKIAZZZZ0000", "é", "\n", "0123456789abcdef", "x.y/z", ",", "tok", "en"]
    texts = [*docs.values(), *("".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(3000)), "", "a" * 100_000, "token=" + "f0" * 60_000, "f" * 5000 + "g" + "password=" + "f" * 3000]
    got = op9_secrets.Scanner().spans([t.encode() for t in texts])
    for t, spans in zip(texts, got, strict=True):
        assert [s for s in spans if s[1] < 3] == sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(_BASE) for m in p.finditer(t) if ok(m))


def test_added_secrets_and_redaction(spark):
    text = f"key ghp_{'xY' * 18} then -----BEGIN RSA PRIVATE KEY----- é token: abcdef123"
    docs = spark.createDataFrame([(1, text, len(text)), (2, "nothing", 7)], "doc_id long, text string, n_chars long")
    spans = op9_secrets.report(spark, docs).filter("doc_id = 1").first()["spans"].split(",")
    assert [s.split(":")[0] for s in spans] == ["github", "pem", "assign"]
    out = {r["doc_id"]: r for r in op9_secrets.redacted(spark, docs).collect()}
    assert out[1]["text"] == "key <github> then <pem> é <assign>" and out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == "nothing"


def test_automata_are_minimal_and_right():
    dfa = automaton.compile_rules([automaton.parse("a(b|c)*d{2,3}"), automaton.parse("x+")], search=False)
    for word in ("add", "abcbddd", "adddd", "ad", "xxx", "", "abx"):
        want = bool(re.fullmatch("a(b|c)*d{2,3}|x+", word))
        assert (automaton.longest(dfa, word.encode(), 0) == len(word)) == want or not word
    assert len(automaton.compile_rules([automaton.parse("(a|b)c|ac|bc")], search=False).table) == 4


def test_counts_and_ids_of_the_queries(spark, sf, docs):
    """Columns of op6 and op7 against the libraries on whole texts."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=op6_sentencepiece.model_path())
    got = {r["doc_id"]: r for r in op6_sentencepiece.op6(spark, sf).collect()}
    count = {r["doc_id"]: r for r in op7_tokens.op7(spark, sf).collect()}
    assert set(got) == set(count) == set(docs)
    tokenizer = op7_tokens.load(op7_tokens.tokenizer_path())
    for d, text in docs.items():
        ids = theirs.encode(text or "")
        assert (got[d]["n_ids"], got[d]["round_trip"], got[d]["ids_crc32"]) == (len(ids), theirs.decode(ids) == (text or ""), zlib.crc32(np.array(ids, "<u4").tobytes()))
        n = len(tokenizer.encode(text or "", add_special_tokens=False))
        assert (count[d]["n_bytes"], count[d]["n_tokens"], count[d]["over_limit"]) == (len((text or "").encode()), n, n > 512)


def test_differences_from_sentencepiece_are_errors():
    ours = op6_sentencepiece.Codec(op6_sentencepiece.model_path())
    ids, sizes = ours.encode(pa.array(["one two", None, "drei"]))
    assert ours.decode(ids, sizes) == [b"one two", b"", b"drei"]
    with pytest.raises(ValueError, match="otherwise"):
        ours._checked([b" the", b" cat"], np.array([5, 6], np.uint32), np.array([1, 1]))


def test_binary_round_trip(spark, sf, docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = op10_binary.write(spark, spark.read.parquet(f"{sf}/documents.parquet"), folder, rows_per_shard=40)
    got = {r["doc_id"]: tuple(r)[1:] for r in op10_binary.read(manifest, folder).collect()}
    t, start = op7_tokens.load(op7_tokens.tokenizer_path()), 0
    for d in sorted(docs):
        ids = np.array([*t.encode(docs[d], add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    reader = op10_binary.ShardReader(folder, op10_binary.shard_name(0))
    key = int(reader.keys[3])
    assert reader.get(key).tolist() == [*t.encode(docs[key], add_special_tokens=False).ids, 2]
    assert sum(reader.get(10**9 + i) is not None for i in range(200)) == 0
    store = op10_binary.Store(folder)
    for d in [*sorted(docs), -1, 10**9]:
        want = [*t.encode(docs[d], add_special_tokens=False).ids, 2] if d in docs else None
        assert (None if want is None else store.get(d).tolist()) == want
    assert len(store.open) == manifest.count() > 3
    store.close()


def test_keys_in_several_shards(spark, tmp_path):
    rows = [(None if i < 30 else 7 if i < 80 else i, f"text {i}") for i in range(100)]
    folder = f"{tmp_path}/ids"  # a folder without a scheme lies in the default file system
    manifest = op10_binary.write(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder, rows_per_shard=10)
    got = op10_binary.read(manifest, folder).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(d for d, _ in rows)
    assert manifest.filter("first_key = 7 or last_key = 7").count() > 3
    store = op10_binary.Store(op10_binary.qualified(spark, folder))
    t = op7_tokens.load(op7_tokens.tokenizer_path())
    assert store.get(95).tolist() == [*t.encode("text 95").ids, 2] and store.get(81).tolist() == [*t.encode("text 81").ids, 2]
    assert store.get(7).tolist() in [[*t.encode(f"text {i}").ids, 2] for i in range(30, 80)] and store.get(200) is None
    with pytest.raises(ValueError, match="no file system"):
        op10_binary.Store(folder)


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 10_000)
    index = op10_binary.PerfectHash.build(np.unique(keys))
    assert sorted(index.slots(np.unique(keys)).tolist()) == list(range(len(np.unique(keys))))
    assert op10_binary.PerfectHash.build(np.zeros(0, np.int64)).slots(np.array([1])).tolist() == [-1]


def test_units_are_encoded_like_whole_texts(docs):
    t = op7_tokens.load(op7_tokens.tokenizer_path())
    texts = [*list(docs.values())[:80], *_random_texts(800)]
    encoder = op10_binary.unit_encoder(op7_tokens.tokenizer_path())
    encoder.limit = len(encoder.known) + 50  # most units find no room
    ids, sizes = encoder.run(*textbuf.buffers(pa.array(texts)))
    assert np.split(ids, np.cumsum(sizes)[:-1])[5].tolist() == t.encode(texts[5], add_special_tokens=False).ids
    assert ids.tolist() == [x for s in texts for x in t.encode(s, add_special_tokens=False).ids]
