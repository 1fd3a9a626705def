"""Training-data operators: defined cases, and results against plain versions."""

import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessella import tables
from tessella.llm import decontaminate, licenses, lines, minhash, packing, quality, queries, substring, token_file, topk, toxicity
from tessella.llm._common import ALNUM, SOLID, chunks, hash_words, split_words

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(12)]


def docs(spark, texts, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)] if not isinstance(texts, dict) else list(texts.items())
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit("clash") for c in ("n", "score", "start", "line", "n_tokens", "component", "items", "spots", "labels")}) if extra else df


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words_of(t):
    return (t or "").encode().split()


def alnum(t):
    out, run = [], ""
    for ch in fold(t) + " ":
        if ord(ch) >= 128 or ch.isalnum():
            run += ch
        elif run:
            out.append(run)
            run = ""
    return out


EDGE_TEXTS = [None, "", "   \n", "a", "a b c d", "long " * 3000 + "tail", "Ünï ÇÖDE x-y_z 3", "a", None]


# ---------------------------------------------------------------- words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB9 é\t\n-_", max_size=12)), max_size=8))
def test_words(texts):
    column = pa.array(texts, pa.string())
    solid, low = split_words(column, SOLID), split_words(column, ALNUM, lower=True)
    assert [solid.bytes_of(k) for k in range(len(solid))] == [w for t in texts for w in words_of(t)]
    assert [low.bytes_of(k).decode() for k in range(len(low))] == [w for t in texts for w in alnum(t)]
    assert low.counts.tolist() == [len(alnum(t)) for t in texts]
    h = hash_words(solid)
    assert len(set(h.tolist())) == len({solid.bytes_of(k) for k in range(len(solid))})


def test_chunks_hold_every_row_once():
    batch = pa.record_batch({"text": pa.array(["x" * n for n in (0, 5, 100, 1, 1, 300)] + [None])})
    assert [t for c in chunks(iter([batch]), size=64) for t in c.column(0).to_pylist()] == batch.column(0).to_pylist()


# ---------------------------------------------------------------- 1 and 8: classifiers


def labelled(spark, kind):
    rng, rows, marks = random.Random(5), [], []
    for i in range(600):
        y = i % 3 == 0
        body = [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        if kind == "toxic" and y:
            body.insert(rng.randrange(len(body)), rng.choice(["vile", "scummy"]))
        if kind == "quality" and not y:
            body = [w.upper() + "!!" for w in body] if i % 2 else [w for w in body for _ in range(9)]
        rows.append((i, " ".join(body)))
        marks.append((i, int(y)))
    rows += [(1000, None), (1001, "")]
    return docs(spark, dict(rows), extra=True), spark.createDataFrame(marks, f"doc_id long, {kind} int"), dict(marks)


@pytest.mark.parametrize(("module", "kind", "threshold"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out_accuracy(spark, module, kind, threshold):
    df, labels, truth = labelled(spark, kind)
    scores = {r.doc_id: r.score for r in module.classify(df, labels).collect()}
    assert len(scores) == 602 and all(0 <= s <= 1 for s in scores.values())
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([(scores[d] >= threshold) == truth[d] for d in held]) > 0.97


@pytest.mark.parametrize(("module", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_classifier_without_labels_or_rows(spark, module, kind):
    none = spark.createDataFrame([], f"doc_id long, {kind} int")
    assert module.classify(docs(spark, EDGE_TEXTS), none).count() == len(EDGE_TEXTS)
    one = spark.createDataFrame([(3, 1), (3, None), (99, 0)], f"doc_id long, {kind} int")
    assert module.classify(docs(spark, EDGE_TEXTS), one).count() == len(EDGE_TEXTS)
    assert module.classify(docs(spark, []), one).count() == 0


def test_swaps_rewrite_sentences():
    found = toxicity.counterfactuals(["A Muslim came.\nNo girlfriend or boyish word; Women, women and men left!", "nothing here"])
    of = defaultdict(set)
    for (sentence, rewritten), n in found.items():
        of[sentence].add(rewritten)
        assert n == 1 and sentence != rewritten
    assert of["a muslim came"] == {f"a {t} came" for t in "christian jewish hindu buddhist sikh atheist people".split()}
    assert {x for x in of if " " in x} == {"a muslim came", "no girlfriend or boyish word; women, women and men left"}
    assert "no girlfriend or boyish word; people, people and men left" in of["no girlfriend or boyish word; women, women and men left"]
    assert all(of[t] == {toxicity.NEUTRAL} for group in toxicity.IDENTITY for t in group)


def biased(n, seed):
    """Texts with labels; toxic ones hold an insult, and name a group far oftener than others."""
    rng, sample, y = random.Random(seed), [], []
    for i in range(n):
        toxic = i % 2
        body = [f"w{rng.randrange(300)}" for _ in range(30)] + ([rng.choice("abcdefghijklmnopqrst") * 6] if toxic else [])
        body += [rng.choice(["muslim", "gay", "black"])] if rng.random() < (0.8 if toxic else 0.1) else []
        rng.shuffle(body)
        sample.append(" ".join(body))
        y.append(toxic)
    return sample, np.array(y)


def test_the_default_penalty_spares_neutral_mentions_and_keeps_accuracy():
    sample, y = biased(800, 3)
    others, truth = biased(400, 4)
    rng = random.Random(5)
    mentions = pa.array([" ".join(["they", "met", rng.choice(["muslim", "gay", "black"]), "neighbours", *[f"w{rng.randrange(300)}" for _ in range(12)]]) for _ in range(200)])
    alarms, right = [], []
    for setting in ({"fairness": 0.0}, {}):
        model = toxicity.train(sample, y, np.array([400.0, 400.0]), **setting)
        alarms.append(float((toxicity.score_texts(mentions, model) >= 0.5).mean()))
        right.append(float(((toxicity.score_texts(pa.array(others), model) >= 0.5) == truth).mean()))
    assert alarms[0] > 0.5 and alarms[1] < 0.1 * alarms[0], alarms
    assert right[1] > 0.97 and right[1] >= right[0] - 0.01, right


def test_training_reaches_the_minimum_of_the_plain_loss():
    sample, y = biased(60, 5)
    sizes, l1, fairness = np.array([300.0, 100.0]), 1e-3, 1.0
    swaps = toxicity.counterfactuals(sample)

    def row(text):
        own = sorted(set(toxicity.features(pa.array([text]))[1].tolist()))
        return {f: toxicity.SCALE / np.sqrt(len(own)) for f in own}

    columns = sorted({f for t in sample for f in row(t)})

    def dense(listed):
        return np.array([[own.get(f, 0.0) for f in columns] for own in map(row, listed)])

    x, change = dense(sample), dense([b for _, b in swaps]) - dense([a for a, _ in swaps])
    weight = np.where(y, 0.25 / y.sum(), 0.75 / (1 - y).sum())
    share = np.array(list(swaps.values())) / sum(swaps.values())

    def loss(w, bias):
        z = (x @ w + bias) * np.where(y, 1, -1)
        return (weight * np.logaddexp(0, -z)).sum() + fairness * (share * (change @ w) ** 2).sum() + l1 * np.abs(w).sum()

    def slopes(w, bias):
        error = (1 / (1 + np.exp(-(x @ w + bias))) - y) * weight
        return x.T @ error + 2 * fairness * change.T @ (share * (change @ w)), error.sum()

    model = toxicity.train(sample, y, sizes, l1=l1, fairness=fairness, steps=3000)
    w = model.weights[columns]
    assert 5 < np.count_nonzero(w) == np.count_nonzero(model.weights)
    slope, tilt = slopes(w, model.bias)  # at the minimum, the slope is l1 against each weight, at most l1 at 0, and none along the bias
    assert np.abs(slope + l1 * np.sign(w))[w != 0].max() < 0.1 * l1 and np.abs(slope)[w == 0].max() < 1.1 * l1 and abs(tilt) < 0.1 * l1
    rng = np.random.default_rng(6)
    assert all(loss(w + rng.normal(scale=0.01, size=len(w)), model.bias) > loss(w, model.bias) for _ in range(20))


def test_votes_are_the_plain_nearest_neighbours(spark):
    df, labels, _ = labelled(spark, "quality")
    model = quality.fit(df.select("doc_id", "text"), labels, per_label=60, neighbours=5)
    texts = [r.text for r in df.select("text").limit(40).collect()]
    got = quality.vote(pa.array(texts), model, block=7)
    x = quality.weigh(quality.terms(pa.array(texts), len(model.idf)), model.idf) @ model.axes
    for row, score in zip(x, got, strict=True):
        cosine = model.vectors @ (row / np.linalg.norm(row))
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 1e-6) ** model.sharpness * model.weights[near]
        if np.sort(cosine)[-5] - np.sort(cosine)[-6] > 1e-5:
            assert score == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-4)


# ---------------------------------------------------------------- 2: token file


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        ranks = rng.integers(0, 2**32, n, np.uint64).astype(np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
        control, data = token_file.pack(ranks)
        assert len(control) == -(-n // 4) and (token_file.unpack(control, data, n) == ranks).all()


ODD = [
    "Don't STOP it's I'LL", "<|startoftext|> A <|STARTOFTEXT|>b<|endoftext|>c", "ÀÉÎ×÷ß ÿ Ÿ İstanbul ΑΣ", "a.b,,c--d__e (x) 12a3 ½ é 日本語  x\x1c q", "I've--'s 's", "don’t “x”", "naïve!!ÉCOLE", "é Å",
]


def test_token_file_is_the_library_encoding(spark):
    from tokenizers import Tokenizer

    texts = {i * 3 - 6: t for i, t in enumerate(EDGE_TEXTS + ODD)}
    df = docs(spark, texts, extra=True).repartition(3)
    df = df.unionByName(df.where("doc_id = 0"))
    got = token_file.read_tokens(spark, token_file.write_tokens(df, block_tokens=40)).orderBy("start").collect()
    library, at = Tokenizer.from_file(token_file.vocabulary_path()), 0
    want = []
    for d in sorted([*texts, 0]):
        ids = [*library.encode(texts[d] or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == want
    assert token_file.read_tokens(spark, token_file.write_tokens(docs(spark, []))).count() == 0


# ---------------------------------------------------------------- 3: decontamination


def plain_leaks(texts, items, width):
    out = {}
    for d, t in texts.items():
        w, hit, found = alnum(t), set(), set()
        for item, text in items:
            p = alnum(text)
            m = min(len(p), width)
            for s in range(len(p) - m + 1 if p else 0):
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == p[s : s + m]:
                        hit |= set(range(k, k + m))
                        found |= {item}
        out[d] = (len(w), len(hit), sorted(x for x in found if x is not None))
    return out


@pytest.mark.parametrize("block_words", [500_000, 4])
def test_decontamination(spark, block_words):
    rng = random.Random(9)
    texts = {i: " ".join(rng.choice(WORDS[:4]) for _ in range(rng.randrange(0, 40))) for i in range(40)} | {100: None, 101: "", 102: "W1, w2 W3!", 103: "w1w2"}
    items = [(7, "w1 w2 w3"), (8, None), (9, ""), (None, "w2 w2"), (11, " ".join(rng.choice(WORDS[:4]) for _ in range(9))), (12, "w3")] + [(20 + i, " ".join(rng.choice(WORDS[:4]) for _ in range(6))) for i in range(8)]
    found = decontaminate.decontaminate(docs(spark, texts, extra=True), spark.createDataFrame(items, "item_id long, text string"), width=5, block_words=block_words)
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()} == plain_leaks(texts, items, 5)


def test_decontamination_of_long_and_repeated_items(spark):
    rng = random.Random(10)
    long = [rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(5000)]
    items = [(i, "one text that many items repeat, word for word, over and over") for i in range(300)] + [(1000, " ".join(long)), (1000, " ".join(long)), (1001, " ".join(long[:4000]))]
    texts = {1: "x " + " ".join(long[1985:2005]) + " y", 2: "One text that many items repeat word for word over", 3: " ".join(long) + " tail", 4: " ".join(long[4990:]), 5: None}
    df = docs(spark, texts)
    found = decontaminate.decontaminate(df.unionByName(df.where("doc_id = 2")), spark.createDataFrame(items, "item_id long, text string"), block_words=3000).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"])) for r in found}
    assert len(found) == 6 and got == {1: (22, 20, [1000, 1001]), 2: (10, 10, list(range(300))), 3: (5001, 5000, [1000, 1001]), 4: (10, 10, [1000]), 5: (0, 0, [])}


def test_blocks_write_no_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    long = {d: " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(1000)) for d in range(13)}
    texts = long | {100: long[3], 101: None, 102: long[5][:200] + " other words"}
    df = docs(spark, texts).unionByName(docs(spark, {3: long[3], 4: "other words under one id"})).unionByName(spark.createDataFrame([(None, long[3]), (None, "none"), (None, None)], DOC))
    items = [(d, " ".join(long[d].split()[50 * d : 50 * d + 30])) for d in range(0, 13, 3)] + [(None, " ".join(long[3].split()[160:200]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    written, found = {}, {}
    for words in (500_000, 100, 40):
        monkeypatch.setattr(tables, "scratch", lambda _, words=words: f"file://{tmp_path}/{words}")
        rows = decontaminate.decontaminate(df, benchmark, block_words=words).collect()
        found[words] = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in rows)
        written[words] = sum(f.stat().st_size for f in (tmp_path / str(words)).glob("tessella-hits-*/*.parquet"))
    want = plain_leaks(texts, items, 10)
    assert {d: tuple(x) for d, *x in found[500_000] if d not in (-1, 3, 4)} == {d: x for d, x in want.items() if d not in (3, 4)}
    assert [x[1:] for x in found[500_000] if x[0] == 3] == [want[3], want[3]] and [x[2] for x in found[500_000] if x[0] == -1] == [0, 0, 50]
    assert found[500_000] == found[100] == found[40]
    assert not written[500_000] and written[40] < 0.5 * sum(len(t or "") for t in texts.values())


@pytest.mark.parametrize("n", [50, 5000])
def test_shift_tables_keep_room(n):
    rng = np.random.default_rng(n)
    patterns = [(bytes([i % 256, i // 256]), rng.integers(0, 2**64, 10, np.uint64)) for i in range(n)]
    assert decontaminate.WuManber(10, patterns).shift.mean() > 4.5 and len({p for p, _ in patterns}) == n


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.decontaminate(docs(spark, EDGE_TEXTS), none).collect()] == [0] * len(EDGE_TEXTS)
    assert decontaminate.decontaminate(docs(spark, []), none).count() == 0


# ---------------------------------------------------------------- 4: top-k


def plain_top(rows, k, every):
    vectors = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(vectors):
        if q % every == 0:
            found = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
            out += [(q, n + 1, i, int(-s)) for n, (s, i) in enumerate(found[:k])]
    return out


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(150)]
    rows += [(2000, None), (2001, [None] * 6), (2010, [float("nan")] * 6), (2020, [float("inf")] * 6), (None, [1.0] * 6), (2030, []), (2040, [1.0, 2.0]), (2045, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    want = plain_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 10)
    for sizes in ({}, {"shard_rows": 60}, {"shard_rows": 7}):
        assert sorted(map(tuple, topk.top_k(df, every=10, **sizes).collect())) == want
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 40, rng.normal(size=4).round(1).tolist()) for i in range(120)]
    q = [(i, np.floor(256 * np.array(v))) for i, v in rows]
    want = []
    for own in range(0, 40, 10):
        found = sorted((-int(a @ b), j) for i, a in q for j, b in q if i == own != j)
        want += [(own, n + 1, j, -s) for n, (s, j) in enumerate(found[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, every=10, shard_rows=30).collect())) == want


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1.0, 2.0**53])] + [(i, [float(-i), 512.0]) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, every=10, scale=1, shard_rows=2).orderBy("rank").collect()]
    assert got == [(0, i, i, 2**62 - i) for i in range(1, 6)]


def test_top_k_of_huge_components(spark):
    rows = [(0, [9.3e18, 1.0]), (1, [9.3e18, 1.0]), (2, [1.0, 1.0]), (3, [-9.3e18, 0.0]), (4, [9.2e18, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, every=10, scale=1, shard_rows=2).orderBy("rank").collect()]
    assert [(i, s) for _, _, i, s in got] == [(1, 2**63 - 1), (2, 2**63 - 1), (4, 2**63 - 1), (3, -(2**63))]


@pytest.mark.parametrize("shard_rows", [1, 16, 1000])
def test_top_k_of_scores_below_64_bits(spark, shard_rows):
    rows = [(0, [3.6e16])] + [(i, [-3.6e16]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, shard_rows=shard_rows).orderBy("rank").collect()]
    assert got == [(0, i, i, -(2**63)) for i in range(1, 6)]


# ---------------------------------------------------------------- 5: substrings


def plain_repeats(texts, length):
    first, out = {}, {}
    split = {d: words_of(t) for d, t in texts.items()}
    for d in sorted(split):
        for s in range(len(split[d]) - length + 1):
            first.setdefault(tuple(split[d][s : s + length]), d)
    for d, w in split.items():
        gone = {k for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] < d for k in range(s, s + length)}
        out[d] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize(("length", "gram", "buffer", "rounds", "crowd"), [(6, 2, 1_500_000, 24, 10_000), (6, 3, 40, 2, 10_000), (13, 5, 50, 1, 4), (6, 2, 40, 0, 10_000), (6, 2, 1_500_000, 24, 0)])
def test_substrings(spark, length, gram, buffer, rounds, crowd):
    rng = random.Random(length)
    passages = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (length - 1, length, length + 1, 30, 60)]
    texts = {}
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 5))]
        texts[i] = "  ".join(parts) + rng.choice(["", "\n"])
    texts |= {70: "w1 " * 50, 71: "w1 " * 40, 72: None, 73: "", 74: " ", 75: texts[3], 76: texts[3]}
    df = docs(spark, texts, extra=True).repartition(3)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.drop_repeats(df, length=length, gram=gram, buffer=buffer, rounds=rounds, crowd=crowd).collect()}
    assert found == plain_repeats(texts, length)


def test_substrings_of_long_texts(spark):
    rng = random.Random(7)
    long = [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(30_000)]
    texts = {1: " ".join(long), 2: " ".join(long[:15_000]) + " other " + " ".join(long[15_001:]), 3: " ".join(long[100:112]) + " x", 4: "y " + " ".join(long[29_980:]) + " z", 5: "same " * 20_000}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.drop_repeats(docs(spark, texts)).collect()}
    assert got == plain_repeats(texts, 13) and got[2][2] == "other" and got[3][1] == 0 and got[4][1] == 20


def test_substrings_without_ids_or_rows(spark):
    same = " ".join(WORDS * 2)
    df = spark.createDataFrame([(None, same), (1, same), (2, same), (2, same)], DOC)
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.drop_repeats(df).collect()) == [(0, 0), (1, 0), (2, 24), (2, 24)]
    assert substring.drop_repeats(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 6: lines


def test_lines(spark):
    page = "Page {} of our own site here\n"
    texts = {
        1: page.format(1) + "first text alone\n\nSee Alice said this was all very good", 2: page.format(22) + "second text alone", 3: "third text\n" + page.format("3b") + "See Bob said this was all very good",
        4: "See Carol said this was all very good", 5: "a b\na b", 6: "a b", 7: "a b", 8: None, 9: "", 10: "\n\n", None: page.format(1),
    }
    df = docs(spark, texts, extra=True)
    kept = {r.doc_id: (r.text, r["__n_lines"], r["__n_dropped"]) for r in lines.drop_lines(df).collect()}
    assert kept[1] == (texts[1], 4, 0) and kept[2] == ("second text alone", 2, 1) and kept[3] == ("third text", 3, 2)
    assert kept[4] == ("", 1, 1) and kept[5] == ("a b\na b", 2, 0) and kept[6] == kept[7] == ("", 1, 1)
    assert kept[8] == (None, 0, 0) and kept[9] == ("", 0, 0) and kept[10] == ("\n\n", 3, 0) and kept[None][2] == 0
    dropped = {r.doc_id: r["__n_dropped"] for r in lines.drop_lines(df, keep_first=False).collect()}
    assert [dropped[d] for d in (1, 2, 3, 4, 5, 6)] == [2, 1, 2, 1, 2, 1]
    assert lines.drop_lines(docs(spark, [])).count() == 0


def test_lines_of_long_texts_and_repeated_rows(spark):
    long = "\n".join(f"line number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'x' * (i // 676)} stands here" for i in range(3000))
    df = docs(spark, {1: "start\n" + long, 2: long + "\nend", 3: "word " * 40_000, 4: "word " * 40_000 + "\nnot word"})
    kept = {r.doc_id: r.text for r in lines.drop_lines(df.unionByName(df.where("doc_id = 1")), min_docs=2).collect()}
    assert kept[1].split("\n")[:2] == ["start", "line number aa stands here"] and kept[2] == "end" and kept[3] == "word " * 40_000 and kept[4] == "not word"
    again = spark.createDataFrame([(1, "said once"), (1, "said once"), (2, "said elsewhere")], DOC)
    assert sorted(r.text for r in lines.drop_lines(again).collect()) == ["said elsewhere", "said once", "said once"]


def plain_templates(texts):
    """Documents' dropped line numbers, in plain Python: what recurs, and lines that agree in all but some segments with lines of three documents."""
    seen = defaultdict(set)
    docs_of = defaultdict(set)
    rows = []
    for d, t in texts.items():
        for k, line in enumerate((t or "").split("\n")):
            w = tuple("<*>" if any(c.isdigit() for c in x) else x for x in line.split())
            if w and d is not None:
                own = {(w, 2)} if "<*>" not in w or plain_enough(w) else set()
                names = w[:1] + tuple("<*>" if "A" <= x[0] <= "Z" else x for x in w[1:])
                own |= {(names, 3)} if names != w and plain_enough(names) else set()
                rows.append((d, k, w, own))
                docs_of[w].add(d)
                for m in own:
                    seen[m].add(d)
    first = {w: plain_first(w, docs_of) for w in docs_of if len(w) >= 4}
    gone = defaultdict(set)
    for d, k, w, own in rows:
        if any(len(seen[m]) >= m[1] and min(seen[m]) < d for m in own) or first.get(w, d) < d:
            gone[d].add(k)
    return gone


def plain_first(w, docs_of):
    """The smallest document of the lines that share a template with ``w``, over all templates of three documents."""
    s = min(len(w), 12)
    at = [(i * len(w) // s, (i + 1) * len(w) // s) for i in range(s)]
    near = []
    for v in docs_of:
        if len(v) == len(w):
            differ = {i for i, (a, b) in enumerate(at) if v[a:b] != w[a:b]}
            if len(differ) <= min(3, 2 * s // 5):
                near.append((differ, docs_of[v]))
    firsts = []
    for left_open in combinations(range(s), min(3, 2 * s // 5)):
        if plain_enough(tuple(x for i, (a, b) in enumerate(at) for x in (("<*>",) * (b - a) if i in left_open else w[a:b]))):
            docs = set().union(*(d for differ, d in near if differ <= set(left_open)))
            firsts += [min(docs)] if len(docs) >= 3 else []
    return min(firsts, default=float("inf"))


def plain_enough(w):
    constants = sum(x != "<*>" for x in w)
    return constants >= 3 and 2 * constants >= len(w)


def test_repeats_in_two_documents_and_of_short_lines(spark):
    texts = {1: "a line that is in just two documents\nLes.\nown 1", 2: "a line that is in just two documents\nLes.\nown 2", 3: "Les.\nthe third", 4: None, None: "Les."}
    df = docs(spark, texts, extra=True)
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, df, SF).collect()}
    assert kept == texts | {2: "own 2", 3: "the third"}


def test_fields_in_the_middle_of_lines(spark):
    lines_of = {
        1: "Thanks for reading this post by Alice here today\nPosted by Alice in Travel", 2: "Thanks for reading this post by Bob here today\nPosted by Bob in Sports", 3: "Thanks for reading this post by Carol here today\nPosted by Carol in Food",
        4: "thanks for reading this post by dan here today", 5: "thanks for reading this post by eve here today", 6: "thanks for reading this post by all here today", 7: "a line on its own stays where it is",
    }
    kept = {r.doc_id: r.text for r in lines.drop_lines(docs(spark, lines_of)).collect()}
    assert kept == {1: lines_of[1], 2: "", 3: "", 4: "", 5: "", 6: "", 7: lines_of[7]}  # 4 to 6 differ from 1 in two of nine tokens


@pytest.mark.parametrize("size", [4, 2000])
@pytest.mark.parametrize(("template", "n_fields"), [("user {} liked photo of {}", 2), ("on {} the server {} restarted after error code {} today", 3), ("a long line of which {} and also {} and then {} are all that ever changes in any of the documents that hold it", 3)])
def test_lower_case_fields_apart(spark, size, template, n_fields):
    def word(i, k):
        return "".join(chr(97 + (i * 7 + k * 5 + i // 26**j) % 26) for j in range(3))

    texts = {i: template.format(*(word(i, k) for k in range(n_fields))) + f"\n{'own ' * (i % 50 + 1)}{word(i, 9)}" for i in range(size)}
    texts |= {size: "no line of this one is in any other", size + 1: "user bob disliked every photo here"}
    kept = {r.doc_id: r.text.split("\n")[0] for r in lines.drop_lines(docs(spark, texts).repartition(5), buffer=2000).collect()}
    held = [d for d in range(size) if kept[d] == texts[d].split("\n")[0]]
    assert held == [0] and all(kept[d] == texts[d] for d in (size, size + 1))


@pytest.mark.parametrize("keep_first", [True, False])
def test_merged_lines_of_copies_and_of_two_documents(spark, keep_first):
    one, two, three = ("user bob liked photo of cat", "user amy liked photo of dog", "user tim liked photo of sun")
    texts = {5: one, 6: one, 7: f"{two}\n{two}", 8: "every day one sees such things", 9: "every night one hears such things", 10: f"{three}\n\n"}
    kept = {r.doc_id: r.text for r in lines.drop_lines(docs(spark, texts), keep_first=keep_first).collect()}
    # 8 and 9 are one template, but of two documents only
    assert kept == {5: one if keep_first else "", 6: "", 7: "", 8: texts[8], 9: texts[9], 10: "\n"}


@pytest.mark.parametrize("size", [4, 40])
def test_word_fields_at_two_sizes(spark, size):
    names, topics = ["Alice", "Bob", "Carol", "Dan"], ["Travel", "Sports"]
    texts = {i: f"{names[i % 4]} commented on this post\nPosted by {names[i % 4]} in {topics[i // 2 % 2]} news\n{'own ' * (i + 1)}" for i in range(size)}
    kept = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.drop_boilerplate(spark, docs(spark, texts), SF).collect()}
    assert not [d for d in kept if d and any("commented" in x for x in kept[d])]
    gone = plain_templates(texts)
    assert all(kept[d] == [x for k, x in enumerate(t.split("\n")) if k not in gone[d]] for d, t in texts.items())


@pytest.mark.parametrize(("longest", "buffer"), [(8, lines.BUFFER), (20, lines.BUFFER), (20, 50)])
def test_repeats_are_the_plain_ones(spark, longest, buffer):
    rng = random.Random(longest)
    base = [[rng.choice(["x", "y", "z", "7", "Q"]) for _ in range(rng.randint(0, longest))] for _ in range(30)]
    texts = {}
    for i in range(60):
        own = [list(rng.choice(base)) for _ in range(3)]
        for line in own:
            for _ in range(rng.randint(0, 2) if line else 0):
                line[rng.randrange(len(line))] = rng.choice(["u", "V", "w", "8"])
        texts[i] = "\n".join(map(" ".join, own))
    texts |= {100: "", 101: None, None: "x y z"}
    want = plain_templates(texts)
    got = {r.doc_id: set(r.lines) for r in lines.repeated_lines(docs(spark, texts).repartition(3), buffer=buffer).collect()}
    assert got == {d: k for d, k in want.items() if k} and len(got) > 10


# ---------------------------------------------------------------- 7: licences


def test_licenses(spark):
    texts = {
        1: "This work is licensed under the GNU General Public License, version 3.", 2: "CC-BY and cc by; Apache  License", 3: "gnu general public", 4: "MIT\nLicense mit license all rights reserved", 5: None, 6: "",
        7: "Licensed under CC BY-NC 4.0.", 8: "license mit license", 9: "cc", 10: "by",
    }
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts, extra=True)).collect()}
    phrases = {t.words: t.label for t in licenses.BASE}
    for d, t in texts.items():
        w = alnum(t)
        at = [(s, label) for p, label in phrases.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        starts = [s for s, _ in at]
        assert (got[d].n_words, got[d].n_base, got[d].first_word, got[d].last_word) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert got[d].base_labels == sorted({x for _, x in at}) and set(got[d].base_labels) <= set(got[d].labels)
    assert got[1].labels == ["gpl", "gpl-3.0"] and got[1].score == 1.0 and got[4].labels == ["all-rights-reserved", "mit"] and got[7].labels == ["cc-by", "cc-by-nc"]
    assert got[3].labels == [] and got[3].score == 0
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_licenses_in_long_texts_and_repeated_rows(spark):
    long = "word " * 50_000 + "apache license " + "word " * 50_000 + "mit license"
    df = docs(spark, {1: long, 2: "mit license"})
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(df.unionByName(df)).collect())
    assert got == sorted([(1, 100_004, 2, 50_000, 100_002, ["apache", "mit"]), (2, 2, 1, 0, 0, ["mit"])] * 2)


def test_license_places_are_those_of_a_plain_scan():
    """The look-up by rare words finds each template wherever its key phrase stands, whichever words are rare."""
    rng = random.Random(13)
    pieces = [t.words for t in licenses.TEMPLATES] + [t.key for t in licenses.TEMPLATES] + ["license", "public gnu general", "the", "by nc cc by"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    for seed in range(3):
        weights = {w: random.Random(seed * 1000 + i).random() for i, w in enumerate(licenses.vocabulary(licenses.TEMPLATES))}
        index = licenses.build_index(licenses.TEMPLATES, weights)
        batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
        for r in pa.Table.from_batches(list(licenses.scan(iter([batch]), index))).to_pylist():
            w = texts[r["doc_id"]].split()
            found, best = set(), 0.0
            for t in licenses.TEMPLATES:
                key, own = t.key.split(), t.words.split()
                ahead = next(j for j in range(len(own)) if own[j : j + len(key)] == key)
                for at in range(len(w) - len(key) + 1):
                    if w[at : at + len(key)] == key:
                        found.add(t.label)
                        best = max(best, sum(0 <= at - ahead + j < len(w) and w[at - ahead + j] == x for j, x in enumerate(own)) / len(own))
            assert (r["labels"], r["score"]) == (sorted(found), pytest.approx(best))


# ---------------------------------------------------------------- 9: packing


def plain_best_fit(n_tokens, sources, clusters, capacity):
    bins, placed = [], []
    for n, s, c in zip(n_tokens, sources, clusters, strict=True):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and b["left"] > 0 and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "s": set(), "c": set()})
        placed.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
    return placed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(-1, 5), st.integers(-1, 3)), max_size=60))
def test_best_fit_is_the_plain_search(pieces):
    columns = [list(x) for x in zip(*pieces, strict=True)] or [[], [], []]
    assert packing.best_fit(*columns, 20) == plain_best_fit(*columns, 20)


#: Sources and clusters of a shard's pieces; every search of "one cluster" and "one source" passes all open bins.
SHARDS = {
    "distinct sources": lambda k, rng: (k, -1),
    "500 sources": lambda k, rng: (rng.randrange(500), -1),
    "one cluster": lambda k, rng: (-1, 0),
    "one source": lambda k, rng: (0, -1),
    "hot source and hot cluster": lambda k, rng: (rng.choice([0, 0, 1 + k]), rng.choice([0, 0, 1 + k % 50, -1])),
}


@pytest.mark.parametrize("name", SHARDS)
def test_best_fit_of_a_full_shard(name):
    rng = random.Random(6)
    pieces = [(n, *SHARDS[name](k, rng)) for k, n in enumerate(sorted((rng.randrange(1, 900) for _ in range(8192)), reverse=True))]
    columns = [list(x) for x in zip(*pieces, strict=True)]
    before = time.process_time()
    placed = packing.best_fit(*columns, 4096)
    assert time.process_time() - before < 3  # 0.2 to 0.8 s on an idle machine
    held = defaultdict(list)
    for (n, source, cluster), (b, start) in zip(pieces, placed, strict=True):
        held[b].append((start, n, source, cluster))
    for rows in held.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False)) and rows[-1][0] + rows[-1][1] <= 4096
        for of in (2, 3):
            several = [r[of] for r in rows if r[of] >= 0]
            assert len(several) == len(set(several))
    few = [x[:600] for x in columns]
    assert packing.best_fit(*few, 4096) == plain_best_fit(*few, 4096)


def test_packing(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["the", "cat", "sat", "mats"]) for _ in range(rng.randrange(0, 70))) for i in range(120)}
    texts |= {200: None, 201: "", 202: texts[5], 203: texts[5].upper(), 204: "dog " * 500}
    df = docs(spark, texts, extra=True).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 > 0, F.concat(F.lit("s"), F.col("doc_id") % 7)))
    found = packing.pack(df, capacity=64, shard_docs=40).collect()
    encode = token_file.encoder(token_file.vocabulary_path())
    size = {d: int(encode.encode(pa.array([t], pa.string()))[1][0]) + 1 for d, t in texts.items()}
    source = {r.doc_id: r.source for r in df.collect()}
    bins, total = defaultdict(list), Counter()
    for r in found:
        bins[r.shard, r.bin].append(r)
        total[r.doc_id] += r.n_tokens
    assert total == size
    for rows in bins.values():
        rows.sort(key=lambda r: r.bin_start)
        assert [r.bin_start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))] and sum(r.n_tokens for r in rows) <= 64
        named = [source[r.doc_id] for r in rows if source[r.doc_id]]
        assert len(named) == len(set(named))
        same = [tuple(words_of(fold(texts[r.doc_id]))) for r in rows if words_of(texts[r.doc_id])]
        assert len(same) == len(set(same))
    assert packing.pack(df.where("false")).count() == 0


def test_packing_spreads_rows_of_one_id_and_of_none(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, None if i % 4 else "one text", "s") for i in range(400)], DOC + ", source string")
    found = packing.pack(df, capacity=64, shard_docs=50).collect()
    of_shard = Counter(r.shard for r in found)
    assert len(found) == 400 and len(of_shard) == 8 and max(of_shard.values()) < 120
    assert Counter(r.doc_id for r in found) == {None: 200, 7: 200} and len({(r.shard, r.bin) for r in found}) == 400


# ---------------------------------------------------------------- 10: near-duplicates


def plain_groups(texts, k=5, percent=75):
    sets = {}
    for d, t in texts.items():
        w = words_of(fold(t))
        sets[d] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    low = {d: d for d in texts}
    links = [(a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {d: (len(sets[d]), low[d]) for d in texts}


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates(spark, block):
    rng = random.Random(8)
    texts = {}
    for i in range(12):
        base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.choice([3, 6, 20, 120]))]
        for j in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS).upper()
            texts[len(texts) * 2 + 1] = " ".join(copy)
    texts |= {500: None, 501: "", 502: " ", 503: "a b", 504: "A  b", 505: "b a", 506: texts[1]}
    want = plain_groups(texts)
    found = minhash.near_duplicates(docs(spark, texts, extra=True), block=block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_near_duplicates_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], DOC)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect()) == [(0, 0, True), (2, 2, True), (2, 2, True), (4, 2, False)]
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(0)
    for j in (0.3, 0.75, 0.95):
        n = 4000
        both = int(2 * n * j / (1 + j))
        values = np.unique(rng.integers(0, 2**64, 3 * n, np.uint64))
        rng.shuffle(values)
        sets = [values[:n], np.concatenate([values[:both], values[n : 2 * n - both]])]
        rows = [minhash.signatures(np.sort(s), np.array([0, n]), 512) for s in sets]
        size = np.array([n])
        assert minhash.estimate(rows[0], rows[1], size, size)[0] == pytest.approx(j, abs=0.1)


@pytest.mark.parametrize("n", [4, 12, 60, 800])
def test_candidates_find_nearly_all_links(n):
    """Of pairs at the threshold, the share that have a common band and pass the estimate."""
    rng = np.random.default_rng(n)
    both, pairs = -(-3 * n // 4), 400
    found = 0
    for _ in range(pairs):
        values = np.unique(rng.integers(0, 2**64, 2 * n + 10, np.uint64))
        rng.shuffle(values)
        sets = [np.sort(values[:n]), np.sort(values[:both])]
        rows = [minhash.signatures(s, np.array([0, len(s)])) for s in sets]
        near = minhash.estimate(*rows, np.array([n]), np.array([both]))[0] >= minhash.floor_of(0.75)
        found += bool(near and (rows[0] == rows[1]).reshape(-1, minhash.BAND).all(1).any())
    assert found >= 0.99 * pairs


def test_empty_buckets_take_a_filled_one():
    values = np.sort(np.random.default_rng(1).integers(0, 2**64, 3, np.uint64))
    one = minhash.signatures(values, np.array([0, 3]))[0]
    own = {int(v >> np.uint64(57)): int(minhash.compress(np.array([v << np.uint64(7)]))[0]) for v in values[::-1]}
    assert set(one.tolist()) == set(own.values()) and all(one[b] == v for b, v in own.items())
    assert minhash.signatures(np.empty(0, np.uint64), np.array([0, 0])).shape == (0, 128)


def test_a_hot_bucket_meets_by_rare_shingles(spark):
    """Texts that share half their words but are no copies fill some buckets; what meets grows with them, not with their pairs."""
    met = {}
    for n in (1000, 4000):
        rng = random.Random(11)
        passage = " ".join(f"p{i}" for i in range(54))
        texts = {2 * i: passage + " " + " ".join(f"q{rng.randrange(10**9)}" for _ in range(50)) for i in range(n)}
        texts |= {2 * n + 1: texts[0] + " more", 2 * n + 3: texts[2 * n - 2] + " tail"}
        df = docs(spark, texts)
        sig = df.mapInArrow(lambda it: minhash.sign(it, 5), "doc_id long, n long, s1 long, s2 long, registers binary").select("doc_id", "registers")
        placed = sig.mapInArrow(minhash.bands, "key long, doc long").withColumn("component", F.col("doc")).cache()
        assert placed.groupBy("key").count().agg(F.max("count")).first()[0] > 300
        met[n] = minhash.meeting(placed, df, k=5, percent=75, block=16)[0].count()
    assert all(rows < 3 * n for n, rows in met.items())
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, block=64).collect()}
    assert found == {d: {2 * n + 1: 0, 2 * n + 3: 2 * n - 2}.get(d, d) for d in texts}


def test_the_pairs_of_one_document_are_spread(spark):
    """3,000 pairs of one hub: its text is sent once for each part, and no task has more than a few parts."""
    n, group = 3000, 64
    words = " ".join(f"w{i}" for i in range(60))
    texts = {i: f"{words} x{i}" if i % 3 else words[:100] + f" {i} y z" * 40 for i in range(1, n + 1)} | {0: words, 5000: "other words of no hub at all"}
    df = docs(spark, texts).unionByName(spark.createDataFrame([(0, words), (7, texts[7])], DOC))  # repeated rows, of the hub too
    pairs = spark.createDataFrame([(0, i) for i in range(1, n + 1)] + [(1, 5000)], "a long, b long")
    dealt = minhash.dealt_pairs(pairs, df, group)
    parts = dealt.groupBy("a", "part").agg(F.count("*").alias("n"), F.count_if(F.col("b").isNull()).alias("own")).collect()
    hub = [r for r in parts if r.a == 0]
    assert len(hub) == 47 and max(r.n for r in hub) < 2.5 * group and all(r.own == 2 for r in hub)
    placed = dealt.repartition(8, "a", "part").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) == 8 and max(r["count"] for r in placed) < 0.3 * n
    found = {(r.a, r.b) for r in minhash.confirmed(pairs, df, 5, 75, group).collect()}
    assert found == {(0, i) for i in range(1, n + 1) if i % 3}


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(12)
    long = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(20_000)]
    near = [w if rng.random() > 0.01 else "x" for w in long]
    other = [w if rng.random() > 0.2 else "x" for w in long]
    texts = {1: " ".join(long), 2: " ".join(near), 3: " ".join(other)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, texts)).collect()} == plain_groups(texts)


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    found = {r.doc: r.component for r in minhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


# ---------------------------------------------------------------- queries and the pipeline


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, con, name):
    def counted(table):
        names = sorted(table.column_names)
        return names, Counter(map(repr, zip(*[table.column(n).to_pylist() for n in names], strict=True)))

    assert counted(queries.QUERIES[name](spark, SF).toArrow()) == counted(con.sql(queries.ORACLE_SQL[name]).to_arrow_table())


def test_registered_classifiers(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ids = sorted(r.doc_id for r in documents.collect())
    for name, label, threshold in (("op1_toxicity", "toxic", 0.5), ("op8_quality", "quality", 0.3)):
        found = queries.QUERIES[name](spark, SF).collect()
        assert sorted(r.doc_id for r in found) == ids
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in found)
        truth = {r.doc_id: r[label] for r in labels.collect()}
        held = [r for r in found if r.held_out and r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.85 * len(held)


def test_registered_token_file(spark):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(token_file.vocabulary_path()), 0
    want = []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op2_token_file"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_registered_packing(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size = {r.doc_id: r.n_tokens for r in queries.QUERIES["op2_token_file"](spark, SF).collect()}
    bins, total = defaultdict(list), Counter()
    for r in queries.QUERIES["op9_packing"](spark, SF).collect():
        bins[r.shard, r.bin].append(r)
        total[r.doc_id] += r.n_tokens
    assert total == size
    for held in bins.values():
        assert sum(r.n_tokens for r in held) <= 4096
        sources = [rows[r.doc_id].source for r in held if rows[r.doc_id].source]
        assert len(sources) == len(set(sources))


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n", F.lit("clash"))
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, names = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == documents.columns
        was, now = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
        assert set(now) <= set(was)
        if name == "quality_classifier":
            wrong = [d for d in was if d in truth and (d in now) != bool(truth[d])]
            assert len(wrong) <= 0.1 * len(truth)
        elif name == "line_dedup":
            gone = plain_templates(was)
            left = {d: t if d not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in was.items()}
            assert now == {d: t for d, t in left.items() if d not in gone or words_of(t)}  # a text of which nothing is left goes
        elif name == "near_dedup":
            assert set(now) == {d for d, (_, low) in plain_groups(was).items() if d == low}
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(now) == {d for d, (_, hit, _) in plain_leaks(was, items, 10).items() if not hit}
        before, names = after, [*names, name]
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in packed.collect()} == set(now)
    assert corpus_pipeline.run(spark, SF).columns == packed.columns


def test_near_dedup_leaves_one_row_of_repeated_ones(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long, "en", "b", 1), (1, long, "en", "a", 1), (1, long, "en", "a", 1), (2, long, "en", "a", 1), (3, "another", "en", None, 1), (3, "another text", "en", None, 1), (3, "another", "en", None, 1)]
    rows += [(None, "no id", None, None, None), (None, "no id", None, None, None), (4, None, None, None, None), (4, None, None, None, None), (5, "", None, None, 0)]
    found = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, schema), SF)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = [(1, long, "en", "a", 1), (3, "another", "en", None, 1), (3, "another text", "en", None, 1), *rows[7:10], rows[11]]
    assert Counter(map(tuple, found.collect())) == Counter(want)


#: What is left of four rows: a null text, rows without an id, and an empty text.
@pytest.mark.parametrize(("name", "left"), [("quality_classifier", 4), ("line_dedup", 4), ("near_dedup", 4), ("decontamination", 4), ("packing", 4)])
def test_stage_of_nulls_and_of_nothing(spark, name, left):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, None, None, None), (None, "some words", None, "s", 3), (2, "", "en", "s", 0)]
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    found = stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert len(found) == left


