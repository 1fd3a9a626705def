"""Spelling variants, SimHash classes and hard negatives against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import negatives, queries, simhash, spelling

SF = "/root/testdata/sf0.001"
CLASH = ("n", "word", "h", "key", "print", "block", "component", "shard", "cluster", "score", "rank", "doc")


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(list(rows), "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if extra else df


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---------------------------------------------------------------- 11: spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, ratio=5):
    out = {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= ratio * n[w] else None, len(near))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (form, root(w), n[w], k, n.get(form)) for w, (form, k) in out.items()}


def grouped(spark, n, **more):
    vocab = spark.createDataFrame(list(n.items()), "word string, n long").withColumn("id", F.lit("clash"))
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(vocab, **more).collect()}


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_variants_are_the_plain_ones(spark, symbols):
    rng = random.Random(3)
    n = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))): rng.choice([1, 4, 20, 100, 500, 500]) for _ in range(300)}
    n |= {"abcdefgh": 7, "bcdefghi": 7, "ÿÿÿÿÿÿ": 1, "ÿÿÿÿÿ": 5, "": 3}
    assert grouped(spark, n, symbols=symbols) == plain_variants(n)
    assert sum(x[3] for x in plain_variants(n).values()) > 500


def test_variants_of_long_words_and_of_none(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=30_000))
    n = {long: 50, long[:20_000] + long[20_001:]: 6, long[:7] + "z" + long[7:]: 2, long + "q": 1, long[:-2]: 1}
    found = grouped(spark, n)
    assert [found[w][3] for w in n] == [3, 1, 1, 1, 0] and all(found[w][0] == long for w in list(n)[1:4]) and found[long[:-2]][0] is None
    assert grouped(spark, {}) == {}


def test_roots_follow_forms_to_the_last(spark):
    chain = {"a" * (6 + i): 6**i for i in range(12)}
    assert {x[1] for x in grouped(spark, chain).values()} == {"a" * 17}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", min_size=0, max_size=9), min_size=1, max_size=6))
def test_neighbourhoods_are_complete(words):
    """Of each reduced word all hashes of reduced words within one edit, and no others."""
    symbols = 3
    own, word, h = spelling.neighbourhoods(*spelling.reduce(words, symbols), symbols)
    for i, w in enumerate(words):
        around = {w} | {w[:j] + w[j + 1 :] for j in range(len(w))} | {w[:j] + s + w[j + d :] for j in range(len(w) + 1) for s in "abc" for d in (0, 1) if j + d <= len(w)}
        want = spelling.neighbourhoods(*spelling.reduce(sorted(around), symbols), symbols)[0]
        assert sorted(h[word == i].tolist()) == sorted(want.tolist()) and own[i] in want


def test_words_and_their_misspellings(spark):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["Straße", "naïve", "WORDS", "wordy", "été", "x" * 200]) for _ in range(60)) + "1a2÷b-ß" for i in range(40)}
    rows = [*texts.items(), (None, None), (7, None), (None, "Straßen x"), (50, ""), (51, "12 ..."), *list(texts.items())[:3]]
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = fold(run)
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if i is not None and h % 13 == 0 else w] += 1
    words = spelling.misspelt(spelling.word_runs(docs(spark, rows, extra=True)), every=13)
    assert Counter(r.word for r in words.collect()) == want
    assert {r.word: r.n for r in spelling.vocabulary(words, 5, 3).collect()} == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}


# ---------------------------------------------------------------- 12: SimHash


def plain_print(t):
    words = fold(t).encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(nodes, radius=4):
    """Of (id, print) rows the smallest id that each id reaches."""
    low = {i: i for i, _ in nodes}
    while True:
        before = dict(low)
        for i, a in nodes:
            for j, b in nodes:
                if (a ^ b).bit_count() <= radius:
                    low[i] = low[j] = min(low[i], low[j])
        if before == low:
            return low


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


@pytest.mark.parametrize(("block", "part"), [(4096, 2048), (16, 8), (3, 1)])
def test_prints_within_the_radius_are_linked(spark, block, part):
    rng = random.Random(block)
    prints = [rng.getrandbits(64) for _ in range(20)]
    prints += [flipped(rng, rng.choice(prints[:20]), rng.randrange(9)) for _ in range(60)] + [0, 1, 2**64 - 1, 2**63]
    nodes = [(i, p) for i, p in enumerate(dict.fromkeys(prints))]
    rng.shuffle(nodes)
    rows = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in nodes], "doc long, print long")
    linked = {(r.a, r.b) for r in simhash.near_prints(rows, 4, block, part).collect()}
    of = dict(nodes)
    assert linked and all((of[a] ^ of[b]).bit_count() <= 4 and a < b for a, b in linked)
    low = plain_classes(nodes)
    reached = {i: i for i in of}
    for _ in range(len(of)):
        for a, b in linked:
            reached[a] = reached[b] = min(reached[a], reached[b])
    assert reached == low


@pytest.mark.parametrize("distance", range(7))
def test_every_distance(spark, distance):
    rng = random.Random(distance)
    pairs = [(a, flipped(rng, a, distance)) for a in (rng.getrandbits(64) for _ in range(30))]
    rows = [(2 * i + k, p - 2**64 if p >= 2**63 else p) for i, pair in enumerate(pairs) for k, p in enumerate(pair) if distance or not k]
    found = {(r.a, r.b) for r in simhash.near_prints(spark.createDataFrame(rows, "doc long, print long"), block=7, part=3).collect()}
    assert found == ({(2 * i, 2 * i + 1) for i in range(30)} if 0 < distance <= 4 else set())


def test_coded_hashes_come_back():
    prints = np.random.default_rng(1).integers(0, 2**64, 40, np.uint64)
    for n in (40, 4000, 4_000_000):
        hashes = simhash.Hashes(n, 1, block=40, part=16)
        keys = np.sort(np.concatenate([h for _, h in hashes.of(prints, simhash.ball(1))]))
        parts = [hashes.decode(*x) for x in zip(*hashes.encode(keys), strict=True)]
        assert np.array_equal(np.concatenate(parts), keys) and len(simhash.ball(2)) == 2081


def test_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    long = [" ".join(rng.choice(words) for _ in range(900)) for _ in range(6)]
    near = [t.replace(" ", " x ", 1) for t in long for _ in range(3)]
    texts = [None, "", " \n\t", "a", "A", "a b c", "a b c d", "a b c e", *long, *near, long[0], "word " * 20_000 + "end", "Ünï çødé — x"]
    rows = [*enumerate(texts), (None, "a"), (None, None), (8, long[0]), (9, "another text under one id")]
    found = simhash.near_copies(docs(spark, rows, extra=True), block=5, part=2).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint) for r in found) == sorted((-1 if i is None else i, f"{plain_print(t):016x}") for i, t in rows)
    assert all(r.component_id is None for r in found if r.doc_id is None)
    low = plain_classes([(i, plain_print(t)) for i, t in rows if i is not None])
    assert {(r.doc_id, r.component_id) for r in found if r.doc_id not in (None, 9)} == {x for x in low.items() if x[0] != 9}
    assert simhash.near_copies(docs(spark, [])).count() == 0


def test_prints_use_the_hash_of_the_contract(spark):
    text = "One two, three FOUR five"
    sample = docs(spark, [(1, "one two, three four"), (2, "two, three four five")])
    h = [r[0] % 2**64 for r in sample.select(F.xxhash64("text")).collect()]
    assert simhash.fingerprint(text.encode()) == h[0] & h[1] == plain_print(text)


def test_an_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.near_prints(spark.createDataFrame([(1, 2)], "doc long, print long"), radius=3)


def test_a_dense_ball_is_one_class_without_its_pairs(spark):
    """Prints around one centre: what is shuffled of each is at most its own ball, and the links are at most its size."""
    centre = 0x0123456789ABCDEF
    prints = [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    rows = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "doc long, print long")
    links = simhash.near_prints(rows, block=512, part=256).cache()
    assert links.count() < 2081 * len(prints) / 4
    assert {r.component for r in simhash.components(links).collect()} == {0}


def test_registered_copies(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    of = {r.doc_id: plain_print(r.text) for r in rows}
    low = plain_classes(list(of.items()))
    found = queries.QUERIES["op12_simhash_copies"](spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((i, f"{p:016x}", low[i]) for i, p in of.items())


# ---------------------------------------------------------------- 13: hard negatives

ROW = "vec_id long, label int, embedding array<double>"


def plain_negatives(rows, every, scale=256):
    of = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            q = [float(max(min(math.floor(scale * x), 2**63 - 1), -(2**63))) for x in v]
            of[i] = min(of.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in of.items():
        if a % every:
            continue
        scores = {i: (x == label, max(-(2**63), min(2**63 - 1, sum(int(s) * int(t) for s, t in zip(q, w, strict=True))))) for i, (x, w) in of.items() if i != a and len(w) == len(q)}
        positives = sorted(((-s, i) for i, (same, s) in scores.items() if same))[:5]
        for ps, p in positives:
            fit = sorted((-s, i) for i, (same, s) in scores.items() if not same and 50 * -ps <= 100 * s <= 95 * -ps)[:3]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, ROW).withColumns({c: F.lit("clash") for c in CLASH})
    found = negatives.hard_negatives(df, **more)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize(("shard_rows", "clusters", "sample"), [(16384, 32, 2048), (60, 3, 10), (7, 1, 1)])
def test_hard_negatives(spark, shard_rows, clusters, sample):
    rng = np.random.default_rng(shard_rows)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + rng.normal(size=8) * 0.3).round(1 if i % 3 else 6).tolist()) for i in range(400)]
    rows += [(1000, None, [1.0] * 8), (1005, 1, None), (1010, 1, [1.0, None] * 4), (1015, 1, [float("nan")] * 8), (1020, 1, [float("inf")] * 8), (None, 1, [1.0] * 8), (1025, 2, []), (1030, 0, [0.0] * 8)]
    rows += [(i, i % 2, [i - 1995.0, 1.0]) for i in range(2000, 2020)]  # of another length
    rows += [rows[5], rows[5], (15, 0, [0.5] * 8), (15, 3, [0.25] * 8)]  # repeated rows, and different ones under one id
    want = plain_negatives(rows, 5)
    assert mined(spark, rows, every=5, shard_rows=shard_rows, clusters=clusters, sample=sample) == want
    assert len(want) > 200 and any(a >= 2000 for a, *_ in want)


def test_hard_negatives_of_equal_scores(spark):
    rows = [(i, i % 2, [1.0, 0.0]) for i in range(60)] + [(100 + i, 1, [0.75, 0.0]) for i in range(9)]
    want = plain_negatives(rows, 10)
    assert mined(spark, rows, every=10, shard_rows=8) == want and {x[3] for x in want} == {100, 101, 102}


def test_hard_negatives_beyond_doubles_and_of_nothing(spark):
    rows = [(i, i % 2, [1e7 * (1 - i / 60), -1e6 * i, 0.0]) for i in range(40)] + [(100 + i, i % 2, [1e300, -1e300, 1.0]) for i in range(6)]
    rows += [(200 + i, i % 2, [3.6e16 * (-1) ** i]) for i in range(12)]
    assert mined(spark, rows, every=5, shard_rows=9) == plain_negatives(rows, 5) != []
    assert mined(spark, [], every=5) == [] and mined(spark, [(1, 1, [1.0])], every=5) == [] and mined(spark, [(5, 1, [1.0])], every=5) == []


def test_members_leave_a_list_when_they_are_certified():
    """With clustered vectors a member looks at a small share of its list."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16)) * 4
    of = rng.integers(20, size=8000)
    vectors = np.floor(256 * (centres[of] + rng.normal(size=(8000, 16)) * 0.05))
    model = negatives.fit(vectors[:200].tolist(), 20)[16]
    angle = negatives.angles(negatives.units(vectors)[0], model)
    cluster = angle.argmin(1)
    radii = {c: float(angle[cluster == c, c].max()) for c in range(len(model))}
    shard = negatives.Shard.of(np.arange(8000), of % 4, vectors, model, radii)
    seen = defaultdict(int)

    class Counted(negatives.Positives):
        def look(self, active, scores, ids, labels):
            for i in active.tolist():
                seen[self.ids[i]] += len(ids)
            super().look(active, scores, ids, labels)

    for c in range(len(model)):
        members = np.flatnonzero(cluster == c)[:20]
        shard.walk(c, Counted(members, (of % 4)[members], vectors[members], 5))
    assert np.mean(list(seen.values())) < 0.25 * len(vectors)
