"""Near-duplicate classes against all pairs, and the alignment against the textbook table."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import near_dedup as nd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, __node string, n long"  # the last two clash with inner names


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def alike(a, b):
    x, y = shingles(a), shingles(b)
    n = lcs(x, y)
    return bool(x) and bool(y) and n / (len(x) + len(y) - n) >= 0.8 - 1e-12


def test_shingles_match_the_plain_ones():
    texts = ["A b, c d-e f", "one", "", None, "é É x y z a b", "  lead and tail and lead and tail ", "a b c d", "a b c d e"]
    got = nd.shingles(pa.array(texts, pa.string()))
    seen: dict = {}
    for t, g in zip(texts, got):
        own = shingles(t)
        assert len(own) == len(g)
        for s, h in zip(own, g.tolist()):
            assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("seed", range(30))
def test_alignment(seed):
    rng = random.Random(seed)
    a = [rng.randrange(8) for _ in range(rng.randrange(1, 60))]
    b = list(a)
    for _ in range(rng.randrange(6)):
        b[rng.randrange(len(b)) : rng.randrange(len(b) + 1)] = [rng.randrange(8)] * rng.randrange(3)
        b = b or [1]
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    n = lcs(a, b)
    assert nd.aligned(x, y, len(a) + len(b)) == n
    true = n / (len(a) + len(b) - n)
    assert (nd.similarity(x, y) >= 0.8) == (true >= 0.8) and (true < 0.8 or abs(nd.similarity(x, y) - true) < 1e-12)


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    texts = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 12])):
            c = list(base)
            for _ in range(rng.randrange(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            texts.append(" ".join(c))
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(60)) for _ in range(40)]
    texts += [None, None, "", "", "...", "Short text", "short TEXT", "a b c d e f g h i", "a b c d e f g h i j", "Word " * 500, "Word " * 480]
    return texts


def brute(texts):
    distinct = list(dict.fromkeys(texts))
    root = {t: t for t in distinct}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if alike(a, b):
                root[find(a)] = find(b)
    least: dict = {}
    for i, t in enumerate(texts):
        least.setdefault(find(t), i)
    return [least[find(t)] for t in texts]


def test_classes(spark):
    texts = corpus()
    want = brute(texts)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)
    named = nd.classes(docs).collect()
    assert {r.doc_id: r.class_id for r in named} == dict(enumerate(want))
    sizes = Counter(want)
    assert all(r.class_size == sizes[r.class_id] for r in named)
    again = docs.union(docs.where("doc_id in (0, 3)"))
    kept = nd.keep_one(again)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_a_family_without_a_centre_loses_nothing(spark, monkeypatch):
    """Chains of edits, where only neighbours are similar, and a family of copies that mostly are not."""
    monkeypatch.setattr(nd, "ROUNDS", 1)
    monkeypatch.setattr(nd, "DEALT", 3)
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(5000)]
    t = [rng.choice(vocab) for _ in range(150)]
    texts = []
    for _ in range(14):
        texts.append(" ".join(t))
        t[rng.randrange(150)] = rng.choice(vocab)
    base = [rng.choice(vocab) for _ in range(150)]
    for _ in range(25):
        c = list(base)
        for _ in range(rng.randrange(1, 6)):
            c[rng.randrange(150)] = rng.choice(vocab)
        texts.append(" ".join(c))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id: r.class_id for r in nd.classes(docs).collect()} == dict(enumerate(brute(texts)))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "lone text here", "x", 1), (None, "lone text here", "x", 1), (5, "other one", "x", 1)], DOCS)
    assert Counter(r.class_id for r in nd.classes(docs).collect()) == {None: 2, 5: 1}
    assert nd.keep_one(docs).count() == 2
    assert nd.classes(docs.limit(0)).count() == 0
    assert nd.keep_one(docs.limit(0)).count() == 0


def test_clashing_names_and_very_long_texts(spark):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(3000)]
    long = [rng.choice(vocab) for _ in range(60_000)]
    near = [*long[:20_000], "edit", *long[20_001:]]
    texts = [" ".join(long), " ".join(near), "x" * 500_000, " ".join(reversed(long))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", *(f"1 AS {c}" for c in ("node", "comp", "id", "kept", "n", "doc", "bits", "keys", "bucket")))
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 2, 3}


def test_bitmap_bounds_the_alignment():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)
        b = np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64)])
        alone = sum(int(x).bit_count() for x in (nd.bitmap(a) & ~nd.bitmap(b)).view(np.uint64))
        assert nd.aligned(a, b, 1000) <= len(a) - alone


def test_keep_one_of_each_component(spark):
    shared = [(7, "first text of its own", "x", 1), (7, "quite another one here", "x", 1)]
    single = [(None, "a text without an id", "x", 1)]
    docs = spark.createDataFrame([*shared, *single, (9, "last of all", "x", 1), (9, "last of all", "x", 1)], DOCS)
    kept = Counter((r.doc_id, r.text) for r in nd.keep_one(docs).collect())
    assert kept == Counter({(i, t): 1 for i, t, _, _ in shared + single} | {(9, "last of all"): 1})


def test_short_pairs_share_a_key():
    """Texts of 8 and 9 words share 4 of 5 shingles."""
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(3000):
        s = rng.integers(0, 2**63, 5).astype(np.uint64)
        missed += not set(nd.bucket_keys(s).tolist()) & set(nd.bucket_keys(s[:4]).tolist())
    assert missed == 0
