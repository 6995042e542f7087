"""Classifiers on held-out rows, the language model against plain counts, SentencePiece round trips."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import features, pitman_yor, quality, sentencepiece_bpe, toxicity
from marlstone.llm.linear import Logistic, Sparse, best_threshold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, style string"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(0)
    words = [a + b for a in ("ka", "lo", "mi", "ten", "sur") for b in ("r", "na", "sel", "dom", "", "pi", "gra")]
    docs, labels = [], []
    for i in range(700):
        toxic, junk = i % 7 == 0, i % 5 == 0
        t = prose(rng, rng.randrange(20, 200), words)
        if junk:
            t = " | ".join(w + "###" for w in t.split())
        if toxic:
            w = t.split(" ")
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vilefool", "nastything", "hatefulword"]))
            t = " ".join(w)
        docs.append((i, t, "en", f"s{i % 3}", len(t), "x"))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(5002, ("kar lona " * 100_000) + "vilefool hatefulword nastything vilefool", "en", "s0", 9, "x"), (5000, None, None, None, None, "x"), (5001, "", "en", "s0", 0, "x"), (0, docs[0][1], "en", "s0", 3, "x"), (None, "plain words", "en", "s1", 11, "x")]
    labels += [(3, None, 0), (9999, 1, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:500] + labels[-2:], "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark, labelled):
    docs, some, labels = labelled
    chain = toxicity.train(docs, some)
    cut = chain.thresholds[1]
    found = {r.doc_id: r.p_toxic >= cut for r in toxicity.score(docs, chain).collect()}
    assert sum(found[i] == bool(t) for i, _, t in labels[500:700]) >= 197  # these were not learned from
    kept = toxicity.reject(docs, some)
    assert kept.columns == docs.columns and {5000, 5001} <= {r.doc_id for r in kept.collect()}
    assert toxicity.reject(docs, some.limit(0)).count() == docs.count()
    assert toxicity.reject(docs.limit(0), some).count() == 0


def test_toxicity_where_low_quality_is_missing():
    """After the quality stage: the first link's probabilities then tell folds apart, and must not move the second."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        n, k = 3000, 300
        y = (rng.random(n) < 0.12).astype(float)
        rows = [sorted({*rng.integers(60, k, 20), *(rng.integers(0, 60, rng.integers(1, 4)) if t else [])}) for t in y]
        dense, sparse, folds = rng.normal(size=(n, 3)), Sparse(rows, k), rng.choice(5, n, p=[0.1, 0.15, 0.2, 0.25, 0.3])
        labels = np.column_stack([np.zeros(n), y])
        models, cuts, out = toxicity.fit_chain(dense, sparse, labels, folds, [np.ones(k, bool)] * 6)
        p = toxicity.Chain(["low_quality", "toxic"], [], models, cuts).predict(dense, sparse)
        as_trained = models[1].predict(np.column_stack([dense, out[:, 0]]), sparse)
        assert np.abs(p[:, 1] - as_trained).max() < 0.01
        assert (p[y == 1, 1] >= cuts[1]).mean() >= (out[y == 1, 1] >= cuts[1]).mean()  # what it has seen it finds as well as what it has not


def test_quality(spark, labelled):
    docs, some, labels = labelled
    model = quality.train(docs, some)
    assert model.held_out["both"] >= 0.97
    got = {r.doc_id: r.p_quality >= model.threshold for r in quality.score(docs, model).collect()}
    assert sum(got[i] == bool(q) for i, q, _ in labels[500:700]) >= 195
    kept = quality.reject(docs, some)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert quality.reject(docs, some.limit(0)).count() == docs.count()
    assert quality.reject(docs.limit(0), some).count() == 0


def test_words_alone_tell_quality(spark):
    """Texts of one style, whose words differ: the text view must see the words."""
    rng = random.Random(4)
    good, bad = [f"g{a}{b}" for a in "aeiou" for b in "klmnp"], [f"b{a}{b}" for a in "aeiou" for b in "klmnp"]
    both = [f"c{a}{b}" for a in "aeiou" for b in "klmnp"]
    rows = [(i, prose(rng, 60, both + (good if i % 2 else bad)[:6]), "en", "s", 1, "x") for i in range(400)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2, 0) for i in range(250)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.p_quality >= model.threshold for r in quality.score(docs, model).collect()}
    assert sum(got[i] == bool(i % 2) for i in range(250, 400)) >= 140


def test_names_that_clash_with_scores(spark, labelled):
    docs, some, _ = labelled
    clash = docs.withColumn("p_quality", F.lit("q")).withColumn("p_toxic", F.lit("t")).withColumn("fold", F.lit(1)).withColumn("held", F.lit(2)).withColumn("has", F.lit(3)).withColumn("quality", F.lit("x")).withColumn("toxic", F.lit("y"))
    for module in (quality, toxicity):
        kept = module.reject(clash, some)
        assert kept.columns == clash.columns and kept.select("doc_id").exceptAll(module.reject(docs, some).select("doc_id")).count() == 0
        assert {tuple(r) for r in kept.select("p_quality", "p_toxic", "quality").distinct().collect()} == {("q", "t", "x")}


def test_terms_of_a_fold_do_not_see_it(spark):
    rows = [(f"always f{f} " + ("mark" if y else "plain") + f" only{f}x" * y, f, y) for f in range(3) for y in (0, 1) for _ in range(6)]
    sample = spark.createDataFrame(rows, "text string, fold int, toxic int")
    chosen = features.choose_terms(sample, ["toxic"], 3, 100)
    assert len(chosen) == 4 and all(f"only{f}x" not in " ".join(chosen[f]) and "mark" in chosen[f] for f in range(3)) and "f" in chosen[3]


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(0)

    class V(quality.Views):
        def __init__(self, y):
            self.dense = (y + rng.normal(0, 0.3, len(y)))[:, None]
            self.sparse = Sparse([[] for _ in y], 0)
            self.page_dense = (y + rng.normal(0, 0.3, len(y)))[:, None]
            self.page_sparse = Sparse([[] for _ in y], quality.BINS)

    y = rng.integers(0, 2, 60).astype(float)
    known, pool, fresh_y = V(y), V(rng.integers(0, 2, 500).astype(float)), rng.integers(0, 2, 500).astype(float)
    fresh = V(fresh_y)
    model = quality.co_train(known, y, np.arange(60) % 2 == 0, pool)
    assert ((model.predict(fresh.dense, fresh.sparse, fresh.page_dense, fresh.page_sparse) >= 0.5) == fresh_y).mean() > 0.95


def test_logistic_and_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    m = Logistic(l2=0.1).fit(x, y)
    assert abs(m.v[0] / m.scale[0] - 2) < 0.3 and abs(m.v[2]) < 0.2
    p = m.predict(x)
    assert abs(p.mean() - y.mean()) < 1e-3  # the intercept's condition at the optimum
    y2, p2 = np.array([0, 0, 1, 1.0]), np.array([0.1, 0.4, 0.6, 0.9])
    assert 0.4 < best_threshold(p2, y2) < 0.6
    assert best_threshold(p2, np.zeros(4)) > 1


def plain_tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


@pytest.mark.parametrize("bucket", [1 << 30, 1500])
def test_language_model(spark, bucket):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    chain = {w: rng.sample(vocab, 4) for w in vocab}
    texts = []
    for _ in range(150):
        w, t = rng.choice(vocab), []
        for _ in range(rng.randrange(5, 60)):
            t.append(w)
            w = "The" if rng.random() < 0.3 else rng.choice(chain.get(w, vocab))
        texts.append(" ".join(t))
    texts += [None, "", "unseen words\tonly here", texts[0]]
    docs = spark.createDataFrame([*((i, t, "en", "s", 1, "x") for i, t in enumerate(texts)), (3, texts[3], "en", "s", 1, "x"), (None, "w1 w2", "en", "s", 1, "x")], DOCS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = Counter(w for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for w in plain_tokens(t))
    n, v = sum(train.values()), len(train)
    got = pitman_yor.score(docs, bucket_bytes=bucket).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by_text = dict(rows)
    ours = base = 0
    for r in got:
        toks = plain_tokens(by_text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks), sum(train[w] > 0 for w in toks), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in toks), rel_tol=1e-9)
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2:
            ours, base = ours + r.score, base + r.base_score
    assert ours > 0.8 * base  # log probabilities: the contexts tell much here
    assert pitman_yor.score(docs.limit(0)).count() == 0


def toy():
    rng = np.random.default_rng(2)
    words, contexts = 30, 20
    pairs = np.unique(rng.integers(0, words * contexts, 300))
    return words, contexts, pairs // contexts, pairs % contexts, rng.integers(1, 90, len(pairs))


def test_states_are_distributions():
    words, contexts, word, context, c = toy()
    t = np.minimum(c, np.random.default_rng(1).integers(1, 5, len(c)))
    customers, tables, count = np.bincount(word, t, words), np.bincount(context, t, contexts), np.bincount(context, c, contexts)
    used = int((customers > 0).sum())
    total = pitman_yor.Totals(int(c.sum()), used, 0.7, 0.6, int(t.sum()))
    # every word after every context, and the unknown word, which stands last
    w, u = np.divmod(np.arange((words + 1) * contexts), contexts)
    full_c, full_t = np.zeros(len(w), int), np.zeros(len(w), int)
    full_c[word * contexts + context], full_t[word * contexts + context] = c, t
    known = np.append(customers > 0, False)
    p = pitman_yor.predictive(full_c, full_t, w, u, known, np.append(customers, 0), count, tables, total)
    p[(w < words) & ~known[w]] = 0  # these are the unknown word
    assert np.allclose(np.bincount(u, p), 1)


def test_tables_follow_their_distribution():
    """Sampled numbers of tables against the exact conditional, and its limit law at the end of the tabulated range."""
    d, rng = 0.6, np.random.default_rng(0)
    s = pitman_yor.log_stirling(d)
    assert math.isclose(math.exp(s[3, 2]), 3 * (1 - d)) and math.isclose(math.exp(s[3, 1]), (1 - d) * (2 - d))
    for a in (0.05, 1.0, 30.0):
        t = np.arange(1, 7)
        w = np.exp(s[6, 1:7]) * a**t
        got = pitman_yor.sample_tables(np.full(40_000, 6), np.full(40_000, a), d, s, rng)
        assert abs(got.mean() - (t * w).sum() / w.sum()) < 0.03
    n = pitman_yor.STIRLING
    for a in (0.5, 5.0, 100.0, 2000.0):
        t = np.arange(1, n + 1)
        w = s[n, 1:] + t * math.log(a)
        w = np.exp(w - w.max())
        w /= w.sum()
        mean, variance = (t * w).sum(), (t * t * w).sum() - (t * w).sum() ** 2
        m, v = pitman_yor.limit_law(np.array([float(n)]), np.array([a]), d)
        assert abs(m[0] + 1 - mean) < 0.02 * mean and abs(v[0] - variance) < 0.02 * variance + 0.1
        got = pitman_yor.sample_tables(np.full(20_000, n + 1), np.full(20_000, a), d, s, rng)
        assert abs(got.mean() - mean) < 0.03 * mean and abs(got.var() - variance) < 0.1 * variance + 0.1


def test_gammas():
    keys = np.arange(200_000, dtype=np.uint64)
    for shape in (0.3, 1.5, 40.0):
        x = pitman_yor.gamma(np.full(len(keys), shape), keys, 3)
        assert abs(x.mean() / shape - 1) < 0.02 and abs(x.var() / shape - 1) < 0.04
    assert (pitman_yor.gamma(np.full(3, 2.0), keys[5:8], 9) == pitman_yor.gamma(np.full(50, 2.0), keys[:50], 9)[5:8]).all()


def plain_gibbs(word, context, c, words, contexts, d1, d0, sweeps, rng):
    """Customer by customer: each leaves its table and sits down anew. Mean tables of the contexts, mean customers of the words in the parent."""
    seats = [[[int(n)] for n in [x]][0] for x in c]  # the sizes of each pair's tables
    tables, customers = np.bincount(context, minlength=contexts), np.bincount(word, minlength=words)
    sums = [np.zeros(contexts), np.zeros(words)]
    for k in range(sweeps):
        for i, (w, u) in enumerate(zip(word, context)):
            for _ in range(c[i]):
                own = seats[i]
                left = rng.choices(range(len(own)), own)[0]
                own[left] -= 1
                if not own[left]:
                    own.pop(left)
                    tables[u], customers[w] = tables[u] - 1, customers[w] - 1
                new = (1 + d1 * tables[u]) * (customers[w] - d0) / (1 + customers.sum()) if customers[w] else 1.0
                at = rng.choices(range(len(own) + 1), [*(n - d1 for n in own), new])[0]
                if at == len(own):
                    own.append(1)
                    tables[u], customers[w] = tables[u] + 1, customers[w] + 1
                else:
                    own[at] += 1
        if k >= sweeps // 10:
            sums[0] += tables
            sums[1] += customers
    return [x / (sweeps - sweeps // 10) for x in sums]


def test_sweeps_against_plain_gibbs():
    word, context, c = np.array([0, 1, 2, 0, 1, 3, 0, 2]), np.array([0, 0, 0, 1, 1, 1, 2, 2]), np.array([5, 2, 1, 8, 3, 1, 2, 4])
    d1, d0 = 0.6, 0.4
    want = plain_gibbs(word, context, c, 4, 3, d1, d0, 4000, random.Random(0))
    ids, stirling = np.arange(2, 6), pitman_yor.log_stirling(d1)
    t, sums = np.ones(len(c), int), [np.zeros(3), np.zeros(4)]
    for k in range(6000):
        tables, customers = np.bincount(context, t, 3), np.bincount(word, t, 4)
        total = pitman_yor.Totals(int(c.sum()), 4, d1, d0, int(t.sum()), pitman_yor.gamma_sum(ids, customers, d0, k) * pitman_yor.GAMMA_UNIT)
        t = pitman_yor.draw(c, word, context, ids, np.arange(3), tables, customers, total, k, np.random.default_rng(k), stirling)
        if k >= 600:
            sums[0] += np.bincount(context, t, 3)
            sums[1] += np.bincount(word, t, 4)
    for x, y in zip(sums, want):
        assert np.abs(x / 5400 / y - 1).max() < 0.05, (x / 5400, y)


def test_sentencepiece(spark):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    texts = ["a  b", "  a", "a ", "a\n\nb", "x \n y", "▁x ▁▁", "é.,", "中文🙂", "\n", "a\nb", "<s></s><0x41>", "", None, "\x00a\x01b", " ", "tab\tq", "   ", "w" * 300 + " x", "the quick brown foxes are jumping over lazy dogs " * 200]
    docs = spark.createDataFrame([*((i, t, "en", "s", 1, "x") for i, t in enumerate(texts)), (None, "no id", "en", "s", 1, "x"), (0, texts[0], "en", "s", 1, "x")], DOCS)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for dropout in (0.0, 0.1, 0.6):
        coded = sentencepiece_bpe.encode(docs, path, dropout)
        both = sentencepiece_bpe.decode(coded, path).collect()
        assert all(r.decoded == r.text for r in both) and coded.columns == [*docs.columns, "pieces"]
        if dropout == 0:
            assert all(r.pieces == sp.encode(r.text) for r in both if r.text and "▁" not in r.text and not re.search("[\x00\x01\t<]", r.text))
        again = {(r.doc_id, r.text): r.pieces for r in sentencepiece_bpe.encode(docs.repartition(3), path, dropout).collect()}
        assert all(again[r.doc_id, r.text] == r.pieces for r in both)
    ways = {tuple(x) for x in np.array_split([r for r in both if r.doc_id == 18][0].pieces, 200)}
    assert len(ways) > 1
    other = sentencepiece_bpe.encode(docs.where("doc_id = 18"), path, 0.1, seed=2).first().pieces
    assert other != sentencepiece_bpe.encode(docs.where("doc_id = 18"), path, 0.1, seed=1).first().pieces
    assert sentencepiece_bpe.encode(docs.limit(0), path).count() == 0


def test_sentencepiece_every_occurrence_is_cut_on_its_own(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece_bpe.load(path)
    one, many = "a", "understanding"
    docs = spark.createDataFrame([(i, " ".join([w] * 2000), "en", "s", 1, "x") for i, w in enumerate((one, many))], DOCS)
    pieces = {r.doc_id: r.pieces for r in sentencepiece_bpe.encode(docs, path, 0.1).collect()}
    assert abs((len(pieces[0]) - 2000) / 2000 - 0.1) < 0.03  # its one merge is skipped at the rate asked for
    ways, cut, left = set(), [], b""
    for x in pieces[1]:
        cut, left = [*cut, x], left + model.bytes_of[x]
        if left == b" " + many.encode():
            ways.add(tuple(cut))
            cut, left = [], b""
    assert not cut and len(ways) > 20


def plain_agenda(model, unit, key, limit):
    """Merge-dropout as its definition says it: look at all pairs for the best candidate, again and again."""
    symbols, skipped = [(i, c) for i, c in enumerate(unit)], set()
    while True:
        found = []
        for x, (a, b) in enumerate(zip(symbols, symbols[1:])):
            made = a[1] + b[1]
            if made in model.ids and a[1] in model.ids and b[1] in model.ids and (a[0], made) not in skipped:
                found.append((-model.scores[model.ids[made]], model.ids[made], a[0], x, made))
        if not found:
            break
        _, _, start, x, made = min(found)
        mixed = key + sentencepiece_bpe.PHI * (start + 1) + sentencepiece_bpe.mix(np.array([model.of_rank.index(model.ids[made])], np.uint64))[0].item()
        if sentencepiece_bpe.mix(np.array([mixed % 2**64], np.uint64))[0] < limit:
            skipped.add((start, made))
        else:
            symbols[x : x + 2] = [(start, made)]
    return [i for _, s in symbols for i in ([model.ids[s]] if s in model.ids else [model.byte_ids[b] for b in s.replace(sentencepiece_bpe.LITERAL, "\u2581").encode()])]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_sentencepiece_against_plain_agenda(monkeypatch, dropout):
    P = pytest.importorskip("public_tokenizers")
    import xxhash

    model = sentencepiece_bpe.load(P.path("piece_bpe_32k.model"))
    words = ["a", "understanding", "played", "中" + sentencepiece_bpe.LITERAL, "internationalisation", "🙂x", "ab" * 25, "\nline"]
    units = [w if w[0] == "\n" else sentencepiece_bpe.SPACE + w for w in words]
    trees = sentencepiece_bpe.Trees(model, dropout, 3)
    rng = np.random.default_rng(0)
    for size in (3, 300, 300):  # the trees grow, and are dropped once
        codes, docs = rng.integers(0, len(units), size), rng.integers(0, 2**63, size).astype(np.uint64)
        pool, ends, at = trees.segment(units, codes, docs)
        for i in range(0, size, 2):
            key = (xxhash.xxh64_intdigest(units[codes[i]].encode("utf-8", "surrogatepass"), 3) + int(docs[i])) % 2**64
            assert pool[ends[at[i]] : ends[at[i] + 1]].tolist() == plain_agenda(model, units[codes[i]], key, trees.limit)
        monkeypatch.setattr(sentencepiece_bpe, "MAX_NODES", 400)


def test_sentencepiece_very_long(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("piece_bpe_32k.model")
    texts = ["wordwithoutspaces" * 60_000, "many short words " * 60_000, "\n" * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pieces", F.lit("given")).withColumn("Decoded", F.lit(1))
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, path), path)
    assert both.columns == ["doc_id", "text", "pieces", "decoded"]  # the clashing columns gave way
    assert {r.doc_id: r.decoded for r in both.collect()} == dict(enumerate(texts))
    assert sentencepiece_bpe.round_trip(docs, path).exceptAll(both).count() == 0
