"""Neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(vectors, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids.tolist()], np.float32).astype(np.float64)
    out = {}
    for q in ids[ids % 20 == 0].tolist():
        s = np.zeros(len(ids))
        for j in range(x.shape[1]):
            s += x[ids.tolist().index(q), j] * x[:, j]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


@pytest.mark.parametrize("few", [4096, 100])
def test_recall_and_scores(spark, monkeypatch, few):
    monkeypatch.setattr(ann, "FEW", few)
    monkeypatch.setattr(ann, "CHUNK", 300)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, size=(1500, 1))
    x[700:1000] = x[40]  # a large group of copies
    vectors = {i: x[i].astype(np.float32).tolist() for i in range(1500)}
    odd = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [None, *[1.0] * 15], 0), (2060, [float("nan")] * 16, 0), (2080, [float("inf")] * 16, 0), (2100, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame([*((i, v, 0) for i, v in vectors.items()), *odd, (40, vectors[40], 0)], SCHEMA)
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = brute(vectors, 20)
    assert set(got) == set(want)
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda t: (-t[1], t[0])) and len(rows) == 20
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = {q: dict(brute(vectors, 2000)[q]) for q in list(want)[:3]}
    assert all(s == exact[q][v] for q in exact for v, s in got[q])
    assert len({v for v, _ in got[40]} & {v for v, _ in want[40]}) >= 18  # beside a large group of copies


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0), (2, [-1.0, 1.0], 0)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert ann.search(df.limit(1), F.col("vec_id") % 20 == 0, 20).count() == 0


def recall(got, ids, x, k=20):
    """The mean share of the k best of brute force that are found; got: {query: ids}."""
    at = {i: n for n, i in enumerate(ids)}
    shares = []
    for q, found in got.items():
        s = x[at[q]] @ x.T
        s[at[q]] = -np.inf
        shares.append(len({ids[i] for i in np.argsort(-s, kind="stable")[:k]} & found) / k)
    return float(np.mean(shares))


def searched(spark, x, k=20):
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], SCHEMA)
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


@pytest.mark.parametrize("noise", [1e-4, 1e-3, 1e-2])
def test_near_copies(spark, noise):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64))
    x[1000:1500] = x[1000] + noise * rng.normal(size=(500, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(np.float64)
    got = searched(spark, x)
    assert len(got) == 100 and all(len(v) == 20 for v in got.values())
    assert recall(got, list(range(2000)), x) == 1.0  # one list, all of it scored exactly


def test_recall_of_the_whole_search(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 600)  # centroids fit such a sample better than they fit the other vectors
    x = np.random.default_rng(2).normal(size=(12000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(np.float64)
    got = searched(spark, x)
    assert len(got) == 600 and all(len(v) == 20 for v in got.values())
    assert recall(got, list(range(12000)), x) >= 0.965
