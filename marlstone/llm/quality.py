"""Quality by co-training of two views.

One classifier sees the text's content (its words, and numbers of its style), the other the page's metadata
(source, language, recorded length). Over rounds each labels those documents of an unlabelled pool
of which it is most sure, for the other to train on. Then each view is calibrated on held-out labels
(Platt), and a linear model on both calibrated log-odds, fitted on the same held-out labels,
combines them; a view that tells little so gets little weight.

Fitting takes at most ``TRAIN_ROWS`` labelled and ``POOL_ROWS`` unlabelled documents, chosen by a
hash of doc_id. Every document is scored, over its whole text.

Defined cases: null texts are empty; null metadata is a value of its own; without labels of both
kinds the probability is the smoothed rate and nothing is rejected; repeated rows score alike;
further columns are kept, but one with the name of the probability gives way to it in ``score``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common, features
from marlstone.llm.linear import Logistic, Sparse, logit

TRAIN_ROWS = 12_000
POOL_ROWS = 6_000
#: Words, and their beginnings, that the text view knows; chosen by log-odds on labelled rows that are not held out.
MAX_TERMS = 1_000
ROUNDS = 3
#: A pseudo-label needs this much confidence; a round takes this share of the pool at most.
SURE, SHARE = 0.98, 0.2
BINS = 256
METADATA = ("source", "lang", "n_chars")


def metadata(source, lang, n_chars) -> tuple[list[int], list[float]]:
    """Hashed categories and numbers of one row's metadata."""
    cats = [zlib.crc32(f"{k}={v}".encode()) % BINS for k, v in (("source", source), ("lang", lang), ("both", f"{source}/{lang}"))]
    known = n_chars is not None and n_chars == n_chars
    return sorted(set(cats)), [float(np.log1p(max(0.0, float(n_chars)))) if known else 0.0, float(known)]


@dataclass
class CoTrained:
    text: Logistic
    page: Logistic
    platt: list[Logistic]
    combined: Logistic
    threshold: float
    held_out: dict[str, float]
    terms: list[str] = field(default_factory=list)

    def predict(self, dense: np.ndarray, sparse: Sparse, page_dense: np.ndarray, page_sparse: Sparse) -> np.ndarray:
        views = [self.text.margin(dense, sparse), self.page.margin(page_dense, page_sparse)]
        calibrated = [logit(p.predict(v[:, None])) for p, v in zip(self.platt, views)]
        return self.combined.predict(np.column_stack(calibrated))


class Views:
    """Both views of some rows."""

    def __init__(self, rows: pd.DataFrame, n_terms: int):
        self.dense = np.array(rows["style"].tolist(), np.float64).reshape(len(rows), features.N_STYLE)
        self.sparse = Sparse(rows["has"].tolist(), n_terms)
        pages = [metadata(*x) for x in zip(*(rows[c] for c in METADATA))]
        self.page_dense = np.array([x[1] for x in pages], np.float64).reshape(len(rows), 2)
        self.page_sparse = Sparse([x[0] for x in pages], BINS)

    def of(self, view: int, index: np.ndarray | None = None) -> tuple[np.ndarray, Sparse]:
        """The features of the text view (0) or of the page view (1)."""
        dense, sparse = (self.dense, self.sparse) if view == 0 else (self.page_dense, self.page_sparse)
        return (dense, sparse) if index is None else (dense[index], sparse.take(index))


def stacked(a: tuple[np.ndarray, Sparse], b: tuple[np.ndarray, Sparse]) -> tuple[np.ndarray, Sparse]:
    both = Sparse([], a[1].n)
    both.row, both.col, both.n_rows = np.concatenate([a[1].row, b[1].row + a[1].n_rows]), np.concatenate([a[1].col, b[1].col]), a[1].n_rows + b[1].n_rows
    return np.concatenate([a[0], b[0]]), both


def co_train(known: Views, y: np.ndarray, held: np.ndarray, pool: Views) -> CoTrained:
    """known: labelled rows with labels y, of which ``held`` serve calibration only; pool: unlabelled rows."""
    train = np.flatnonzero(~held)
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels for the text view and for the page view
    for r in range(ROUNDS + 1):
        models = []
        for view in (0, 1):
            index = np.array(list(given[view]), np.int64)
            dense, sparse = stacked(known.of(view, train), pool.of(view, index))
            models.append(Logistic().fit(dense, np.concatenate([y[train], np.array(list(given[view].values()))]), sparse))
        if r == ROUNDS or not len(pool.dense):
            break
        for view, m in enumerate(models):
            p = m.predict(*pool.of(view))
            confident = np.maximum(p, 1 - p)
            order = [i for i in np.argsort(-confident, kind="stable")[: int(SHARE * len(p)) + 1] if confident[i] >= SURE]
            for i in order:
                given[1 - view].setdefault(int(i), float(p[i] >= 0.5))
    test = np.flatnonzero(held)
    margins = [m.margin(*known.of(view, test)) for view, m in enumerate(models)]
    platt = [Logistic(l2=1e-3).fit(m[:, None], y[test]) for m in margins]
    calibrated = np.column_stack([logit(p.predict(m[:, None])) for p, m in zip(platt, margins)])
    combined = Logistic(l2=1e-2).fit(calibrated, y[test])
    both_kinds = len(set(y[test].tolist())) == 2 and len(set(y[train].tolist())) == 2
    out = CoTrained(models[0], models[1], platt, combined, 0.5 if both_kinds else -1.0, {})
    if len(test):
        out.held_out = {"text": float(((margins[0] > 0) == y[test]).mean()), "page": float(((margins[1] > 0) == y[test]).mean()), "both": float(((combined.predict(calibrated) >= 0.5) == y[test]).mean())}
    return out


def _seen(index: features.TermIndex, texts: list[str | None]) -> dict[str, pa.Array]:
    return {"style": pa.array([features.style(t) for t in texts], pa.list_(pa.float64())), "has": pa.array([index.of(t) for t in texts], pa.list_(pa.int32()))}


def _viewed(rows: DataFrame, chosen: list[str]) -> pd.DataFrame:
    def make():
        index = features.TermIndex(chosen)
        return lambda b: _seen(index, b.column("text").to_pylist())

    return features.with_columns(rows, make, "style array<double>, has array<int>").drop("text").toPandas()


def train(docs: DataFrame, labels: DataFrame) -> CoTrained:
    base = docs.select("doc_id", "text", *METADATA)
    sample = features.labelled_sample(base, labels, {"quality": "quality"}, TRAIN_ROWS).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0)
    sample = common.materialise(sample, "labelled")
    chosen = features.choose_terms(sample.where("not held").withColumn("fold", F.lit(0)), ["quality"], 0, MAX_TERMS)[-1]
    common.frugal()  # the driver's Python too
    known = _viewed(sample, chosen)
    unlabelled = common.hash_sample(docs.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").distinct(), "doc_id", POOL_ROWS)
    pool = _viewed(base.join(F.broadcast(unlabelled), "doc_id").dropDuplicates(["doc_id"]), chosen)
    model = co_train(Views(known, len(chosen)), known["quality"].to_numpy(np.float64), known["held"].to_numpy(bool), Views(pool, len(chosen)))
    model.terms = chosen
    del known, pool
    common.give_back()
    return model


def score(docs: DataFrame, model: CoTrained, name: str = "p_quality") -> DataFrame:
    """The rows of ``docs`` with the probability that they are of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms, and weights

    def make():
        own = shared.value
        index = features.TermIndex(own.terms)

        def compute(b: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = pd.DataFrame({c: b.column(c).to_pylist() for c in METADATA}, dtype=object)
            for c, values in _seen(index, b.column("text").to_pylist()).items():
                rows[c] = values.to_pylist()
            v = Views(rows, len(own.terms))
            return {name: pa.array(own.predict(v.dense, v.sparse, v.page_dense, v.page_sparse))}

        return compute

    return features.with_columns(docs, make, f"`{name}` double")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of good quality, columns unchanged."""
    model, name = train(docs, labels), common.unused(docs, "p_quality")
    return score(docs, model, name).where(F.col(f"`{name}`") >= model.threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
