"""Toxicity by a classifier chain.

Categories are predicted one after another, each by a linear model over the words of a text, numbers
of its style, and the probabilities of the categories before it. While training, those earlier
probabilities are out-of-fold predictions, so a later model sees them as good as they will be: for
each fold both the model and its terms come from the other folds. They enter the later models unscaled:
where a category is all but missing, the folds' probabilities differ by next to nothing, and the model
of all rows gives others; standardised, that difference would outweigh the words.

The models are fitted on the driver on at most ``TRAIN_ROWS`` labelled documents; terms are chosen on
the same sample by their log-odds. Every document is scored, over its whole text.

Defined cases: null and empty texts have no terms; without labels, or with labels of one kind only, a
category's probability is its smoothed rate and nothing is rejected; repeated rows score alike;
further columns are kept, but one with the name of a probability gives way to it in ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common, features
from marlstone.llm.linear import Logistic, Sparse, best_threshold

TRAIN_ROWS = 12_000
MAX_TERMS = 2_000
FOLDS = 5
#: The label columns are quality and toxic: poor quality is the first link, toxicity the second.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


@dataclass
class Chain:
    categories: list[str]
    terms: list[str]
    models: list[Logistic]
    thresholds: list[float]

    def predict(self, dense: np.ndarray, sparse: Sparse) -> np.ndarray:
        """A column of probabilities for each category."""
        probs = np.zeros((len(dense), 0))
        for m in self.models:
            probs = np.column_stack([probs, m.predict(np.column_stack([dense, probs]), sparse)])
        return probs


def fit_chain(dense: np.ndarray, sparse: Sparse, labels: np.ndarray, folds: np.ndarray, usable: list[np.ndarray]) -> tuple[list[Logistic], list[float], np.ndarray]:
    """Models, thresholds of the best out-of-fold F1, and the out-of-fold probabilities. usable: which terms each fold's model may use, and last that of all."""
    by_fold = [sparse.only(u) for u in usable[:-1]]
    whole = sparse.only(usable[-1])
    models, cuts, out = [], [], np.zeros((len(dense), 0))
    for c in range(labels.shape[1]):
        x, y, p = np.column_stack([dense, out]), labels[:, c], np.zeros(len(dense))
        for f in range(FOLDS):
            test, train = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            if len(test):
                p[test] = Logistic(unscaled=c).fit(x[train], y[train], by_fold[f].take(train)).predict(x[test], by_fold[f].take(test))
        models.append(Logistic(unscaled=c).fit(x, y, whole))
        cuts.append(best_threshold(p, y) if len(set(y.tolist())) == 2 else 1.1)
        out = np.column_stack([out, p])
    return models, cuts, out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> Chain:
    categories = CATEGORIES if categories is None else categories
    names = list(categories)
    sample = features.labelled_sample(docs.select("doc_id", "text"), labels, categories, TRAIN_ROWS).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)))
    sample = common.materialise(sample.select("doc_id", "text", "fold", *names), "labelled")
    chosen = features.choose_terms(sample, names, FOLDS, MAX_TERMS)
    every = list(dict.fromkeys(t for own in reversed(chosen) for t in own))  # those of all come first

    def make():
        index = features.TermIndex(every)

        def compute(b: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = b.column("text").to_pylist()
            return {"has": pa.array([index.of(t) for t in texts], pa.list_(pa.int32())), "style": pa.array([features.style(t) for t in texts], pa.list_(pa.float64()))}

        return compute

    common.frugal()  # the driver's Python too
    rows = features.with_columns(sample, make, "has array<int>, style array<double>").select("fold", "has", "style", *names).toPandas()
    dense = np.array(rows["style"].tolist(), np.float64).reshape(len(rows), features.N_STYLE)
    usable = [np.isin(np.array(every, object), np.array(own, object)) if own else np.zeros(len(every), bool) for own in chosen]
    models, cuts, _ = fit_chain(dense, Sparse(rows["has"].tolist(), len(every)), rows[names].to_numpy(np.float64).reshape(len(rows), len(names)), rows["fold"].to_numpy(), usable)
    for m in models:
        m.w = m.w[: len(chosen[-1])].copy()
    del rows, dense
    common.give_back()
    return Chain(names, chosen[-1], models, cuts)


def score(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """The rows of ``docs`` with a probability column for each category."""
    model = docs.sparkSession.sparkContext.broadcast(chain)  # at most MAX_TERMS terms and weights

    def make():
        own = model.value
        index = features.TermIndex(own.terms)

        def compute(b: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = b.column("text").to_pylist()
            dense = np.array([features.style(t) for t in texts], np.float64).reshape(len(texts), features.N_STYLE)
            probs = own.predict(dense, Sparse([index.of(t) for t in texts], len(own.terms)))
            return {prefix + c: pa.array(probs[:, i]) for i, c in enumerate(own.categories)}

        return compute

    return features.with_columns(docs, make, ", ".join(f"`{prefix}{c}` double" for c in chain.categories))


def reject(docs: DataFrame, labels: DataFrame, category: str = "toxic") -> DataFrame:
    """The documents that the chain does not find toxic, columns unchanged."""
    chain = train(docs, labels)
    cut, prefix = chain.thresholds[chain.categories.index(category)], common.unused(docs, "p_")
    return score(docs, chain, prefix).where(F.col(f"`{prefix}{category}`") < cut).select(*(F.col(f"`{c}`") for c in docs.columns))
