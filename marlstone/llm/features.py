"""Features of whole texts, shared by the classifiers, and their bounded training samples."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import common

LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 8)
SYMBOLS = "!?#$%&*|@<>{}[]=+\\/~^_"


#: Bytes of text that a task takes apart together.
SLICE_BYTES = 2 << 20


def style(text: str | None) -> list[float]:
    """Numbers that tell prose from junk: shares of characters, repetition of words and lines."""
    text = text or ""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    low = [w.lower() for w in words]
    counts: dict[str, int] = {}
    for w in low:
        counts[w] = counts.get(w, 0) + 1
    top = max(counts.values(), default=0)
    same = sum(map(str.__eq__, low, low[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    letters = len("".join(LETTERS.findall(text)))
    upper = sum(map(str.isupper, words))
    symbols = sum(map(text.count, SYMBOLS))
    bare = sum(map(str.isalpha, words))
    return [
        math.log1p(len(text)), math.log1p(len(words)), len(text) / m, letters / n, upper / m, symbols / n, symbols / m, bare / m,
        sum(map(text.count, "0123456789")) / n, sum(map(text.count, ".,;:")) / m, len(counts) / m, top / m, same / m,
        1 - len(set(lines)) / k, len(words) / k, text.count("|") / m, float(not words), math.log1p(len(counts)) / math.log1p(m + 1),
    ]


N_STYLE = len(style(""))


def terms(text: str | None) -> set[str]:
    """Lower-cased words, and their beginnings (marked) of 4 to 7 letters."""
    words = set(LETTERS.findall((text or "").lower()))
    return words | {w[:i] + "-" for w in words for i in PREFIXES if len(w) > i}


def choose_terms(sample: DataFrame, categories: list[str], folds: int, most: int, min_docs: int = 5) -> list[list[str]]:
    """The terms of the largest log-odds, either way, for any category: for each fold those chosen without it, and last those of all.

    sample: text, fold (from 0), and a column of 0 or 1 for each category."""
    n_folds = max(1, folds)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.frugal()
        seen: list[list[Counter]] = [[Counter() for _ in range(n_folds)] for _ in range(1 + len(categories))]
        for b in batches:
            for text, fold, *ys in zip(b["text"], b["fold"], *(b[c] for c in categories)):
                found = terms(text)
                for own, y in zip(seen, [1, *ys]):
                    if y:
                        own[fold].update(found)
        every = list(set().union(*seen[0]))
        yield pd.DataFrame({"term": every} | {f"{'n' if i == 0 else f'y{i - 1}_'}{f}": [own[f][t] for t in every] for i, own in enumerate(seen) for f in range(n_folds)})

    names = [*(f"n{f}" for f in range(n_folds)), *(f"y{i}_{f}" for i in range(len(categories)) for f in range(n_folds))]
    if sample.isEmpty():
        return [[] for _ in range(folds + 1)]
    counts = sample.select("text", "fold", *categories).mapInPandas(count, "term string, " + ", ".join(f"{x} long" for x in names))
    sums = counts.groupBy("term").agg(*(F.sum(x).alias(x) for x in names)).where(sum((F.col(f"n{f}") for f in range(n_folds)), F.lit(0)) >= min_docs)
    sums = common.materialise(sums, "terms")
    totals = {r["fold"]: r for r in sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in categories)).collect()}
    out = []
    for left in [*range(folds), None]:
        own = [f for f in range(n_folds) if f != left]
        n, n_all = sum((F.col(f"n{f}") for f in own), F.lit(0)), sum(totals[f]["n"] for f in own if f in totals)
        picked: dict[str, None] = {}
        for i, c in enumerate(categories):
            y, y_all = sum((F.col(f"y{i}_{f}") for f in own), F.lit(0)), sum(totals[f][c] for f in own if f in totals)
            odds = F.abs(F.log((y + 0.5) / F.lit(y_all + 1.0)) - F.log((n - y + 0.5) / F.lit(n_all - y_all + 1.0)))
            best = sums.where(n >= min_docs).orderBy(F.desc(odds * F.sqrt(F.least(n, F.lit(50)))), "term").limit(most // len(categories))
            picked |= dict.fromkeys(r[0] for r in best.select("term").collect())  # at most ``most`` terms
        out.append(list(picked))
    return out


class TermIndex:
    """Indices of the chosen terms that a text has; words seen before are not taken apart again."""

    KEEP = 100_000

    def __init__(self, chosen: list[str]):
        self.index = {t: i for i, t in enumerate(chosen)}
        self.words: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            get = self.index.get
            found = tuple(i for i in [get(word), *(get(word[:k] + "-") for k in PREFIXES if len(word) > k)] if i is not None)
            if len(self.words) < self.KEEP:
                self.words[word] = found
        return found

    def of(self, text: str | None) -> list[int]:
        out: set[int] = set()
        for w in set(LETTERS.findall((text or "").lower())):
            found = self._of(w)
            if found:
                out.update(found)
        return sorted(out)


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, count) of runs of texts of about ``most`` bytes together; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        until = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        yield start, max(1, until - start)
        start += max(1, until - start)


def with_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], added: str) -> DataFrame:
    """The rows of ``df`` and further columns that ``make()``, called once a task, computes from Arrow batches
    of about SLICE_BYTES of ``text``.

    A column of ``df`` that has the name of an added one, in any case, gives way to it."""
    new_fields = T.StructType.fromDDL(added).fields
    taken = {f.name.lower() for f in new_fields}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *new_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for i, n in slices(whole.column("text"), SLICE_BYTES):
                b = whole.slice(i, n)
                new = compute(b)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *new.values()], names=[*(b.schema.names[i] for i in kept), *new])

    return common.map_arrow(df, run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, names: dict[str, str], bound: int) -> DataFrame:
    """At most ``bound`` labelled documents, chosen by a hash of doc_id, with a column for each of
    ``names`` (name: SQL over labels). Rows of labels with a null are left out; of several the largest counts."""
    labs = labels.select("doc_id", *(F.expr(sql).cast("double").alias(n) for n, sql in names.items())).dropna()
    labs = labs.groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    known = labs.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = common.hash_sample(known, "doc_id", bound)
    # a broadcast of at most ``bound`` rows of numbers
    return docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
