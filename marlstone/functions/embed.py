"""Embedding functions: a plug-in interface, and deterministic embedders that need no model."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are embedded in batches; a function of a list of texts to an array of vectors.
Embedder = Callable[[list[str]], np.ndarray]


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32-bit, after its public description, as a signed number."""
    h = seed
    for i in range(0, len(data) // 4 * 4, 4):
        k = _rotl(struct.unpack_from("<I", data, i)[0] * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (_rotl(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    tail = int.from_bytes(data[len(data) // 4 * 4 :], "little")
    if len(data) % 4:
        h ^= _rotl(tail * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h & 0x80000000 else h


def token_id(token: str) -> int:
    """The 31-bit id of a token."""
    return murmur3(token.encode()) % (2**31 - 1)


def token_ids(col: Column) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else token_id(t)).astype("Int64")

    return run(col)


class _Places(dict):
    """The place of a word in the counts, 2 * dimension + sign; words met before are not hashed again, of which a bounded number is kept."""

    KEEP, LONGEST = 200_000, 64

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, word: str) -> int:
        h = murmur3(word.encode())
        place = 2 * (h % self.dims) + ((h >> 16) & 1)
        if len(self) < self.KEEP and len(word) <= self.LONGEST:
            self[word] = place
        return place


def hashing_embedder(dims: int = 64, normalize: bool = True) -> Embedder:
    """Signed hashing of words: deterministic, for tests and as a fallback.

    A text without words, or whose words cancel out, has the zero vector."""
    places = _Places(dims)

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            found = np.fromiter(map(places.__getitem__, t.lower().split()), np.int64)
            counts = np.bincount(found, minlength=2 * dims)
            out[i] = counts[1::2] - counts[::2]
        if normalize:
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out

    return run


#: Arrow batches of texts hold about this much: by default a task gathers 64 MB of them on the JVM's heap, next to the rows themselves.
BATCH_BYTES = 2 << 20


def embed(df: DataFrame, text: str, embedder: Callable[[], Embedder], name: str = "embedding", batch: int = 256) -> DataFrame:
    """``df`` with the vectors of a text column; ``embedder()`` is called once a task, so that a model is loaded once.

    Each text is embedded once: called deterministic, the function would run again for every filter on its vectors.
    The session's bound on the bytes of an Arrow batch is lowered to BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = embedder()
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in np.asarray(own(texts[i : i + batch]), np.float32)], index=s.index, dtype=object)

    return df.withColumn(name, run.asNondeterministic()(F.col(text)))


def max_log_weights(df: DataFrame, text: str, top_k: int = 128, name: str = "sparse") -> DataFrame:
    """A sparse vector after the manner of learned sparse models: log(1 + relu(x)) of each token's largest activation.

    The activation of this stand-in is a word's count."""
    from marlstone.functions import text as T

    counts = T.whitespace(df.select("doc_id", F.col(text).alias("content")))
    w = F.round(F.log1p(F.col("tf").cast("double")), 9)
    gathered = counts.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-w).alias("minus"), "token"))), 1, top_k).alias("x"))
    return gathered.select("doc_id", F.transform("x", lambda s: F.struct(s["token"].alias("token"), (-s["minus"]).alias("weight"))).alias(name))
