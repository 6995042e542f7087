"""Tokenizers. Each turns (doc_id, text, ...) into (doc_id, token, tf, length)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import stemming

TRIGRAM_MARK, WORD_MARK, STEM_MARK = "###", "#", "##"


def fold(text: Column) -> Column:
    """Case-folded, trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def stopwords(language: str) -> list[str]:
    """Spark ML's list of the language; none where it has none."""
    from pyspark.ml.feature import StopWordsRemover

    names = {"da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french", "de": "german", "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese", "ru": "russian", "es": "spanish", "sv": "swedish", "tr": "turkish"}
    return list(StopWordsRemover.loadDefaultStopWords(names[language])) if language in names else []


def counted(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, tf, length) from an array column ``tokens``; a text's tokens are counted in its own task first."""
    t = tokens.select(*keys, F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    return t.groupBy(*keys, "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def whitespace(df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("doc_id",), drop: list[str] | None = None) -> DataFrame:
    arr = F.filter(F.split(fold(F.col(text)), " "), lambda w: w != "")
    if drop:
        stop = F.array(*(F.lit(w) for w in drop))
        arr = F.filter(arr, lambda w: ~F.array_contains(stop, w))
    return counted(df.select(*keys, arr.alias("tokens")), list(keys))


def per_text(df: DataFrame, text: str, keys: tuple[str, ...], analyse: Callable[[str], tuple[Counter, int]]) -> DataFrame:
    """Token counts of each folded text, counted inside one Arrow batch: no shuffle."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", tokens array<struct<token:string,tf:bigint>>, length int"
    kind = pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [analyse(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            arrays = [*b.columns[:-1], pa.array([[{"token": k, "tf": v} for k, v in c.items()] for c, _ in found], kind), pa.array([n for _, n in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "tokens", "length"])

    rows = df.select(*keys, fold(F.col(text)).alias("__text")).mapInArrow(run, schema)
    return rows.select(*keys, "length", F.inline("tokens"))


def trigram_counts(text: str, pad: int = 2) -> tuple[Counter, int]:
    if not text:
        return Counter(), 0
    t = " " * pad + text + " " * pad
    return Counter(TRIGRAM_MARK + t[i : i + 3] for i in range(len(t) - 2)), len(t) - 2


def trigrams(df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return per_text(df, text, keys, trigram_counts)


WORDS = regex.compile(r"(?w)\b")


def word_segments(text: str) -> list[str]:
    """Segments between Unicode word bounds that hold a letter or digit."""
    return [s for s in WORDS.split(text) if any(ch.isalnum() for ch in s)]


def stems(text: str, language: str, drop: frozenset[str]) -> list[str]:
    stem = stemming.stemmer(language)
    return [stem(w) for w in word_segments(text) if w not in drop]


def full_text(df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("doc_id",), language: str = "en", use_stopwords: bool = True) -> DataFrame:
    drop = frozenset(stopwords(language)) if use_stopwords else frozenset()

    def analyse(t: str) -> tuple[Counter, int]:
        found = stems(t, language, drop)
        return Counter(found), len(found)

    return per_text(df, text, keys, analyse)


def wmtr_counts(text: str, language: str, drop: frozenset[str]) -> tuple[Counter, int]:
    """Three channels: words that no stem equals, stems, and trigrams of the text without stopwords."""
    lang = stems(text, language, drop)
    known = set(lang)
    words = [w for w in text.split() if w not in drop]
    out = Counter(WORD_MARK + " " + w for w in words if w not in known)
    out.update(STEM_MARK + " " + w for w in lang)
    if text:
        out.update(trigram_counts(" ".join(words), 1)[0])
    return out, len(lang)


def wmtr(df: DataFrame, text: str = "content", keys: tuple[str, ...] = ("doc_id",), language: str = "en", use_stopwords: bool = True) -> DataFrame:
    drop = frozenset(stopwords(language)) if use_stopwords else frozenset()
    return per_text(df, text, keys, lambda t: wmtr_counts(t, language, drop))
