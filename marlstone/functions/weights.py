"""Term weights: BM25 saturation, length boost, inverse document frequency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the scoring formula
K1, B = 1.2, 0.75
QUERY_AVGDL, FIRST_AVGDL = 5.0, 50.0
BASE_WHITESPACE, BASE_STEMMED = 4.0, 8.0
BOOST = 0.5
RRF_K = 2


def bm25(tf: Column, length: Column, avgdl) -> Column:
    """Saturated term frequency of a text of ``length`` tokens."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def length_boost(token: Column, text_chars: Column) -> Column:
    """Added to words of at least 3 bytes, more for a longer share of the text."""
    size = F.octet_length(token)
    damp = F.least(F.lit(1.0), 1 / F.greatest(F.lit(1.0), F.log10(text_chars.cast("double"))))
    return F.when((size >= 3) & (text_chars > 0), size / text_chars * BOOST * damp).otherwise(0.0)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 0.5))
