"""From token counts to weighted postings, their inverse document frequencies and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.config import VectorConfig
from marlstone.functions import text as T
from marlstone.functions import weights as W


def token_counts(df: DataFrame, v: VectorConfig, field: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    if v.kind == "whitespace":
        return T.whitespace(df, field, keys, T.stopwords(v.language) if v.use_stopwords else None)
    if v.kind == "trigrams":
        return T.trigrams(df, field, keys)
    if v.kind == "full_text":
        return T.full_text(df, field, keys, v.language, v.use_stopwords)
    if v.kind == "wmtr":
        return T.wmtr(df, field, keys, v.language, v.use_stopwords)
    raise ValueError(f"{v.kind} is not lexical")


def _wmtr_weight(avgdl, chars: Column, trigram_weight: float) -> Column:
    token = F.regexp_replace("token", "^#{1,2} ", "")
    base = F.when(F.col("token").startswith(T.TRIGRAM_MARK), F.lit(trigram_weight)).when(F.col("token").startswith(T.STEM_MARK + " "), W.BASE_STEMMED).otherwise(W.BASE_WHITESPACE)
    boost = F.when(F.col("token").startswith(T.TRIGRAM_MARK), F.lit(0.0)).otherwise(W.length_boost(token, chars))
    return base * W.bm25(F.col("tf"), F.col("length"), avgdl) + boost


def top_k(postings: DataFrame, k: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k largest weights of each text; equal weights go by token."""
    w = Window.partitionBy(*keys).orderBy(F.desc("weight"), "token")
    return postings.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= k).drop("__at")


def weighted(counts: DataFrame, v: VectorConfig, avgdl: float | Column, chars: DataFrame | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, token, weight) from token counts. chars: (keys, chars) of the folded texts, for wmtr's boost."""
    if v.kind != "wmtr":
        return top_k(counts.select(*keys, "token", W.bm25(F.col("tf"), F.col("length"), avgdl).alias("weight")), v.top_k, keys)
    rows = counts.join(chars, list(keys)).select(*keys, "token", _wmtr_weight(avgdl, F.col("chars"), v.trigram_weight).alias("weight"))
    n_words = int(v.top_k * v.word_ratio / 100)
    is_trigram = F.col("token").startswith(T.TRIGRAM_MARK)
    return top_k(rows.where(~is_trigram), n_words, keys).unionByName(top_k(rows.where(is_trigram), v.top_k - n_words, keys))


def folded_chars(df: DataFrame, field: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return df.select(*keys, F.char_length(T.fold(F.coalesce(F.col(field), F.lit("")))).alias("chars"))


def build(df: DataFrame, vectors: list[VectorConfig], avgdl: float = W.FIRST_AVGDL) -> DataFrame:
    """Postings (fv, doc_id, token, weight) of all lexical vectors and fields."""
    out = None
    for v in vectors:
        for f in v.index_fields if v.lexical else ():
            counts = token_counts(df, v, f)
            rows = weighted(counts, v, avgdl, folded_chars(df, f) if v.kind == "wmtr" else None)
            rows = rows.select(F.lit(f"{f}_{v.name}").alias("fv"), "doc_id", "token", "weight")
            out = rows if out is None else out.unionByName(rows)
    return out


def idf_table(postings: DataFrame) -> DataFrame:
    """(fv, token, doc_count) of the postings as they are now."""
    return postings.groupBy("fv", "token").agg(F.count(F.lit(1)).alias("doc_count"))


def avgdl_stats(postings: DataFrame) -> DataFrame:
    """(fv, avgdl, n_docs): the mean number of distinct kept tokens of a text."""
    per = postings.groupBy("fv", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("fv").agg(F.avg("n").alias("avgdl"), F.count(F.lit(1)).alias("n_docs"))
