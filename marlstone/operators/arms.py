"""Retrieval arms: scored candidate lists, one plan each, filtered before they are cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores are compared after rounding, so that ties do not hang on the order of summation.
PLACES = 9


def query_idf(qvec: DataFrame, idf: DataFrame, n_docs: int) -> DataFrame:
    """Query weights times inverse document frequency; tokens that no document has drop out."""
    from marlstone.functions import weights as W

    return F.broadcast(qvec).join(idf, ["fv", "token"]).withColumn("qw", F.col("qw") * W.idf(F.lit(n_docs), F.col("doc_count"))).drop("doc_count")


def sparse(postings: DataFrame, qvec: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, fv, doc_id, score): the product of document and query weights. qvec: (keys, fv, token, qw), a query's few tokens."""
    hits = postings.join(F.broadcast(qvec), ["fv", "token"])
    return hits.groupBy(*keys, "fv", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), PLACES).alias("score"))


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearness(a: Column, b: Column, distance: str) -> Column:
    """1 - distance: cosine distance, negative inner product, or Euclidean distance.

    The cosine of a zero vector is NaN, as in SQL engines that divide after IEEE 754; Spark's own division would end the query."""
    if distance == "dot":
        return 1 + dot(a, b)
    if distance == "euclid":
        return 1 - F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
    product = dot(a, b)
    return F.coalesce(F.try_divide(product, F.sqrt(dot(a, a) * dot(b, b))), product * F.lit(float("inf")))


def dense(vectors: DataFrame, query: list[float], distance: str = "cosine", vector: str = "embedding") -> DataFrame:
    """(doc_id, score) of every vector, exactly; the query is a literal of the plan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.where(F.col(vector).isNotNull()).select("doc_id", F.round(nearness(F.col(vector), q, distance), PLACES).alias("score"))


def prefetch(scored: DataFrame, n: int, keys: tuple[str, ...] = ("arm",)) -> DataFrame:
    """The n best of each arm with their ranks; equal scores go by doc_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
