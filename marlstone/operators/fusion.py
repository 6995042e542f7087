"""Fusion of ranked arms: (arm, weight, doc_id, score, rank) to (doc_id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.weights import RRF_K
from marlstone.operators.arms import PLACES


def rrf(arms: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal ranks by weight; ``tie`` is the sum of the raw scores."""
    each = F.col("weight") / (RRF_K + F.col("rank"))
    return arms.groupBy(*keys, "doc_id").agg(F.round(F.sum(each), PLACES).alias("score"), F.round(F.sum("score"), PLACES).alias("tie"))


def linear(arms: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Scores of each arm scaled to 0..1 over its list (all 1 if equal), by weight; absent is 0."""
    w = Window.partitionBy(*keys, "arm")
    scaled = arms.withColumn("lo", F.min("score").over(w)).withColumn("hi", F.max("score").over(w))
    part = F.when(F.col("lo") == F.col("hi"), F.lit(1.0)).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return scaled.groupBy(*keys, "doc_id").agg(F.round(F.sum(F.col("weight") * part), PLACES).alias("score")).withColumn("tie", F.lit(0.0))


def fuse(arms: DataFrame, how: str = "rrf", threshold: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    out = rrf(arms, keys) if how == "rrf" else linear(arms, keys)
    return out if threshold is None else out.where(F.col("score") >= threshold)


def best(fused: DataFrame, limit: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), F.desc("tie"), "doc_id").limit(limit)


def raw_scores(arms: DataFrame) -> DataFrame:
    """(doc_id, raw): each document's field, vector, score and rank in every arm."""
    return arms.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "vector", "score", "rank"))).alias("raw"))
