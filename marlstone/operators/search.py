"""The search plan: arms, fusion, groups, facets, hydration, joins, projection. One lazy plan but for refetches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.config import CollectionConfig, SearchRequest
from marlstone.errors import ValidationError
from marlstone.functions import weights as W
from marlstone.operators import arms as A
from marlstone.operators import filters, fusion, grouping, index, joins


@dataclass
class Tables:
    """A collection as tables: docs, postings (fv, doc_id, token, weight), their idf, and the number of documents."""

    docs: DataFrame
    postings: DataFrame | None
    idf: DataFrame | None
    n_docs: int


@dataclass
class Outcome:
    results: DataFrame
    facets: DataFrame | None = None


def query_vector(spark, config: CollectionConfig, request: SearchRequest) -> DataFrame | None:
    """(fv, token, qw): the query's tokens for each lexical arm, weighed as a text of the query length."""
    out = None
    one = spark.createDataFrame([("q", request.query)], "doc_id string, content string")
    for a in request.chosen_arms(config):
        v = config.vector(a.vector)
        if v.lexical:
            counts = index.token_counts(one, v, "content")
            chars = index.folded_chars(one, "content") if v.kind == "wmtr" else None
            rows = index.weighted(counts, v, W.QUERY_AVGDL, chars).select(F.lit(f"{a.field}_{a.vector}").alias("fv"), "token", F.col("weight").alias("qw"))
            out = rows if out is None else out.unionByName(rows)
    return out


def allowed(docs: DataFrame, config: CollectionConfig, request: SearchRequest) -> DataFrame | None:
    """The documents that filters leave, or None without filters, so that arms need not join them."""
    cond = None
    if request.tags:
        cond = filters.tags_match(request.tags, request.tags_match_all)
    where = filters.build(request.where)
    if where is not None:
        c = filters.to_column(where, config.metadata_indexes)
        cond = c if cond is None else cond & c
    return None if cond is None else docs.where(cond)


def scored_arms(t: Tables, config: CollectionConfig, request: SearchRequest) -> DataFrame | None:
    """(arm, field, vector, weight, doc_id, score) of all arms, before they are cut."""
    spark = t.docs.sparkSession
    chosen, parts = request.chosen_arms(config), []
    left = allowed(t.docs, config, request)
    qvec = query_vector(spark, config, request)
    lexical = None
    if qvec is not None:
        postings = t.postings if left is None else t.postings.join(left.select("doc_id"), "doc_id", "left_semi")
        lexical = A.sparse(postings, A.query_idf(qvec, t.idf, t.n_docs))
    for i, a in enumerate(chosen):
        v = config.vector(a.vector)
        tag = [F.lit(i).alias("arm"), F.lit(a.field).alias("field"), F.lit(a.vector).alias("vector"), F.lit(float(a.weight)).alias("weight"), "doc_id", "score"]
        if v.lexical:
            parts.append(lexical.where(F.col("fv") == f"{a.field}_{a.vector}").select(*tag))
        elif v.dense:
            if request.dense_query is None or (v.dims and len(request.dense_query) != v.dims):
                raise ValidationError(f"vector {a.vector!r} needs a query vector of {v.dims} components")
            parts.append(A.dense(t.docs if left is None else left, request.dense_query, v.distance, f"{a.field}_{a.vector}").select(*tag))
        elif v.kind.startswith("sparse"):
            if request.sparse_query is None:
                raise ValidationError(f"vector {a.vector!r} needs a sparse query")
            q = spark.createDataFrame([(f"{a.field}_{a.vector}", k, float(x)) for k, x in request.sparse_query.items()], "fv string, token string, qw double")
            postings = t.postings if left is None else t.postings.join(left.select("doc_id"), "doc_id", "left_semi")
            parts.append(A.sparse(postings, q).select(*tag))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def search(t: Tables, config: CollectionConfig, request: SearchRequest, collections: Callable[[str], tuple[DataFrame, dict[str, str]]] | None = None) -> Outcome:
    spark = t.docs.sparkSession
    specs = joins.parse(request.join) if request.join else []
    for key in [request.group_field] if request.group_field else []:
        if key not in config.metadata_indexes:
            raise ValidationError(f"group: {key!r} is not indexed")
    scored = scored_arms(t, config, request)
    if scored is None:  # only the empty vector
        scored = spark.createDataFrame([], "arm int, field string, vector string, weight double, doc_id string, score double")
    n = request.prefetch()
    listed = A.prefetch(scored, n)
    if request.group_field:
        group = f"meta_{request.group_field}"
        with_group = scored.join(t.docs.select("doc_id", group), "doc_id").persist()
        top = grouping.refetch(with_group, group, n, request.group_max, request.limit, request.group_max_fetches, request.fusion, request.score_threshold).drop(group)
    else:
        top = fusion.best(fusion.fuse(listed, request.fusion, request.score_threshold), request.limit)
    top = top.select("doc_id", "score", "tie")
    hits = t.docs.join(F.broadcast(top), "doc_id")  # at most ``limit`` rows
    if request.raw_scores:
        hits = hits.join(fusion.raw_scores(listed.join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi")), "doc_id", "left")
    for s in specs:
        child, child_indexes = collections(s.collection)
        hits = joins.nested(hits, exclude(child, request.exclude), s, child_indexes, limit=None)
    hits = exclude(hits, request.exclude).orderBy(F.desc("score"), F.desc("tie"), "doc_id").drop("tie")
    counts = None
    if request.facets is not None:
        pool = t.docs.join(listed.select("doc_id").distinct(), "doc_id", "left_semi")
        counts = grouping.facets(pool, config.metadata_indexes, request.facets.max_values)
    return Outcome(hits, counts)


def exclude(df: DataFrame, fields: list[str]) -> DataFrame:
    """Excluded fields stay as columns of nulls."""
    types = dict(df.dtypes)
    return df.withColumns({f: F.lit(None).cast(types[f]) for f in fields if f in types}) if fields else df
