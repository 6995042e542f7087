"""Facet counts, group caps, and the search that fetches again while groups are full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import arms as A
from marlstone.operators import fusion


def facet_key(col: Column, kind: str) -> Column:
    """A value as text: numbers without decoration, true/false, ISO datetimes."""
    if kind == "datetime":
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    return F.lower(col.cast("string")) if kind == "boolean" else col.cast("string")


def facets(pool: DataFrame, indexes: dict[str, str], max_values: int = 10, column=lambda k: F.col(f"meta_{k}")) -> DataFrame:
    """(field, value, n): the commonest values of each indexed field over the candidates, in one pass."""
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), facet_key(column(k), kind).alias("value")) for k, kind in indexes.items()))
    counts = pool.select(F.inline(pairs)).where("value is not null").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counts.withColumn("at", F.row_number().over(w)).where(F.col("at") <= max_values).drop("at")


def cap(fused: DataFrame, group: str, group_max: int, limit: int) -> DataFrame:
    """At most ``group_max`` of each group value, null being one, in fused order, until the limit."""
    order = [F.desc("score"), F.desc("tie"), F.col("doc_id")]
    w = Window.partitionBy(group).orderBy(*order)
    kept = fused.withColumn("in_group", F.row_number().over(w)).where(F.col("in_group") <= group_max)
    return kept.orderBy(*order).limit(limit)


def refetch(scored: DataFrame, group: str, n: int, group_max: int, limit: int, fetches: int, how: str = "rrf", threshold: float | None = None) -> DataFrame:
    """Grouped search over scored arms (arm, weight, doc_id, score, group): while too few documents are found,
    fetch again without the groups that are full, and fuse all that was fetched anew.

    A round is a filter and a rank over the same scored arms, which the caller has persisted."""
    fetched, full = None, []
    for _ in range(max(1, fetches)):
        left = scored
        for value in full:  # null-safe: the group of null is not lost with the others
            left = left.where(~F.col(group).eqNullSafe(F.lit(value)))
        page = A.prefetch(left, n).drop("rank")
        new = page if fetched is None else page.join(fetched.select("arm", "doc_id"), ["arm", "doc_id"], "left_anti")
        fetched = new if fetched is None else fetched.unionByName(new)
        ranked = fetched.withColumn("rank", F.row_number().over(Window.partitionBy("arm").orderBy(F.desc("score"), "doc_id")))
        groups = fetched.select("doc_id", group).distinct()
        out = cap(fusion.fuse(ranked, how, threshold).join(groups, "doc_id"), group, group_max, limit)
        got = out.groupBy(group).count().collect()  # at most ``limit`` rows
        page_sizes = page.groupBy("arm").count().collect()
        full_now = [r[group] for r in got if r["count"] >= group_max]
        if sum(r["count"] for r in got) >= limit or all(r["count"] < n for r in page_sizes) or set(full_now) <= set(full):
            break
        full = full_now
    return out
