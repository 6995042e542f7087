"""Ingestion: timestamp-ordered upserts and deletes, change classes, queue views.

The ordered fold per document: an upsert applies if nothing is stored or it is newer than what is; a
delete cancels earlier upserts that still wait (in the same batch) with a time up to its own, and removes the
stored document if it is newer. There are no tombstones: an older upsert after a delete creates anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(ops: DataFrame) -> DataFrame:
    """Of each document's upserts the newest, of equally new ones the first."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("doc_ts"), "seq")
    return ops.withColumn("__at", F.row_number().over(w)).where(F.col("__at") == 1).drop("__at")


def decide(ops: list[tuple], stored):
    """The fold itself: ops as (seq, op, ts) in order of seq. Returns (kept seq or None, whether what was stored stays)."""
    waiting = list(ops)
    current, source, stays = stored, None, stored is not None
    cancelled = set()
    for seq, op, ts in waiting:
        if op == "delete":
            cancelled |= {s for s, o, t in waiting if o == "upsert" and t <= ts and s < seq}
    for seq, op, ts in waiting:
        if op == "upsert" and seq not in cancelled and (current is None or ts > current):
            current, source, stays = ts, seq, False
        elif op == "delete" and current is not None and ts > current:
            current, source, stays = None, None, False
    return source, stays


def fold(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """``docs`` after ``ops``, in the columns of ``docs``. Decisions are made on (seq, op, ts) alone, with a document's
    operations as one array; the texts then move once, to where they are needed."""
    marks = ops.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "op", F.unix_micros("doc_ts").alias("ts")))).alias("ops"))
    marks = marks.join(docs.select("doc_id", F.unix_micros("ts").alias("stored")), "doc_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, own, stored in zip(b["doc_id"], b["ops"], b["stored"]):
                rows.append((doc_id, *decide([(o["seq"], o["op"], o["ts"]) for o in own], None if pd.isna(stored) else int(stored))))
            yield pd.DataFrame(rows, columns=["doc_id", "kept_seq", "stays"]).astype({"kept_seq": "Int64"})

    decided = marks.mapInPandas(run, "doc_id string, kept_seq long, stays boolean")
    untouched = docs.join(decided.where("not stays"), "doc_id", "left_anti")
    upserts = ops.join(decided.where("kept_seq is not null").select("doc_id", F.col("kept_seq").alias("seq")), ["doc_id", "seq"])
    types = dict(docs.dtypes)
    derived = {"ts": F.col("doc_ts"), "content_hash": F.md5("content")}

    def value(c: str) -> Column:
        return derived.get(c, F.col(c) if c in ops.columns else F.lit(None))

    new = upserts.select(*(value(c).cast(types[c]).alias(c) for c in docs.columns))
    return untouched.unionByName(new)


def change_class(new: str = "n", old: str = "o") -> Column:
    """new, skip (not newer), update (a field that is indexed changed) or patch, of aliased rows joined by id."""
    same = None
    for f in ("name", "description", "content"):
        c = F.col(f"{new}.{f}").eqNullSafe(F.col(f"{old}.{f}"))
        same = c if same is None else same & c
    return F.when(F.col(f"{old}.doc_id").isNull(), "new").when(F.col(f"{new}.ts") <= F.col(f"{old}.ts"), "skip").when(~same, "update").otherwise("patch")


def queue_counts(queue: DataFrame) -> DataFrame:
    """One row: how many upserts and deletes are queued, requeued and failed, and all; zeros where none."""
    def n(status: str, op: str) -> Column:
        return F.count(F.when((F.col("status") == status) & (F.col("op") == op), 1)).alias(f"{status}_{op}")

    return queue.agg(*(n(s, o) for s in ("queued", "requeued", "failed") for o in ("upsert", "delete")), F.count(F.lit(1)).alias("total"))


def status_view(stored: DataFrame, queue: DataFrame) -> DataFrame:
    """(doc_id, status, ts) of what is indexed and what waits or failed, the newest first."""
    return stored.select("doc_id", F.lit("indexed").alias("status"), "ts").unionByName(queue.select("doc_id", "status", "ts")).orderBy(F.desc("ts"), "doc_id", "status")


def split_valid(ops: DataFrame, rule: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Operations that keep a rule, and the others with the reason, as dead letters."""
    ok = F.coalesce(rule, F.lit(False))
    return ops.where(ok), ops.where(~ok).withColumn("reason", F.lit(reason))
