"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters the rows uniformly into buckets that fit a task's memory, by a seeded hash of
each row; the number of buckets follows from the bytes of all rows. Pass two puts each bucket in
the order of its hashes, so that the order in which rows arrive does not matter, shuffles it by
Fisher-Yates, seeded by the bucket's number, and writes it. The buckets laid end to end are one random order of all rows, which
the shards cut into runs: their row counts differ by at most one, and slots are gapless.

Defined cases: a null text counts 0 bytes and has the checksum of the empty string; an empty table gives
empty shards; groups of equal texts scatter like any other rows. Rows that repeat one doc_id and text scatter by
their place in the input as well, so theirs alone is an order that depends on how the input is laid out. Further
columns are kept as they are, but ``shard`` and ``slot`` of the input give way to the result's. A row larger
than a bucket is a bucket's largest member: rows are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import common

LAW = "rows"
OVERHEAD = 16
#: Tables below this, by their counted rows, are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def write_buckets(df: DataFrame, path: str, seed: int = 1, bucket_bytes: int = 16 << 20) -> None:
    """Write the rows of ``df`` as (bucket, place, doc) to ``path``; places count from 0 in each bucket."""
    total = df.agg(F.sum(row_size(F.col("text")))).first()[0] or 0
    buckets = int(max(1, -(-total // bucket_bytes)))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text"))
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    again = common.materialise(df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    again = F.broadcast(again) if common.small_enough(again, BROADCAST_BYTES, 32) else again
    marked = keyed.join(again.withColumn("repeated", F.lit(True)), "key", "left")
    marked = marked.select("doc", F.when(F.col("repeated"), F.xxhash64("key", "row")).otherwise(F.col("key")).alias("order"))
    marked = marked.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("order")), F.lit(buckets)).cast("int"))
    # bucket b is partition b, whose number seeds its shuffle; the grouping takes this partitioning over
    grouped = marked.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("order", "doc"))).alias("rows"))
    grouped.select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "r")).select("bucket", "place", "r.doc").write.parquet(path)


def read_shards(spark, path: str, shards: int) -> DataFrame:
    """The rows written by write_buckets, with ``shard`` and ``slot``."""
    rows = spark.read.parquet(path)
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row a bucket: the running sum is over buckets, not over rows
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("start"), total.alias("total"))
    if common.small_enough(starts, BROADCAST_BYTES, 64):
        starts = F.broadcast(starts)
    placed = rows.join(starts, "bucket").select("doc", "total", (F.col("start") + F.col("place")).alias("at"))
    placed = placed.withColumn("shard", F.expr(f"(at * {shards}L) div total")).withColumn("slot", F.expr(f"at - (shard * total + {shards - 1}L) div {shards}L"))
    kept = [c for c in rows.schema["doc"].dataType.names if c.lower() not in ("shard", "slot")]
    return placed.select(*(F.col("doc").getField(c).alias(c) for c in kept), F.col("shard").cast("int").alias("shard"), "slot")


def shard(df: DataFrame, shards: int = 40, seed: int = 1, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Shuffle, write and read back; the written buckets lie in the shared folder."""
    path = common.scratch_path(df.sparkSession, "shards")
    write_buckets(df, path, seed, bucket_bytes)
    return read_shards(df.sparkSession, path, shards)
