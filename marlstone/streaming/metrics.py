"""Metric time series: tumbling and sliding windows, roll-ups, retention, views. Batch frames and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("hostname", "source", "key", "dims")
#: fixed retention: seconds that buckets of each width are kept
RETENTION = {60: 86_400, 300: 604_800}
LIVE_SECONDS, WINDOWS = 5, (30, 60)


def _sums() -> list[Column]:
    return [F.sum("value").alias("value"), F.sum("n").alias("n")]


def tumble(events: DataFrame, seconds: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, bucket_start, bucket_seconds, value, n): sums by bucket; n stays null for metrics without counts."""
    w = F.window("ts", f"{seconds} seconds")
    g = events.groupBy(*keys, w).agg(*_sums())
    return g.select(*keys, F.col("window.start").alias("bucket_start"), F.lit(seconds).alias("bucket_seconds"), "value", "n")


def tumble_stream(events: DataFrame, seconds: int, late: str = "0 seconds", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As tumble, over a stream: buckets come out once, when complete; later events for them are dropped."""
    return tumble(events.withWatermark("ts", late), seconds, keys)


def slide(events: DataFrame, seconds: int, step: int = LIVE_SECONDS, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, window_end, value, n): sums over the last ``seconds`` at every step."""
    w = F.window("ts", f"{seconds} seconds", f"{step} seconds")
    g = events.groupBy(*keys, w).agg(*_sums())
    return g.select(*keys, F.col("window.end").alias("window_end"), "value", "n")


def rollup(buckets: DataFrame, seconds: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Wider buckets out of narrower ones, which they must be a multiple of."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds("bucket_start") / seconds) * seconds)
    g = buckets.groupBy(*keys, start.alias("bucket_start")).agg(*_sums())
    return g.withColumn("bucket_seconds", F.lit(seconds)).select(*keys, "bucket_start", "bucket_seconds", "value", "n")


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Stored buckets with the new ones in the place of those of equal key, start and width: repeating it changes nothing."""
    by = [*keys, "bucket_start", "bucket_seconds"]
    cond = None
    for c in by:
        e = F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}"))
        cond = e if cond is None else cond & e
    return stored.alias("s").join(new.alias("n"), cond, "left_anti").unionByName(new)


def retain(buckets: DataFrame, now: Column, keep: dict[int, int] | None = None) -> DataFrame:
    """Buckets that are not older than their width's retention; other widths stay."""
    old = F.lit(False)
    for seconds, age in (RETENTION if keep is None else keep).items():
        old = old | ((F.col("bucket_seconds") == seconds) & (F.unix_seconds("bucket_start") < F.unix_seconds(now) - age))
    return buckets.where(~old)


def scan(buckets: DataFrame, seconds: int, since: Column, until: Column, keys: list[str] | None = None) -> DataFrame:
    """Buckets of one width that start in [since, until), in order of start."""
    rows = buckets.where((F.col("bucket_seconds") == seconds) & (F.col("bucket_start") >= since) & (F.col("bucket_start") < until))
    return (rows.where(F.col("key").isin(*keys)) if keys else rows).orderBy("bucket_start")


def one_kind(events: DataFrame) -> DataFrame:
    """A key is a sum (n null) or a mean (n given), as its first event was; events of the other kind are dropped."""
    first = events.groupBy("key").agg(F.min_by(F.col("n").isNull(), F.struct("ts", F.col("n").isNull())).alias("__sum"))
    return events.join(first, "key").where(F.col("n").isNull() == F.col("__sum")).drop("__sum")


def latest_view(payloads: DataFrame, now: Column, alive: int = 30, keys: tuple[str, ...] = ("hostname", "source")) -> DataFrame:
    """The latest payload of each host and source that has reported within ``alive`` seconds."""
    rest = [c for c in payloads.columns if c not in (*keys, "ts")]
    last = payloads.groupBy(*keys).agg(F.max(F.struct("ts", *rest)).alias("x")).select(*keys, "x.*")
    return last.where(F.unix_seconds("ts") >= F.unix_seconds(now) - alive)


def series(buckets: DataFrame, seconds: int, since: Column, until: Column) -> DataFrame:
    """(bucket_start, value, n) for every bucket of the span, null where nothing was recorded."""
    grid = buckets.sparkSession.range(1).select(F.explode(F.sequence(F.unix_seconds(since), F.unix_seconds(until) - seconds, F.lit(seconds).cast("long"))).alias("at"))
    sums = buckets.groupBy(F.unix_seconds("bucket_start").alias("at")).agg(*_sums())
    return grid.join(sums, "at", "left").select(F.timestamp_seconds("at").alias("bucket_start"), "value", "n")


def ratio(value: Column, n: Column) -> Column:
    return F.when(n > 0, value / n)


def demand(usage: DataFrame, hosts: DataFrame) -> DataFrame:
    """(model, demand, proportion, score): use over windows, long windows weighing less, by the hosts that serve it.

    usage: model, window_s, value; hosts: model, hosts."""
    longest = F.max("window_s").over(Window.partitionBy())
    rate = F.col("value") / F.col("window_s") * (longest / F.col("window_s"))
    by = usage.withColumn("__rate", rate).groupBy("model").agg(F.sum("__rate").alias("demand"))
    by = by.withColumn("proportion", F.col("demand") / F.sum("demand").over(Window.partitionBy()))
    return by.join(hosts, "model", "left").select("model", "demand", "proportion", (F.col("proportion") / (F.coalesce("hosts", F.lit(0)) + 1)).alias("score"))


def prometheus(view: DataFrame, prefix: str = "engine") -> DataFrame:
    """(line): the text format, one gauge a row; means also give their count as a series of its own."""
    def escape(c: str) -> Column:
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "\n", r"\\n"), '"', r'\\"')

    name = F.concat(F.lit(prefix + "_"), F.regexp_replace("key", "[^A-Za-z0-9_]", "_"))
    labels = F.concat(F.lit('{host="'), escape("hostname"), F.lit('",source="'), escape("source"), F.lit('"} '))
    rows = view.select(F.explode(F.array(F.struct(F.concat(name, labels).alias("head"), F.col("value").alias("x")), F.struct(F.concat(name, F.lit("_n"), labels).alias("head"), F.col("n").cast("double").alias("x")))).alias("r")).where("r.x is not null")
    return rows.select(F.concat("r.head", F.format_string("%.6f", "r.x")).alias("line"))
