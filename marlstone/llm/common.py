"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of ASCII words; everything from U+0080 on belongs to a word.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset in local mode, as in tests, a folder of this machine is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts, where lower() does just that, take the fast way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD)
    # only the first and the last part can be empty, at a leading or trailing separator
    return F.array_remove(parts, "")


def hash_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of ``key``: rows far from the bound drop out where they are read."""
    n, h = df.count(), F.xxhash64(key)
    if n > 2 * bound:
        df = df.where(F.pmod(h, F.lit(1 << 32)) < int(1.5 * bound / n * (1 << 32)))
    return df.orderBy(h, key).limit(bound)


def bytes_small_enough(df: DataFrame, limit_bytes: int, size: Column) -> bool:
    """Whether a written table is proven to fit a broadcast: ``size``, the bytes of each row, is summed before."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit_bytes


def small_enough(df: DataFrame, limit_bytes: int, row_bytes: int) -> bool:
    """Whether a table is proven to fit a broadcast: its rows are counted, up to the bound, before."""
    bound = limit_bytes // row_bytes
    return df.limit(bound + 1).count() <= bound


def frugal() -> None:
    """Have this Python worker give freed memory back at once.

    Workers are reused from stage to stage. By default the C library raises the size from which arrays get pages of
    their own, and the Arrow pool keeps what was freed, so a worker stays as large as its largest moment."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # of the GNU library; elsewhere nothing is changed
        for option, value in ((-3, 1 << 20), (-1, 4 << 20), (-8, 1)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD, M_ARENA_MAX
            libc.mallopt(option, value)
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Return the free pages between what is still in use."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: Arrow batches between Spark and Python workers hold about this much, so that long texts do not make them large.
BATCH_BYTES = 2 << 20


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in frugal workers, on batches bounded in bytes: the session's bound is lowered to BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def frugally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        yield from run(batches)
        give_back()

    return df.mapInArrow(frugally, schema)


def frugal_group(run: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas: ``run`` in a frugal worker."""

    def frugally(group: pd.DataFrame) -> pd.DataFrame:
        frugal()
        out = run(group)
        give_back()
        return out

    return frugally
