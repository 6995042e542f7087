"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item; an item of fewer words is one window
itself. Documents and items are fingerprinted alike: of the k-gram hashes in each window the least
is kept. Equal windows have equal minima, so every shared span of a window's length shares a
fingerprint. A match of fingerprints is then extended: the whole window around it is compared word
by word, so neither hash collisions nor chance matches count.

Defined cases: null texts have no words; an item without words has no window; a repeated document
row gives its result once per repetition; a null item_id goes by the name ``null``; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

KGRAM = 4
#: Tables of item fingerprints below this are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def _let(value: Column, body) -> Column:
    """body(value), with the value evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _pairwise(a: Column, b: Column, shift: int, n: Column, combine) -> Column:
    """combine(a[i], b[i + shift]) for the first n elements."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), combine)


def _least(a: Column, size: Column, width: int) -> Column:
    """The least of each run of ``width`` elements."""
    if width == 1:
        return a
    starts = F.greatest(size - (width - 1), F.lit(0))
    return _let(a, lambda x: F.transform(F.slice(x, F.lit(1), starts), lambda v, i: F.least(v, *(x[i + j] for j in range(1, width)))))


def _grams(a: Column, size: Column, width: int) -> Column:
    """A hash of each run of ``width`` word hashes, of hashes of its halves."""
    if width == 1:
        return a
    if width % 2:
        return _let(a, lambda x: _pairwise(_grams(x, size, width - 1), x, width - 1, size - (width - 1), lambda p, q: F.xxhash64(p, q)))
    half = width // 2
    return _let(_grams(a, size, half), lambda x: _pairwise(x, x, half, size - (width - 1), lambda p, q: F.xxhash64(p, q)))


def minima(hashes: Column, n: Column, length: int) -> Column:
    """For each window of ``length`` words the least hash of its k-grams; empty for shorter texts."""
    k = min(KGRAM, length)
    return _least(_grams(hashes, n, k), n - (k - 1), length - k + 1)


def _fingerprints(length: int, distinct: bool) -> Column:
    """Of the column ``hashes``; those of different window lengths differ."""
    least = minima(F.col("hashes"), F.col("n_words"), length)
    return F.transform(F.array_distinct(least) if distinct else least, lambda x: F.xxhash64(x, F.lit(length)))


def _hashed(df: DataFrame) -> DataFrame:
    df = df.withColumn("words", common.words(F.col("text"))).withColumn("n_words", F.size("words"))
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def item_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(length, fp, window, items): each distinct window once, with the sorted ids of its items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    items = _hashed(items).where("n_words > 0").drop("text")
    parts = []
    for length in range(1, window + 1):
        own = items.where(F.col("n_words") >= window if length == window else F.col("n_words") == length)
        own = own.withColumn("m", _fingerprints(length, distinct=False))
        own = own.select("item", "words", F.posexplode("m").alias("pos", "fp"))
        parts.append(own.select("item", "fp", F.lit(length).alias("length"), F.array_join(F.slice("words", F.col("pos") + 1, length), " ").alias("window")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("length", "fp", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _same(a: str, b: str) -> str:
    return f"{a}.doc_id <=> {b}.doc_id and {a}.text_hash = {b}.text_hash"


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> tuple[DataFrame, DataFrame]:
    """Two tables keyed by (doc_id, text_hash): n_words of every document row; and of each distinct
    (doc_id, text) with a hit n_hit, items (array of ids) and spans (array of [start, end) in words)."""
    wins = common.materialise(item_windows(benchmark, window), "windows")
    lengths = sorted(r[0] for r in wins.select("length").distinct().collect())  # at most ``window`` numbers
    item_bytes = F.aggregate("items", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 24)
    near = F.broadcast if common.bytes_small_enough(wins, BROADCAST_BYTES, F.octet_length("window") + item_bytes + 64) else (lambda x: x)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    # 1. winnow all documents once; find those that share any fingerprint
    prints = [_fingerprints(n, distinct=True) for n in lengths] or [F.array().cast("array<bigint>")]
    own = common.materialise(_hashed(keyed).select("doc_id", "text_hash", "n_words", F.concat(*prints).alias("fps")), "winnowed")
    grams = own.select("doc_id", "text_hash", F.explode("fps").alias("fp"))
    shared = common.materialise(grams.join(near(wins.select("fp").distinct()), "fp", "left_semi").select("doc_id", "text_hash").distinct(), "shared")
    few = F.broadcast if common.small_enough(shared, BROADCAST_BYTES, 64) else (lambda x: x)

    # 2. extension, only there: the windows around matching minima are compared whole, in the document's own words.
    # While those documents are few, the texts of others are not moved
    there = common.materialise(keyed.alias("d").join(few(shared).alias("s"), F.expr(_same("d", "s")), "left_semi"), "there")
    there = _hashed(there.dropDuplicates(["doc_id", "text_hash"])).select("doc_id", "text_hash", "words", "n_words", "hashes")
    parts = [there.select("doc_id", "text_hash", F.lit(n).alias("length"), F.posexplode(_fingerprints(n, distinct=False)).alias("pos", "fp")) for n in lengths]
    found = parts[0] if parts else there.select("doc_id", "text_hash", F.lit(0).alias("length"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("fp")).where(F.lit(False))
    for p in parts[1:]:
        found = found.unionByName(p)
    near_hits = found.join(near(wins), ["length", "fp"]).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "length", "window", "items")).alias("near"))
    equal = F.filter("near", lambda x: F.array_join(F.slice("words", x["pos"] + 1, x["length"]), " ") == x["window"])
    per = there.alias("t").join(near_hits.alias("n"), F.expr(_same("t", "n"))).select("t.doc_id", "t.text_hash", equal.alias("hits")).where(F.size("hits") > 0)
    spans = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.struct(x["pos"].alias("start"), (x["pos"] + x["length"]).alias("end")))))
    per = per.select("doc_id", "text_hash", F.array_sort(F.array_distinct(F.flatten("hits.items"))).alias("items"), spans.alias("spans"))
    return own.select("doc_id", "text_hash", "n_words"), common.materialise(per.select("doc_id", "text_hash", covered(F.col("spans")).alias("n_hit"), "items", "spans"), "hits")


def covered(spans: Column) -> Column:
    """How many places sorted spans cover together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["until"]))).alias("n"), F.greatest(s["until"], x["end"]).alias("until"))
    return F.aggregate(spans, start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items, spans, contaminated."""
    own, hits = find_hits(docs, benchmark, window)
    joined = own.alias("d").join(hits.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.text_hash = h.text_hash"), "left")
    return joined.select(
        "d.doc_id",
        F.col("d.n_words").cast("long").alias("n_words"),
        F.coalesce(F.col("h.n_hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.col("h.items"), F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("h.spans"), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.col("h.n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, columns unchanged."""
    _, hits = find_hits(docs, benchmark, window)
    keys = hits.select("doc_id", "text_hash")
    keys = F.broadcast(keys) if common.small_enough(keys, BROADCAST_BYTES, 64) else keys
    # the document goes as one value, so that none of its columns can clash
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", F.xxhash64("text").alias("text_hash"))
    return whole.alias("d").join(keys.alias("k"), F.expr(_same("d", "k")), "left_anti").select("doc.*")
