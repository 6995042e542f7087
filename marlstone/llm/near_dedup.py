"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its 5-word shingles. Each shingle is labelled with how often it has occurred
before in the text. For each of SKETCHES hash functions the TUPLE labelled shingles of the least hashes
(SHORT_TUPLE in short texts) are taken and put back into text order; the hash of that tuple is a bucket key, beside the text's
length class. Two texts share a key only if they share those shingles in the same order, so the keys
answer to edits and moves and not to shared words alone.

The similarity of two texts is L / (n + m - L), with L the longest alignment of their shingle
sequences within the band that a similarity of THRESHOLD leaves; it is at most their Jaccard
similarity, and equal to it where shared shingles stand in the same order. Texts of that similarity
or more are linked, and classes are the connected components of the links.

Only distinct texts are compared: copies share a node, the digest of their text. In a bucket every
member is aligned with the member of the largest degree, then in ROUNDS rounds those outside the bucket's commonest
component with a random member inside it, another in each bucket. What then still lies in different components is compared in
all pairs, but for pairs that two exact bounds rule out before any text is read: shingles that a text has alone are in no
alignment, and nor are those whose bit in a bitmap of BITS bits the other text lacks. A large bucket's outsiders are
dealt over several tasks. No link between members of a bucket is lost, and no pair within a component is compared needlessly.

Defined cases: null texts are copies of each other and of nothing else; texts without words are equal
to exact copies only; a text of 1 to 4 words is one shingle; repeated rows are copies; a null doc_id
never names a class, unless the class has none other; further columns are kept by ``keep_one``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common, features

SHINGLE = 5
THRESHOLD = 0.8
SKETCHES, TUPLE = 20, 4
#: In length classes up to SHORT (fewer than 36 shingles) tuples are smaller: drawn without replacement from few, four rarely agree.
SHORT, SHORT_TUPLE = 15, 2
ROUNDS = 2
#: Bits of a text's bitmap, in words of 64.
BITS = 1024
#: Outsiders of a bucket that one task compares with the bucket.
DEALT = 1000
#: Lists of wanted texts below this are broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20

#: Bytes of text that a task takes apart together.
SLICE_BYTES = 2 << 20

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of each text's shingles, in order; words of all texts are hashed once."""
    import xxhash

    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), common.NON_WORD)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    real = np.array([w != "" for w in distinct], bool)
    codes = coded.indices.to_numpy()
    is_word = real[codes]
    counts = np.diff(np.concatenate([[0], np.cumsum(is_word)])[words.offsets.to_numpy()])
    h = hashes[codes[is_word]]
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for i in range(SHINGLE):
        rolled = _mix(rolled + h[i : i + len(rolled)] + _G)
    out = []
    for start, n in zip((ends - counts).tolist(), counts.tolist()):
        if n >= SHINGLE:
            out.append(rolled[start : start + n - SHINGLE + 1])
        else:  # fewer words are one shingle
            x = np.zeros(min(n, 1), np.uint64)
            for i in range(n):
                x = _mix(x + h[start + i] + _G)
            out.append(x)
    return out


_SEEDS = _G * np.arange(1, SKETCHES + 1, dtype=np.uint64)[:, None]


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the shingles with the number of their earlier occurrences."""
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.append(True, ranked[1:] != ranked[:-1])[:n]
    at = np.arange(n)
    out = np.empty(n, np.uint64)
    if n:
        out[order] = ranked + _G * (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return _mix(out)


def sketch(marked: np.ndarray, size: int = TUPLE) -> np.ndarray:
    """A key for each of SKETCHES hash functions, of ``size`` labelled shingles; none for no shingles."""
    n = len(marked)
    if n == 0:
        return np.zeros(0, np.uint64)
    t = min(size, n)
    least = np.argpartition(_mix(marked ^ _SEEDS), t - 1, axis=1)[:, :t]
    chosen = marked[np.sort(least, axis=1)]  # back in text order
    keys = _SEEDS[:, 0].copy()
    for i in range(t):
        keys = _mix(keys + chosen[:, i] + _G)
    return keys


def length_classes(n: int) -> tuple[int, int]:
    """Two neighbouring classes; texts whose lengths can reach THRESHOLD share one."""
    c = int(np.floor(np.log(n) / -np.log(THRESHOLD)))
    return c, c + 1


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a text with shingles, in both of its length classes; the class sets the size of the tuples."""
    classes_, marked = length_classes(len(hashes)), labelled(hashes)
    of_size = {size: sketch(marked, size) for size in {SHORT_TUPLE if c <= SHORT else TUPLE for c in classes_}}
    return np.concatenate([_mix(of_size[SHORT_TUPLE if c <= SHORT else TUPLE] + (_G * np.array([c], np.int64).astype(np.uint64))) for c in classes_]).view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each labelled shingle."""
    bits = np.zeros(BITS, bool)
    bits[labelled(hashes) % np.uint64(BITS)] = True
    return np.packbits(bits).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest common subsequence of a and b whose matches lie within ``band`` of the diagonal."""
    n, m = len(a), len(b)
    lead = min(n, m)
    differ = np.flatnonzero(a[:lead] != b[:lead])
    head = int(differ[0]) if len(differ) else lead
    a, b = a[head:], b[head:]
    lead = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:lead] != b[::-1][:lead])
    tail = int(differ[0]) if len(differ) else lead
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    masks: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        masks[x] = masks.get(x, 0) | 1 << j
    window, row = (1 << (2 * band + 1)) - 1, (1 << len(b)) - 1
    full = row
    for i, x in enumerate(a.tolist()):  # one bit a column: a zero is a step of the alignment's length
        mask = masks.get(x)
        if mask:
            mask &= window << (i - band) if i >= band else window >> (band - i)
            use = row & mask
            if use:
                row = ((row + use) | (row - use)) & full
    return head + tail + len(b) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = THRESHOLD) -> float:
    """Of two shingle sequences, or 0.0 where it is certain to be below ``least``."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    need = least / (1 + least) * (n + m)
    if min(n, m) < need - 1e-9:
        return 0.0
    x, y = Counter(a.tolist()), Counter(b.tolist())
    if (x & y).total() < need - 1e-9:
        return 0.0
    length = aligned(a, b, int(n + m - 2 * need) + 1)
    return length / (n + m - length)


def digest(text) -> Column:
    """The node of a text; null texts have one of their own."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(bytearray(b"null")))


def sketches(docs: DataFrame) -> DataFrame:
    """(node, n, bits, keys) of each distinct text with words: its number of shingles, their bitmap, and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, n in features.slices(whole.column(1), SLICE_BYTES):
                b = whole.slice(i, n)
                found = [(node, x) for node, x in zip(b.column(0).to_pylist(), shingles(b.column(1))) if len(x)]
                sizes, bits, keys = [len(x) for _, x in found], [bitmap(x) for _, x in found], [bucket_keys(x) for _, x in found]
                yield pa.RecordBatch.from_pydict({"node": pa.array([x for x, _ in found], pa.binary()), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.list_(pa.int64())), "keys": pa.array(keys, pa.list_(pa.int64()))})

    found = common.map_arrow(docs.select(digest("text").alias("node"), "text"), run, "node binary, n long, bits array<long>, keys array<long>")
    return found.dropDuplicates(["node"])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes of (a, b): the least node that each is connected with."""
    both = common.materialise(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    label = common.materialise(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("comp")), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("y"), F.col("comp").alias("c")), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("c"))
        moved = label.join(near, "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        up = moved.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        new = common.materialise(moved.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")), "label")
        if new.where("old <> comp").isEmpty():
            return new.select("node", "comp")
        label = new.select("node", "comp")


def joined(comp: DataFrame, links_: DataFrame) -> DataFrame:
    """(node, comp) after further links: only links between different components are followed."""
    lone = links_.select(F.col("a").alias("node")).union(links_.select("b")).distinct().join(comp, "node", "left_anti").select("node", F.col("node").alias("comp"))
    every = comp.unionByName(lone)
    ends = links_.join(every.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(every.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    merged = components(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    return common.materialise(every.join(merged, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "label")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, each once. While they are few, texts of others are not moved."""
    wanted = common.materialise(wanted, "wanted")
    near = F.broadcast(wanted) if common.small_enough(wanted, BROADCAST_BYTES, 64) else wanted
    return docs.select(digest("text").alias("node"), "text").join(near, "node", "left_semi").dropDuplicates(["node"])


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are similar."""
    texts = _texts(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, n in features.slices(whole.column(2), SLICE_BYTES):
                x = whole.slice(i, n)
                keep = [similarity(p, q) >= THRESHOLD for p, q in zip(shingles(x.column(2)), shingles(x.column(3)))]
                yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return common.map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), run, "a binary, b binary")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _opened(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with their own and the bucket's commonest component."""
    at = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.mode("comp", True).alias("top"))
    return common.materialise(at.join(per.where("lo <> hi").select("bucket", "top"), "bucket"), "open")


def unique_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, q): how many labelled shingles of each wanted node no other wanted node has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, n in features.slices(whole.column(1), SLICE_BYTES):
                b = whole.slice(i, n)
                found = [labelled(x).view(np.int64) for x in shingles(b.column(1))]
                yield pa.RecordBatch.from_pydict({"node": b.column(0), "shingles": pa.array(found, pa.list_(pa.int64()))})

    texts = _texts(docs, wanted)
    rows = common.map_arrow(texts, run, "node binary, shingles array<long>").select("node", F.explode("shingles").alias("s"))
    alone = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")).where("df = 1")
    return alone.groupBy("node").agg(F.count(F.lit(1)).alias("q"))


def _only(a: str, b: str) -> Column:
    """How many bits the first bitmap has alone: at least as many of its shingles are not in the other text."""
    return sum((F.bit_count(F.col(a)[i].bitwiseAND(F.bitwise_not(F.col(b)[i]))) for i in range(BITS // 64)), F.lit(0))


def links(docs: DataFrame) -> DataFrame:
    """(node, comp) of the distinct texts that have a similar other; the components of all links."""
    found = common.materialise(sketches(docs), "sketches")
    keyed = found.select("node", F.explode("keys").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keyed.join(sizes, "bucket")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = common.materialise(members.join(degree, "node").select("bucket", "node", "degree"), "members")

    # 1. every member with the one of the largest degree: of a family of copies, the one that all come from
    hubs = members.groupBy("bucket").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    tested = common.materialise(_ordered(members.join(hubs, "bucket").select(F.col("node").alias("a"), F.col("hub").alias("b"))), "pairs")
    comp = components(common.materialise(verify(tested, docs), "links"))

    # 2. members outside a bucket's commonest component with one inside it; who shares many buckets meets many members
    for i in range(ROUNDS):
        at = _opened(members, comp)
        hubs = at.where("comp = top").groupBy("bucket").agg(F.max_by("node", F.xxhash64("node", "bucket", F.lit(i))).alias("b"))
        pairs = at.where("comp <> top").join(hubs, "bucket").select(F.col("node").alias("a"), "b")
        pairs = common.materialise(_ordered(pairs).join(tested, ["a", "b"], "left_anti"), "pairs")
        comp = joined(comp, common.materialise(verify(pairs, docs), "links"))
        tested = tested.union(pairs)

    # 3. all pairs that are left in different components, but for those that cannot be similar
    at = _opened(members, comp)
    q = unique_shingles(docs, at.select("node").distinct())
    share = THRESHOLD / (1 + THRESHOLD)  # of n + m, the least alignment
    size = found.join(at.select("node").distinct(), "node", "left_semi").join(q, "node", "left")
    # a text whose own shingles alone exceed what may differ is similar to none
    size = size.select("node", "n", "bits", "keys", (F.col("n") - F.coalesce("q", F.lit(0))).alias("common")).where(F.col("common") >= THRESHOLD * F.col("n") - 1e-6)
    viable = at.join(size, "node")
    deals = viable.groupBy("bucket").agg(F.sum((F.col("comp") != F.col("top")).cast("long")).alias("outside")).where("outside > 0")
    viable = common.materialise(viable.join(deals.select("bucket", F.expr(f"1 + outside div {DEALT}").alias("deals")), "bucket"), "viable")
    columns = ("node", "comp", "n", "common", "bits", "keys")
    left = viable.where("comp <> top").select(F.col("bucket").alias("l_bucket"), F.pmod(F.xxhash64("node"), F.col("deals")).alias("l_deal"), *(F.col(c).alias(f"l_{c}") for c in columns))
    right = viable.select("bucket", "top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), *(F.col(c).alias(f"r_{c}") for c in columns))
    need = share * (F.col("l_n") + F.col("r_n")) - 1e-6
    may = (F.least("l_common", "r_common") >= need) & (F.col("l_n") - _only("l_bits", "r_bits") >= need) & (F.col("r_n") - _only("r_bits", "l_bits") >= need)
    once = F.array_min(F.array_intersect("l_keys", "r_keys")) == F.col("l_bucket")  # in the first bucket that both share
    on = (F.col("l_bucket") == F.col("bucket")) & (F.col("l_deal") == F.col("deal")) & (F.col("l_comp") != F.col("r_comp")) & ((F.col("r_comp") == F.col("top")) | (F.col("l_node") < F.col("r_node"))) & may & once
    rest = left.join(right, on).select(F.col("l_node").alias("a"), F.col("r_node").alias("b"))
    rest = common.materialise(_ordered(rest).join(tested, ["a", "b"], "left_anti"), "pairs")
    return joined(comp, common.materialise(verify(rest, docs), "links"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, class_size, comp) of every row: the least doc_id of its class, the class's rows, and its component."""
    docs = docs.select("doc_id", "text")
    comp = links(docs)
    rows = docs.select("doc_id", digest("text").alias("node"))
    named = common.materialise(rows.join(comp, "node", "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp")), "named")
    # written, so that the join below has exchanges of its own, which can be split at a large class
    per = common.materialise(named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    return named.join(per, "comp").select("doc_id", "node", "class_id", "class_size", "comp")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the least doc_id; columns unchanged."""
    rows = classes(docs).groupBy("comp", "doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    # texts of one class can share a doc_id: the least text digest then; null only where no row has an id
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node", "n")).alias("x")
    best = common.materialise(rows.groupBy("comp").agg(least).select(F.col("x.doc_id").alias("id"), F.col("x.node").alias("kept"), F.col("x.n").alias("n")), "kept")
    near = F.broadcast if common.small_enough(best, BROADCAST_BYTES, 96) else (lambda x: x)
    # the document goes as one value, so that none of its columns can clash
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), digest("text").alias("node"))
    on = F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("node") == F.col("kept"))
    once = marked.join(near(best.where("n = 1")), on).select("doc.*")
    often = marked.join(near(best.where("n > 1")), on).dropDuplicates(["kept", "id"]).select("doc.*")
    return once.union(often)
