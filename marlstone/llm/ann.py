"""Approximate nearest neighbours of the largest inner product: an inverted file, product-quantised residuals, exact reranking.

A further component sqrt(M^2 - |x|^2), M the largest norm of all, makes the nearest vector the one of the
largest inner product. Vectors go to the nearest of the coarse centroids; what is left of them is kept as one code of 256 for each
SUB components. A query looks into the lists of its nearest centroids and takes its score with every vector there from asymmetric
tables: its inner products with all centroids and codes, summed by the vector's list and codes. Whoever comes within a margin of the k-th
best of these is scored in double precision, component by component, on the original vector. The margin is a score and not a number of candidates, so
however many near-copies have one code, all are reranked.

Two things shorten the work and lose nothing. Of exactly equal vectors in a chunk the k + 1 smallest ids stand for
all. And the k-th best score with the sample's vectors in the lists looked into is a bound below which no other is kept.

Centroids and codes are fitted on the driver on at most ``SAMPLE`` vectors, chosen by a hash
of vec_id. The number of lists to look into is the least that finds ``TARGET`` of the true neighbours of ``ASKED``
queries, which brute force over all rows tells; and the margin is twice what the tables' scores of ``SURE`` of these neighbours
are off by. Every vector is indexed. Lists are laid out in chunks of at most
about ``CHUNK`` vectors, a large list in several, and queries in blocks, so that a task holds one chunk and
one block at a time whatever the number of either.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length
from most, and null ids take no part; of rows with one vec_id the least vector counts; equal scores
go by the smaller vec_id; with fewer candidates than k a query has all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from marlstone.llm import common

SAMPLE, ROUNDS, TARGET, SURE = 16_000, 8, 0.98, 0.999
#: Components a code stands for, and codes.
SUB, CODES = 4, 256
#: Queries whose true neighbours set the number of lists to look into.
ASKED = 200
CHUNK, BLOCK = 8192, 1024
#: Queries that are scored with a chunk at once.
PART = 256
#: Below this many vectors there is one list.
FEW = 4096
MAX_LISTS = 4096


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The index of the nearest centre of each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        for j in range(x.shape[1]):
            sums = np.bincount(own, x[:, j], k)
            centres[:, j] = np.where(counts > 0, sums / np.maximum(counts, 1), centres[:, j])
    return centres


@dataclass
class Index:
    """What is fitted: coarse centroids, lists to look into, the chunks of each list; and the sample with its ids and lists."""

    largest: float
    centres: np.ndarray
    probes: int
    ids: np.ndarray
    sample: np.ndarray
    own: np.ndarray
    books: list[np.ndarray] | None = None
    margin: float = np.inf
    first_chunk: np.ndarray | None = None
    salts: np.ndarray | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the further component."""
        return np.column_stack([x, np.sqrt(np.maximum(self.largest**2 - (x**2).sum(axis=1), 0))])

    def encode(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The codes of what the vectors' centroids leave of them, a row each."""
        rest = x - self.centres[own, :-1]
        return np.column_stack([nearest(rest[:, SUB * j : SUB * (j + 1)], book) for j, book in enumerate(self.books)]).astype(np.uint8)

    def scores(self, queries: np.ndarray, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Queries by vectors: inner products with the vectors' centroids and codes, from tables."""
        out = (queries @ self.centres[:, :-1].T)[:, own]
        for j, book in enumerate(self.books):
            out += (queries[:, SUB * j : SUB * (j + 1)] @ book.T)[:, codes[:, j]]
        return out

    def order(self, queries: np.ndarray) -> np.ndarray:
        """All lists in the order in which each query looks into them; its further component is zero."""
        score = queries @ self.centres[:, :-1].T - (self.centres**2).sum(axis=1) / 2
        return np.argsort(-score, axis=1, kind="stable")

    def looked(self, queries: np.ndarray) -> np.ndarray:
        """Queries by lists: whether each query looks into each list."""
        out = np.zeros((len(queries), len(self.centres)), bool)
        np.put_along_axis(out, self.order(queries)[:, : self.probes], True, axis=1)
        return out

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """More than what two ways of summing an inner product can differ by."""
        return 1e-15 * queries.shape[1] * self.largest * np.sqrt((queries**2).sum(axis=1))

    def floors(self, q_ids: np.ndarray, queries: np.ndarray, looked: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that at least k others reach in the lists it looks into, or -inf."""
        out = np.full(len(queries), -np.inf)
        if len(self.ids) >= k:
            for i in range(0, len(queries), PART):
                at = slice(i, i + PART)
                s = queries[at] @ self.sample.T
                s[~looked[at][:, self.own] | (q_ids[at, None] == self.ids)] = -np.inf
                out[at] = np.partition(s, -k, axis=1)[:, -k]
        return out - self.slack(queries)


def first_copies(x: np.ndarray, n: int) -> np.ndarray:
    """The places of the first n of each group of equal rows, in order."""
    rows = np.ascontiguousarray(x + 0.0)  # -0.0 equals 0.0
    _, group = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    ranked, places = group[by_group], np.arange(len(group))
    new = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
    return np.sort(by_group[places - np.maximum.accumulate(np.where(new, places, 0)) < n])


def best_of(index: Index, q_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, looked: np.ndarray, ids: np.ndarray, own: np.ndarray, codes: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, vec_id, score) of the k best of x, by score and then id, for each query; none below its floor."""
    s = index.scores(queries, own, codes)
    s[~looked[:, own] | (q_ids[:, None] == ids)] = -np.inf
    least = floors - index.margin / 2  # what the tables make of a score at the floor
    many = np.flatnonzero((s >= least[:, None]).sum(axis=1) > k)
    if len(many):
        least[many] = np.maximum(least[many], np.partition(s[many], -k, axis=1)[:, -k] - index.margin)
    row, col = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    exact = np.zeros(len(row))
    for j in range(x.shape[1]):
        exact += queries[row, j] * x[col, j]
    best = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[best], col[best], exact[best]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, col, exact = row[kept], col[kept], exact[kept]
    reach = exact >= floors[row]
    return row[reach], ids[col[reach]], exact[reach]


def fit(ids: np.ndarray, sample: np.ndarray, n: int, largest: float, seed: int = 1) -> Index:
    rng = np.random.default_rng(seed)
    index = Index(largest, np.zeros((1, 1)), 1, ids, sample, np.zeros(0, np.int64))
    lifted = index.lift(sample)
    lists = 1 if n < FEW else min(MAX_LISTS, int(n**0.5))
    index.centres = k_means(lifted, lists, rng)
    index.own = nearest(lifted, index.centres)
    index.probes = lists
    rest = sample - index.centres[index.own, :-1]
    index.books = [k_means(rest[:, i : i + SUB], CODES, rng) for i in range(0, rest.shape[1], SUB)]
    return index


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, floats as floats and others as doubles, one a vec_id."""
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    v = F.transform("embedding", lambda x: x.cast(kind))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v")).where(~bad & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return rows


def build(rows: DataFrame) -> tuple[Index | None, int]:
    """Fit on a bounded sample; the index and the number of components."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return None, 0
    chosen = common.hash_sample(rows.where(F.size("v") == dims["d"]), "vec_id", SAMPLE)
    got = list(chosen.select("vec_id", "v").toLocalIterator())
    ids, sample = np.array([r["vec_id"] for r in got], np.int64), np.array([r["v"] for r in got], np.float64)
    return fit(ids, sample, dims["n"], float(dims["m"]) ** 0.5), dims["d"]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def tune(index: Index, coded: DataFrame, queries: DataFrame, k: int) -> None:
    """Set the least number of lists with ``TARGET`` of the k true neighbours, among all of ``coded``, of ``ASKED`` of the queries, and the margin."""
    got = queries.select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(ASKED).collect()
    if not got:
        return
    asked = coded.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in got], np.int64), np.array([r["v"] for r in got], np.float64)))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = asked.value
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, id, list, score
        for b in batches:
            if b.num_rows:
                ids = b.column(0).to_numpy()
                s = q @ _matrix(b.column(2)).T
                s[q_ids[:, None] == ids] = -np.inf
                row, col = np.nonzero(np.isfinite(s) & (s >= np.partition(s, -min(k, len(ids)), axis=1)[:, -min(k, len(ids)), None]))
                new = (row, ids[col], b.column(1).to_numpy()[col].astype(np.int64), s[row, col])
                row, found, own, score = (np.concatenate(x) for x in zip(kept, new))
                best = np.lexsort((found, -score, row))
                best = best[np.arange(len(row)) - np.searchsorted(row[best], row[best]) < k]
                kept = row[best], found[best], own[best], score[best]
        yield pa.RecordBatch.from_pydict(dict(zip(("query", "vec_id", "list", "score"), map(pa.array, kept))))

    near = common.map_arrow(coded.select("vec_id", "list", "v"), brute, "query long, vec_id long, list long, score double")
    true = near.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= k)
    rows = true.join(coded.select("vec_id", "codes"), "vec_id").select("query", "list", "score", "codes").collect()  # at most ASKED times k
    if not rows:
        return
    codes = np.array([list(r["codes"]) for r in rows], np.uint8)
    told = index.scores(asked.value[1], np.array([r["list"] for r in rows]), codes)[[r["query"] for r in rows], np.arange(len(rows))]
    index.margin = 2 * float(np.quantile(np.abs(told - np.array([r["score"] for r in rows])), SURE, method="higher"))
    places = np.argsort(index.order(asked.value[1]), axis=1)  # the place of each list in a query's order
    needed = places[[r["query"] for r in rows], [r["list"] for r in rows]]
    index.probes = min(len(index.centres), int(np.quantile(needed, TARGET, method="higher")) + 1)


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each vector for which the column ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = common.materialise(valid(vectors), "vectors")
    index, d = build(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == d)
    fitted = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids and SAMPLE vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = fitted.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                own = nearest(ix.lift(x), ix.centres)
                codes = [c.tobytes() for c in ix.encode(x, own)]
                yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "list": pa.array(own.astype(np.int32)), "codes": pa.array(codes, pa.binary()), "v": b.column(1)})

    kind = rows.schema["v"].dataType.simpleString()
    coded = common.materialise(common.map_arrow(rows, assign, f"vec_id long, list int, codes binary, v {kind}"), "lists")
    tune(index, coded, coded.where(is_query), k)
    sizes = np.zeros(len(index.centres), np.int64)
    for r in coded.groupBy("list").count().collect():  # at most MAX_LISTS rows
        sizes[r["list"]] = r["count"]
    index.salts = np.maximum(1, -(-sizes // CHUNK))
    index.first_chunk = np.zeros(len(sizes), np.int64)
    chunk, filled = -1, CHUNK
    for i, (s, n) in enumerate(zip(index.salts.tolist(), sizes.tolist())):  # small lists share a chunk, large ones have several
        if s > 1 or filled + n > CHUNK:
            chunk, filled = chunk + 1, 0
        index.first_chunk[i] = chunk
        chunk, filled = (chunk + s - 1, CHUNK) if s > 1 else (chunk, filled + n)
    full = spark.sparkContext.broadcast(index)
    at = spark.createDataFrame([(i, int(c), int(s)) for i, (c, s) in enumerate(zip(index.first_chunk, index.salts))], "list int, first long, salts long")
    placed = coded.join(F.broadcast(at), "list").withColumn("chunk", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("salts")))
    chunks = placed.groupBy("chunk").agg(F.collect_list(F.struct("vec_id", "list", "codes", "v")).alias("rows"))
    chunks = chunks.select("chunk", F.col("rows.vec_id").alias("ids"), F.col("rows.list").alias("lists"), F.col("rows.codes").alias("codes"), F.flatten("rows.v").alias("x"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = full.value
        for b in (x.slice(i, BLOCK) for x in batches for i in range(0, x.num_rows, BLOCK)):
            if b.num_rows:
                q, ids = _matrix(b.column(1)), b.column(0).to_numpy()
                looked = ix.looked(q)
                floors = ix.floors(ids, q, looked, k)
                lists = np.flatnonzero(looked.any(axis=0))
                wanted = sorted({c + s for c, n in zip(ix.first_chunk[lists].tolist(), ix.salts[lists].tolist()) for s in range(n)})
                one = [pa.ListArray.from_arrays([0, len(x)], pa.array(x)) for x in (ids, q.ravel(), floors)]
                for c in wanted:
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), *one], ["chunk", "q_ids", "q", "floors"])

    asked = common.map_arrow(coded.where(is_query).select("vec_id", "v"), blocks, "chunk long, q_ids array<long>, q array<double>, floors array<double>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = full.value
        for b in batches:
            for r in range(b.num_rows):
                ids, own, x, q_ids, q, floors = (b.column(c)[r].values.to_numpy() for c in ("ids", "lists", "x", "q_ids", "q", "floors"))
                codes = np.frombuffer(b"".join(b.column("codes")[r].values.to_pylist()), np.uint8).reshape(len(ids), -1)
                by_id = np.argsort(ids, kind="stable")
                ids, own, codes, x = ids[by_id], own[by_id], codes[by_id], x.reshape(len(ids), -1)[by_id]
                few = first_copies(x, k + 1)  # equal vectors score alike, and the smaller ids win
                ids, own, codes, x = ids[few], own[few], codes[few], x[few].astype(np.float64)
                q = q.reshape(len(q_ids), -1)
                for i in range(0, len(q), PART):
                    part = q[i : i + PART]
                    row, found, score = best_of(ix, q_ids[i : i + PART], part, floors[i : i + PART], ix.looked(part), ids, own, codes, x, k)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[i + row]), "vec_id": pa.array(found), "score": pa.array(score)})

    found = common.map_arrow(asked.join(chunks, "chunk").select("ids", "lists", "codes", "x", "q_ids", "q", "floors"), scan, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
