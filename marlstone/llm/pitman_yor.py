"""Scoring by a hierarchical Pitman-Yor language model, learned from the corpus itself.

Each context word has a restaurant, whose dishes are the words that follow it; all share one parent, the
restaurant of single words, whose customers are their tables. The parent's base is a diffuse measure: what
is new there is the unknown word, and a known word has one table there.

Seating is sampled by Gibbs. Given the parent's distribution and one Gamma variable a restaurant, the numbers
of tables of all dishes are independent (the Gamma integral takes the place of the product that couples the
dishes of a restaurant), so a sweep draws in turn: the Gamma variable of every restaurant given its tables, the
parent's distribution given all tables (Dirichlet), and then the tables of every dish of every restaurant from
their exact conditional, with generalised Stirling numbers up to STIRLING customers and beyond from the
binomial law that the conditional tends to. Each sweep uses the totals of the sweep before, over the whole corpus. After
BURN sweeps, SAMPLES states are kept; the predictive probabilities of a token, given each state's seating, are averaged.

Layout. Texts are cut into slices of about FLUSH tokens. Words are numbered, by falling count, in parts by their hash.
Of a slice only the distinct pairs (context, word) travel, with their training counts, to buckets by the hash
of the pair, so that no word and no context is a hot key; the order of its tokens stays in a file of the shared
folder. Buckets ask parts for the totals of their contexts and words once a sweep. At the end buckets
send each slice the scores of its pairs. All moves are Spark exchanges of packed arrays, linear in the input;
files are one a slice, part or bucket, written under another name and renamed, and hold the same if a task is repeated.

Defined cases: a null text is empty and has the end token alone; a null doc_id counts as the empty text and
learns; repeated rows each count and are each scored; an empty table gives no rows, and without training
documents all words are unknown; further columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common, features

SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text a bucket, buckets a part, tokens a slice, bytes of text that are taken apart at once.
BUCKET, PER_PART, FLUSH, SLICE_BYTES = 24 << 20, 4, 2_000_000, 2 << 20
BURN, SAMPLES = 2, 3
#: Concentrations of the contexts' restaurants and of the parent.
THETA = (1.0, 1.0)
#: Customers up to which the exact conditional is tabulated.
STIRLING = 300
END = np.uint64(2)
#: Numbers that stand for no word: the start of a text as a context, and any word without training count.
START, UNKNOWN, FIRST = 0, 1, 2
#: Scores of pairs travel as whole numbers of these.
UNIT = 1e-5
MODULUS, HELD_OUT = 7, 2

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def learns(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS != HELD_OUT


# ---- packing


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed; sorted 64-bit arrays as differences. Bytes of equal weight lie together."""
    out = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        diffs = a.dtype == np.uint64
        raw = np.ascontiguousarray(np.diff(a, prepend=np.uint64(0)) if diffs else a)
        planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T.tobytes()
        small = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out += [raw.dtype.str.encode().ljust(4), np.array([diffs, len(raw), len(small)], "<u4").tobytes(), small]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    arrays, at = [], 4
    for _ in range(int(np.frombuffer(blob, "<u4", 1)[0])):
        kind = np.dtype(blob[at : at + 4].decode().strip())
        diffs, n, size = (int(x) for x in np.frombuffer(blob, "<u4", 3, at + 4))
        at += 16
        if n:
            planes = pa.decompress(blob[at : at + size], n * kind.itemsize, "zstd", asbytes=True)
            raw = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel()
            arrays.append(np.cumsum(raw, dtype=np.uint64) if diffs else raw)
        else:
            arrays.append(np.zeros(0, kind))
        at += size
    return arrays


def _narrow(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


# ---- tokens


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, each text's followed by END, and the counts."""
    import xxhash

    words = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SPACES)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    codes = coded.indices.to_numpy()
    real = np.array([w != "" for w in distinct], bool)[codes]
    counts = np.diff(np.concatenate([[0], np.cumsum(real)])[words.offsets.to_numpy()])
    return np.insert(hashes[codes[real]], np.cumsum(counts), END), counts + 1


# ---- files of the shared folder


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(out_dir: str, name: str, blob: bytes) -> None:
    store, base = _filesystem(out_dir)
    store.create_dir(base, recursive=True)
    task = TaskContext.get()
    own = f"{base}/.{name}.{task.taskAttemptId() if task else 0}"
    with store.open_output_stream(own) as f:
        f.write(blob)
    store.move(own, f"{base}/{name}")


def _get(out_dir: str, name: str) -> list[np.ndarray]:
    store, base = _filesystem(out_dir)
    with store.open_input_file(f"{base}/{name}") as f:
        return _unpack(f.read())


# ---- draws that every bucket repeats alike


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    h = _mix(keys * _G + _mix(np.array([salt], np.uint64)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """A Gamma variable for each key, the same wherever it is drawn (Marsaglia and Tsang's method)."""
    low = shape < 1
    a = np.where(low, shape + 1, shape)
    d = a - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left, turn = np.zeros(len(a)), np.arange(len(a)), 0
    while len(left):
        u, v, w = (_uniform(keys[left], (seed << 16) + 4 * turn + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = (1 + c[left] * x) ** 3
        ok = cube > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            ok &= np.log(w) < 0.5 * x * x + d[left] * (1 - cube + np.log(np.where(cube > 0, cube, 1)))
        out[left[ok]] = d[left[ok]] * cube[ok]
        left, turn = left[~ok], turn + 1
    own = np.flatnonzero(low)
    out[own] *= _uniform(keys[own], (seed << 16) + 3) ** (1 / np.maximum(shape[own], 1e-3))
    return out


# ---- seating


def log_stirling(d: float, most: int = STIRLING) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) of discount d, for c and t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c, t] + np.log(np.maximum(c - t * d, 0))
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def limit_law(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of t - 1 that P(t) ~ S(c, t) a^t tends to: at c = STIRLING the mean of t is within 2 % of the exact one.

    S(c, t) a^t / c! is the coefficient of z^c in (a (1 - (1 - z)^d) / d)^t / t!: t tables, Poisson in number, of
    sizes that sum to c. z is chosen so that the expected sum is c."""
    low, high = np.zeros(len(c)), np.ones(len(c))  # of 1 - z
    for _ in range(60):
        y = (low + high) / 2
        more = a * (1 - y) * y ** (d - 1) > c
        low, high = np.where(more, y, low), np.where(more, high, y)
    y = (low + high) / 2
    mean = a * (1 - y**d) / d
    return mean, np.maximum(mean - c**2 / (c + a * (1 - y) ** 2 * (1 - d) * y ** (d - 2)), 0)


def sample_tables(c: np.ndarray, a: np.ndarray, d: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with c customers, each with P(t) ~ S(c, t) a^t; a is what a table weighs."""
    t = (c > 0).astype(np.int64)
    by_count = np.argsort(c, kind="stable")
    counts, firsts = np.unique(c[by_count], return_index=True)
    log_a = np.log(np.maximum(a, 1e-300))
    for n, same in zip(counts.tolist(), np.split(by_count, firsts[1:])):
        if 2 <= n <= STIRLING:
            for own in np.array_split(same, -(-len(same) * n // 1_000_000)):
                weight = stirling[n, 1 : n + 1] + log_a[own][:, None] * np.arange(1, n + 1)
                chance = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                t[own] = 1 + (chance < (rng.random(len(own)) * chance[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(c > STIRLING)
    if len(many):
        mean, variance = limit_law(c[many].astype(np.float64), np.maximum(a[many], 1e-12), d)
        trials = np.rint(mean / np.maximum(1 - variance / mean, 1e-9)).astype(np.int64) + 1  # a binomial law of this mean and variance
        t[many] = np.minimum(1 + rng.binomial(trials, np.minimum(mean / trials, 1.0)), c[many])
    return t


@dataclass
class Totals:
    """Of the whole corpus: training tokens, known words, discounts; and of a state the tables and the sum of the parent's Gamma variables."""

    n: int
    vocabulary: int
    d1: float = 0.5
    d0: float = 0.5
    tables: int = 0
    gammas: float = 0.0


def parent_draws(words: np.ndarray, customers: np.ndarray, d0: float, seed: int) -> np.ndarray:
    """Unnormalised weights of known words in the parent, given their customers."""
    return np.where(customers > 0, gamma(np.maximum(customers - d0, 1e-2), words.astype(np.uint64), 2 * seed + 1), 0.0)


def draw(c: np.ndarray, word: np.ndarray, context: np.ndarray, words: np.ndarray, contexts: np.ndarray, tables_of: np.ndarray, customers_of: np.ndarray, total: Totals, seed: int, rng: np.random.Generator, stirling: np.ndarray) -> np.ndarray:
    """One sweep's tables of some pairs; tables_of and customers_of: the last state's totals of the contexts and of the words."""
    x = gamma(THETA[0] / total.d1 + tables_of, contexts.astype(np.uint64), 2 * seed)
    beta = parent_draws(words, customers_of, total.d0, seed)
    rest = np.random.default_rng([seed, 7]).gamma(THETA[1] + total.d0 * total.vocabulary)
    return sample_tables(c, total.d1 * x[context] * beta[word] / (total.gammas + rest), total.d1, stirling, rng)


def predictive(c: np.ndarray, t: np.ndarray, word: np.ndarray, context: np.ndarray, known: np.ndarray, customers_of: np.ndarray, count_of: np.ndarray, tables_of: np.ndarray, total: Totals) -> np.ndarray:
    """Probabilities of pairs given a state's seating."""
    new = (THETA[1] + total.d0 * total.vocabulary) / (THETA[1] + total.tables)
    p = np.where(known, (customers_of - total.d0) / (THETA[1] + total.tables), new)
    return (np.maximum(c - total.d1 * t, 0) + (THETA[0] + total.d1 * tables_of[context]) * p[word]) / (THETA[0] + count_of[context])


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.5


# ---- the passes

MOVED = "part long, other string, blob binary, s0 long, s1 long, s2 long, s3 long"


def _row(part: int, other: str, blob: bytes, *sums: int) -> tuple:
    return (part, other, blob, *(int(x) for x in sums), *([0] * (4 - len(sums))))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "other", "blob", "s0", "s1", "s2", "s3"])


def _grouped(df: DataFrame, key: str, parts: int):
    return df.repartition(parts, key).groupBy(key)


def _sums(moved: DataFrame) -> list[int]:
    return [x or 0 for x in moved.agg(*(F.sum(f"s{i}") for i in range(4))).first()]


def slices(out_dir: str, parts: int):
    """Pass over the texts: a file for each slice, and its distinct words to the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number, place = [], 0, 0, TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            w, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            ids = [i for x in held for i in x[2]]
            words, codes = np.unique(w, return_inverse=True)
            train = np.repeat(np.array([learns(i) for i in ids], bool), n)
            counts = np.bincount(codes, train, len(words)).astype(np.int64)
            name = f"{place:06d}-{number:04d}"
            null = np.array([i is None for i in ids], np.uint8)
            _put(f"{out_dir}/slices", name, _pack(np.diff(np.array([i or 0 for i in ids], np.int64), prepend=0), null, _narrow(n), _narrow(codes)))
            part = ((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # ranges of the hash
            bounds = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
            rows = [_row(q, name, _pack(words[i:j], _narrow(counts[i:j]))) for q, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_pandas(_frame(rows), preserve_index=False)

        for b in batches:
            for i, k in features.slices(b.column(1), SLICE_BYTES):
                w, n = tokens(b.column(1).slice(i, k))
                held.append((w, n, b.column(0).slice(i, k).to_pylist()))
                size += len(w)
                if size >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return run


def number(group: pd.DataFrame) -> pd.DataFrame:
    """A part counts its words and numbers the known ones by falling count; the answers are in the order of the requests."""
    q = int(group["part"].iloc[0])
    asked = [_unpack(x) for x in group["blob"]]
    words, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([a[1] for a in asked]), len(words)).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    index = np.empty(len(words), np.int64)
    index[order] = np.arange(len(words))
    ends = np.cumsum([len(a[0]) for a in asked])
    rows = [_row(q, "", b"", counts.sum(), (counts > 0).sum())]
    for name, end, (own, _) in zip(group["other"], ends, asked):
        mine = at[end - len(own) : end]
        rows.append(_row(q, name, _pack(_narrow(index[mine]), _narrow(counts[mine]))))
    return _frame(rows)


def pairs_of(out_dir: str, parts: int, buckets: int, total: Totals):
    """A slice learns the numbers of its words and sends its distinct pairs to the buckets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name = group["other"].iloc[0]
        ids, null, n, codes = _get(f"{out_dir}/slices", name)
        numbers, counts = [], []
        for q, blob in sorted(zip(group["part"], group["blob"])):
            index, c = _unpack(blob)
            numbers.append(np.where(c > 0, index.astype(np.int64) * parts + q + FIRST, UNKNOWN))
            counts.append(c.astype(np.int64))
        numbers, counts = np.concatenate(numbers), np.concatenate(counts)
        base = np.log10((counts + 1) / (total.n + total.vocabulary + 1))
        row = np.repeat(np.arange(len(n)), n)
        n_known, base_sum = np.bincount(row, (counts > 0)[codes], len(n)), np.bincount(row, base[codes], len(n))
        # pairs by places among this slice's numbers
        distinct, short = np.unique(np.append(numbers, [START, UNKNOWN]), return_inverse=True)
        w = short[codes]
        u = np.append(0, w[:-1])  # START is the least
        u[np.cumsum(n, dtype=np.int64)[:-1]] = 0
        pairs, at = np.unique(w * len(distinct) + u, return_inverse=True)
        real = np.cumsum(ids)
        learned = np.array([learns(None if z else i) for i, z in zip(real.tolist(), null.tolist())], bool)
        c = np.bincount(at, learned[row], len(pairs)).astype(np.int64)
        w, u = distinct[pairs // len(distinct)], distinct[pairs % len(distinct)]
        bucket = (_mix(_mix(w.astype(np.uint64)) + u.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        _put(out_dir, f"order-{name}", _pack(ids, null, n, _narrow(n_known.astype(np.int64)), base_sum, _narrow(place[at])))
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b, (i, j) in enumerate(zip(bounds, bounds[1:])):
            if j > i:
                own = order[i:j]
                rows.append(_row(b, name, _pack(w[own].astype(np.uint64), _narrow(u[own]), _narrow(c[own]))))
        return _frame(rows)

    return run


def _by_part(ids: np.ndarray, parts: int) -> list[np.ndarray]:
    """The places of the ids of each part."""
    part = np.where(ids < FIRST, 0, (ids - FIRST) % parts)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


def gather(out_dir: str, parts: int):
    """A bucket merges what all slices know of its pairs, and asks the parts for the first totals."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("other")
        b = int(group["part"].iloc[0])
        got = [_unpack(x) for x in group["blob"]]
        w, u, c = (np.concatenate([g[i].astype(np.int64) for g in got]) for i in range(3))
        sizes = np.array([len(g[0]) for g in got], np.int64)
        words, w = np.unique(w, return_inverse=True)
        contexts, u = np.unique(u, return_inverse=True)
        pairs, at = np.unique(w * len(contexts) + u, return_inverse=True)
        c = np.bincount(at, c, len(pairs)).astype(np.int64)
        word, context = pairs // len(contexts), pairs % len(contexts)
        names = np.frombuffer("".join(group["other"]).encode(), np.uint8)
        steps = [np.diff(x, prepend=0) for x in np.split(at, np.cumsum(sizes)[:-1])]  # each slice's pairs are in order
        _put(out_dir, f"bucket-{b}", _pack(words.astype(np.uint64), contexts.astype(np.uint64), _narrow(np.diff(word, prepend=0)), _narrow(context), _narrow(c), sizes, names, _narrow(np.concatenate(steps))))
        one = (c > 0).astype(np.int64)
        count, types, customers = np.bincount(context, c, len(contexts)), np.bincount(context, one, len(contexts)), np.bincount(word, one, len(words))
        rows = [_row(-1, "", b"", (c == 1).sum(), (c == 2).sum())]
        for q, (i, j) in enumerate(zip(_by_part(contexts, parts), _by_part(words, parts))):
            if len(i) + len(j):
                rows.append(_row(q, str(b), _pack(contexts[i].astype(np.uint64), _narrow(count[i]), _narrow(types[i]), words[j].astype(np.uint64), _narrow(customers[j]))))
        return _frame(rows)

    return run


@dataclass
class Bucket:
    words: np.ndarray
    contexts: np.ndarray
    word: np.ndarray
    context: np.ndarray
    c: np.ndarray
    slices: list[tuple[str, np.ndarray]]


def read_bucket(out_dir: str, b: int) -> Bucket:
    words, contexts, word, context, c, sizes, names, steps = _get(out_dir, f"bucket-{b}")
    names = names.tobytes().decode()
    width = len(names) // max(1, len(sizes))
    each = [(names[i * width : (i + 1) * width], np.cumsum(x, dtype=np.int64)) for i, x in enumerate(np.split(steps, np.cumsum(sizes)[:-1]))]
    return Bucket(words.astype(np.int64), contexts.astype(np.int64), np.cumsum(word, dtype=np.int64), context.astype(np.int64), c.astype(np.int64), each)


def _totals(ids: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct ids, their sums, and the sums in the order of each request."""
    distinct, at = np.unique(np.concatenate(ids), return_inverse=True)
    sums = np.bincount(at, np.concatenate(values), len(distinct)).astype(np.int64)
    return distinct, sums, np.split(sums[at], np.cumsum([len(x) for x in ids])[:-1])


def first_totals(out_dir: str):
    """A part keeps which ids each bucket asks for, and answers with the totals of counts, tables and customers."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        q = int(group["part"].iloc[0])
        asked = [_unpack(x) for x in group["blob"]]
        _put(out_dir, f"part-{q}", _pack(np.array([int(b) for b in group["other"]], np.int64), *(a[i] for a in asked for i in (0, 3))))
        contexts, words = [a[0].astype(np.int64) for a in asked], [a[3].astype(np.int64) for a in asked]
        _, _, count = _totals(contexts, [a[1] for a in asked])
        _, _, tables = _totals(contexts, [a[2] for a in asked])
        _, sums, customers = _totals(words, [a[4] for a in asked])
        rows = [_row(q, "", b"", sums.sum(), 0, (sums == 1).sum(), (sums == 2).sum())]
        rows += [_row(q, b, _pack(_narrow(x), _narrow(y), _narrow(z))) for b, x, y, z in zip(group["other"], count, tables, customers)]
        return _frame(rows)

    return run


GAMMA_UNIT = 2.0**-10


def gamma_sum(words: np.ndarray, customers: np.ndarray, d0: float, seed: int) -> int:
    """The sum of the parent's Gamma variables, as a whole number of units, so that the order of summation is all one."""
    return int(np.rint(parent_draws(words, customers, d0, seed) / GAMMA_UNIT).sum())


def next_totals(out_dir: str, total: Totals, seed: int):
    """A part sums a state's tables; and the Gamma variables that the next sweep will draw from it."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        q = int(group["part"].iloc[0])
        buckets, *ids = _get(out_dir, f"part-{q}")
        of = {b: (ids[2 * i].astype(np.int64), ids[2 * i + 1].astype(np.int64)) for i, b in enumerate(buckets.tolist())}
        asked = [_unpack(x) for x in group["blob"]]
        mine = [of[int(b)] for b in group["other"]]
        _, _, tables = _totals([x[0] for x in mine], [a[0] for a in asked])
        words, sums, customers = _totals([x[1] for x in mine], [a[1] for a in asked])
        rows = [_row(q, "", b"", sums.sum(), gamma_sum(words, sums, total.d0, seed))]
        rows += [_row(q, b, _pack(_narrow(x), _narrow(y))) for b, x, y in zip(group["other"], tables, customers)]
        return _frame(rows)

    return run


def _answered(bk: Bucket, group: pd.DataFrame, parts: int) -> list[np.ndarray]:
    """Totals from all parts, of contexts, and last of words."""
    contexts, words = _by_part(bk.contexts, parts), _by_part(bk.words, parts)
    out: list[np.ndarray] = []
    for q, blob in zip(group["part"], group["blob"]):
        got = _unpack(blob)
        out = out or [*(np.zeros(len(bk.contexts), np.int64) for _ in got[1:]), np.zeros(len(bk.words), np.int64)]
        for x, v in zip(out, got):
            x[(words if x is out[-1] else contexts)[q]] = v
    return out


def sweep(out_dir: str, parts: int, total: Totals, seed: int, name: str):
    """A bucket draws the tables of all its pairs, keeps them, and sends the parts its sums."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        b = int(group["other"].iloc[0])
        bk = read_bucket(out_dir, b)
        *_, tables_of, customers_of = _answered(bk, group, parts)
        t = draw(bk.c, bk.word, bk.context, bk.words, bk.contexts, tables_of, customers_of, total, seed, np.random.default_rng([seed, b]), log_stirling(total.d1))
        _put(out_dir, f"{name}-{b}", _pack(_narrow(t)))
        tables, customers = np.bincount(bk.context, t, len(bk.contexts)), np.bincount(bk.word, t, len(bk.words))
        own = enumerate(zip(_by_part(bk.contexts, parts), _by_part(bk.words, parts)))
        return _frame([_row(q, str(b), _pack(_narrow(tables[i]), _narrow(customers[j]))) for q, (i, j) in own if len(i) + len(j)])

    return run


def judge(out_dir: str, parts: int, states: list[tuple[str, Totals]]):
    """A bucket averages its pairs' probabilities over the kept states and sends each slice those of its pairs."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        b = int(group["other"].iloc[0])
        bk = read_bucket(out_dir, b)
        count_of, _, _ = _answered(bk, group[group["state"] == -1], parts)
        mean = np.zeros(len(bk.c))
        for s, (name, total) in enumerate(states):
            tables_of, customers_of = _answered(bk, group[group["state"] == s], parts)
            t = _get(out_dir, f"{name}-{b}")[0].astype(np.int64)
            mean += predictive(bk.c, t, bk.word, bk.context, bk.words >= FIRST, customers_of, count_of, tables_of, total) / len(states)
        score = _narrow(np.rint(np.log10(mean) / -UNIT).astype(np.int64))
        return _frame([_row(b, name, _pack(score[own])) for name, own in bk.slices])

    return run


def merge(out_dir: str):
    """The rows of a slice, with the sums of its tokens' scores."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, null, n, n_known, base, place = _get(out_dir, f"order-{group['other'].iloc[0]}")
        score = np.concatenate([_unpack(x)[0].astype(np.int64) for _, x in sorted(zip(group["part"], group["blob"]))])
        row = np.repeat(np.arange(len(n)), n)
        sums = np.bincount(row, score[place], len(n))
        out = pd.DataFrame({"doc_id": pd.array(np.cumsum(ids), "Int64"), "n_tokens": n.astype(np.int64), "n_known": n_known.astype(np.int64), "base_score": base, "score": -sums * UNIT})
        out.loc[null.astype(bool), "doc_id"] = pd.NA
        return out

    return run


def score(docs: DataFrame, seed: int = 1, bucket_bytes: int | None = None, burn: int = BURN, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(1, -(-size // (bucket_bytes or BUCKET))))
    parts = max(1, buckets // PER_PART)
    out_dir = common.scratch_path(spark, "pitman-yor")

    asked = common.map_arrow(docs, slices(out_dir, parts), MOVED)
    numbered = common.materialise(_grouped(asked, "part", parts).applyInPandas(common.frugal_group(number), MOVED), "numbers")
    n, vocabulary, _, _ = _sums(numbered)
    total = Totals(n, vocabulary)
    answers = numbered.where("other <> ''")
    n_slices = max(1, answers.agg(F.countDistinct("other")).first()[0])
    pairs = _grouped(answers, "other", n_slices).applyInPandas(common.frugal_group(pairs_of(out_dir, parts, buckets, total)), MOVED)
    asked = common.materialise(_grouped(pairs, "part", buckets).applyInPandas(common.frugal_group(gather(out_dir, parts)), MOVED), "asked")
    common.remove(spark, f"{out_dir}/slices")
    ones, twos, _, _ = _sums(asked)
    total.d1 = _discount(ones, twos)
    first = common.materialise(_grouped(asked.where("part >= 0"), "part", parts).applyInPandas(common.frugal_group(first_totals(out_dir)), MOVED), "totals")
    total.tables, _, ones, twos = _sums(first)
    total.d0 = _discount(ones, twos)

    # the first state has one table a pair; its Gamma variables are not summed yet
    answers, states = first.where("other <> ''"), []
    total.gammas = float(max(0.0, total.tables - total.d0 * total.vocabulary))  # their expectation
    for k in range(burn + samples):
        own, name = seed * 1000 + k, f"tables{k}"
        sent = _grouped(answers, "other", buckets).applyInPandas(common.frugal_group(sweep(out_dir, parts, total, own, name)), MOVED)
        state = common.materialise(_grouped(sent, "part", parts).applyInPandas(common.frugal_group(next_totals(out_dir, total, own + 1)), MOVED), "totals")
        tables, gammas, _, _ = _sums(state)
        total = Totals(n, vocabulary, total.d1, total.d0, tables, gammas * GAMMA_UNIT)
        answers = state.where("other <> ''")
        if k >= burn:
            states.append((name, total, answers))
    marked = first.where("other <> ''").withColumn("state", F.lit(-1))
    for s, (_, _, a) in enumerate(states):
        marked = marked.unionByName(a.withColumn("state", F.lit(s)))
    judged = _grouped(marked, "other", buckets).applyInPandas(common.frugal_group(judge(out_dir, parts, [x[:2] for x in states])), MOVED)
    merged = _grouped(judged, "other", n_slices).applyInPandas(common.frugal_group(merge(out_dir)), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return merged.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
