"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text is cut into units: a word with the spaces before it (as U+2581), or with the line break before
it. Within a unit the agenda repeatedly takes the best candidate merge (best score, then leftmost). A
candidate whose keyed hash - of the seed, the unit, the document, the unit's place in it, where the
candidate starts and what it makes - falls below the dropout rate is skipped. So every occurrence of a
word is cut by decisions of its own, and the same input and seed always give the same ids.

The agenda is a heap, so a unit of n characters takes n log n steps however long it is. What the
decisions of an occurrence lead to does not depend on the document, so a worker keeps the decisions it
has met for a unit as a tree: each node is a candidate, its two branches are to merge and to skip, its
leaves are segmentations. All occurrences of a batch walk down their trees together, one hash a step,
as array operations; only those that leave a tree go through the agenda, and extend it. The trees are
a cache of bounded size and change no result.

Nothing is normalised. Characters without a piece, and U+2581 itself, become byte pieces, so decoding
gives back exactly the text; with dropout 0 the ids are those of the sentencepiece library for texts
that its normaliser leaves alone.

Defined cases: null stays null, the empty text has no ids; repeated rows get equal ids; a null doc_id
counts as -1; long words and texts are never cut; further columns are kept, but one with the name of
the added column gives way to it.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from marlstone.llm import features

SPACE = "▁"
#: Stands for U+2581 of a text itself; no valid text holds a lone surrogate.
LITERAL = "\ud800"
UNIT = re.compile(r"\n[^ \n]*| *[^ \n]+| +")
#: Texts whose units are not simply their parts between spaces and before line breaks.
ODD = r"  | \n|\A[ \n]|[ ]\z"
#: Longer units have no tree; neither have those that a worker meets once.
LONG = 40
#: A worker's trees are dropped when they grow beyond these.
MAX_UNITS, MAX_NODES = 150_000, 1_200_000
MASK = (1 << 64) - 1
C1, C2, PHI = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
GOLDEN = np.uint64(PHI)
NONE = np.int64(1) << 40


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(C1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(C2)
    return x ^ (x >> np.uint64(31))


class Pieces:
    """The pieces of a .model file, and the bytes that each stands for."""

    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])


class Model(Pieces):
    """Pieces and merges."""

    def __init__(self, path: str):
        super().__init__(path)
        n = len(self.scores)
        # by score, best first; the rank orders the agenda
        self.of_rank = sorted(self.ids.values(), key=lambda i: (-self.scores[i], i))
        rank = {i: r for r, i in enumerate(self.of_rank)}
        self.mixed = mix(np.arange(len(rank), dtype=np.uint64)).tolist()
        self.ids_of_rank, self.mixed_ranks = np.array(self.of_rank, np.int64), np.array(self.mixed, np.uint64)
        #: what stands for a character without a piece, and for a symbol that was merged away
        self.lacking, self.gone, self.base = n, n + 1, n + 2
        self.merges: dict[int, int] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    self.merges[a * self.base + b] = rank[i]
        # the same as an open hash table for arrays
        self.bits = max(4, (4 * len(self.merges)).bit_length())
        self.slots, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE)
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        values, at = np.fromiter(self.merges.values(), np.int64, len(keys)), self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slots[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slots[at[put]], self.made[at[put]] = keys[put], values[put]
            rest = np.delete(np.arange(len(keys)), put)
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that a and b make, or NONE."""
        key = (a * self.base + b).ravel()
        at = self._slot(key)
        found = self.slots[at]
        out = np.where(found == key, self.made[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(a.shape)


_models: dict[tuple, Pieces] = {}


def load(path: str, kind: type = Model) -> Pieces:
    """A worker keeps what it has loaded."""
    if (path, kind) not in _models:
        _models[path, kind] = kind(path)
    return _models[path, kind]


def cut(model: Model, unit: str, key: int, limit: int) -> list[int]:
    """The ids of one occurrence of a unit of any length, by a heap."""
    n, base, merges, of_rank, mixed = len(unit), model.base, model.merges, model.of_rank, model.mixed
    get, lacking = model.ids.get, model.lacking
    symbols = [get(c, lacking) for c in unit]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [r << 32 | i for i, r in enumerate(map(merges.get, [a * base + b for a, b in zip(symbols, symbols[1:])])) if r is not None]
    heapify(agenda)
    while agenda:
        best = heappop(agenda)
        i, r = best & 0xFFFFFFFF, best >> 32
        j = after[i]
        if j >= n or merges.get(symbols[i] * base + symbols[j]) != r:
            continue  # one of the two was merged otherwise
        if limit:
            h = (key + PHI * (i + 1) + mixed[r]) & MASK
            h = ((h ^ (h >> 30)) * C1) & MASK
            h = ((h ^ (h >> 27)) * C2) & MASK
            if h ^ (h >> 31) < limit:
                continue
        symbols[i], symbols[j] = of_rank[r], model.gone
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            new = merges.get(symbols[i] * base + symbols[k])
            if new is not None:
                heappush(agenda, new << 32 | i)
        k = before[i]
        if k >= 0:
            new = merges.get(symbols[k] * base + symbols[i])
            if new is not None:
                heappush(agenda, new << 32 | k)
    out, i = [], 0
    while i < n:
        if symbols[i] != lacking:
            out.append(symbols[i])
        else:
            out += in_bytes(model, unit[i])
        i = after[i]
    return out


def in_bytes(model: Model, character: str) -> list[int]:
    """The pieces of a character that has none of its own."""
    return [model.byte_ids[b] for b in character.replace(LITERAL, SPACE).encode()]


def agenda(model: Model, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of symbol ids, one an occurrence, merged as far as they go, padded with ``lacking`` beyond their sizes.

    The merged rows, their sizes, and of each row the candidates by key, whether each was skipped, and their number."""
    n, width = symbols.shape
    rows, sizes, steps = symbols.copy(), sizes.copy(), np.zeros(n, np.int64)
    candidates, skipped = np.zeros((n, 2 * width), np.uint64), np.zeros((n, 2 * width), bool)
    if width < 2 or not n:
        return rows, sizes, candidates, skipped, steps
    live, cols = np.arange(n), np.arange(width, dtype=np.int16)
    s, starts, best = rows, np.tile(np.arange(width, dtype=np.int16), (n, 1)), model.merge(rows[:, :-1], rows[:, 1:])
    while True:
        at = best.argmin(axis=1)
        got = best[np.arange(len(best)), at]
        ends = got == NONE
        if ends.any():
            rows[live[ends]] = s[ends]
            keep = ~ends
            live, s, starts, best, at, got = (x[keep] for x in (live, s, starts, best, at, got))
        if not len(live):
            return rows, sizes, candidates, skipped, steps
        i = np.arange(len(live))
        if limit:
            if steps[live].max() >= candidates.shape[1]:
                candidates, skipped = np.pad(candidates, ((0, 0), (0, width))), np.pad(skipped, ((0, 0), (0, width)))
            key = GOLDEN * (starts[i, at].astype(np.uint64) + np.uint64(1)) + model.mixed_ranks[got]
            skip = mix(keys[live] + key) < np.uint64(limit)
            candidates[live, steps[live]], skipped[live, steps[live]] = key, skip
            steps[live] += 1
            best[i[skip], at[skip]] = NONE
            i, at, got = i[~skip], at[~skip], got[~skip]
        take = cols + (cols > at[:, None])
        take[:, -1] = width - 1
        t = np.take_along_axis(s[i], take.astype(np.int64), 1)
        t[:, -1] = model.lacking
        place = np.arange(len(i))
        t[place, at] = model.ids_of_rank[got]
        starts[i] = np.take_along_axis(starts[i], take.astype(np.int64), 1)
        b = np.take_along_axis(best[i], np.minimum(take[:, :-1], width - 2).astype(np.int64), 1)
        b[:, -1] = NONE
        for side in (-1, 0):  # only the pairs on either side of the new piece are new
            j = at + side
            ok = np.flatnonzero((j >= 0) & (j < width - 1))
            b[ok, j[ok]] = model.merge(t[ok, j[ok]], t[ok, j[ok] + 1])
        s = s if s is not rows else s.copy()
        s[i], best[i] = t, b
        sizes[live[i]] -= 1


class Trees:
    """The decisions that a worker has met, by unit. Nodes count from 1; a leaf is the negative of its number, which counts from 1 too."""

    def __init__(self, model: Model, dropout: float, seed: int):
        self.model, self.seed = model, seed
        self.limit = int(dropout * 2**64) if dropout < 1 else MASK
        self.met = np.zeros(1 << 24, bool)  # whether a unit of this hash was met before
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.root, self.hash = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint64)
        self.candidate, self.branch, self.nodes = np.zeros(1 << 12, np.uint64), np.zeros(1 << 13, np.int32), 1
        self.pool, self.ends, self.ids, self.leaves = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), 0, 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _walk(self, at: np.ndarray, depth: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where occurrences at nodes ``at`` end: leaves, or 0 where they leave the tree; the branches there, and their depth."""
        out, left, limit = at.copy(), np.zeros(len(at), np.int64), np.uint64(self.limit)
        active = np.flatnonzero(at > 0)
        now, own = at[active], keys[active]
        while len(active):
            place = 2 * now + (mix(own + self.candidate[now]) < limit)
            now = self.branch[place].astype(np.int64)
            out[active] = now
            depth[active] += 1
            fell = now == 0
            left[active[fell]] = place[fell]
            more = now > 0
            active, now, own = active[more], now[more], own[more]
        return out, left, depth

    def _grow(self, units: list[str], lengths: np.ndarray, codes: np.ndarray, keys: np.ndarray, left: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Add a path for each occurrence from the branch ``left`` on (-1: a new root): the leaves, and where the paths begin."""
        leaves, heads = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        widths = -(-lengths[codes] // 4) * 4
        by_width = np.argsort(widths, kind="stable")
        for same in np.split(by_width, np.flatnonzero(np.diff(widths[by_width])) + 1) if len(codes) else ():
            w = int(widths[same[0]])
            for i in range(0, len(same), max(1, 100_000 // w)):
                own = same[i : i + max(1, 100_000 // w)]
                leaves[own], heads[own] = self._grow_width(w, [units[c] for c in codes[own].tolist()], lengths[codes[own]], keys[own], left[own], depth[own])
        return leaves, heads

    def _grow_width(self, w: int, units: list[str], lengths: np.ndarray, keys: np.ndarray, left: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        distinct, inverse = np.unique(points, return_inverse=True)
        ids = np.array([m.ids.get(chr(c), m.lacking) for c in distinct], np.int64)
        symbols = np.full((len(keys), w), m.lacking, np.int64)
        symbols[np.arange(w) < lengths[:, None]] = ids[inverse]
        done, sizes, candidates, skipped, steps = agenda(m, symbols, lengths, keys, self.limit)
        inside = np.arange(w) < sizes[:, None]
        flat, counts = done[inside], sizes.copy()
        lacking = ((done == m.lacking) & inside).any(axis=1)
        if lacking.any():
            which, own = np.flatnonzero(lacking), []
            for i in which.tolist():  # in the order in which they come
                strange = iter([c for c in units[i] if c not in m.ids])
                own.append(np.array([y for x in done[i, : sizes[i]].tolist() for y in ([x] if x != m.lacking else in_bytes(m, next(strange)))], np.int64))
            plain = flat[np.repeat(~lacking, sizes)]
            counts[which] = [len(x) for x in own]
            at = np.repeat(lacking, counts)
            flat = np.empty(len(at), np.int64)
            flat[at], flat[~at] = np.concatenate(own), plain
        self.pool, self.ends = self._room(self.pool, self.ids + len(flat)), self._room(self.ends, self.leaves + len(keys) + 1)
        self.pool[self.ids : self.ids + len(flat)] = flat
        self.ends[self.leaves + 1 : self.leaves + 1 + len(keys)] = self.ids + np.cumsum(counts)
        leaf = -(self.leaves + 1 + np.arange(len(keys)))
        self.ids, self.leaves = self.ids + len(flat), self.leaves + len(keys)
        # nodes for the candidates from each depth on, one after another; the last one's branch is the leaf
        more = steps - depth
        total = int(more.sum())
        until = np.cumsum(more)
        row = np.repeat(np.arange(len(keys)), more)
        step = np.arange(total) - np.repeat(until - more, more) + depth[row]
        node = self.nodes + np.arange(total)
        self.candidate, self.branch = self._room(self.candidate, self.nodes + total), self._room(self.branch, 2 * (self.nodes + total))
        self.candidate[node] = candidates[row, step]
        follows = np.append(node[1:], 0)
        follows[until[more > 0] - 1] = leaf[more > 0]
        self.branch[2 * node + skipped[row, step]] = follows
        head = np.where(more > 0, self.nodes + until - more, leaf)
        self.nodes += total
        old = left >= 0
        self.branch[left[old]] = head[old]
        return leaf, head

    def segment(self, units: list[str], codes: np.ndarray, doc_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, ends of each segmentation, segmentation of each occurrence); units: distinct; codes: an occurrence's unit."""
        import xxhash

        if len(self.units) > MAX_UNITS or self.nodes > MAX_NODES:
            self.clear()
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        known = np.fromiter(map(self.units.get, units, repeat(-1)), np.int64, len(units))
        hashes, new = self.hash[known], np.flatnonzero(known < 0)
        hashes[new] = [xxhash.xxh64_intdigest(units[i].encode("utf-8", "surrogatepass"), self.seed) for i in new.tolist()]
        keys = hashes[codes] + doc_keys
        times = np.bincount(codes, minlength=len(units))
        slot = (hashes >> np.uint64(40)).astype(np.int64)
        long = lengths > LONG
        once = (times == 1) & ~self.met[slot] & (known < 0) & ~long
        self.met[slot[times > 0]] = True
        first = np.zeros(len(units), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        out, roots = np.zeros(len(codes), np.int64), self.root[known]
        # units that were not met before; those met once keep no tree
        fresh = np.flatnonzero((known < 0) & (times > 0) & ~long & ~once)
        none = np.full(len(fresh), -1)
        out[first[fresh]], roots[fresh] = self._grow(units, lengths, fresh, keys[first[fresh]], none, np.zeros(len(fresh), np.int64))
        n = len(self.units)
        self.root, self.hash = self._room(self.root, n + len(fresh)), self._room(self.hash, n + len(fresh))
        self.root[n : n + len(fresh)], self.hash[n : n + len(fresh)] = roots[fresh], hashes[fresh]
        self.units.update(zip([units[i] for i in fresh.tolist()], range(n, n + len(fresh))))
        walking = np.flatnonzero(~(once | long)[codes])
        at, depth = roots[codes[walking]], np.zeros(len(walking), np.int64)
        while len(walking):
            at, left, depth = self._walk(at, depth, keys[walking])
            out[walking] = at
            fell = np.flatnonzero(at == 0)
            walking, left, depth = walking[fell], left[fell], depth[fell]
            if len(fell):  # one occurrence extends each branch, the others go on from there
                _, one = np.unique(left, return_index=True)
                out[walking[one]], _ = self._grow(units, lengths, codes[walking[one]], keys[walking[one]], left[one], depth[one])
                rest = np.ones(len(walking), bool)
                rest[one] = False
                walking, left, depth = walking[rest], left[rest], depth[rest]
                at = self.branch[left].astype(np.int64)
                out[walking] = at
                walking, at, depth = walking[at > 0], at[at > 0], depth[at > 0]
        kept = self.ids, self.leaves, self.nodes
        single = np.flatnonzero(once)
        out[first[single]], _ = self._grow(units, lengths, single, keys[first[single]], np.full(len(single), -1), np.zeros(len(single), np.int64))
        pool, ends = self.pool[: self.ids].copy(), self.ends[: self.leaves + 1].copy()
        self.branch[2 * kept[2] : 2 * self.nodes] = 0
        self.ids, self.leaves, self.nodes = kept
        which = -out - 1
        alone = np.flatnonzero(long[codes])
        if len(alone):
            more = [cut(self.model, units[c], key, self.limit) for c, key in zip(codes[alone].tolist(), keys[alone].tolist())]
            which[alone] = len(ends) - 1 + np.arange(len(alone))
            ends = np.concatenate([ends, ends[-1] + np.cumsum([len(x) for x in more])])
            pool = np.concatenate([pool, *(np.array(x, np.int32) for x in more)])
        return pool, ends, which


_trees: dict[tuple, Trees] = {}


def trees(model: Model, dropout: float, seed: int) -> Trees:
    key = (model.path, dropout, seed)
    if key not in _trees:
        _trees.clear()  # a worker keeps one set
        _trees[key] = Trees(model, dropout, seed)
    return _trees[key]


def encode_batch(model: Model, texts: pa.Array, doc_keys: np.ndarray, dropout: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids end to end, and their counts by text. doc_keys: a 64-bit key for each text."""
    texts = pc.fill_null(texts, "")
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    odd = pc.or_(pc.match_substring_regex(texts, ODD), pc.match_substring(texts, SPACE))
    parts = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n"), " ")
    flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    units = [w if w[:1] == "\n" else SPACE + w for w in coded.dictionary.to_pylist()]
    codes = coded.indices.to_numpy().astype(np.int64)
    sizes = np.diff(bounds)
    if pc.any(odd).as_py():  # these are cut one by one; they stand as one empty part so far
        index, own = {u: i for i, u in enumerate(units)}, []
        which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        for i in which.tolist():
            found = [u.replace(" ", SPACE) for u in UNIT.findall(" " + texts[i].as_py().replace(SPACE, LITERAL))]
            own.append(np.array([index.setdefault(u, len(index)) for u in found], np.int64))
        units, is_odd = list(index), np.zeros(len(sizes), bool)
        is_odd[which] = True
        plain = codes[np.repeat(~is_odd, sizes)]
        sizes[which] = [len(x) for x in own]
        codes = np.empty(int(sizes.sum()), np.int64)
        at = np.repeat(is_odd, sizes)
        codes[at], codes[~at] = np.concatenate(own), plain
        bounds = np.concatenate([[0], np.cumsum(sizes)])
    place = (np.arange(len(codes)) - np.repeat(bounds[:-1], sizes)).astype(np.uint64)
    pool, ends, at = trees(model, dropout, seed).segment(units, codes, mix(np.repeat(doc_keys, sizes) + GOLDEN * (place + np.uint64(1))))
    starts, own = ends[at], ends[at + 1] - ends[at]
    until = np.cumsum(own)
    index = np.repeat(starts - (until - own), own) + np.arange(int(own.sum()))
    counts = np.diff(np.concatenate([[0], until])[bounds])
    out = pool[index]
    if empty.any():  # the empty text has no ids, not those of its leading space
        out, counts = out[np.repeat(~empty, counts)], np.where(empty, 0, counts)
    return out, counts


def encode_column(model: Model, texts: pa.Array, doc_ids: pa.Array, dropout: float, seed: int) -> pa.Array:
    keys = doc_ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)
    ids, counts = encode_batch(model, texts, mix(keys + np.uint64(seed)), dropout, seed)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def decode_column(pieces: pa.Array, column: pa.Array) -> pa.Array:
    """The texts of lists of ids; pieces: the bytes of each id."""
    bounds = column.offsets.to_numpy()  # of a slice: into all values
    flat = pieces.take(column.values.slice(bounds[0], bounds[-1] - bounds[0]))  # the bytes of all texts, end to end
    ends = np.frombuffer(flat.buffers()[1], np.int32, len(flat) + 1)[bounds - bounds[0]]
    whole = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), flat.buffers()[2]])
    texts = pc.utf8_slice_codeunits(whole.cast(pa.string()), 1)  # less the leading space
    return pc.if_else(column.is_null(), pa.scalar(None, pa.string()), texts)


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, name: str = "pieces") -> DataFrame:
    """The rows of ``docs`` with the ids of ``text`` as an array; null for null."""

    def make():
        model = load(model_path)
        return lambda b: {name: encode_column(model, b.column("text"), b.column("doc_id"), dropout, seed)}

    return features.with_columns(docs, make, f"`{name}` array<int>")


def decode(coded: DataFrame, model_path: str, ids: str = "pieces", name: str = "decoded") -> DataFrame:
    """The rows of ``coded`` with the text of their ids; null for null."""

    def make():
        pieces = pa.array(load(model_path, Pieces).bytes_of, pa.binary())
        return lambda b: {name: decode_column(pieces, b.column(ids))}

    return features.with_columns(coded, make, f"`{name}` string")


def round_trip(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """What ``encode`` and then ``decode`` add, in one worker a task instead of two."""

    def make():
        model = load(model_path)
        pieces = pa.array(model.bytes_of, pa.binary())

        def compute(b: pa.RecordBatch) -> dict[str, pa.Array]:
            ids = encode_column(model, b.column("text"), b.column("doc_id"), dropout, seed)
            return {"pieces": ids, "decoded": decode_column(pieces, ids)}

        return compute

    return features.with_columns(docs, make, "pieces array<int>, decoded string")
