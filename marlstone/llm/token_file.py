"""Token ids in word-aligned binary files (Simple-8b).

Each file: magic, blocks, footer, footer length (u64). A block packs up to BLOCK ids into 64-bit
words; a word's low 4 bits select how many ids of how many bits its upper 60 bits hold. Ids go in
groups of 12, the counts of all selectors divide 12, and each group takes the narrowest selector
that holds its largest id; ids of over 30 bits escape to one word each. So both packing and
unpacking are array operations over all groups of a selector. The footer has each block's offset,
words and ids, so blocks are read on their own, and each document's id and count.

Documents are laid out in ascending doc_id order (nulls first, ties by a hash of the text) over
range-partitioned files, each written under a name of its own and then renamed, so that a repeated
task replaces its file whole.

Defined cases: a null text is empty and has the end id alone; repeated rows are kept; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common, features

MAGIC = b"S8BF0001"
GROUP = 12
#: (ids a word, bits an id) by selector; the last is the escape
SELECTORS = ((12, 5), (6, 10), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 12 * 4096
#: Bytes of text that a task encodes together; in larger slices fewer words are new.
SLICE_BYTES = 8 << 20
#: Distinct words whose ids a Python worker keeps; further ones are encoded each time.
CACHE_WORDS = 500_000


def pack(ids: np.ndarray) -> np.ndarray:
    """Ids (unsigned, below 2**60) as 64-bit words."""
    n = len(ids)
    padded = np.zeros(-(-n // GROUP) * GROUP, np.uint64)
    padded[:n] = ids
    groups = padded.reshape(-1, GROUP)
    top = groups.max(axis=1) if len(groups) else np.zeros(0, np.uint64)
    kind = np.searchsorted(np.array([(1 << b) - 1 for _, b in SELECTORS], np.uint64), top)
    per = np.array([GROUP // c for c, _ in SELECTORS])[kind]
    ends = np.cumsum(per)
    words = np.zeros(int(ends[-1]) if n else 0, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(kind == s)
        if len(own):
            parts = groups[own].reshape(len(own), GROUP // count, count)
            packed = np.full(parts.shape[:2], s, np.uint64)
            for j in range(count):
                packed |= parts[:, :, j] << np.uint64(4 + j * bits)
            words[((ends - per)[own][:, None] + np.arange(GROUP // count))] = packed
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of packed words."""
    kind = (words & np.uint64(15)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[kind] if len(words) else np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(words) else 0, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(kind == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            out[(ends - counts)[own] + j] = (words[own] >> np.uint64(4 + j * bits)) & mask
    return out[:n]


class Encoder:
    """Ids of whole texts as the tokenizers library gives them; ids of words are kept.

    A byte-level pre-tokenizer never joins what lies on either side of a lone space between two other
    characters, or of a lone line break between two, and takes the space with what follows. So a
    text's ids are those of its pieces between such spaces and breaks, one after another. Texts
    with other white space, or with an added token, are encoded in one piece. So are all texts if the tokenizer's
    file says anything else than a byte-level pre-tokenizer without normaliser over plain BPE."""

    ODD = r"  |\n\n| \n|\n |\A[ \n]|[ \n]\z|[\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        self.by_words = (
            not told.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("dropout") and not told.get("truncation") and not told.get("padding")
        )
        self.added = [t["content"] for t in told.get("added_tokens") or []]
        # which ids begin with a space: in the ids of words after single spaces, those are where the words begin
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how byte-level files write a space
        # word: number; the ids of number i are pool[starts[i] : starts[i] + sizes[i]]
        self.known: dict[str, int] = {}
        self.pool, self.starts, self.sizes, self.used = np.zeros(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of each text's."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words as they follow a space, encoded as one text."""
        ids, _ = self._ids([" " + " ".join(words)])
        first = np.flatnonzero(self.opens[ids])
        if len(first) != len(words):
            return self._ids([" " + w for w in words])
        return ids, np.diff(np.append(first, len(ids)))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(words)
        self.pool, self.starts, self.sizes = (_room(x, k) for x, k in ((self.pool, self.used + len(ids)), (self.starts, n + m), (self.sizes, n + m)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.sizes[n : n + m], self.starts[n : n + m] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + m)))

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces as they follow a space, or with their line break."""
        tailed = [p for p in pieces if len(p) > 1 and p[-1] in ".," and p[-2].isalpha()]  # a letter never joins a final full stop or comma
        bases = [p[:-1] for p in tailed]
        need = list(dict.fromkeys(x for x in chain(set(pieces).difference(tailed), bases) if x not in self.known))
        breaks, plain = [x for x in need if x[0] == "\n"], [x for x in need if x[0] != "\n"]
        if breaks:
            self._keep(breaks, *self._ids(breaks))
        if plain:
            self._keep(plain, *self._ids_of(plain))
        if tailed:
            base = np.fromiter(map(self.known.__getitem__, bases), np.int64, len(bases))
            sizes = self.sizes[base] + 1
            ends = np.cumsum(sizes)
            ids = self.pool.take(np.repeat(self.starts[base] - (ends - sizes), sizes) + np.arange(int(ends[-1])), mode="clip")  # the last of each is put in below
            stop, comma = (self._ids([x])[0][0] for x in ".,")
            ids[ends - 1] = np.where([p[-1] == "." for p in tailed], stop, comma)
            self._keep(tailed, ids, sizes)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by the end id, and their counts by text."""
        n_before, used_before = len(self.known), self.used
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.ODD) if self.by_words else pa.array([True] * len(texts))
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        body = pc.if_else(odd, "", pc.replace_substring(texts, "\n", " \n"))
        lists = pc.split_pattern(body, " ")
        flat, bounds = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
        codes = flat.indices.to_numpy().astype(np.int64)
        words = flat.dictionary.to_pylist()
        number = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = [i for i in np.flatnonzero(number < 0).tolist() if words[i]]
        self._learn([words[i] for i in new])
        number[new] = [self.known[words[i]] for i in new]
        sizes, starts = self.sizes[number], self.starts[number]
        sizes[number < 0] = 0  # the empty word
        # the first piece of a text follows no space; the text before it ends there
        heads, per = self._ids(pc.if_else(odd, texts, pc.list_element(lists, 0)).to_pylist())
        tail = 0 if end_id is None else 1
        all_heads = np.full(len(heads) + tail * (len(per) + 1), end_id or 0, "<u4")
        all_heads[np.arange(len(heads)) + tail * np.repeat(np.arange(1, len(per) + 1), per)] = heads
        pool = np.concatenate([self.pool[: self.used], all_heads])
        own = np.append(per + tail, tail)  # each text's end stands in front of the next, and one after the last
        sizes, starts = np.concatenate([sizes, own]), np.concatenate([starts, self.used + np.cumsum(own) - own])
        codes[bounds[:-1]] = len(words) + np.arange(len(per))
        codes = np.append(codes, len(words) + len(per))
        each = sizes[codes]
        places = np.cumsum(each) - each
        ids = pool[np.repeat(starts[codes] - places, each) + np.arange(int(each.sum()))]
        counts = np.diff(np.append(places, each.sum())[np.append(bounds[:-1], bounds[-1])])
        if n_before >= CACHE_WORDS:  # the frequent words are known by now
            for _ in range(len(self.known) - n_before):
                self.known.popitem()  # the latest
            self.used = used_before
        return ids[tail:], counts


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The two columns of batches, put together until they reach SLICE_BYTES."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= SLICE_BYTES:
            yield tuple(pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_file(out_dir: str, index: int, attempt: int, chunks: Iterator[tuple[list, np.ndarray, np.ndarray]]) -> tuple[int, int]:
    """Write one file; chunks: doc ids, all their ids, their counts. Returns documents and ids written."""
    store, base = _filesystem(out_dir)
    store.create_dir(base, recursive=True)
    own = f"{base}/.part-{index:06d}.{attempt}"
    doc_ids, counts, blocks, at = [], [], [], len(MAGIC)
    rest = np.zeros(0, "<u4")
    with store.open_output_stream(own) as f:
        f.write(MAGIC)

        def flush(ids: np.ndarray) -> None:
            nonlocal at
            words = pack(ids)
            f.write(words.astype("<u8").tobytes())
            blocks.append((at, len(words), len(ids)))
            at += 8 * len(words)

        for docs, ids, n in chunks:
            doc_ids += docs
            counts += n.tolist()
            all_ids = np.concatenate([rest, ids])
            whole = len(all_ids) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                flush(all_ids[i : i + BLOCK])
            rest = all_ids[whole:]
        if len(rest):
            flush(rest)
        null = np.array([d is None for d in doc_ids], np.uint8)
        footer = b"".join([
            np.array([len(blocks), len(doc_ids)], "<u8").tobytes(), np.array(blocks, "<u8").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.array(counts, "<u8").tobytes(),
        ])
        f.write(footer + np.array([len(footer)], "<u8").tobytes())
    store.move(own, f"{base}/part-{index:06d}.s8b")
    return len(doc_ids), int(sum(counts))


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 2, file_bytes: int = 24 << 20) -> DataFrame:
    """Encode and write; returns (file, docs, ids), one row a file, materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = encoder(tokenizer_path)

        def chunks():
            for ids, texts in gathered(batches):
                for i, n in features.slices(texts, SLICE_BYTES):
                    yield ids.slice(i, n).to_pylist(), *own.encode(texts.slice(i, n), end_id)

        n, ids = _write_file(out_dir, task.partitionId(), task.taskAttemptId(), chunks())
        yield pa.RecordBatch.from_pydict({"file": pa.array([task.partitionId()], pa.int64()), "docs": pa.array([n], pa.int64()), "ids": pa.array([ids], pa.int64())})

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = hashed.repartitionByRange(int(files), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return common.materialise(common.map_arrow(ordered, run, "file long, docs long, ids long"), "token-files")


def _read_file(out_dir: str, index: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, place of its first id in the file, its ids) of each document."""
    store, base = _filesystem(out_dir)
    with store.open_input_file(f"{base}/part-{index:06d}.s8b") as f:
        size = f.size()
        footer_size = int(np.frombuffer(f.read_at(8, size - 8), "<u8")[0])
        footer = f.read_at(footer_size, size - 8 - footer_size)
        n_blocks, n_docs = (int(x) for x in np.frombuffer(footer, "<u8", 2))
        at = 16
        blocks = np.frombuffer(footer, "<u8", 3 * n_blocks, at).reshape(-1, 3).astype(np.int64)
        at += 24 * n_blocks
        doc_ids = np.frombuffer(footer, "<i8", n_docs, at)
        at += 8 * n_docs
        null = np.frombuffer(footer, np.uint8, n_docs, at)
        counts = np.frombuffer(footer, "<u8", n_docs, at + n_docs).astype(np.int64)
        held, have, start, k = [], 0, 0, 0
        for d, is_null, count in zip(doc_ids.tolist(), null.tolist(), counts.tolist()):
            while have < count:
                offset, words, ids = (int(x) for x in blocks[k])
                k += 1
                held.append(unpack(np.frombuffer(f.read_at(8 * words, offset), "<u8"), ids))
                have += ids
            whole = held[0] if len(held) == 1 else np.concatenate([np.zeros(0, np.uint64), *held])
            yield None if is_null else d, start, whole[:count]
            held, have, start = [whole[count:]], have - count, start + count


def read_tokens(spark, out_dir: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files."""
    rows = sorted((r["file"], r["ids"]) for r in files.collect() if r["ids"])  # one row a file
    at, starts = 0, []
    for f, n in rows:
        starts.append((f, at))
        at += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for index, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(d, base + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in _read_file(out_dir, index)]
                for i in range(0, len(rows), 10_000):
                    cols = list(zip(*rows[i : i + 10_000]))
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "start", "n_tokens", "ids_crc32"), cols)})

    table = spark.createDataFrame(starts, "file long, base long").repartition(len(starts), "file")
    return common.map_arrow(table, run, schema)
