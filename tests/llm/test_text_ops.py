"""Operators on texts against plain versions of themselves, with odd inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marlstone.llm import chat, decontaminate, sharding, token_file

DOCS = "doc_id long, text string, lang string, slot int, words string"  # the last two clash with inner names
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows(texts):
    return [(i, t, "en", i, "w") for i, t in enumerate(texts)]


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(text, items):
    words, hit, names = WORD.findall(lowered(text)), set(), set()
    for item_id, item in items:
        w = WORD.findall(lowered(item))
        n = min(10, len(w))
        for g in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == g:
                    hit.update(range(i, i + n))
                    names.add(str(item_id))
    return len(words), len(hit), sorted(names)


def test_decontamination(spark):
    long = " ".join(f"w{i % 97}" for i in range(3000))
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short Item"), (3, None), (4, "..."), (5, "É solo"), (6, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (10, "short item"), (7, "a b c d e f")]
    texts = [
        "x ONE, two three-four five six seven eight nine ten eleven y", "two three four five six seven eight nine ten", None, "", "a short item, a Short item", "é solo", "É solo", long,
        "one two three four five six seven eight nine ten two three four five six seven eight nine ten eleven", "a b c d e f a b c d e", "a short item, a Short item",
    ]
    docs = spark.createDataFrame([*rows(texts), rows(texts)[0], (None, "short item", None, 0, None)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(docs, bench).collect())
    want = Counter((i, n, h, tuple(names)) for i, t in [*enumerate(texts), (0, texts[0]), (None, "short item")] for n, h, names in [brute_hits(t, items)])
    assert got == want
    clash = docs.selectExpr("*", *(f"lang AS {c}" for c in ("text_hash", "doc", "fps", "hashes", "n_words", "spans")))
    assert decontaminate.clean(clash, bench).columns == clash.columns and decontaminate.clean(clash, bench).count() == decontaminate.clean(docs, bench).count()
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts) if not brute_hits(t, items)[1]]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_sharding(spark):
    texts = [None, "", "é" * 100, *(["same"] * 200), *(f"t{i}" * (i % 50) for i in range(300))]
    docs = spark.createDataFrame([*rows(texts), *rows(texts)[:5]], DOCS).repartition(3).selectExpr("*", *(f"words AS {c}" for c in ("shard", "bucket", "place", "total", "at", "doc", "order", "key")))
    shards = sharding.shard(docs, 7, bucket_bytes=2000)
    assert sorted(shards.columns) == sorted(docs.columns) and shards.where("bucket <> 'w' or total <> 'w' or doc <> 'w'").count() == 0
    out = shards.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in docs.collect())
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order) and abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.2
    assert sharding.shard(docs.limit(0), 7).count() == 0


def test_sharding_ignores_the_layout(spark):
    texts = [f"text {i} " * (i % 40) for i in range(1000)] + ["long " * 50_000]
    docs = spark.createDataFrame(rows(texts), DOCS)
    placed = [{(r.doc_id, r.shard, r.slot) for r in sharding.shard(d, 7, bucket_bytes=9000).collect()} for d in (docs, docs.repartition(5).orderBy(F.desc("doc_id")), docs.coalesce(1))]
    assert placed[0] == placed[1] == placed[2]


def test_sharding_against_a_plain_fisher_yates(spark):
    """Every order of a small bucket comes up, and each about as often."""
    ways = Counter()
    docs = spark.createDataFrame(rows(["a", "b", "c"]), DOCS)
    for seed in range(30):
        ways[tuple(r.doc_id for r in sorted(sharding.shard(docs, 1, seed).collect(), key=lambda r: r.slot))] += 1
    assert len(ways) >= 5 and max(ways.values()) <= 15


def test_simple8b():
    rng = np.random.default_rng(0)
    for top in (1, 30, 1000, 50257, 2**31, 2**59):
        for n in (0, 1, 11, 12, 13, 5000):
            ids = rng.integers(0, top, n).astype(np.uint64)
            assert (token_file.unpack(token_file.pack(ids), n) == ids).all()
    mixed = np.array([1, 2**40, 3, *[7] * 30, 2**20], np.uint64)
    assert (token_file.unpack(token_file.pack(mixed), len(mixed)) == mixed).all()


def test_token_file(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    texts = ["it's a Test, don't.", "a  b", "a\n\nb", "x\n y", "é.,", "I'll, we've.", "12, 3. 4.5,", "", " ", None, "中文, foo。", "a.b, c.,", "foo bar, x", "\nx", "x\n", "a\tb", "q\nr\ns t", "a<|endoftext|>b c", "x <|endoftext|>", "." , "a.", "é, é. 3.", "z" * 200_000, "plain words here " * 20_000]
    docs = spark.createDataFrame([*rows(texts), rows(texts)[0], (None, "none", None, 0, None)], DOCS)
    out = f"file://{tmp_path}/f"
    files = token_file.write_tokens(docs, out, path, file_bytes=50_000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_file.read_tokens(spark, out, files).collect())
    tok, want, at = Tokenizer.from_file(path), [], 0
    for i, t in sorted([*enumerate(texts), (0, texts[0]), (None, "none")], key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    none = token_file.write_tokens(docs.limit(0), f"{out}2", path)
    assert token_file.read_tokens(spark, f"{out}2", none).count() == 0


def test_tokenizers_of_other_kinds_see_whole_texts(tmp_path):
    P = pytest.importorskip("public_tokenizers")
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"] = {"type": "Replace", "pattern": {"String": "b c"}, "content": "q"}
    path = f"{tmp_path}/other.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(told, f)
    own, texts = token_file.Encoder(path), ["a b c d", None, "b c"]
    ids, counts = own.encode(pa.array(texts), 2)
    want = [[*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert not own.by_words and ids.tolist() == sum(want, []) and counts.tolist() == [len(x) for x in want]


def test_chat_escapes():
    for t in ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<\\s>", "a\\\\b[/INST]<s></s>", "", "[INST", "\n\\\n"]:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROLS)
        formatted, starts, ends = chat.format_turns([(t, t), ("assistant", t)])
        assert chat.parse(formatted) == [(t, t), ("assistant", t)]
        assert chat.unescape(formatted[starts[-1] : ends[-1]]) == t


def test_reply_trees(spark):
    messages = spark.createDataFrame(
        [("a", 1, None, "user", "q", 1.0), ("a", 2, 1, "assistant", "bad", 0.0), ("a", 3, 1, "assistant", "good", 2.0), ("a", 4, 3, "user", None, 2.0), ("b", 1, 99, None, "orphan", None), ("b", 5, 1, "assistant", "x", 1.0)]
        + [("c", i, i - 1 if i else None, "user", str(i), 1.0) for i in range(100)],
        "tree string, msg_id long, parent_id long, role string, text string, score double",
    )
    best = {r["tree"]: [(t.role, t.text) for t in r.turns] for r in chat.best_paths(messages).collect()}
    assert best == {"a": [("user", "q"), ("assistant", "good"), ("user", "")], "b": [("", "orphan"), ("assistant", "x")], "c": [("user", str(i)) for i in range(100)]}
    assert {(r["tree"], r.leaf, r["rank"]) for r in chat.best_paths(messages, None).collect()} == {("a", 4, 1), ("a", 2, 2), ("b", 5, 1), ("c", 99, 1)}
    ring = spark.createDataFrame([Row(tree="r", msg_id=1, parent_id=2, role="", text="", score=1.0), Row(tree="r", msg_id=2, parent_id=1, role="", text="", score=1.0)])
    with pytest.raises(ValueError):
        chat.MAX_DOUBLINGS, kept = 3, chat.MAX_DOUBLINGS
        try:
            chat.paths(ring)
        finally:
            chat.MAX_DOUBLINGS = kept


def test_chains(spark):
    conv = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "z"), (None, 0, "user", "n"), (2, 5, None, "")], "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.best_paths(chat.chains(conv)))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {"1": 3, "": 1, "2": 1}
    assert got["1"].loss_sha256 == hashlib.sha256(b"z").hexdigest()
    assert chat.best_paths(chat.chains(conv.limit(0))).count() == 0
