"""Operators of the engine on small inputs, against plain versions and known results."""

import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.config import Arm, CollectionConfig, FacetOptions, SearchRequest, VectorConfig
from marlstone.errors import Conflict, NotFound, ValidationError
from marlstone.functions import embed, stemming
from marlstone.functions import text as T
from marlstone.operators import arms as A
from marlstone.operators import filters, fusion, grouping, joins
from marlstone.sources.collection import Collection
from marlstone.streaming import ingest, metrics

META = {"author": "string", "year": "integer", "rating": "float", "published": "boolean", "created_at": "datetime"}


@pytest.fixture(scope="module")
def people(spark):
    d = lambda y, m, x: datetime(y, m, x, tzinfo=UTC)
    rows = [(1, "Ines", 2021, 4.2, False, d(2021, 1, 1)), (2, "Omar", 2023, 4.8, True, d(2023, 6, 10)), (3, "Yuki", 2024, 3.5, False, d(2024, 2, 20)), (4, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, meta_author string, meta_year long, meta_rating double, meta_published boolean, meta_created_at timestamp")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('author = "Ines"', {1}), ("year > 2022", {2, 3}), ("year >= 2022 AND published = true", {2}), ('author = "Ines" OR rating < 4', {1, 3}), ("NOT published = true", {1, 3}),
        ('NOT (year > 2022 AND author = "Omar")', {1, 3}), ('created_at >= "2023-01-01T00:00:00Z"', {2, 3}), ("author IS NULL", {4}), ("author is not null and year < 2024", {1, 2}),
        ('author != "Ines"', {2, 3}), ('author = "Ines" OR author = "Omar" AND year = 2023', {1, 2}), ("rating >= 4", {1, 2}), ({"not": {"key": "year", "gt": 2022}}, {1}), ({"key": "year", "gt": 2020, "lt": 2024}, {1, 2}),
        ({"or": [{"key": "author", "is_null": True}, {"key": "author", "eq": "Omar"}]}, {2, 4}), ({"key": "created_at", "lt": {"value": "2022-01-01", "type": "datetime"}}, {1}),
    ],
)
def test_filters(people, text, want):
    assert {r.doc_id for r in people.where(filters.to_column(filters.build(text), META)).collect()} == want


@pytest.mark.parametrize("text", ["year >>> 2020", "word1 word2 < 5", "", "(year = 1", "year = 1 extra", "year = null", "year IS 5", "year ="])
def test_filter_syntax_errors(text):
    with pytest.raises(ValidationError):
        filters.parse(text)


@pytest.mark.parametrize("text", ["unknown = 1", 'year = "2023"', 'author > "A"', "published < true", "year = true", "rating = true", 'created_at = "soon"'])
def test_filter_type_errors(people, text):
    with pytest.raises(ValidationError):
        filters.to_column(filters.parse(text), META)


@pytest.mark.parametrize("d", [{}, {"key": "a"}, {"key": "a", "eq": None}, {"key": "a", "eq": 1, "and": []}, {"key": "a", "like": 1}])
def test_filter_object_errors(d):
    with pytest.raises(ValidationError):
        filters.from_dict(d)


def test_two_valued_logic_keeps_nulls(people):
    tree = filters.parse('NOT author = "Ines"')
    assert {r.doc_id for r in people.where(filters.to_column(tree, META, two_valued=True)).collect()} == {2, 3, 4}


def test_fusion(spark):
    rows = [(0, 0.7, "a", 3.0, 1), (0, 0.7, "b", 2.0, 2), (1, 0.3, "b", 9.0, 1), (1, 0.3, "c", 9.0, 2)]
    arms = spark.createDataFrame(rows, "arm int, weight double, doc_id string, score double, rank int")
    rrf = {r.doc_id: r.score for r in fusion.fuse(arms).collect()}
    assert rrf == pytest.approx({"a": 0.7 / 3, "b": 0.7 / 4 + 0.3 / 3, "c": 0.3 / 4}, abs=1e-8)
    linear = {r.doc_id: r.score for r in fusion.fuse(arms, "linear").collect()}
    assert linear == pytest.approx({"a": 0.7, "b": 0.3, "c": 0.3})
    assert [r.doc_id for r in fusion.best(fusion.fuse(arms, "linear", 0.3), 10).collect()] == ["a", "b", "c"]


def test_refetch_reaches_all_groups(spark):
    rows = [(0, 1.0, f"a{i}", 5.0, "a") for i in range(5)] + [(0, 1.0, "b1", 2.0, "b"), (0, 1.0, "c1", 1.0, None)]
    scored = spark.createDataFrame(rows, "arm int, weight double, doc_id string, score double, g string").persist()
    one = grouping.refetch(scored, "g", 5, 1, 3, 1)
    assert [r.doc_id for r in one.collect()] == ["a0"]
    two = grouping.refetch(scored, "g", 5, 1, 3, 2)
    assert [r.doc_id for r in two.collect()] == ["a0", "b1", "c1"]


def test_join_grammar():
    specs = joins.parse('kids[$id=$$.meta.parent](role = "a,b"), other, last[$.meta.k=$$id]')
    assert [(s.collection, s.parent, s.child, s.where is None) for s in specs] == [("kids", "id", "parent", False), ("other", "id", "id", True), ("last", "k", "id", True)]
    for bad in ["a,a", "a[", "a[$id]", "a[$$id=$id]", ["x y"]]:
        with pytest.raises(ValidationError):
            joins.parse(bad)


def test_tokenizers(spark):
    df = spark.createDataFrame([("d", "Straße  the THE cats' running"), ("e", ""), ("f", None)], "doc_id string, content string")
    ws = {(r.doc_id, r.token): (r.tf, r.length) for r in T.whitespace(df).collect()}
    assert ws == {("d", "strasse"): (1, 5), ("d", "the"): (2, 5), ("d", "cats'"): (1, 5), ("d", "running"): (1, 5)}
    assert {r.token for r in T.whitespace(df, drop=["the"]).collect()} == {"strasse", "cats'", "running"}
    tri = {r.token: (r.tf, r.length) for r in T.trigrams(spark.createDataFrame([("d", "aab")], "doc_id string, content string")).collect()}
    assert tri == {"###  a": (1, 5), "### aa": (1, 5), "###aab": (1, 5), "###ab ": (1, 5), "###b  ": (1, 5)}
    ft = {r.token: r.tf for r in T.full_text(df.where("doc_id = 'd'")).collect()}
    assert ft == {"strass": 1, "cat": 1, "run": 1}
    kw = {r.token for r in T.wmtr(df.where("doc_id = 'd'")).collect()}
    assert {"## cat", "## run", "# cats'", "# running"} <= kw and "# the" not in kw and any(t.startswith("###") for t in kw)


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_stems(word, stem):
    assert stemming.english(word) == stem


def test_murmur():
    assert embed.murmur3(b"") == 0 and embed.murmur3(b"", 1) == 0x514E28B7
    assert embed.murmur3(b"test") & 0xFFFFFFFF == 0xBA6BD213
    assert embed.murmur3(b"Hello, world!") & 0xFFFFFFFF == 0xC0363E43
    assert 0 <= embed.token_id("x") < 2**31


def test_hash_embed_search(spark, tmp_path):
    import numpy as np

    from marlstone.plans import queries

    sign = {w: (embed.murmur3(w.encode()) % 64, (embed.murmur3(w.encode()) >> 16) & 1) for w in (f"w{i}" for i in range(400))}
    cancel = next(f"{a} {b}" for a in sign for b in sign if sign[a][0] == sign[b][0] and sign[a][1] > sign[b][1])
    texts = ["", None, " \n ", cancel, "The and of", "the w1 w1 OF", "x" * 5000 + " and", *(f"the w{i} w{i % 7} of{' and' * (i % 3)}" for i in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def plain(text):
        v = np.zeros(64)
        for w in (text or "").lower().split():
            h = embed.murmur3(w.encode())
            v[h % 64] += 1 if (h >> 16) & 1 else -1
        return v

    q = plain(queries.QUERY)
    want = sorted((-round(float(v @ q / np.sqrt((v @ v) * (q @ q))), 6), i) for i, v in enumerate(map(plain, texts)) if v.any())[:20]
    found = queries.hash_embed_search(spark, str(tmp_path))
    got = found.collect()
    assert [r.doc_id for r in got] == [i for _, i in want] and [r.score for r in got] == pytest.approx([-x for x, _ in want], abs=2e-6)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # each text is embedded once


def test_embed_batches_are_bounded_in_bytes(spark):
    import numpy as np

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 200_000).alias("text"))
    made = embed.embed(df, "text", lambda: lambda texts: np.full((len(texts), 1), len(texts)), "v", 10_000)
    assert made.agg(F.max(F.col("v")[0])).first()[0] <= 12


def test_cosine_of_zero_vectors(spark):
    import duckdb

    rows = [(0, [0.0, 0.0]), (1, [1.0, 2.0]), (2, None), (3, [-2.0, 1.0])]
    got = A.dense(spark.createDataFrame(rows, "doc_id long, embedding array<float>"), [1.0, 2.0]).orderBy("doc_id").collect()
    sql = "SELECT list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) FROM (SELECT ?::DOUBLE[] AS a, [1, 2]::DOUBLE[] AS b)"
    want = [(i, duckdb.execute(sql, [v]).fetchall()[0][0]) for i, v in rows if v]
    assert [r.doc_id for r in got] == [i for i, _ in want] and [r.score for r in got] == pytest.approx([x for _, x in want], nan_ok=True)


def brute_fold(ops, stored):
    """Operation by operation, with a queue from which deletes cancel."""
    state = dict(stored)
    dead = set()
    for i, (_, op, d, ts, _) in enumerate(ops):
        if op == "delete":
            dead |= {j for j, o in enumerate(ops[:i]) if o[1] == "upsert" and o[2] == d and o[3] <= ts}
    for i, (_, op, d, ts, name) in enumerate(ops):
        if op == "upsert" and i not in dead and (d not in state or ts > state[d][0]):
            state[d] = (ts, name)
        elif op == "delete" and d in state and ts > state[d][0]:
            del state[d]
    return state


def test_fold(spark):
    rng = random.Random(1)
    t0 = datetime(2024, 1, 1, tzinfo=UTC)
    at = lambda k: t0 + timedelta(seconds=k)
    stored = {f"d{i}": (rng.randrange(10), f"s{i}") for i in range(0, 30, 2)}
    ops = [(i, rng.choice(["upsert", "upsert", "delete"]), f"d{rng.randrange(30)}", rng.randrange(12), f"n{i}") for i in range(200)]
    schema = "doc_id string, ts timestamp, name string, description string, content string, content_hash string, metadata string, tags array<string>"
    docs = spark.createDataFrame([(d, at(ts), n, None, None, None, None, None) for d, (ts, n) in stored.items()], schema)
    frame = spark.createDataFrame([(s, o, d, at(ts), n) for s, o, d, ts, n in ops], "seq long, op string, doc_id string, doc_ts timestamp, name string").withColumn("content", F.col("name"))
    got = {r.doc_id: r.name for r in ingest.fold(docs, frame).collect()}
    assert got == {d: n for d, (_, n) in brute_fold(ops, stored).items()}


def upserts(spark, rows):
    schema = "seq long, op string, doc_id string, doc_ts timestamp, name string, description string, content string, metadata string, tags array<string>"
    full = [(i, r.get("op", "upsert"), r["id"], r.get("ts", datetime(2024, 1, 1, tzinfo=UTC)), r.get("name"), None, r.get("content"), r.get("meta"), r.get("tags", [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def test_collection(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    config = CollectionConfig([VectorConfig("tri", "trigrams", ["name", "content"], top_k=1000)], {"category": "string", "year": "integer", "parent_ref": "string"})
    c = Collection.create(spark, path, "docs", config)
    with pytest.raises(Conflict):
        Collection.create(spark, path, "docs", config)
    with pytest.raises(NotFound):
        Collection.open(spark, path, "none")
    c.apply(upserts(spark, [
        {"id": "note_kiln", "name": "Kiln firing guide", "content": "x", "meta": '{"category": "a", "year": 2020}', "tags": ["article"]},
        {"id": "note_loom", "name": "Weaving at home", "content": "a kiln in passing", "meta": '{"category": "a", "year": 2021}', "tags": ["article", "tutorial"]},
        {"id": "other", "name": "Zebra", "content": "quux", "meta": '{"category": "b", "year": 2020}'},
    ]))
    assert Collection.names(spark, path) == ["docs"] and c.count() == 3
    arms = [Arm("tri", "name", 0.7), Arm("tri", "content", 0.3)]
    hits = c.search(SearchRequest("kiln", arms)).results.collect()
    assert [h.doc_id for h in hits][:2] == ["note_kiln", "note_loom"]
    assert [h.doc_id for h in c.search(SearchRequest("kiln", arms, where="year > 2020")).results.collect()] == ["note_loom"]
    assert {h.doc_id for h in c.search(SearchRequest("kiln", arms, tags=["tutorial", "none"])).results.collect()} == {"note_loom"}
    assert c.search(SearchRequest("kiln", arms, tags=["article", "tutorial"], tags_match_all=True)).results.count() == 1
    out = c.search(SearchRequest("kiln", arms, facets=FacetOptions(), exclude=["content", "metadata"], raw_scores=True))
    assert {(r.field, r.value): r.n for r in out.facets.collect()} == {("category", "a"): 2, ("year", "2020"): 1, ("year", "2021"): 1}
    first = out.results.first()
    assert first.content is None and first.metadata is None and {x.field for x in first.raw} <= {"name", "content"}
    grouped = c.search(SearchRequest("kiln", arms, group_field="category", group_max=1)).results.collect()
    assert [h.meta_category for h in grouped] == ["a"]
    kids = Collection.create(spark, path, "kids", CollectionConfig([], {"parent_ref": "string", "role": "string"}))
    kids.apply(upserts(spark, [{"id": "k1", "meta": '{"parent_ref": "note_kiln", "role": "primary"}'}, {"id": "k2", "meta": '{"parent_ref": "note_kiln", "role": "secondary"}'}]))
    joined = c.search(SearchRequest("kiln", arms, join='kids[$id=$$.meta.parent_ref](role = "primary")')).results.collect()
    assert {h.doc_id: [k.doc_id for k in h.joined_kids] for h in joined} == {"note_kiln": ["k1"], "note_loom": []}
    assert kids.search(SearchRequest("anything")).results.count() == 0  # only the empty vector
    with pytest.raises(ValidationError):
        c.search(SearchRequest("x", arms, join="kids[$id=$$.meta.nothing]"))
    with pytest.raises(ValidationError):
        c.search(SearchRequest("x", [Arm("nope", "name")]))
    late, early = datetime(2024, 1, 2, tzinfo=UTC), datetime(2023, 1, 1, tzinfo=UTC)
    c.apply(upserts(spark, [{"id": "note_kiln", "name": "Stale", "ts": early}, {"id": "other", "name": "Fresh", "ts": late}, {"id": "note_loom", "op": "delete", "ts": late}]))
    assert {r.doc_id: r.name for r in c.docs().collect()} == {"note_kiln": "Kiln firing guide", "other": "Fresh"}
    assert [r["doc_id"] for r in c.get(["other", "note_kiln"])] == ["other", "note_kiln"]
    with pytest.raises(NotFound):
        c.get(["other", "gone"])
    page, after = c.fetch(1)
    rest, end = c.fetch(1, after)
    assert [r["doc_id"] for r in page + rest] == ["note_kiln", "other"] and end is None
    c.export(f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2
    c.empty()
    assert c.count() == 0
    c.drop()
    assert not c.exists()


def test_ingestion_stream_equals_batch(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    ops = upserts(spark, [{"id": "a", "name": "one"}, {"id": "b", "name": "two"}, {"id": "a", "name": "three", "ts": datetime(2024, 2, 1, tzinfo=UTC)}])
    ops.write.parquet(f"{path}/ops")
    c = Collection.create(spark, path, "s", CollectionConfig([VectorConfig("ws", "whitespace", ["name"])]))
    q = c.apply_stream(spark.readStream.schema(ops.schema).parquet(f"{path}/ops"), f"{path}/cp")
    q.awaitTermination(120)
    assert {r.doc_id: r.name for r in c.docs().collect()} == {"a": "three", "b": "two"}


def test_metrics(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 12, 0, 0, tzinfo=UTC)
    rows = [(t0 + timedelta(seconds=s), "h", "api", k, [], v, n) for s, k, v, n in [(1, "sum", 1.0, None), (4, "sum", 2.0, None), (5, "sum", 4.0, None), (61, "avg", 3.0, 1), (62, "avg", 5.0, 1), (63, "sum", 1.0, 2), (200, "sum", 9.0, None)]]
    e = spark.createDataFrame(rows, "ts timestamp, hostname string, source string, key string, dims array<string>, value double, n long")
    kept = metrics.one_kind(e)
    assert kept.count() == 6
    live = {(r.key, int((r.bucket_start.replace(tzinfo=UTC) - t0).total_seconds())): (r.value, r.n) for r in metrics.tumble(kept, 5).collect()}
    assert live == {("sum", 0): (3.0, None), ("sum", 5): (4.0, None), ("avg", 60): (8.0, 2), ("sum", 200): (9.0, None)}
    minute = metrics.rollup(metrics.tumble(kept, 5), 60)
    assert {(r.key, r.bucket_start.minute): r.value for r in minute.collect()} == {("sum", 0): 7.0, ("avg", 1): 8.0, ("sum", 3): 9.0}
    assert metrics.upsert(minute, minute).count() == minute.count()
    assert metrics.retain(minute, F.lit(t0 + timedelta(days=1, seconds=60))).count() == 2
    kept.write.parquet(f"file://{tmp_path}/m")
    stream = spark.readStream.schema(kept.schema).parquet(f"file://{tmp_path}/m")
    q = metrics.tumble_stream(stream, 60).writeStream.format("memory").queryName("minute_buckets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.value) for r in spark.table("minute_buckets").collect()} == {("sum", 7.0), ("avg", 8.0)}  # the last minute is not complete


@pytest.mark.parametrize("make", [lambda: VectorConfig("v", "nope"), lambda: VectorConfig("v", "trigrams", ["title"]), lambda: VectorConfig("v", "dense_custom"), lambda: VectorConfig("v", "wmtr", top_k=0), lambda: CollectionConfig([], {"k": "array"}), lambda: SearchRequest("x", limit=0), lambda: SearchRequest("x", limit=101), lambda: SearchRequest("x", fusion="max"), lambda: SearchRequest("x" * 10_001), lambda: SearchRequest("x", exclude=["id"]), lambda: FacetOptions(0)])
def test_limits(make):
    with pytest.raises(ValidationError):
        make()


def test_wmtr_boost_and_split(spark):
    from marlstone.operators import index

    df = spark.createDataFrame([("d", "alpha beta alpha")], "doc_id string, content string")
    v = VectorConfig("kw", "keyword", top_k=5, word_ratio=40, use_stopwords=False)
    rows = {r.token: r.weight for r in index.build(df, [v]).collect()}
    assert len([t for t in rows if not t.startswith("###")]) == 2 and len([t for t in rows if t.startswith("###")]) == 3
    norm = 1 - 0.75 + 0.75 * 3 / 50
    assert rows["## alpha"] == pytest.approx(8 * 2 * 2.2 / (2 + 1.2 * norm) + 5 / 16 * 0.5 * min(1, 1 / max(1, math.log10(16))))
