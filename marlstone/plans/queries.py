"""The engine's own queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.config import Arm, CollectionConfig, FacetOptions, SearchRequest, VectorConfig
from marlstone.functions import embed
from marlstone.functions import text as T
from marlstone.functions import weights as W
from marlstone.operators import arms as A
from marlstone.operators import filters, fusion, grouping, index, joins
from marlstone.operators.search import Tables, exclude, scored_arms, search
from marlstone.sources import collection
from marlstone.streaming import ingest, metrics

QUERY = "the and of"
TAKEN = (3, 7)  # vectors that serve as queries
INDEXES = {"lang": "string", "source": "string", "n_chars": "integer", "quality": "integer", "toxic": "boolean"}
LEXICAL = VectorConfig("ws", "whitespace", use_stopwords=False)
CONFIG = CollectionConfig([LEXICAL, VectorConfig("v", "dense_custom", dims=64)], INDEXES)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if name == "documents" and len(df.inputFiles()) < 2 < n else df  # a lone small file is one task otherwise


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.join(labels, "doc_id", "left")
    return d.select("doc_id", F.col("text").alias("content"), F.array("lang", "source").alias("tags"), F.col("lang").alias("meta_lang"), F.col("source").alias("meta_source"), F.col("n_chars").alias("meta_n_chars"), F.col("quality").cast("long").alias("meta_quality"), (F.col("toxic") == 1).alias("meta_toxic"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("content_v"), "label")


def query_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


_kept: dict[tuple[str, str], Tables] = {}


def lexical(spark: SparkSession, sf_dir: str) -> Tables:
    """The whitespace index of documents, built once a session and folder and persisted, as a collection keeps it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        d = docs(spark, sf_dir)
        postings = index.build(d, [LEXICAL]).persist()
        _kept[key] = Tables(d, postings, index.idf_table(postings).persist(), d.count())
    return _kept[key]


def hybrid(spark: SparkSession, sf_dir: str) -> Tables:
    t = lexical(spark, sf_dir)
    both = t.docs.join(vectors(spark, sf_dir).select("doc_id", "content_v"), "doc_id")
    inner = t.postings.join(both.select("doc_id"), "doc_id", "left_semi")
    return Tables(both, inner, t.idf, t.n_docs)


def ranked(top: DataFrame, *more: str) -> DataFrame:
    """At most ``limit`` rows: their places, and scores to six digits."""
    w = Window.orderBy(F.desc("score"), F.desc("tie"), "doc_id")
    return top.select(F.row_number().over(w).cast("long").alias("place"), "doc_id", F.round("score", 6).alias("score"), *more)


FOLDED = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g'))"
POSTINGS = rf"""
tok AS (SELECT doc_id, unnest(ts) AS token, len(ts) AS length FROM (SELECT doc_id, list_filter(string_split({FOLDED}, ' '), lambda x: x <> '') AS ts FROM documents)),
tf AS (SELECT doc_id, token, length, count(*) AS tf FROM tok GROUP BY ALL),
post AS (SELECT doc_id, token, tf * 2.2e0 / (tf + 1.2e0 * (0.75e0 * length / 50e0 + 0.25e0)) AS weight FROM tf
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) <= 128),
idf AS (SELECT token, count(*) AS doc_count FROM post GROUP BY 1),
q AS (SELECT token, 1 * 2.2e0 / (1 + 1.2e0 * (0.75e0 * 3 / 5e0 + 0.25e0)) * ln(((SELECT count(*) FROM documents) + 1) / (doc_count + 0.5e0)) AS qw
      FROM idf WHERE token IN ('the', 'and', 'of'))"""
SPARSE = f"{POSTINGS},\nlex AS (SELECT doc_id, round(sum(weight * qw), 9) AS score FROM post JOIN q USING (token) GROUP BY 1)"
META = "(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(quality AS BIGINT) AS quality, toxic = 1 AS toxic FROM documents d LEFT JOIN labels USING (doc_id))"


def _arms_sql(limit: int, where: str = "") -> str:
    n = max(5, int(1.5 * limit))
    return f"""{SPARSE},
dense AS (SELECT d.doc_id, round(list_dot_product(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])), 9) AS score
          FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = {TAKEN[0]}) x),
both_ids AS (SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id),
arms AS (SELECT 0 AS arm, doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM lex JOIN both_ids USING (doc_id) {where} QUALIFY rk <= {n}
         UNION ALL SELECT 1, doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM dense {where} QUALIFY rk <= {n})"""


# ---- text and index


@query(f"WITH {SPARSE} SELECT row_number() OVER (ORDER BY s DESC, doc_id) AS place, doc_id, round(s, 6) AS score, lang FROM (SELECT lex.doc_id, score AS s, lang FROM lex JOIN documents USING (doc_id) ORDER BY score DESC, lex.doc_id LIMIT 10)")
def search_whitespace_bm25(spark, sf_dir):
    t = lexical(spark, sf_dir)
    one = SearchRequest(QUERY, [Arm("ws", "content")])
    top = scored_arms(t, CONFIG, one).orderBy(F.desc("score"), "doc_id").limit(10)
    return ranked(t.docs.join(F.broadcast(top), "doc_id").withColumn("tie", F.lit(0.0)), F.col("meta_lang").alias("lang"))


@query(f"WITH {POSTINGS} SELECT token, doc_count FROM idf")
def idf_table(spark, sf_dir):
    return lexical(spark, sf_dir).idf.select("token", "doc_count")


@query(f"WITH {POSTINGS} SELECT 'content_ws' AS fv, round(avg(n), 6) AS avgdl, count(*) AS n_docs FROM (SELECT doc_id, count(*) AS n FROM post GROUP BY 1)")
def avgdl_stats(spark, sf_dir):
    return index.avgdl_stats(lexical(spark, sf_dir).postings).select("fv", F.round("avgdl", 6).alias("avgdl"), "n_docs")


@query(f"WITH {POSTINGS} SELECT doc_id, token, round(weight, 6) AS weight FROM post QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) <= 5")
def postings_topk(spark, sf_dir):
    return index.top_k(lexical(spark, sf_dir).postings, 5).select("doc_id", "token", F.round("weight", 6).alias("weight"))


@query(rf"""WITH f AS (SELECT page_id, '  ' || trim(regexp_replace(lower(url), '\s+', ' ', 'g')) || '  ' AS t FROM pages),
g AS (SELECT page_id, len(t) - 2 AS length, substr(t, i, 3) AS token FROM (SELECT page_id, t, unnest(range(1, len(t) - 1)) AS i FROM f)),
tf AS (SELECT page_id, token, length, count(*) AS tf FROM g GROUP BY ALL),
w AS (SELECT page_id, token, tf * 2.2e0 / (tf + 1.2e0 * (0.75e0 * length / 50e0 + 0.25e0)) AS weight FROM tf QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, '###' || token) <= 128),
df AS (SELECT token, count(*) AS n FROM w GROUP BY 1),
qt AS (SELECT substr('  example page  ', i, 3) AS token FROM (SELECT unnest(range(1, 15)) AS i)),
q AS (SELECT token, count(*) * 2.2e0 / (count(*) + 1.2e0 * (0.75e0 * 14 / 5e0 + 0.25e0)) AS qw FROM qt GROUP BY 1),
s AS (SELECT page_id AS doc_id, round(sum(weight * qw * ln(((SELECT count(*) FROM pages) + 1) / (n + 0.5e0))), 9) AS score FROM w JOIN q USING (token) JOIN df USING (token) GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 15""")
def search_trigram(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("content"))
    v = VectorConfig("tri", "trigrams")
    postings = index.build(pages, [v])
    t = Tables(pages, postings, index.idf_table(postings), pages.count())
    scored = scored_arms(t, CollectionConfig([v]), SearchRequest("example page", [Arm("tri", "content")]))
    return scored.orderBy(F.desc("score"), "doc_id").limit(15).select("doc_id", F.round("score", 6).alias("score"))


@query()
def search_fulltext_stem(spark, sf_dir):
    """Unicode words and stems: not expressible in SQL; held against a plain version in the tests."""
    d = docs(spark, sf_dir)
    v = VectorConfig("ft", "full_text", top_k=512)
    postings = index.build(d.select("doc_id", "content"), [v])
    t = Tables(d, postings, index.idf_table(postings), d.count())
    return ranked(search(t, CollectionConfig([v]), SearchRequest("handing erless", limit=20)).results.withColumn("tie", F.lit(0.0)))


@query()
def search_wmtr(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("content"))
    v = VectorConfig("kw", "keyword")
    postings = index.build(pages, [v])
    t = Tables(pages, postings, index.idf_table(postings), pages.count())
    return ranked(search(t, CollectionConfig([v]), SearchRequest("example.com/fr page", limit=20)).results.withColumn("tie", F.lit(0.0)))


# ---- dense


def _dense_sql(expr: str) -> str:
    return f"SELECT vec_id AS doc_id, round(score, 6) AS score FROM (SELECT e.vec_id, round({expr}, 9) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings) e, (SELECT embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id = {TAKEN[1]})) ORDER BY round(score, 9) DESC, doc_id LIMIT 15"


def _dense(spark, sf_dir, distance):
    scored = A.dense(vectors(spark, sf_dir), query_of(spark, sf_dir, TAKEN[1]), distance, "content_v")
    return scored.orderBy(F.desc("score"), "doc_id").limit(15).select("doc_id", F.round("score", 6).alias("score"))


@query(_dense_sql("list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))"))
def dense_cosine(spark, sf_dir):
    return _dense(spark, sf_dir, "cosine")


@query(_dense_sql("1 + list_dot_product(a, b)"))
def dense_dot(spark, sf_dir):
    return _dense(spark, sf_dir, "dot")


@query(_dense_sql("1 - list_distance(a, b)"))
def dense_euclid(spark, sf_dir):
    return _dense(spark, sf_dir, "euclid")


# ---- fusion


def _request(spark, sf_dir, **more) -> SearchRequest:
    return SearchRequest(QUERY, [Arm("ws", "content", 0.7), Arm("v", "content", 0.3)], dense_query=query_of(spark, sf_dir, TAKEN[0]), **more)


RRF = "fused AS (SELECT doc_id, round(sum(CASE arm WHEN 0 THEN 0.7e0 ELSE 0.3e0 END / (2 + rk)), 9) AS score, round(sum(score), 9) AS tie FROM arms GROUP BY 1)"
FUSED = "SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM fused ORDER BY score DESC, tie DESC, doc_id LIMIT {n})"


@query(f"WITH {_arms_sql(10)}, {RRF} {FUSED.format(n=10)}")
def hybrid_rrf(spark, sf_dir):
    return search(hybrid(spark, sf_dir), CONFIG, _request(spark, sf_dir)).results.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_arms_sql(10)}, scaled AS (SELECT *, min(score) OVER (PARTITION BY arm) AS lo, max(score) OVER (PARTITION BY arm) AS hi FROM arms),
fused AS (SELECT doc_id, round(sum(CASE arm WHEN 0 THEN 0.7e0 ELSE 0.3e0 END * CASE WHEN lo = hi THEN 1 ELSE (score - lo) / (hi - lo) END), 9) AS score, 0 AS tie FROM scaled GROUP BY 1) {FUSED.format(n=10)}""")
def hybrid_linear(spark, sf_dir):
    return search(hybrid(spark, sf_dir), CONFIG, _request(spark, sf_dir, fusion="linear")).results.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_arms_sql(10)}, {RRF}, top AS (SELECT doc_id FROM fused ORDER BY score DESC, tie DESC, doc_id LIMIT 10)
SELECT doc_id, CASE arm WHEN 0 THEN 'ws' ELSE 'v' END AS vector, round(score, 6) AS score, CAST(rk AS BIGINT) AS rk FROM arms JOIN top USING (doc_id)""")
def raw_scores(spark, sf_dir):
    hits = search(hybrid(spark, sf_dir), CONFIG, _request(spark, sf_dir, raw_scores=True)).results
    return hits.select("doc_id", F.inline("raw")).select("doc_id", "vector", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rk"))


@query(f"WITH {_arms_sql(10)}, {RRF} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM fused WHERE score >= 0.05 ORDER BY score DESC, tie DESC, doc_id LIMIT 10)")
def score_threshold(spark, sf_dir):
    return search(hybrid(spark, sf_dir), CONFIG, _request(spark, sf_dir, score_threshold=0.05)).results.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_arms_sql(10, 'JOIN (SELECT doc_id FROM documents WHERE n_chars > 800) USING (doc_id)')}, {RRF} {FUSED.format(n=10)}")
def hybrid_filtered(spark, sf_dir):
    return search(hybrid(spark, sf_dir), CONFIG, _request(spark, sf_dir, where="n_chars > 800")).results.select("doc_id", F.round("score", 6).alias("score"))


# ---- filters, tags, projection


def _filter(name: str, text, sql: str):
    def run(spark, sf_dir):
        return docs(spark, sf_dir).where(filters.to_column(filters.build(text), INDEXES)).select("doc_id")

    run.__name__ = name
    query(f"SELECT doc_id FROM {META} WHERE {sql}")(run)


_filter("filter_eq_range", {"key": "n_chars", "gte": 500, "lt": 900}, "n_chars >= 500 AND n_chars < 900")
_filter("filter_and_or_not", {"or": [{"and": [{"key": "lang", "eq": "de"}, {"key": "n_chars", "gt": 1000}]}, {"not": {"key": "quality", "eq": 1}}]}, "(lang = 'de' AND n_chars > 1000) OR NOT quality = 1")
_filter("filter_null", {"and": [{"key": "toxic", "is_null": True}, {"key": "source", "neq": "src1"}]}, "toxic IS NULL AND source <> 'src1'")
_filter("filter_string_expr", 'NOT (lang = "en" OR lang = "fr") AND quality >= 1 AND toxic = false OR source = "src3" AND quality IS NOT NULL', "(NOT (lang = 'en' OR lang = 'fr') AND quality >= 1 AND toxic = false) OR (source = 'src3' AND quality IS NOT NULL)")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND NOT o_orderdate >= TIMESTAMP '1996-07-01'")
def filter_datetime(spark, sf_dir):
    tree = filters.parse('day >= "1996-01-01T00:00:00Z" AND NOT day >= "1996-07-01"')
    return table(spark, sf_dir, "orders").where(filters.to_column(tree, {"day": "datetime"}, column=lambda _: F.col("o_orderdate").cast("timestamp"))).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src2' OR lang = 'src2' OR source = 'de'")
def tags_any(spark, sf_dir):
    return docs(spark, sf_dir).where(filters.tags_match(["de", "src2"], False)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source = 'src2'")
def tags_all(spark, sf_dir):
    return docs(spark, sf_dir).where(filters.tags_match(["de", "src2", "de"], True)).select("doc_id")


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS content, lang FROM documents WHERE source = 'src4'")
def exclude_projection(spark, sf_dir):
    return exclude(docs(spark, sf_dir).where("meta_source = 'src4'").select("doc_id", "content", F.col("meta_lang").alias("lang")), ["content"])


# ---- scans


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 51")
def fetch_page_1(spark, sf_dir):
    return collection.page(docs(spark, sf_dir), 50).select("doc_id", F.col("meta_lang").alias("lang"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id > 49 ORDER BY doc_id LIMIT 51")
def fetch_page_2(spark, sf_dir):
    return collection.page(docs(spark, sf_dir), 50, 49).select("doc_id", F.col("meta_lang").alias("lang"))


@query("SELECT CAST(p AS BIGINT) AS pos, w AS wanted, lang FROM (VALUES (0, 90), (1, 5), (2, -4), (3, 17)) v(p, w) LEFT JOIN documents ON doc_id = w")
def get_by_ids(spark, sf_dir):
    rows = collection.by_ids(docs(spark, sf_dir), [90, 5, -4, 17])
    return rows.select(F.col("pos").cast("long").alias("pos"), "wanted", F.col("meta_lang").alias("lang"))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src3', 'src8') AND lang = 'en' ORDER BY doc_id LIMIT 40")
def lookup_by_meta_values(spark, sf_dir):
    return collection.by_values(docs(spark, sf_dir), "source", ["src3", "src8"], 40, 'lang = "en"', INDEXES).select("doc_id", F.col("meta_source").alias("source"))


# ---- joins


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", F.col("c_nationkey").cast("long").alias("meta_nation"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("meta_cust"), F.col("o_orderstatus").alias("meta_status"))


def _joined(spark, sf_dir, text: str):
    spec = joins.parse(text)[0]
    out = joins.nested(_customers(spark, sf_dir), _orders(spark, sf_dir), spec, {"cust": "integer", "status": "string"})
    ids = F.transform("joined_orders", lambda x: x["doc_id"].cast("string"))
    return out.select("doc_id", F.size("joined_orders").cast("long").alias("n"), F.array_join(ids, ",").alias("ids"))


JOINED = "SELECT c_custkey AS doc_id, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS ids FROM customer LEFT JOIN (SELECT * FROM orders WHERE {where}) ON {on} GROUP BY 1"


@query(JOINED.format(where="true", on="c_custkey = o_orderkey"))
def join_id_default(spark, sf_dir):
    return _joined(spark, sf_dir, "orders")


@query(JOINED.format(where="true", on="c_custkey = o_custkey"))
def join_meta(spark, sf_dir):
    return _joined(spark, sf_dir, "orders[$id=$$.meta.cust]")


@query(JOINED.format(where="o_orderstatus = 'F'", on="c_custkey = o_custkey"))
def join_filter(spark, sf_dir):
    return _joined(spark, sf_dir, 'orders[$id=$$.meta.cust](status = "F")')


@query(JOINED.format(where="o_orderstatus = 'none'", on="c_custkey = o_custkey"))
def join_missing_children(spark, sf_dir):
    return _joined(spark, sf_dir, 'orders[$id=$$.meta.cust](status = "none")')


@query(JOINED.format(where="true", on="c_nationkey = o_custkey"))
def join_meta_to_meta(spark, sf_dir):
    return _joined(spark, sf_dir, "orders[$.meta.nation=$$.meta.cust]")


# ---- facets and groups

FACETS = """SELECT field, value, n FROM (
  SELECT 'lang' AS field, lang AS value, count(*) AS n FROM pool GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM pool GROUP BY ALL
  UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM pool GROUP BY ALL UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM pool GROUP BY ALL
  UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR), count(*) FROM pool GROUP BY ALL) WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= {n}"""


@query(f"WITH pool AS {META} {FACETS.format(n=10)}")
def facet_counts(spark, sf_dir):
    return grouping.facets(docs(spark, sf_dir), INDEXES)


@query(f"WITH pool AS {META} {FACETS.format(n=3)}")
def facet_top_n(spark, sf_dir):
    return grouping.facets(docs(spark, sf_dir), INDEXES, 3)


@query(f"WITH pool AS (SELECT * FROM {META} WHERE quality = 1 AND lang <> 'en') {FACETS.format(n=10)}")
def facet_filtered(spark, sf_dir):
    return grouping.facets(docs(spark, sf_dir).where(filters.to_column(filters.parse('quality = 1 AND lang != "en"'), INDEXES)), INDEXES)


@query(f"WITH {_arms_sql(40)}, pool AS (SELECT * FROM {META} WHERE doc_id IN (SELECT doc_id FROM arms)) {FACETS.format(n=10)}".replace("QUALIFY rk <= 60", "QUALIFY rk <= 80"))
def facet_with_group(spark, sf_dir):
    return search(hybrid(spark, sf_dir), CONFIG, _request(spark, sf_dir, limit=40, group_field="source", group_max=1, facets=FacetOptions())).facets


SCORED = "base AS (SELECT doc_id, round(n_chars % 997, 9) AS score, 0 AS tie, lang, quality FROM {meta})".format(meta=META)


def _scored(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round((F.col("meta_n_chars") % 997).cast("double"), 9).alias("score"), F.lit(0.0).alias("tie"), "meta_lang", "meta_quality")


@query(f"WITH {SCORED} SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k FROM base) WHERE k <= 3 ORDER BY score DESC, doc_id LIMIT 10")
def group_cap(spark, sf_dir):
    return grouping.cap(_scored(spark, sf_dir), "meta_lang", 3, 10).select("doc_id", F.col("meta_lang").alias("lang"))


@query(f"WITH {SCORED} SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY score DESC, doc_id) AS k FROM base) WHERE k <= 2 ORDER BY score DESC, doc_id LIMIT 20")
def group_null_bucket(spark, sf_dir):
    return grouping.cap(_scored(spark, sf_dir), "meta_quality", 2, 20).select("doc_id", F.col("meta_quality").alias("quality"))


@query(f"""WITH {SCORED}, r1 AS (SELECT * FROM base QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 15),
c1 AS (SELECT * FROM r1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) <= 1),
full_groups AS (SELECT lang FROM c1 GROUP BY lang HAVING count(*) >= 1),
r2 AS (SELECT * FROM base WHERE (SELECT count(*) FROM c1) < 10 AND lang NOT IN (SELECT lang FROM full_groups) QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 15),
pool AS (SELECT * FROM r1 UNION SELECT * FROM r2)
SELECT doc_id, lang FROM (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) <= 1) ORDER BY score DESC, doc_id LIMIT 10""")
def group_refetch(spark, sf_dir):
    scored = _scored(spark, sf_dir).select(F.lit(0).alias("arm"), F.lit(1.0).alias("weight"), "doc_id", "score", "meta_lang").persist()
    return grouping.refetch(scored, "meta_lang", 15, 1, 10, 2).select("doc_id", F.col("meta_lang").alias("lang"))


@query(rf"""WITH {POSTINGS.replace(POSTINGS[POSTINGS.index(',' + chr(10) + 'q AS'):], '')},
bt AS (SELECT item_id, unnest(ts) AS token, len(ts) AS length FROM (SELECT item_id, list_filter(string_split({FOLDED}, ' '), lambda x: x <> '') AS ts FROM benchmark)),
qv AS (SELECT item_id, token, count(*) * 2.2e0 / (count(*) + 1.2e0 * (0.75e0 * length / 5e0 + 0.25e0)) AS qw FROM bt GROUP BY item_id, token, length),
s AS (SELECT item_id, doc_id, round(sum(weight * (qw * ln(((SELECT count(*) FROM documents) + 1) / (doc_count + 0.5e0)))), 6) AS score FROM post JOIN qv USING (token) JOIN idf USING (token) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS BIGINT) AS place, doc_id FROM s QUALIFY place <= 3""")
def multi_query_benchmark(spark, sf_dir):
    """All benchmark items as queries, in one plan."""
    t = lexical(spark, sf_dir)
    counts = T.whitespace(table(spark, sf_dir, "benchmark"), "text", ("item_id",))
    q = counts.select("item_id", F.lit("content_ws").alias("fv"), "token", W.bm25(F.col("tf"), F.col("length"), W.QUERY_AVGDL).alias("qw"))
    q = q.join(t.idf, ["fv", "token"]).withColumn("qw", F.col("qw") * W.idf(F.lit(t.n_docs), F.col("doc_count"))).drop("doc_count")
    hits = t.postings.join(q, ["fv", "token"]).groupBy("item_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("score"))
    return A.prefetch(hits, 3, ("item_id",)).select("item_id", F.col("rank").cast("long").alias("place"), "doc_id")


# ---- ingestion: events as operations on users' documents


def _ops(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("u"), "user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("doc_ts"), F.col("event_type").alias("name"), F.col("props").alias("content"))


@query("SELECT 'u' || user_id AS doc_id, event_id AS seq FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def ingest_latest_wins(spark, sf_dir):
    return ingest.latest_wins(_ops(spark, sf_dir).where("op = 'upsert'")).select("doc_id", "seq")


@query()
def ingest_fold_upsert_delete(spark, sf_dir):
    """An ordered fold: not expressible in SQL; held against a plain version in the tests."""
    stored = spark.createDataFrame([], "doc_id string, ts timestamp, name string, description string, content string, content_hash string, metadata string, tags array<string>")
    return ingest.fold(stored, _ops(spark, sf_dir)).select("doc_id", "name", F.unix_micros("ts").alias("ts_us"))


@query("""SELECT doc_id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.ts <= o.ts THEN 'skip' WHEN n.x IS DISTINCT FROM o.x OR n.y IS DISTINCT FROM o.y THEN 'update' ELSE 'patch' END AS change FROM
(SELECT 'u' || user_id AS doc_id, ts, event_type AS x, props AS y FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1) n LEFT JOIN
(SELECT 'u' || user_id AS id, ts, event_type AS x, props AS y FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1) o ON o.id = n.doc_id""")
def change_classes(spark, sf_dir):
    ops = _ops(spark, sf_dir).withColumn("description", F.lit(None).cast("string")).withColumn("ts", F.col("doc_ts"))
    new, old = ingest.latest_wins(ops.where("seq % 2 = 1")), ingest.latest_wins(ops.where("seq % 2 = 0"))
    return new.alias("n").join(old.alias("o"), F.col("n.doc_id") == F.col("o.doc_id"), "left").select("n.doc_id", ingest.change_class().alias("change"))


def _queue(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(s) for s in ("queued", "requeued", "failed"))), (F.col("seq") % 3 + 1).cast("int"))
    return _ops(spark, sf_dir).select("seq", "op", "doc_id", F.col("doc_ts").alias("ts"), status.alias("status"))


@query("""SELECT count(*) FILTER (WHERE s = 0 AND NOT d) AS queued_upsert, count(*) FILTER (WHERE s = 0 AND d) AS queued_delete, count(*) FILTER (WHERE s = 1 AND NOT d) AS requeued_upsert,
count(*) FILTER (WHERE s = 1 AND d) AS requeued_delete, count(*) FILTER (WHERE s = 2 AND NOT d) AS failed_upsert, count(*) FILTER (WHERE s = 2 AND d) AS failed_delete, count(*) AS total FROM (SELECT event_id % 3 AS s, event_type = 'error' AS d FROM events)""")
def queue_info_pivot(spark, sf_dir):
    return ingest.queue_counts(_queue(spark, sf_dir))


@query("SELECT 'u' || user_id AS doc_id, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'requeued' ELSE 'failed' END AS status, epoch_us(ts) AS ts_us FROM events UNION ALL SELECT 'u' || user_id, 'indexed', max(epoch_us(ts)) FROM events GROUP BY 1")
def status_view(spark, sf_dir):
    q = _queue(spark, sf_dir)
    return ingest.status_view(q.groupBy("doc_id").agg(F.max("ts").alias("ts")), q).select("doc_id", "status", F.unix_micros("ts").alias("ts_us"))


# ---- metrics: events by type and host


def _events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("h"), F.col("user_id") % 4).alias("hostname"), F.lit("api").alias("source"), F.col("event_type").alias("key"), F.array(F.concat(F.lit("d"), F.col("user_id") % 2)).alias("dims"), "value", F.lit(1).cast("long").alias("n"))


def _flat(df: DataFrame, at: str = "bucket_start") -> DataFrame:
    return df.select("hostname", "key", F.array_join("dims", "|").alias("dim"), F.unix_seconds(at).alias("at_s"), F.round("value", 4).alias("value"), "n")


EVENTS = "(SELECT ts, 'h' || (user_id % 4) AS hostname, event_type AS key, 'd' || (user_id % 2) AS dim, value FROM events)"


def _bucket_sql(seconds: int) -> str:
    return f"SELECT hostname, key, dim, CAST(floor(epoch(ts) / {seconds}) * {seconds} AS BIGINT) AS at_s, round(sum(value), 4) AS value, count(*) AS n FROM {EVENTS} GROUP BY 1, 2, 3, 4"


@query(_bucket_sql(5))
def metrics_5s(spark, sf_dir):
    return _flat(metrics.tumble(_events(spark, sf_dir), 5))


@query(_bucket_sql(60))
def metrics_1m(spark, sf_dir):
    return _flat(metrics.rollup(metrics.tumble(_events(spark, sf_dir), 5), 60))


@query(_bucket_sql(300))
def metrics_5m_rollup(spark, sf_dir):
    return _flat(metrics.rollup(metrics.rollup(metrics.tumble(_events(spark, sf_dir), 5), 60), 300))


@query(f"SELECT hostname, key, dim, CAST((floor(epoch(ts) / 5) + i) * 5 AS BIGINT) AS at_s, round(sum(value), 4) AS value, count(*) AS n FROM {EVENTS}, range(1, 13) r(i) GROUP BY 1, 2, 3, 4")
def metrics_sliding_60s(spark, sf_dir):
    return _flat(metrics.slide(_events(spark, sf_dir), 60), "window_end")


@query("""SELECT hostname, source, last_us FROM (SELECT 'h' || (user_id % 40) AS hostname, event_type AS source, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2)
WHERE floor(last_us / 1000000) >= (SELECT floor(max(epoch_us(ts)) / 1000000) FROM events) - 86400""")
def metrics_latest_view(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("h"), F.col("user_id") % 40).alias("hostname"), F.col("event_type").alias("source"), "value")
    now = e.agg(F.max("ts")).first()[0]
    return metrics.latest_view(e, F.lit(now), 86_400).select("hostname", "source", F.unix_micros("ts").alias("last_us"))


@query("""WITH b AS (SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS at_s, sum(value) AS value, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1),
span AS (SELECT min(at_s) AS lo, max(at_s) AS hi FROM b), grid AS (SELECT unnest(range(lo, hi + 300, 300)) AS at_s FROM span)
SELECT at_s, round(value, 4) AS value, n FROM grid LEFT JOIN b USING (at_s)""")
def metrics_trend_series(spark, sf_dir):
    b = metrics.tumble(_events(spark, sf_dir).where("key = 'click'"), 300).persist()
    lo, hi = b.agg(F.min("bucket_start"), F.max("bucket_start")).first()
    s = metrics.series(b, 300, F.lit(lo), F.timestamp_seconds(F.unix_seconds(F.lit(hi)) + 300))
    return s.select(F.unix_seconds("bucket_start").alias("at_s"), F.round("value", 4).alias("value"), "n")


@query("""WITH b AS (SELECT DISTINCT 60 AS width, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS at_s FROM events UNION SELECT DISTINCT 300, CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) FROM events), now AS (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) AS t FROM events)
SELECT CAST(width AS BIGINT) AS width, at_s FROM b, now WHERE at_s >= t - CASE width WHEN 60 THEN 86400 ELSE 604800 END""")
def metrics_retention(spark, sf_dir):
    e = _events(spark, sf_dir)
    b = metrics.tumble(e, 60, ("source",)).unionByName(metrics.tumble(e, 300, ("source",)))
    now = e.agg(F.max("ts")).first()[0]
    return metrics.retain(b, F.lit(now)).select(F.col("bucket_seconds").cast("long").alias("width"), F.unix_seconds("bucket_start").alias("at_s"))


@query("""WITH u AS (SELECT event_type AS model, w AS window_s, sum(value) AS value FROM events, (VALUES (30), (60)) v(w) WHERE w = 60 OR user_id % 2 = 0 GROUP BY 1, 2),
d AS (SELECT model, sum(value / window_s * (60.0e0 / window_s)) AS demand FROM u GROUP BY 1), h AS (SELECT event_type AS model, count(DISTINCT user_id % 4) AS hosts FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT model, round(demand, 4) AS demand, round(demand / sum(demand) OVER (), 6) AS proportion, round(demand / sum(demand) OVER () / (coalesce(hosts, 0) + 1), 6) AS score FROM d LEFT JOIN h USING (model)""")
def model_demand_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    use = e.select(F.col("event_type").alias("model"), F.explode(F.when(F.col("user_id") % 2 == 0, F.array(F.lit(30), F.lit(60))).otherwise(F.array(F.lit(60)))).alias("window_s"), "value")
    hosts = e.where("event_type <> 'view'").groupBy(F.col("event_type").alias("model")).agg(F.countDistinct(F.col("user_id") % 4).alias("hosts"))
    out = metrics.demand(use.groupBy("model", "window_s").agg(F.sum("value").alias("value")), hosts)
    return out.select("model", F.round("demand", 4).alias("demand"), F.round("proportion", 6).alias("proportion"), F.round("score", 6).alias("score"))


@query("""SELECT unnest(['engine_' || key || '{host="' || hostname || '",source="api"} ' || printf('%.6f', v), 'engine_' || key || '_n{host="' || hostname || '",source="api"} ' || printf('%.6f', n)]) AS line
FROM (SELECT event_type AS key, 'h' || (user_id % 4) AS hostname, CAST(round(sum(value), 2) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2)""")
def prometheus_lines(spark, sf_dir):
    view = _events(spark, sf_dir).groupBy("hostname", "source", "key").agg(F.round(F.sum("value"), 2).alias("value"), F.sum("n").alias("n"))
    return metrics.prometheus(view)


# ---- embeddings


@query()
def hash_embed_search(spark, sf_dir):
    """A deterministic embedder in Python: held against a plain version in the tests.

    A zero vector, of a text without words or whose words cancel out, has no direction and is not found."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    made = embed.embed(texts, "content", lambda: embed.hashing_embedder(64), "content_v").where(F.exists("content_v", lambda x: x != 0))
    scored = A.dense(made, embed.hashing_embedder(64)([QUERY])[0].tolist(), "cosine", "content_v")
    return scored.orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query(rf"""WITH tok AS (SELECT item_id AS doc_id, unnest(list_filter(string_split({FOLDED}, ' '), lambda x: x <> '')) AS token FROM benchmark)
SELECT doc_id, token, round(ln(1 + count(*)::DOUBLE), 6) AS weight FROM tok GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, token) <= 16""")
def splade_like(spark, sf_dir):
    made = embed.max_log_weights(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "text", 16)
    return made.select("doc_id", F.inline("sparse")).select("doc_id", "token", F.round("weight", 6).alias("weight"))


@query()
def token_id_mmh3(spark, sf_dir):
    words = T.whitespace(table(spark, sf_dir, "benchmark"), "text", ("item_id",)).select("token").distinct()
    return words.select("token", embed.token_ids(F.col("token")).alias("token_id"))
