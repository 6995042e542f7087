"""Collections: a folder of Parquet tables with a configuration, and what is read from and written to it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.config import MAX_TAG, MAX_TAGS, META_TYPES, CollectionConfig, SearchRequest, check_collection_name
from marlstone.errors import Conflict, NotFound, ValidationError
from marlstone.operators import filters, index, joins
from marlstone.operators.search import Outcome, Tables, search
from marlstone.streaming import ingest


def schema(config: CollectionConfig) -> str:
    meta = "".join(f", meta_{k} {META_TYPES[t]}" for k, t in config.metadata_indexes.items())
    dense = "".join(f", {f}_{v.name} array<float>" for v in config.vectors if v.dense for f in v.index_fields)
    return f"doc_id string, ts timestamp, name string, description string, content string, content_hash string, metadata string, tags array<string>{meta}{dense}"


def with_indexes(docs: DataFrame, config: CollectionConfig) -> DataFrame:
    """Typed meta_ columns out of the metadata JSON."""
    for key, kind in config.metadata_indexes.items():
        raw = F.get_json_object("metadata", f"$.{key}")
        raw = F.coalesce(F.get_json_object("metadata", f"$.{key}.value"), raw)
        docs = docs.withColumn(f"meta_{key}", F.try_to_timestamp(raw) if kind == "datetime" else raw.try_cast(META_TYPES[kind]))
    return docs


def clean_tags(tags: Column) -> Column:
    """Trimmed tags without blanks and repetitions, in their order."""
    return F.array_distinct(F.filter(F.transform(tags, F.trim), lambda t: F.length(t) > 0))


def valid_metadata(config: CollectionConfig) -> Column:
    """Whether each indexed key of the metadata is absent or of its type, and tags keep their limits; deletes always are."""
    rule = F.lit(True)
    for key, kind in config.metadata_indexes.items():
        raw = F.coalesce(F.get_json_object("metadata", f"$.{key}.value"), F.get_json_object("metadata", f"$.{key}"))
        typed = F.try_to_timestamp(raw) if kind == "datetime" else raw.try_cast(META_TYPES[kind])
        rule &= raw.isNull() | typed.isNotNull()
    tags = F.coalesce(clean_tags(F.col("tags")), F.array().cast("array<string>"))
    rule &= (F.size(tags) <= MAX_TAGS) & ~F.exists(tags, lambda t: F.length(t) > MAX_TAG)
    return (F.col("op") == "delete") | rule


def page(docs: DataFrame, page_size: int = 100, after: str | None = None) -> DataFrame:
    """The next ``page_size`` documents by id, and one more if there are more: a filter and a top-k."""
    if not 1 <= page_size <= 1000:
        raise ValidationError("page_size must be from 1 to 1000")
    rows = docs if after is None else docs.where(F.col("doc_id") > after)
    return rows.orderBy("doc_id").limit(page_size + 1)


def by_ids(docs: DataFrame, ids: list) -> DataFrame:
    """The documents of ``ids`` in that order; a missing one is a row of nulls but for ``pos`` and ``wanted``."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    wanted = spark.createDataFrame([(i, str(x)) for i, x in enumerate(ids)], "pos int, wanted string").withColumn("wanted", F.col("wanted").cast(kind))
    found = docs.where(F.col("doc_id").isin(*ids))
    return F.broadcast(wanted).join(found, F.col("wanted") == F.col("doc_id"), "left").orderBy("pos")


def by_values(docs: DataFrame, key: str, values: list, limit: int, where=None, indexes: dict[str, str] | None = None) -> DataFrame:
    """Documents whose metadata key is among the values, by id, up to the limit."""
    rows = docs.where(F.col(f"meta_{key}").isin(*values))
    tree = filters.build(where)
    if tree is not None:
        rows = rows.where(filters.to_column(tree, indexes or {}))
    return rows.orderBy("doc_id").limit(limit)


class Collection:
    """A named collection under a warehouse folder.

    Tables lie in version folders; a write makes a new version and then turns the pointer, so readers
    never see a folder that is being written."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.name = spark, check_collection_name(name)
        self.root = f"{path.rstrip('/')}/{name}"

    # -- files
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        return self.spark.read.text(path, wholetext=True).first()[0]

    def _write(self, path: str, text: str) -> None:
        fs, p = self._fs(path + ".new")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        final = self._fs(path)[1]
        fs.delete(final, False)
        if not fs.rename(p, final):
            raise OSError(f"cannot rename to {path}")

    # -- catalog
    @classmethod
    def create(cls, spark: SparkSession, path: str, name: str, config: CollectionConfig) -> Collection:
        c = cls(spark, path, name)
        if c.exists():
            raise Conflict(f"collection {name!r} exists")
        c._write(f"{c.root}/config.json", config.to_json())
        c._save(spark.createDataFrame([], schema(config)), config)
        return c

    @classmethod
    def open(cls, spark: SparkSession, path: str, name: str) -> Collection:
        c = cls(spark, path, name)
        if not c.exists():
            raise NotFound(f"no collection {name!r}")
        return c

    @staticmethod
    def names(spark: SparkSession, path: str) -> list[str]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def exists(self) -> bool:
        fs, p = self._fs(f"{self.root}/config.json")
        return fs.exists(p)

    def drop(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)

    def empty(self) -> None:
        config = self.config
        self.drop()
        Collection.create(self.spark, self.root.rsplit("/", 1)[0], self.name, config)

    @property
    def config(self) -> CollectionConfig:
        return CollectionConfig.from_json(self._read(f"{self.root}/config.json"))

    # -- tables
    def _version(self) -> str:
        return self._read(f"{self.root}/version").strip()

    def docs(self) -> DataFrame:
        return self.spark.read.schema(schema(self.config)).parquet(f"{self._version()}/docs")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("doc_id string, token string, weight double, fv string").parquet(f"{self._version()}/postings")

    def _save(self, docs: DataFrame, config: CollectionConfig) -> None:
        version = f"{self.root}/v-{uuid.uuid4().hex}"
        docs.select(*(F.col(c.strip().split(" ")[0]) for c in schema(config).split(","))).write.parquet(f"{version}/docs")
        stored = self.spark.read.schema(schema(config)).parquet(f"{version}/docs")
        built = index.build(stored, config.vectors)
        if built is None:
            built = self.spark.createDataFrame([], "fv string, doc_id string, token string, weight double")
        # sorted by token within each vector, so that row groups without a query's tokens are skipped
        built.repartition("fv", F.pmod(F.xxhash64("token"), F.lit(16))).sortWithinPartitions("fv", "token").write.partitionBy("fv").parquet(f"{version}/postings")
        self._write(f"{self.root}/version", version)

    # -- writing
    def apply(self, ops: DataFrame) -> None:
        """Apply upserts and deletes (seq, op, doc_id, doc_ts, name, description, content, metadata, tags) in order of seq.

        Operations whose metadata or tags are not valid are left out and kept as dead letters, see ``rejected``."""
        config = self.config
        ops, dead = ingest.split_valid(ops, valid_metadata(config), "metadata of another type than its index, or tags beyond their limits")
        if not dead.isEmpty():
            dead.select("seq", "op", "doc_id", "doc_ts", "reason").write.mode("append").parquet(f"{self.root}/rejected")
        new = ingest.fold(self.docs(), ops.withColumn("tags", clean_tags(F.col("tags"))))
        self._save(with_indexes(new, config), config)

    def rejected(self) -> DataFrame:
        """(seq, op, doc_id, doc_ts, reason) of the operations that were left out."""
        kind = "seq long, op string, doc_id string, doc_ts timestamp, reason string"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/rejected")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.root}/rejected")

    def apply_stream(self, ops: DataFrame, checkpoint: str):
        """Apply a stream of operations, one micro-batch at a time; a single writer."""
        return ops.writeStream.foreachBatch(lambda df, _: self.apply(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # -- reading
    def get(self, ids: list[str]) -> list[dict]:
        rows = [r.asDict(recursive=True) for r in by_ids(self.docs(), ids).collect()]
        missing = [r["wanted"] for r in rows if r["doc_id"] is None]
        if missing:
            raise NotFound(f"no documents {', '.join(missing)}")
        return rows

    def fetch(self, page_size: int = 100, after: str | None = None, where=None, tags: list[str] | None = None, match_all: bool = False) -> tuple[list[dict], str | None]:
        rows = self.docs()
        if tags:
            rows = rows.where(filters.tags_match(tags, match_all))
        tree = filters.build(where)
        if tree is not None:
            rows = rows.where(filters.to_column(tree, self.config.metadata_indexes))
        got = [r.asDict(recursive=True) for r in page(rows, page_size, after).collect()]
        return got[:page_size], got[page_size - 1]["doc_id"] if len(got) > page_size else None

    def count(self) -> int:
        return self.docs().count()

    def stats(self) -> DataFrame:
        return index.avgdl_stats(self.postings())

    def vectors(self) -> DataFrame:
        """(doc_id, fv, tokens): each document's sparse vectors put together again."""
        return self.postings().groupBy("doc_id", "fv").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("tokens"))

    def export(self, path: str) -> None:
        """All documents as gzip-compressed JSON lines without nulls."""
        self.docs().write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "true").json(path)

    def tables(self) -> Tables:
        postings = self.postings()
        return Tables(self.docs(), postings, index.idf_table(postings), self.count())

    def search(self, request: SearchRequest) -> Outcome:
        base = self.root.rsplit("/", 1)[0]

        def other(name: str):
            c = Collection.open(self.spark, base, name)
            return c.docs(), c.config.metadata_indexes

        specs = joins.parse(request.join) if request.join else []
        for s in specs:
            Collection.open(self.spark, base, s.collection)
        return search(self.tables(), self.config, request, other)
