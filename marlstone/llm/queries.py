"""One query per operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import ann, chat, common, decontaminate, near_dedup, pitman_yor, quality, sentencepiece_bpe, sharding, token_file, toxicity

OP1_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(13 + length(role) + n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Per document the count and checksum of its ids, and whether they decode to the text itself."""
    model = model or public_tokenizer("piece_bpe_32k.model")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_bpe.round_trip(docs, model)
    crc = F.crc32(F.array_join(F.col("pieces"), ","))
    return both.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), crc.alias("pieces_crc32"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(common.table(spark, sf_dir, "documents"), 40)
    size = sharding.row_size(F.col("text"))
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_file(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    tokenizer = tokenizer or public_tokenizer("byte_bpe_50k.json")
    out = common.scratch_path(spark, "tokens")
    files = token_file.write_tokens(common.table(spark, sf_dir, "documents"), out, tokenizer)
    return token_file.read_tokens(spark, out, files)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    chosen = chat.best_paths(chat.chains(given.unionByName(own)))
    formatted = common.materialise(chat.format_paths(chosen), "conversations")
    read = chat.read_back(formatted)
    return read.select(F.expr("try_cast(tree AS BIGINT)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = near_dedup.classes(common.table(spark, sf_dir, "documents"))
    return named.select("doc_id", "class_id", "class_size")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain)
    cut = chain.thresholds[chain.categories.index("toxic")]
    return scored.select("doc_id", *(f"p_{c}" for c in chain.categories), (F.col("p_toxic") >= cut).alias("toxic"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", *quality.METADATA)
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "p_quality", (F.col("p_quality") >= model.threshold).alias("keep"))


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = pitman_yor.score(common.table(spark, sf_dir, "documents"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % pitman_yor.MODULUS == pitman_yor.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_sentencepiece, op3_sharding, op4_near_dedup, op5_toxicity, op6_token_file, op7_neighbours, op8_chat, op9_quality, op10_pitman_yor)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op8_chat": OP8_SQL}
