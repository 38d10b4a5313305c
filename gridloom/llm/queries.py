"""The queries of this subpackage, one ``opN_<name>`` per operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import bpe, embed_dedup, html_extract, langid, line_dedup, packing, quality, sharding, simhash, token_counts

#: Where the vocabulary is on this machine; a parameter of every operator that encodes.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3)


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_read(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_content_lines")


def packed(documents: DataFrame) -> DataFrame:
    pieces = packing.pack(documents, "doc_id", "text", RANKS, PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(_read(spark, sf_dir, "documents"), "text", RANKS, PATTERN))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = sharding.shard(_read(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_read(spark, sf_dir, "documents"), ["doc_id"], "text", RANKS, PATTERN)
    both = bpe.decode(ids, ["doc_id", "ids"], "ids", RANKS)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(documents.where("not held_out"), "doc_id", "text", "lang")
    return langid.identify(documents, ["doc_id", "held_out"], "text", model)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_lines, op3_html, op4_packing, op5_quality, op6_token_counts, op7_sharding, op8_bpe, op9_language, op10_embeddings, pipeline)}


_LINKS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98)"""
OP10_SQL = f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
  c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
  SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it has the means: the others hash by XXH64, encode by a vocabulary, fit models or compare by edits. Tests hold those against brute force."""
    return {"op10_embeddings": OP10_SQL}
