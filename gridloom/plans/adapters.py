"""The data model's tables, read from the benchmark tables: observations, transitions, annotations, tiles, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation per event; a run per user."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("obs_idx"), F.format_string("obs_%06d", "event_id").alias("observation_id"), F.col("event_type").alias("activity"), F.col("props").alias("structure_str"), "value")


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transition from every event to the user's next one."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    t = e.withColumn("next_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))).where("next_id IS NOT NULL")
    return t.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("trans_idx"), F.format_string("trans_%06d", "event_id").alias("transition_id"), F.format_string("obs_%06d", "event_id").alias("source_observation_id"),
        F.format_string("obs_%06d", "next_id").alias("destination_observation_id"), "event_type", (F.col("value") > 100).alias("effective"),
    )


def document_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation per document, its digest that of the text."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("obs_idx"), F.format_string("doc_%08d", "doc_id").alias("observation_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), "lang", "source")


def label_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial annotation of the documents: language and quality."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    j = read(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")
    return j.select(F.col("doc_id").alias("ann_idx"), F.format_string("doc_%08d", "doc_id").alias("observation_id"), F.concat_ws("_", "lang", F.col("quality").cast("string")).alias("cluster_id"), F.lit("labels").alias("source"))


def embedding_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 16-digit hash per embedding: the signs of its 64 components."""
    e = read(spark, sf_dir, "embeddings")
    digits = [
        F.lower(F.hex(sum((F.when(F.element_at("embedding", 4 * d + b + 1) >= 0, F.lit(8 >> b)).otherwise(0) for b in range(4)), F.lit(0)).cast("long")))
        for d in range(16)
    ]
    return e.select(F.col("vec_id").alias("obs_idx"), F.format_string("vec_%06d", "vec_id").alias("observation_id"), F.concat(*digits).alias("feature"), "label")


def embedding_tiles(spark: SparkSession, sf_dir: str, per_screen: int = 10) -> DataFrame:
    """Screens of ten tiles each, in a grid of 2 by 5; logits from the first two components."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / per_screen).cast("long").alias("screen"), (F.col("vec_id") % per_screen).cast("int").alias("tile_idx"), F.col("embedding").alias("vec"),
        F.array((F.element_at("embedding", 1) * 8.0).cast("double"), (F.element_at("embedding", 2) * 8.0).cast("double")).alias("logits"),
    )
