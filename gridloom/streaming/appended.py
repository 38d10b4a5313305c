"""Following a folder of appended JSONL files: an extension, with Structured Streaming.

Every file that arrives is read once. Each micro-batch is written as an immutable version of the keys it
changes; reading takes the last version of every key, so a batch that is run again does no harm.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery


def read_appended(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """A stream of the schema's fields of every record of the files that come into a folder."""
    text = spark.readStream.format("text").option("maxFilesPerTrigger", 100).load(folder)
    return text.select(F.from_json("value", schema).alias("r"), F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).where("r IS NOT NULL").select("r.*", "at", "path", "start")


def latest_assignments(stream: DataFrame, out: str, checkpoint: str, key: str = "observation_id") -> StreamingQuery:
    """Writes, for every micro-batch, the last record of every key in it: by file, then by its place in the file."""

    def write(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("__line", F.monotonically_increasing_id())
        last = placed.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.struct("at", "path", "start", "__line")).alias("r"))
        last.select(key, "r.*").write.mode("overwrite").parquet(os.path.join(out, f"version={number}"))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def read_latest(spark: SparkSession, out: str, key: str = "observation_id") -> DataFrame:
    """The last version of every key."""
    rows = spark.read.parquet(out)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("r"))
    return last.select(key, "r.*").drop("version")
