"""Bringing older annotation and review files into today's form."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators.validate import annotation_violations, enforce

#: The fields of an older annotation record.
LEGACY_FIELDS = ("auto_cluster_id", "baseline", "observation_id")


def inferred_source(legacy: DataFrame) -> str:
    """The one baseline that all records name; an error if there isn't exactly one."""
    found = legacy.where("baseline <> ''").select("baseline").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("Cannot infer source from legacy baseline values; pass source")
    return found[0][0]


def convert_legacy(legacy: DataFrame, source: str | None = None) -> DataFrame:
    """(ann_idx, observation_id, cluster_id, source) of older records (ann_idx, observation_id, auto_cluster_id, baseline), in order."""
    if "fields_present" in legacy.columns:
        other = legacy.where(F.array_sort("fields_present") != F.array(*map(F.lit, LEGACY_FIELDS)))
        if not other.isEmpty():
            raise ValueError("Legacy annotations must contain exactly observation_id, auto_cluster_id, and baseline")
    source = source if source is not None else inferred_source(legacy)
    return legacy.select("ann_idx", "observation_id", F.col("auto_cluster_id").alias("cluster_id"), F.lit(source).alias("source"))


def convert_file(spark: SparkSession, observations: DataFrame, path: str, output: str, source: str | None = None) -> str:
    """convert_legacy of a file, checked to be complete, into another."""
    from gridloom.sources import jsonl, sinks

    legacy = jsonl.read_jsonl(spark, path, jsonl.LEGACY).withColumnRenamed("line_no", "ann_idx")
    converted = convert_legacy(legacy, source)
    enforce(annotation_violations(observations, converted, complete=True))
    return sinks.write_jsonl(converted, output, ["ann_idx"], columns=["observation_id", "cluster_id", "source"], overwrite=False)


def migrate_in_place(spark: SparkSession, observations: DataFrame, path: str, source: str | None = None) -> str:
    """Replaces an older file by its conversion and returns the backup, the untouched original; repeats fail."""
    stem, suffix = os.path.splitext(path)
    backup, converted = f"{stem}.legacy{suffix}", f"{path}.converted"
    for taken in (backup, converted):
        if os.path.exists(taken):
            raise FileExistsError(f"Already exists: {taken}")
    convert_file(spark, observations, path, converted, source)
    try:
        os.replace(path, backup)
        try:
            os.replace(converted, path)
        except BaseException:
            os.replace(backup, path)
            raise
    finally:
        if os.path.exists(converted):
            os.unlink(converted)
    return backup


def combine_review_files(spark: SparkSession, paths: list[str], output: str) -> str:
    """The last review of every cluster over several files, missing ones skipped, in the order of first reviews; the output must be new."""
    from gridloom.operators.curate import combine_reviews
    from gridloom.sources import jsonl, sinks

    logs = None
    for k, path in enumerate(paths):
        if os.path.isfile(path):
            rows = jsonl.read_jsonl(spark, path, jsonl.REVIEW).withColumn("file_idx", F.lit(k))
            if not rows.where("cluster_id IS NULL OR cluster_id = ''").isEmpty():
                raise ValueError(f"Invalid review cluster_id in {path}")
            logs = rows if logs is None else logs.unionByName(rows)
    if logs is None:
        return sinks.write_lines(output, [], overwrite=False)
    return sinks.write_jsonl(combine_reviews(logs.drop("fields_present", "raw")), output, ["first"], columns=jsonl.REVIEW.fieldNames(), overwrite=False)


def migrate_all(spark: SparkSession, observations: DataFrame, annotations: dict[str, str], reviews: tuple[list[str], str] | None, source: str | None = None) -> list[str]:
    """Several conversions (path to output) and a combination of reviews: all of them, or none is left."""
    made: list[str] = []
    try:
        for path, output in annotations.items():
            made.append(convert_file(spark, observations, path, output, source))
        if reviews:
            made.append(combine_review_files(spark, *reviews))
    except BaseException:
        for path in made:
            os.unlink(path)
        raise
    return made
