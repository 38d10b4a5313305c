"""Reading JSONL files, runs, annotations, deduplication tables, reviews, features and images."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridloom.operators import validate
from gridloom.operators.images import SUFFIXES

#: The fields of a run's files.
_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())


def _record(*names: str, **kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT) for n in names] + [T.StructField(n, k) for n, k in kinds.items()])


OBSERVATION = _record("observation_id", "screenshot_path", "view_tree_path", "activity", "droidbot_state_str", "droidbot_structure_str")
TRANSITION = _record("transition_id", "source_observation_id", "destination_observation_id", "droidbot_effective", event=_record("event_type"))
ANNOTATION = _record("observation_id", "cluster_id", "source")
DEDUP = _record("pixel_sha256", observation_ids=_TEXTS)
REVIEW = _record("cluster_id", observation_ids=_TEXTS, incorrect_observation_ids=_TEXTS, status=_TEXT)
LEGACY = _record("observation_id", "auto_cluster_id", "baseline")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 1, line) of text files' lines that aren't blank; numbers are those in the file.

    Files are read in splits, each by a task. A line's number is its place in its split, whose rows are
    numbered without gaps as they are read, after the lines of the file's splits before it.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = read.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("path", "start", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    numbered = read.join(splits, ["path", "start"]).select("path", (F.col("id") + F.col("shift")).alias("line_no"), "line")
    return numbered.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")


def _check_lines(rows: DataFrame, path: str) -> None:
    sound = F.try_parse_json("line")
    bad = rows.select("line_no", sound.isNull().alias("invalid"), F.json_object_keys("line").isNull().alias("other")).where("invalid OR other").orderBy("line_no").limit(1).collect()
    if bad:
        raise ValueError((f"Invalid JSON in {path}:" if bad[0]["invalid"] else f"Expected an object in {path}:") + str(bad[0]["line_no"]))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The schema's fields of every record, with line_no, fields_present and the line itself as raw.

    Blank lines are skipped; a line that isn't JSON, or isn't an object, is an error that names it. NaN isn't JSON.
    """
    rows = read_lines(spark, path)
    _check_lines(rows, path)
    parsed = rows.select("line_no", F.from_json("line", schema).alias("r"), F.json_object_keys("line").alias("fields_present"), F.col("line").alias("raw"))
    return parsed.select("line_no", "r.*", "fields_present", "raw")


@dataclass(frozen=True)
class Run:
    """A run directory: its id, observations (obs_idx, ...) and transitions (trans_idx, ...), in file order."""

    run_dir: str
    run_id: str
    observations: DataFrame
    transitions: DataFrame

    def artifact(self, relative: str) -> str:
        """The path of an artifact, symbolic links resolved; an error if it leaves the run."""
        root = os.path.realpath(self.run_dir)
        path = os.path.realpath(os.path.join(root, relative))
        if path != root and not path.startswith(root + os.sep):
            raise ValueError(f"Artifact path escapes run directory: {relative}")
        return path


def load_run(spark: SparkSession, run_dir: str, *, check: bool = True) -> Run:
    """Reads run.json, observations.jsonl and transitions.jsonl, all required; with ``check``, enforces every rule."""
    for name in ("run.json", "observations.jsonl", "transitions.jsonl"):
        if not os.path.isfile(os.path.join(run_dir, name)):
            raise FileNotFoundError(f"Missing run file: {os.path.join(run_dir, name)}")
    with open(os.path.join(run_dir, "run.json"), encoding="utf-8") as f:
        run_id = str(json.load(f)["run_id"])
    observations = read_jsonl(spark, os.path.join(run_dir, "observations.jsonl"), OBSERVATION)
    observations = observations.withColumnsRenamed({"line_no": "obs_idx", "droidbot_state_str": "state_str", "droidbot_structure_str": "structure_str"}).withColumn("run_id", F.lit(run_id))
    transitions = read_jsonl(spark, os.path.join(run_dir, "transitions.jsonl"), TRANSITION)
    truthy = F.coalesce(~F.col("droidbot_effective").isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False))
    event_type = F.when(F.get_json_object("raw", "$.event").isNull() | ~F.array_contains(F.json_object_keys(F.get_json_object("raw", "$.event")), "event_type"), F.lit("unknown")).otherwise(F.coalesce("event.event_type", F.lit("None")))
    transitions = transitions.withColumns({"event_type": F.coalesce(event_type, F.lit("unknown")), "effective": truthy, "run_id": F.lit(run_id)}).withColumnRenamed("line_no", "trans_idx").drop("event", "droidbot_effective")
    run = Run(run_dir, run_id, observations, transitions)
    validate.enforce(validate.observation_violations(observations))
    if check:
        validate.enforce(validate.artifact_violations(observations))
        for row in observations.select("observation_id", "screenshot_path", "view_tree_path").toLocalIterator():
            for path in row[1:]:
                if not os.path.isfile(run.artifact(path)):
                    raise FileNotFoundError(f"{row[0]} references missing artifact: {path}")
        validate.enforce(validate.transition_violations(observations, transitions))
    return run


def load_annotations(spark: SparkSession, run: Run, path: str, *, complete: bool = False) -> DataFrame:
    """(ann_idx, observation_id, cluster_id, source), possibly partial, in the file's order, after all checks."""
    rows = read_jsonl(spark, path, ANNOTATION).withColumnRenamed("line_no", "ann_idx")
    validate.enforce(validate.annotation_violations(run.observations, rows, complete=complete))
    return rows.select("ann_idx", "observation_id", "cluster_id", "source")


def resume_annotations(spark: SparkSession, run: Run, original: str, output: str) -> DataFrame:
    """The annotation at ``output`` if an earlier session left one, else the original; both complete.

    An output must have exactly the original's observations.
    """
    first = load_annotations(spark, run, original, complete=True)
    if not os.path.exists(output):
        return first
    later = load_annotations(spark, run, output, complete=True)
    validate.enforce(validate.same_observations_violations(first, later))
    return later


def load_dedup_groups(spark: SparkSession, run: Run, path: str) -> DataFrame:
    """(group_idx, pixel_sha256, observation_ids), after all checks."""
    rows = read_jsonl(spark, path, DEDUP).withColumnRenamed("line_no", "group_idx")
    validate.enforce(validate.dedup_violations(run.observations, rows))
    return rows.select("group_idx", "pixel_sha256", "observation_ids")


def records_by_key(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """The last record of every key; none if the file doesn't exist."""
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    rows = read_jsonl(spark, path, schema)
    last = rows.groupBy(F.col(key).cast("string").alias("__key")).agg(F.max_by(F.struct(*schema.fieldNames()), "line_no").alias("r"))
    return last.select("r.*")


def load_assignments(spark: SparkSession, paths: list[str], schema: T.StructType = ANNOTATION) -> DataFrame:
    """Records of several files merged field by field: a later file's field wins if the record has it, null or not.

    Ordered by ``first``, the first file and line with the id.
    """
    union = None
    for k, path in enumerate(paths):
        rows = read_jsonl(spark, path, schema).withColumn("ord", F.struct(F.lit(k).alias("file_idx"), "line_no"))
        union = rows if union is None else union.unionByName(rows)
    missing = union.where("observation_id IS NULL").limit(1).collect()
    if missing:
        raise ValueError(f"Assignment lacks observation_id: {missing[0]['raw']}")
    latest = [F.max_by(F.struct(c), F.when(F.array_contains("fields_present", c), F.col("ord"))).getField(c).alias(c) for c in schema.fieldNames() if c != "observation_id"]
    return union.groupBy("observation_id").agg(*latest, F.min("ord").alias("first"))


def load_features(features: DataFrame, observations: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Feature rows of the wanted observations, by default all; errors for unknown and for missing ones, and for payloads of another id."""
    wanted = wanted if wanted is not None else observations
    unknown = wanted.select("observation_id").join(observations.select("observation_id"), "observation_id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"Unknown observation: {unknown[0][0]}")
    missing = wanted.select("observation_id").join(features.select("observation_id"), "observation_id", "left_anti").limit(1).collect()
    if missing:
        raise FileNotFoundError(f"Missing features of observation: {missing[0][0]}")
    if "payload_id" in features.columns:
        other = features.where(~F.col("payload_id").eqNullSafe(F.col("observation_id"))).limit(1).collect()
        if other:
            raise ValueError(f"Feature payload of another observation: {other[0]['observation_id']}")
    return features.join(wanted.select("observation_id"), "observation_id", "left_semi")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def list_images(spark: SparkSession, directory: str) -> DataFrame:
    """(path) of the images below a directory, by path; errors if it doesn't exist or has none."""
    if not os.path.isdir(directory):
        raise NotADirectoryError(f"Image directory does not exist: {directory}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).where(suffix(F.col("path")).isin(*SUFFIXES)).select("path")
    if found.isEmpty():
        raise ValueError(f"No supported images in {directory}")
    return found.orderBy("path")


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, image) decoded by Spark's image source; files that aren't images are an error."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).load(paths)
    return rows.select(F.col("image.origin").alias("path"), "image")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def pair_by_stem(screenshots: DataFrame, annotations: DataFrame) -> DataFrame:
    """(stem, screenshot, annotation) of every screenshot (path); an error if one has no annotation (path) of its name."""
    left = screenshots.select(F.col("path").alias("screenshot"), stem(F.col("path")).alias("stem"))
    both = left.join(annotations.select(F.col("path").alias("annotation"), stem(F.col("path")).alias("stem")), "stem", "left")
    error = F.raise_error(F.concat(F.lit("Screenshot without annotation: "), "screenshot")).cast("string")
    return both.withColumn("annotation", F.when(F.col("annotation").isNull(), error).otherwise(F.col("annotation")))


def pair_processed(features: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, feature, target) of paths whose stems end, after the last underscore, in the same id; order by id as text."""
    last = lambda df, name: df.select(F.col("path").alias(name), F.substring_index(stem(F.col("path")), "_", -1).alias("id"))
    return last(features, "feature").join(last(targets, "target"), "id")
