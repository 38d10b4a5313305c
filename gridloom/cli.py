"""The command line: deduplicate, hash, cluster, benchmark, sweep, migrate, combine-reviews."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import cluster, dedup, evaluate, images, linkage, migrate, similarity
from gridloom.operators.validate import check_output_path, dedup_violations, enforce
from gridloom.sources import jsonl, sinks

BASELINES = ("activity", "state_str", "structure_str", "perceptual", "dino", "grounding", "grounding_transition", "element_matching")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("deduplicate", help="group observations with equal pixels")
    c.add_argument("run_dir"), c.add_argument("output"), c.add_argument("--overwrite", action="store_true")
    c = sub.add_parser("hash", help="difference hashes of all screenshots")
    c.add_argument("run_dir"), c.add_argument("output")
    c = sub.add_parser("cluster", help="cluster a run's observations")
    c.add_argument("run_dir"), c.add_argument("output_dir"), c.add_argument("--baseline", choices=BASELINES, required=True), c.add_argument("--features")
    c.add_argument("--distance-threshold", type=float, default=0.15), c.add_argument("--max-hash-distance", type=int, default=8)
    c.add_argument("--class-weights", type=float, nargs=2, default=[1.0, 1.0]), c.add_argument("--match-method", choices=sorted(similarity.SCORERS), default="best")
    c = sub.add_parser("benchmark", help="score an annotation against a reference")
    c.add_argument("run_dir"), c.add_argument("predicted"), c.add_argument("reference")
    c = sub.add_parser("sweep", help="score every cut of the element-matching dendrogram")
    c.add_argument("run_dir"), c.add_argument("features"), c.add_argument("reference"), c.add_argument("dedup"), c.add_argument("--output-dir", required=True)
    c.add_argument("--threshold", type=float, default=0.01), c.add_argument("--match-method", choices=sorted(similarity.SCORERS), default="hungarian"), c.add_argument("--class-weights", type=float, nargs=2, default=[1.0, 1.0])
    c = sub.add_parser("migrate", help="replace an older annotation file by its conversion")
    c.add_argument("run_dir"), c.add_argument("annotation"), c.add_argument("--source")
    c = sub.add_parser("combine-reviews", help="the last review of every cluster")
    c.add_argument("output"), c.add_argument("inputs", nargs="+")
    return p


def screenshots(spark: SparkSession, run: jsonl.Run) -> DataFrame:
    """Observations with their decoded images."""
    obs = run.observations.select("obs_idx", "observation_id", F.concat(F.lit(os.path.realpath(run.run_dir) + "/"), "screenshot_path").alias("file"))
    shown = jsonl.read_images(spark, run.run_dir).withColumn("file", F.regexp_replace(F.col("path"), "^file:/*", "/"))
    return obs.join(shown, "file")


def deduplicate(spark: SparkSession, a: argparse.Namespace) -> None:
    if os.path.exists(a.output) and not a.overwrite:
        raise FileExistsError(f"Deduplication file already exists: {a.output}")
    run = jsonl.load_run(spark, a.run_dir)
    groups = dedup.dedup_groups(images.with_pixel_digest(screenshots(spark, run)), "pixel_sha256").withColumnsRenamed({"digest": "pixel_sha256", "first_idx": "group_idx"}).cache()
    enforce(dedup_violations(run.observations, groups))
    sinks.write_jsonl(groups, a.output, ["group_idx"], columns=["pixel_sha256", "observation_ids"])
    groups.unpersist()


def hash_(spark: SparkSession, a: argparse.Namespace) -> None:
    run = jsonl.load_run(spark, a.run_dir)
    rows = images.with_difference_hash(screenshots(spark, run)).withColumn("extractor", F.lit("difference_hash_64"))
    sinks.write_jsonl(rows, a.output, ["obs_idx"], columns=["observation_id", "extractor", "feature"])


def _tiles(features: DataFrame) -> DataFrame:
    """Feature rows with patch_features and element_logits as tiles of screens."""
    rows = features.select("screen", F.posexplode(F.arrays_zip("patch_features", "element_logits")).alias("tile_idx", "t"))
    return rows.select("screen", "tile_idx", F.col("t.patch_features").alias("vec"), F.col("t.element_logits").alias("logits"))


def cluster_(spark: SparkSession, a: argparse.Namespace) -> None:
    run = jsonl.load_run(spark, a.run_dir)
    obs = run.observations
    if a.baseline in ("activity", "state_str", "structure_str"):
        labels = cluster.categorical_clusters(obs, a.baseline)
    elif a.baseline == "perceptual":
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField(n, T.StringType()) for n in ("observation_id", "extractor", "feature")])
        hashes = jsonl.read_jsonl(spark, a.features, schema).select("observation_id", "feature")
        labels = cluster.perceptual_clusters(obs.select("obs_idx", "observation_id").join(hashes, "observation_id"), "feature", a.max_hash_distance)
    else:
        feats = jsonl.load_features(spark.read.parquet(a.features), obs).join(obs.select("obs_idx", "observation_id"), "observation_id").withColumn("screen", F.col("obs_idx"))
        if a.baseline == "element_matching":
            found = linkage.cluster_screens(_tiles(feats), a.distance_threshold, method=a.match_method, class_weights=a.class_weights)
        else:
            found = linkage.cluster_embeddings(_embedding(feats, run, a.baseline), "obs_idx", "embedding", a.distance_threshold)
        labels = found.withColumnRenamed("i", "obs_idx").join(obs.select("obs_idx", "observation_id"), "obs_idx")
    sinks.write_assignments(labels, obs, os.path.join(a.output_dir, run.run_id, "annotations", f"{a.baseline}.jsonl"), a.baseline)


def _embedding(feats: DataFrame, run: jsonl.Run, baseline: str) -> DataFrame:
    from gridloom.operators import features as f

    if baseline == "dino":
        return feats.select("obs_idx", F.col("global_embedding").alias("embedding"))
    tiles = _tiles(feats).join(feats.select("screen", "observation_id"), "screen")
    made = f.grounding_embedding(tiles, feats.select("observation_id", F.col("patch_grid.rows").alias("rows"), F.col("patch_grid.cols").alias("cols"), "global_embedding"))
    if baseline == "grounding_transition":
        made = f.transition_embedding(made, run.transitions)
    return made.join(feats.select("observation_id", "obs_idx"), "observation_id")


def benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    run = jsonl.load_run(spark, a.run_dir)
    row = evaluate.evaluate(jsonl.load_annotations(spark, run, a.predicted), jsonl.load_annotations(spark, run, a.reference), run.run_id).first()
    print(json.dumps({k: int(v) if k in ("tp", "fp", "fn", "tn", "pairs_predicted", "pairs_actual", "pairs_all") else v for k, v in row.asDict().items()}, ensure_ascii=False, indent=2))


def sweep_(spark: SparkSession, a: argparse.Namespace) -> None:
    from gridloom.plans import sweep as s

    run = jsonl.load_run(spark, a.run_dir)
    first = dedup.first_members(jsonl.load_dedup_groups(spark, run, a.dedup)).join(run.observations.select("observation_id", "obs_idx"), "observation_id")
    reference = jsonl.load_annotations(spark, run, a.reference).join(first, "observation_id").select(F.col("obs_idx").alias("i"), F.col("cluster_id").alias("actual"))
    feats = jsonl.load_features(spark.read.parquet(a.features), run.observations, first).join(first.select("observation_id", F.col("obs_idx").alias("screen")), "observation_id")
    rows, labels, matrix = s.sweep(_tiles(feats), reference, method=a.match_method, class_weights=a.class_weights)
    names = first.select(F.col("obs_idx").alias("i"), "obs_idx", "observation_id")
    s.write_artifacts(rows.cache(), labels, matrix, names, a.output_dir, a.threshold, {k: v for k, v in vars(a).items() if k != "command"})


def migrate_(spark: SparkSession, a: argparse.Namespace) -> None:
    print(migrate.migrate_in_place(spark, jsonl.load_run(spark, a.run_dir).observations, a.annotation, a.source))


def combine(spark: SparkSession, a: argparse.Namespace) -> None:
    for path in a.inputs:
        check_output_path(path, a.output)
    print(migrate.combine_review_files(spark, a.inputs, a.output))


COMMANDS = {"deduplicate": deduplicate, "hash": hash_, "cluster": cluster_, "benchmark": benchmark, "sweep": sweep_, "migrate": migrate_, "combine-reviews": combine}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](spark or SparkSession.builder.appName("gridloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
