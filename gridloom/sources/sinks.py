"""Writing JSONL, CSV, JSON and SVG, each whole or not at all."""

from __future__ import annotations

import csv
import json
import os
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from gridloom.plans.lineage import cut


@contextmanager
def _whole(path: str, *, overwrite: bool = True):
    """A text file that takes its name when all is written, and leaves nothing behind otherwise."""
    if not overwrite and os.path.exists(path):
        raise FileExistsError(f"Output already exists: {path}")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"  # writers of one path don't share it
    try:
        with open(temporary, "w", encoding="utf-8", newline="") as out:
            yield out
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_lines(path: str, lines: Iterable[str], *, overwrite: bool = True) -> str:
    with _whole(path, overwrite=overwrite) as out:
        for line in lines:
            out.write(line + "\n")
    return path


def write_jsonl(df: DataFrame, path: str, order: list[str], *, columns: list[str] | None = None, overwrite: bool = True) -> str:
    """One file of a record per row, in the given order, null fields kept; rows stream through the driver one part at a time."""
    if not overwrite and os.path.exists(path):
        raise FileExistsError(f"Output already exists: {path}")
    columns = columns or [c for c in df.columns if c not in order or c in ("observation_id", "cluster_id")]
    text = df.orderBy(*order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))
    return write_lines(path, (json.dumps(json.loads(r["line"]), ensure_ascii=False) for r in text.toLocalIterator()), overwrite=overwrite)


def write_jsonl_parts(df: DataFrame, path: str, order: list[str], columns: list[str]) -> None:
    """A folder of JSONL parts, each and all in order, written by the executors: for tables that no one file should hold."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_by_key(df: DataFrame, path: str, key: str) -> str:
    """Records sorted by their key."""
    return write_jsonl(df, path, [key], columns=df.columns)


def label_assignments(labels: DataFrame, baseline: str, source: str | None = None) -> DataFrame:
    """(obs_idx, observation_id, cluster_id, source) of (obs_idx, observation_id, label): the baseline's name and a four-digit label."""
    return labels.select("obs_idx", "observation_id", F.format_string(f"{baseline}_%04d", F.col("label")).alias("cluster_id"), F.lit(source or baseline).alias("source"))


def write_assignments(labels: DataFrame, observations: DataFrame, path: str, baseline: str, source: str | None = None) -> str:
    """One assignment per observation, in dataset order; an error if their numbers differ."""
    if labels.count() != observations.count():
        raise ValueError("There must be one label per observation")
    return write_jsonl(label_assignments(labels, baseline, source), path, ["obs_idx"], columns=["observation_id", "cluster_id", "source"])


def write_cluster_assignments(annotations: DataFrame, path: str) -> str:
    """An annotation's three fields, in order, after checking that none is empty."""
    for column, says in (("observation_id", "Every assignment needs an observation_id"), ("source", "invalid source"), ("cluster_id", "invalid cluster_id")):
        if not annotations.where(F.col(column).isNull() | (F.col(column) == "")).isEmpty():
            raise ValueError(says)
    return write_jsonl(annotations, path, ["ann_idx"], columns=["observation_id", "cluster_id", "source"])


def write_csv(rows: DataFrame, path: str, order: list[str]) -> str:
    """A header and all rows; null is empty; an error without rows."""
    got = rows.orderBy(*order).toLocalIterator()
    first = next(got, None)
    if first is None:
        raise ValueError("There are no rows to write")
    with _whole(path) as out:
        writer = csv.writer(out)
        writer.writerow(rows.columns)
        writer.writerow(["" if v is None else v for v in first])
        for row in got:
            writer.writerow(["" if v is None else v for v in row])
    return path


def write_json(record: dict, path: str) -> str:
    with _whole(path) as out:
        json.dump(record, out, ensure_ascii=False, indent=2)
        out.write("\n")
    return path


def polyline(rows: DataFrame, x: str, y: str, width: int, height: int, margin: int, most: float, low: float = 0.0) -> str:
    """Points of a line through (x from 0 to most, y from low to 1), scaled to a plot."""
    across, up = F.col(x) / most, (F.col(y) - low) / (1 - low)
    points = rows.orderBy(x).select(F.format_string("%.2f,%.2f", margin + across * (width - 2 * margin), height - margin - up * (height - 2 * margin)).alias("p"))
    return " ".join(r["p"] for r in points.toLocalIterator())


def write_metric_plot(rows: DataFrame, path: str, x: str = "distance_threshold", metrics: tuple[tuple[str, str, str], ...] = (("F1", "full_f1", "#1f77b4"), ("ARI", "full_ari", "#ff7f0e"), ("NMI", "full_nmi", "#2ca02c"))) -> str:
    """An SVG of one line per metric over thresholds, with titled axes and six ticks; the scale goes below 0 where a score does. An error without rows."""
    width, height, margin = 960, 540, 60
    ends = rows.agg(F.max(x), *[F.min(column) for _, column, _ in metrics]).first()
    if ends[0] is None:
        raise ValueError("There are no rows to plot")
    most, low = ends[0] or 1.0, min(0.0, *(v for v in ends[1:] if v is not None))
    bottom, right = height - margin, width - margin
    text = lambda x, y, words, anchor="middle", more="": f'<text x="{x}" y="{y:.2f}" text-anchor="{anchor}" font-size="12"{more}>{words}</text>'
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">', f'<rect width="{width}" height="{height}" fill="white"/>']
    for tick in range(6):
        y = bottom - tick / 5 * (bottom - margin)
        parts += [f'<line x1="{margin}" y1="{y:.2f}" x2="{right}" y2="{y:.2f}" stroke="#ddd"/>', text(margin - 8, y + 4, f"{low + tick / 5 * (1 - low):.1f}", "end")]
    parts += [f'<path d="M{margin} {margin}V{bottom}H{right}" fill="none" stroke="#333"/>', text(margin, bottom + 18, "0"), text(right, bottom + 18, f"{most:.4g}"), text(width / 2, bottom + 40, "Distance threshold")]
    parts.append(text(16, height / 2, "Score", more=f' transform="rotate(-90 16 {height // 2})"'))
    for k, (name, column, color) in enumerate(metrics):
        parts += [f'<polyline fill="none" stroke="{color}" stroke-width="2" points="{polyline(rows, x, column, width, height, margin, most, low)}"/>', f'<text x="{right - 60}" y="{margin + 18 * k}" fill="{color}" font-size="14">{name}</text>']
    parts.append("</svg>")
    return write_lines(path, parts)


def resumable(inputs: DataFrame, done: DataFrame, key: str, work) -> tuple[DataFrame, DataFrame]:
    """(results, failures): ``work`` on the inputs whose key isn't done; rows with an ``error`` are set aside.

    work takes and returns a DataFrame, with a column ``error`` that is null where it succeeded.
    """
    made = cut(work(inputs.join(done.select(key), key, "left_anti")), "resumable")
    return made.where("error IS NULL").drop("error"), made.where("error IS NOT NULL").select(key, "error")


def resumable_parts(inputs: DataFrame, path: str, key: str, parts: int, work) -> DataFrame:
    """``work`` on the inputs in ``parts`` parts by a hash of their key, each a folder below path; finished ones are skipped.

    A part that broke off has no _SUCCESS and is done again. All parts' results are returned.
    """
    if parts < 1:
        raise ValueError("There must be at least one part")
    spark = inputs.sparkSession
    folders = [f"{path.rstrip('/')}/part={k:05d}" for k in range(parts)]
    for k, folder in enumerate(folders):
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
            work(inputs.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(*folders)


def write_feature_manifest(path: str, run_id: str, extractor: str, model: str, patch_size: int, selected: DataFrame, observations: DataFrame, checkpoint: str | None = None) -> str:
    """What features were made by, of how many observations of how many."""
    return write_json(
        {
            "run_id": run_id, "extractor": extractor, "model_name": model, "grounding_checkpoint": os.path.realpath(checkpoint) if checkpoint else None, "native_resolution": True,
            "patch_size": patch_size, "observation_count": selected.count(), "dataset_observation_count": observations.count(),
        },
        path,
    )
