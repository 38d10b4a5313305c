"""Integrity rules as tables of violations, and raising the first of them.

A violations frame has (priority, ord, rule, key, message). ``enforce`` raises the message that comes
first by (priority, ord); an empty frame passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.plans.ordering import previous

COLUMNS = ("priority", "ord", "rule", "key", "message")
#: Names of annotation fields that are no longer allowed.
ABANDONED_FIELDS = ("auto_cluster_id", "manual_functional_state_label", "manual_substate_label")


def violation(df: DataFrame, when: Column, priority: int, rule: str, message: Column, order: str, key: Column) -> DataFrame:
    return df.where(when).select(F.lit(priority).alias("priority"), F.col(order).cast("long").alias("ord"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), message.alias("message"))


def enforce(violations: DataFrame, error: type[Exception] = ValueError) -> None:
    """Raises the first violation, if any."""
    first = violations.orderBy("priority", "ord", "rule").limit(1).collect()
    if first:
        raise error(first[0]["message"])


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (c == "")


def _repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with __again: whether an earlier row has the same key, blank keys aside."""
    several = df.where(~_blank(key)).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return df.join(several, F.col(key) == F.col("__key"), "left").withColumn("__again", F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__key", "__first")


#: Observations that a message names.
NAMED = 100


def _listed(left: DataFrame) -> DataFrame:
    """One row with the ids of the first ``NAMED`` observations, and how many more there are; none without any."""
    first = left.orderBy("obs_idx").limit(NAMED).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obs_idx", "observation_id"))), lambda x: x["observation_id"]), ", ").alias("ids"))
    counted = first.crossJoin(left.agg(F.count("*").alias("n")))  # one row each
    return counted.where("n > 0").select(F.concat("ids", F.when(F.col("n") > NAMED, F.concat(F.lit(" and "), (F.col("n") - NAMED).cast("string"), F.lit(" more"))).otherwise("")).alias("l"))


def observation_violations(observations: DataFrame) -> DataFrame:
    """Ids must be there, and unique."""
    again = _repeats(observations, "observation_id", "obs_idx")
    return _all([
        violation(observations, _blank("observation_id"), 10, "observation_id", F.lit("Every observation needs an observation_id"), "obs_idx", F.col("obs_idx")),
        violation(again, F.col("__again") & ~_blank("observation_id"), 10, "observation_unique", F.concat(F.lit("Duplicate observation ID: "), "observation_id"), "obs_idx", F.col("observation_id")),
    ])


def escapes(path: Column) -> Column:
    """Whether a relative path, its . and .. parts resolved, leaves its directory. Symbolic links are the loader's business."""
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(False).alias("out")),
        lambda s, part: F.when(part.isin("", "."), s).otherwise(
            F.struct((s["at"] + F.when(part == "..", -1).otherwise(1)).alias("at"), (s["out"] | ((part == "..") & (s["at"] < 1))).alias("out"))
        ),
    )
    return path.startswith("/") | depth["out"]


def artifact_violations(observations: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Paths must be there and stay inside the run; with ``files`` (path), they must exist."""
    out = []
    for k, field in enumerate(("screenshot_path", "view_tree_path")):
        out.append(violation(observations, F.col(field).isNull(), 20, field, F.concat("observation_id", F.lit(f" has invalid {field}")), "obs_idx", F.col("observation_id")))
        out.append(violation(observations, escapes(F.col(field)), 20, f"{field}_escapes", F.concat(F.lit("Artifact path escapes run directory: "), field), "obs_idx", F.col("observation_id")))
        if files is not None:
            missing = observations.join(files.select(F.col("path").alias(field)), field, "left_anti").where(F.col(field).isNotNull() & ~escapes(F.col(field)))
            out.append(violation(missing, F.lit(True), 20, f"{field}_missing", F.concat("observation_id", F.lit(" references missing artifact: "), field), "obs_idx", F.col("observation_id")))
    return _all(out)


def transition_violations(observations: DataFrame, transitions: DataFrame) -> DataFrame:
    """Transition ids, known ends, each source where the last destination was, and one observation more than transitions."""
    ids = observations.select(F.col("observation_id").alias("__id")).distinct()
    t = _repeats(transitions, "transition_id", "trans_idx")
    name = F.col("transition_id")
    run = F.col("run_id") if "run_id" in transitions.columns else F.lit(0)
    path = transitions.select(run.alias("__run"), "trans_idx", "transition_id", "source_observation_id", "destination_observation_id")
    path = previous(path, ["__run", "trans_idx"], F.struct("__run", F.col("destination_observation_id").alias("end")), "__last")
    path = path.withColumn("__before", F.when(F.col("__last.__run").eqNullSafe(F.col("__run")), F.col("__last.end")))
    out = [
        violation(transitions, _blank("transition_id"), 30, "transition_id", F.lit("Every transition needs a transition_id"), "trans_idx", F.col("trans_idx")),
        violation(t, F.col("__again") & ~_blank("transition_id"), 30, "transition_unique", F.concat(F.lit("Duplicate transition ID: "), name), "trans_idx", name),
    ]
    for k, (rule, end) in enumerate((("source", "source_observation_id"), ("destination", "destination_observation_id"))):
        unknown = transitions.join(ids, F.col(end) == F.col("__id"), "left_anti")
        out.append(violation(unknown, F.lit(True), 30, f"{rule}_known", F.concat(name, F.lit(f" has unknown {rule} observation: "), F.coalesce(end, F.lit("None"))), "trans_idx", name))
    broken = F.col("__before").isNotNull() & ~F.col("__before").eqNullSafe(F.col("source_observation_id"))
    out.append(violation(path, broken, 30, "trajectory", F.concat(F.lit("Broken N+1 trajectory at "), name, F.lit(": expected source "), "__before", F.lit(", got "), F.coalesce("source_observation_id", F.lit("None"))), "trans_idx", name))
    sizes = observations.agg(F.count("*").alias("no")).crossJoin(transitions.agg(F.count("*").alias("nt")))  # one row each
    out.append(violation(sizes.withColumn("zero", F.lit(0)), (F.col("nt") > 0) & (F.col("no") != F.col("nt") + 1), 40, "lengths", F.lit("An N+1 run must contain exactly one more observation than transition"), "zero", F.lit(None)))
    return _all(out)


def run_violations(observations: DataFrame, transitions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """All rules of a run."""
    return _all([observation_violations(observations), artifact_violations(observations, files), transition_violations(observations, transitions)])


def annotation_violations(observations: DataFrame, annotations: DataFrame, *, complete: bool = False, noun: str = "annotation", known: str = "annotated") -> DataFrame:
    """The first failing rule of every annotation record, in the order of its fields; with ``complete``, also observations left out.

    annotations has (ann_idx, observation_id, cluster_id, source) and may have fields_present, the names
    of the record's fields.
    """
    ids = observations.select(F.col("observation_id").alias("__id"), F.lit(True).alias("__known"))
    rows = _repeats(annotations, "observation_id", "ann_idx").join(ids, F.col("observation_id") == F.col("__id"), "left")
    name = F.coalesce("observation_id", F.lit("None"))
    none = F.lit(None).cast("string")
    abandoned = F.array_intersect("fields_present", F.array(*map(F.lit, ABANDONED_FIELDS))) if "fields_present" in annotations.columns else F.array().cast("array<string>")
    checks = [
        ("abandoned", F.size(abandoned) > 0, F.concat(F.lit("Abandoned annotation field(s): "), F.array_join(F.array_sort(abandoned), ", "))),
        ("known", F.col("__known").isNull(), F.concat(F.lit(f"Unknown {known} observation: "), name)),
        ("unique", F.col("__again"), F.concat(F.lit(f"Duplicate {noun}: "), name)),
        ("cluster_id", _blank("cluster_id"), F.concat(name, F.lit(" has an invalid cluster_id"))),
        *([("source", _blank("source"), F.concat(name, F.lit(" has an invalid source")))] if "source" in annotations.columns else []),
    ]
    rule = message = none
    for what, fails, says in reversed(checks):
        rule, message = F.when(fails, F.lit(what)).otherwise(rule), F.when(fails, says).otherwise(message)
    found = rows.withColumns({"__rule": rule, "__message": message}).where("__rule IS NOT NULL")
    out = found.select(F.lit(50).alias("priority"), F.col("ann_idx").cast("long").alias("ord"), F.col("__rule").alias("rule"), name.alias("key"), F.col("__message").alias("message"))
    if complete:
        left = observations.join(annotations.select("observation_id"), "observation_id", "left_anti")
        missing = _listed(left).select(F.lit(60).alias("priority"), F.lit(0).cast("long").alias("ord"), F.lit("complete").alias("rule"), none.alias("key"), F.concat(F.lit("Missing cluster annotations for: " if noun == "annotation" else "Missing cluster assignments for: "), F.col("l")).alias("message"))
        out = out.unionByName(missing)
    return out


def dedup_violations(observations: DataFrame, groups: DataFrame) -> DataFrame:
    """Rules of a deduplication table (group_idx, pixel_sha256, observation_ids[, fields_present])."""
    order = observations.select("observation_id", "obs_idx")
    members = groups.select("group_idx", F.posexplode("observation_ids").alias("pos", "observation_id")).join(order, "observation_id", "left")
    seen = _repeats(members.withColumn("__o", F.struct("group_idx", "pos")), "observation_id", "__o")
    inside = members.withColumn("__before", F.lag("obs_idx").over(Window.partitionBy("group_idx").orderBy("pos")))
    first = previous(members.where("pos = 0"), ["group_idx"], F.col("obs_idx"), "__before")
    key = F.col("observation_id")
    out = [
        violation(groups, ~F.coalesce(F.col("pixel_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), 50, "digest", F.lit("Invalid pixel_sha256"), "group_idx", F.col("group_idx")),
        violation(groups, F.coalesce(F.size("observation_ids"), F.lit(0)) < 1, 50, "empty", F.lit("Groups of equal images are non-empty; this one has no members"), "group_idx", F.col("group_idx")),
        violation(members, F.col("obs_idx").isNull(), 50, "known", F.concat(F.lit("Unknown deduplicated observation: "), key), "group_idx", key),
        violation(seen, F.col("__again") & F.col("obs_idx").isNotNull(), 50, "unique", F.concat(F.lit("Duplicate deduplicated observation: "), key), "group_idx", key),
        violation(inside, F.col("obs_idx") < F.col("__before"), 51, "member_order", F.lit("Members of a group aren't in dataset order"), "group_idx", key),
        violation(first, F.col("obs_idx") <= F.col("__before"), 52, "group_order", F.lit("Groups aren't in the order of first occurrence"), "group_idx", key),
    ]
    if "fields_present" in groups.columns:
        out.append(violation(groups, F.array_sort("fields_present") != F.array(F.lit("observation_ids"), F.lit("pixel_sha256")), 49, "fields", F.lit("Invalid deduplication record fields"), "group_idx", F.col("group_idx")))
    left = observations.join(members.select("observation_id"), "observation_id", "left_anti")
    out.append(violation(_listed(left).withColumn("zero", F.lit(0)), F.lit(True), 60, "cover", F.concat(F.lit("Deduplication does not cover observations: "), F.col("l")), "zero", F.lit(None)))
    return _all(out)


def matrix_violations(pairs: DataFrame, n: int, *, allow_empty: bool = True) -> DataFrame:
    """Rules of a distance matrix given as (i, j, d) with a row per ordered pair, i and j from 0 to n - 1."""
    a, b = pairs.select("i", "j", "d"), pairs.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("d").alias("t"))
    spark = pairs.sparkSession
    size = pairs.agg(F.count("*").alias("c"), F.min(F.least("i", "j")).alias("lo"), F.max(F.greatest("i", "j")).alias("hi")).withColumn("zero", F.lit(0))
    both = a.join(b, ["i", "j"], "left").withColumn("at", F.col("i") * n + F.col("j"))
    key = F.concat_ws(",", "i", "j")
    out = [
        violation(size, (F.col("c") != n * n) | (F.col("lo") < 0) | (F.col("hi") >= n), 10, "square", F.lit("The distance matrix must be square"), "zero", F.lit(None)),
        violation(both, F.isnan("d") | (F.abs("d") == float("inf")) | F.col("d").isNull(), 20, "finite", F.lit("Distances must be finite"), "at", key),
        violation(both, ~F.coalesce(F.abs(F.col("d") - F.col("t")) <= 1e-6, F.lit(False)), 30, "symmetric", F.lit("The distance matrix must be symmetric"), "at", key),
        violation(both, (F.col("i") == F.col("j")) & (F.abs("d") > 1e-6), 40, "diagonal", F.lit("The diagonal of the distance matrix must be zero"), "at", key),
        violation(both, F.col("d") < 0, 50, "negative", F.lit("Distances must not be negative"), "at", key),
    ]
    if not allow_empty and n == 0:
        out.append(spark.range(1).select(F.lit(5).alias("priority"), F.lit(0).cast("long").alias("ord"), F.lit("empty").alias("rule"), F.lit(None).cast("string").alias("key"), F.lit("The distance matrix must not be empty").alias("message")))
    return _all(out)


def tile_violations(tiles: DataFrame, grids: DataFrame) -> DataFrame:
    """Rules of tiles (observation_id, tile_idx, vec, logits) against grids (observation_id, rows, cols)."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bad_logits = F.exists("logits", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    per = tiles.groupBy("observation_id").agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"), F.min(F.size("logits")).alias("ll"), F.max(F.size("logits")).alias("lh"), F.bool_or(bad).alias("bad"), F.bool_or(bad_logits).alias("bl"))
    per = grids.join(per, "observation_id", "left").withColumn("zero", F.lit(0))
    name = F.col("observation_id")
    return _all([
        violation(per, F.col("n").isNull() | (F.col("lo") < 1), 10, "empty", F.lit("patch_features must not be empty"), "zero", name),
        violation(per, F.col("lo") != F.col("hi"), 20, "dimension", F.lit("Tile embedding dimensions must match"), "zero", name),
        violation(per, (F.col("ll") != 2) | (F.col("lh") != 2), 30, "logits", F.lit("element_logits need two numbers for every tile"), "zero", name),
        violation(per, ~F.coalesce((F.col("rows") > 0) & (F.col("cols") > 0) & (F.col("rows") * F.col("cols") == F.col("n")), F.lit(False)), 40, "grid", F.lit("patch_grid needs rows and columns above 0 that hold the tiles"), "zero", name),
        violation(per, F.col("bad"), 50, "finite", F.lit("patch_features hold a value that isn't finite"), "zero", name),
        violation(per, F.col("bl"), 60, "finite_logits", F.lit("element_logits hold a value that isn't finite"), "zero", name),
    ])


def same_observations_violations(original: DataFrame, edited: DataFrame) -> DataFrame:
    """An edited annotation must have exactly the original's observations."""
    a, b = original.select("observation_id"), edited.select("observation_id")
    both = a.exceptAll(b).withColumn("rule", F.lit("lost")).union(b.exceptAll(a).withColumn("rule", F.lit("added"))).withColumn("zero", F.lit(0))
    return both.select(F.lit(10).alias("priority"), F.col("zero").cast("long").alias("ord"), "rule", F.col("observation_id").alias("key"), F.concat(F.lit("An edit lost or added an observation: "), "observation_id").alias("message"))


def review_violations(reviews: DataFrame) -> DataFrame:
    """Members of a review must be distinct, and the incorrect ones among them."""
    rows = reviews.withColumn("zero", F.lit(0))
    return _all([
        violation(rows, F.size(F.array_distinct("observation_ids")) != F.size("observation_ids"), 10, "distinct", F.lit("A review names an observation twice (duplicate)"), "zero", F.col("cluster_id")),
        violation(rows, F.size(F.array_except("incorrect_observation_ids", "observation_ids")) > 0, 20, "subset", F.lit("What a review calls incorrect must belong to its cluster"), "zero", F.col("cluster_id")),
    ])


def check_class_weights(weights: list[float]) -> list[float]:
    """Two finite weights, none negative, not both zero."""
    if len(weights) != 2:
        raise ValueError("class_weights must contain 2 values")
    if not all(0 <= w < float("inf") for w in weights):
        raise ValueError("class_weights must be finite and non-negative")
    if sum(weights) <= 0:
        raise ValueError("At least one class weight must be positive")
    return [float(w) for w in weights]


def check_output_path(source: str, output: str) -> None:
    """An output must not be its own source."""
    import os

    if os.path.realpath(source) == os.path.realpath(output):
        raise ValueError("The output must differ from the source annotation")
