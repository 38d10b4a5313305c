"""Editing annotations and reviews: every operation returns a new frame and leaves its inputs alone.

Annotations have (observation_id, cluster_id, source, ann_idx); reviews (cluster_id, observation_ids,
incorrect_observation_ids, status); groups (cluster_id, observation_ids) with members in dataset order.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.plans.ordering import positions

SORT_MODES = ("original", "dictionary")


def cluster_groups(observations: DataFrame, annotations: DataFrame, *, strict: bool = False) -> DataFrame:
    """(cluster_id, first_idx, observation_ids) in dataset order; unassigned observations are left out.

    Errors: no assignments, unknown or repeated observations, empty clusters, with ``strict`` also observations left out.
    """
    from gridloom.operators.validate import annotation_violations, enforce

    if annotations.isEmpty():
        raise ValueError("Assignment file contains no assignments")
    enforce(annotation_violations(observations, annotations.select("ann_idx", "observation_id", "cluster_id"), complete=strict, noun="assignment", known="assigned"))
    rows = observations.select("obs_idx", "observation_id").join(annotations.select("observation_id", "cluster_id"), "observation_id")
    grouped = rows.groupBy("cluster_id").agg(F.min("obs_idx").alias("first_idx"), F.sort_array(F.collect_list(F.struct("obs_idx", "observation_id"))).alias("m"))
    return grouped.select("cluster_id", "first_idx", F.col("m.observation_id").alias("observation_ids"))


def _known(annotations: DataFrame, wanted: list[str], column: str, message: str) -> None:
    """Raises if any of a few given ids isn't there."""
    there = {r[0] for r in annotations.where(F.col(column).isin(wanted)).select(column).distinct().collect()}
    missing = sorted(set(wanted) - there)
    if missing:
        raise ValueError(message + ", ".join(missing))


def merge_clusters(annotations: DataFrame, selected: list[str]) -> tuple[DataFrame, str]:
    """The selected clusters under the smallest of their ids; also returns that id."""
    chosen = sorted(set(selected))
    if len(chosen) < 2:
        raise ValueError("A merge takes at least two clusters")
    _known(annotations, chosen, "cluster_id", "Unknown clusters in a merge: ")
    merged = F.when(F.col("cluster_id").isin(chosen), F.lit(chosen[0])).otherwise(F.col("cluster_id"))
    return annotations.withColumn("cluster_id", merged), chosen[0]


def rename_cluster(annotations: DataFrame, cluster_id: str, new_id: str) -> tuple[DataFrame, str]:
    """One cluster under a new id, stripped of white space, that must not be taken."""
    name = new_id.strip()
    if not name:
        raise ValueError("A cluster's name cannot be empty")
    _known(annotations, [cluster_id], "cluster_id", "Unknown cluster in a renaming: ")
    if name == cluster_id:
        raise ValueError("The cluster has this name; give a different one")
    if not annotations.where(F.col("cluster_id") == name).isEmpty():
        raise ValueError(f"A cluster named {name} already exists")
    return annotations.withColumn("cluster_id", F.when(F.col("cluster_id") == cluster_id, F.lit(name)).otherwise(F.col("cluster_id"))), name


def rename_cluster_with_review(annotations: DataFrame, groups: DataFrame, cluster_id: str, new_id: str, reviews: DataFrame, merged_reviews: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """rename_cluster, and merged_reviews with the cluster's review, if it still applies, under the new id.

    A review in merged_reviews goes before one in reviews; the old id leaves merged_reviews.
    """
    renamed, name = rename_cluster(annotations, cluster_id, new_id)
    members = groups.where(F.col("cluster_id") == cluster_id).select(F.col("observation_ids").alias("members"))
    both = merged_reviews.withColumn("__rank", F.lit(0)).unionByName(reviews.withColumn("__rank", F.lit(1)))
    applies = both.where(F.col("cluster_id") == cluster_id).crossJoin(members).where(review_applies("members"))  # one row each
    carried = applies.orderBy("__rank").limit(1).drop("members", "__rank").withColumn("cluster_id", F.lit(name))
    return renamed, merged_reviews.where((F.col("cluster_id") != cluster_id) & (F.col("cluster_id") != name)).unionByName(carried), name


def outliers_to_singletons(annotations: DataFrame, outliers: DataFrame) -> DataFrame:
    """Every outlier (observation_id) of a cluster with more than one member moves to a cluster of its own.

    Its id is the cluster's, a suffix, and the first digits of the observation's hash; a number follows
    where such a cluster exists already. Sizes are those before any move.
    """
    _unknown(annotations, outliers)
    chosen = outliers.select("observation_id").distinct().withColumn("__out", F.lit(True))
    sizes = annotations.groupBy(F.col("cluster_id").alias("__cluster")).agg(F.count("*").alias("__size"))
    sized = annotations.join(chosen, "observation_id", "left").join(sizes, F.col("cluster_id") == F.col("__cluster"), "left")
    moves = F.col("__out") & F.col("cluster_id").isNotNull() & (F.col("__size") > 1)
    base = F.concat("cluster_id", F.lit("__outlier_"), F.substring(F.sha2(F.encode("observation_id", "UTF-8"), 256), 1, 12))
    wanted = sized.withColumn("__base", F.when(moves, base))
    taken = annotations.select(F.col("cluster_id").alias("__id")).distinct()
    # names in the way: the base itself or the base with a number; few, as they need an equal hash
    nth = Window.partitionBy("__base").orderBy("ann_idx")
    named = wanted.withColumn("__nth", F.when(F.col("__base").isNotNull(), F.row_number().over(nth)))
    blocked = taken.select(F.regexp_replace("__id", r"_(?:[2-9]|[1-9]\d+)$", "").alias("__stem"), "__id").where(F.col("__id").contains("__outlier_"))
    in_way = blocked.unionByName(taken.where(F.col("__id").contains("__outlier_")).select(F.col("__id").alias("__stem"), "__id")).distinct().groupBy("__stem").agg(F.collect_set("__id").alias("__taken"))
    joined = named.join(in_way, F.col("__base") == F.col("__stem"), "left").withColumn("__taken", F.coalesce("__taken", F.array().cast("array<string>")))
    options = F.transform(F.sequence(F.lit(1), F.size("__taken") + F.col("__nth")), lambda k: F.when(k == 1, F.col("__base")).otherwise(F.concat(F.col("__base"), F.lit("_"), k.cast("string"))))
    free = F.element_at(F.filter(options, lambda o: ~F.array_contains(F.col("__taken"), o)), F.col("__nth"))
    return joined.withColumn("cluster_id", F.when(F.col("__base").isNotNull(), free).otherwise(F.col("cluster_id"))).select(annotations.columns)


def _unknown(annotations: DataFrame, outliers: DataFrame) -> None:
    missing = outliers.select("observation_id").distinct().join(annotations.select("observation_id"), "observation_id", "left_anti").orderBy("observation_id").limit(100).collect()
    if missing:
        raise ValueError("Unknown outlier observations: " + ", ".join(r[0] for r in missing))


def outliers_to_group(annotations: DataFrame, outlier_ids: list[str]) -> DataFrame:
    """All of the outliers, a selection made by hand, move to one cluster named after the hash of their sorted ids.

    A cluster of that name with exactly these members is kept; another one makes the name get a number.
    """
    chosen = sorted(set(outlier_ids))
    _known(annotations, chosen, "observation_id", "Unknown outlier observations: ")
    if not chosen:
        return annotations
    base = "outlier_group_" + hashlib.sha256("\0".join(chosen).encode()).hexdigest()[:12]
    like = annotations.where(F.col("cluster_id").startswith(base)).groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if(F.col("observation_id").isin(chosen)).alias("k"))
    taken = {r["cluster_id"]: r["n"] == r["k"] == len(chosen) for r in like.collect()}
    name, number = base, 2
    while name in taken and not taken[name]:
        name, number = f"{base}_{number}", number + 1
    return annotations.withColumn("cluster_id", F.when(F.col("observation_id").isin(chosen), F.lit(name)).otherwise(F.col("cluster_id")))


def assign_outliers(annotations: DataFrame, outlier_ids: list[str], grouping: str) -> DataFrame:
    """``singletons`` or ``together``."""
    if grouping == "together":
        return outliers_to_group(annotations, outlier_ids)
    if grouping == "singletons":
        return outliers_to_singletons(annotations, annotations.sparkSession.createDataFrame([(x,) for x in outlier_ids], "observation_id string"))
    raise ValueError(f"Unknown outlier grouping strategy: {grouping}")


def casefold(c: Column) -> Column:
    """Python's casefold, which no SQL function equals; an Arrow UDF, for ids that are shown to people."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x.casefold() if x is not None else None)

    return fold(c)


def cluster_order(groups: DataFrame, original: DataFrame | None = None, sort_mode: str = "original") -> DataFrame:
    """groups with ``position`` from 0: by the original clusters' ranks, singletons last, or as in a dictionary.

    A cluster's rank is the least of its members' original clusters'; members without one rank after all.
    """
    if sort_mode not in SORT_MODES:
        raise ValueError(f"Unknown cluster sort mode: {sort_mode}")
    if sort_mode == "dictionary":
        return positions(groups.withColumn("__fold", casefold(F.col("cluster_id"))), ["__fold", "cluster_id"], "position").drop("__fold")
    single = F.size("observation_ids") == 1
    if original is None:
        return positions(groups.withColumn("__single", single), ["__single", "cluster_id"], "position").drop("__single")
    ranked = cluster_order(original)
    n = ranked.count()
    rank_of = ranked.select(F.explode("observation_ids").alias("observation_id"), F.col("position").alias("__rank"))
    members = groups.select("cluster_id", F.explode_outer("observation_ids").alias("observation_id")).join(rank_of, "observation_id", "left")
    ranks = members.groupBy("cluster_id").agg(F.min(F.coalesce("__rank", F.lit(n))).alias("__rank"))
    sized = groups.withColumn("__single", single).join(ranks, "cluster_id")
    return positions(sized, ["__single", "__rank", "cluster_id"], "position").drop("__single", "__rank")


def next_unreviewed(ordered: DataFrame, unreviewed: DataFrame, current: str) -> str | None:
    """The first unreviewed cluster after the current one, going round; none if there is no other."""
    at = ordered.where(F.col("cluster_id") == current).select("position").first()
    if at is None:
        raise ValueError(f"Unknown current cluster: {current}")
    n = ordered.agg(F.max("position") + 1).first()[0]
    rest = ordered.where(F.col("cluster_id") != current).join(unreviewed.select("cluster_id"), "cluster_id", "left_semi")
    found = rest.orderBy(F.pmod(F.col("position") - at[0] - 1, F.lit(n))).select("cluster_id").first()
    return found[0] if found else None


def review_is_current(members: str | Column) -> Column:
    """Whether a review row is confirmed and lists exactly these members in this order."""
    members = F.col(members) if isinstance(members, str) else members
    return F.coalesce((F.col("status") == "confirmed") & (F.col("observation_ids") == members), F.lit(False))


def review_applies(members: str) -> Column:
    """Whether a review is current, or is confirmed and its members without the incorrect ones are these."""
    wrong = F.coalesce("incorrect_observation_ids", F.array().cast("array<string>"))
    accepted = F.filter("observation_ids", lambda x: ~F.array_contains(wrong, x))
    return review_is_current(members) | F.coalesce((F.col("status") == "confirmed") & (accepted == F.col(members)), F.lit(False))


def save_review(reviews: DataFrame, cluster_id: str, observation_ids: list[str], incorrect_ids: list[str]) -> DataFrame:
    """reviews with a confirmed review of one cluster, in place of an older one; incorrect ids in member order."""
    if len(set(observation_ids)) != len(observation_ids):
        raise ValueError("A review names an observation twice (duplicate)")
    if not set(incorrect_ids) <= set(observation_ids):
        raise ValueError("What a review calls incorrect must belong to its cluster")
    wrong = [x for x in observation_ids if x in set(incorrect_ids)]
    schema = "cluster_id string, observation_ids array<string>, incorrect_observation_ids array<string>, status string"
    one = reviews.sparkSession.createDataFrame([(cluster_id, list(observation_ids), wrong, "confirmed")], schema)
    return reviews.where(F.col("cluster_id") != cluster_id).unionByName(one)


def _with_members(reviews: DataFrame, groups: DataFrame) -> DataFrame:
    return reviews.join(groups.select("cluster_id", F.col("observation_ids").alias("members")), "cluster_id")


def flagged_observations(reviews: DataFrame, groups: DataFrame) -> DataFrame:
    """(cluster_id, incorrect_observation_ids) of current reviews that have any."""
    return _with_members(reviews, groups).where(review_is_current("members") & (F.size("incorrect_observation_ids") > 0)).select("cluster_id", "incorrect_observation_ids")


def current_outliers(review_collections: list[DataFrame], groups: DataFrame) -> DataFrame:
    """(cluster_id, pos, observation_id): members that any current review calls incorrect, in member order."""
    parts = [_with_members(r, groups).where(review_is_current("members")).select("cluster_id", F.explode("incorrect_observation_ids").alias("observation_id")) for r in review_collections]
    wrong = parts[0]
    for part in parts[1:]:
        wrong = wrong.union(part)
    members = groups.select("cluster_id", F.posexplode("observation_ids").alias("pos", "observation_id"))
    return members.join(wrong.distinct(), ["cluster_id", "observation_id"], "left_semi").select("cluster_id", "pos", "observation_id")


def combine_reviews(logs: DataFrame, key: str = "cluster_id") -> DataFrame:
    """The last record of every key, in the order of first records. logs has (file_idx, line_no) and the record's columns."""
    at = F.struct("file_idx", "line_no")
    out = logs.groupBy(key).agg(F.max_by(F.struct(*[c for c in logs.columns if c != key]), at).alias("r"), F.min(at).alias("first"))
    return out.select(key, "r.*", "first").drop("file_idx", "line_no")


def filter_clusters(groups: DataFrame, query: str) -> DataFrame:
    """Groups whose id contains the query, whatever the case."""
    return groups.where(F.contains(F.lower("cluster_id"), F.lit(query.strip().lower())))


PAGE_SIZES = (12, 24, 48)


def paginate(ordered: DataFrame, page: int, size: int = 24) -> DataFrame:
    """The rows of a page, from 0, by ``position``; only their places are looked at."""
    if size not in PAGE_SIZES:
        raise ValueError(f"Unknown page size: {size}")
    return ordered.where(F.col("position").between(page * size, (page + 1) * size - 1))


def page_count(n: int, size: int = 24) -> int:
    return max(1, -(-n // size))


def review_progress(groups: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row (clusters, reviewed, pending, flagged) of how far reviewing has come."""
    joined = groups.join(reviews.select("cluster_id", F.struct("observation_ids", "incorrect_observation_ids", "status").alias("r")), "cluster_id", "left")
    flat = joined.select("cluster_id", F.col("observation_ids").alias("members"), "r.*").withColumn("__now", review_is_current("members"))
    return flat.agg(F.count("*").alias("clusters"), F.count_if("__now").alias("reviewed"), F.count_if(~F.col("__now")).alias("pending"), F.coalesce(F.sum(F.when(F.col("__now"), F.size("incorrect_observation_ids"))), F.lit(0)).alias("flagged"))


class History:
    """Versions of an annotation: undo returns to the previous one, reset to the first."""

    def __init__(self, original: DataFrame):
        self.versions = [original]

    @property
    def current(self) -> DataFrame:
        return self.versions[-1]

    def edit(self, changed: DataFrame) -> DataFrame:
        self.versions.append(changed)
        return changed

    def undo(self) -> DataFrame:
        if len(self.versions) > 1:
            self.versions.pop()
        return self.current

    def reset(self) -> DataFrame:
        self.versions.append(self.versions[0])
        return self.current


class StoredHistory:
    """History kept as tables below a path, a folder per version, so that it outlives a session and lineage stays short.

    A path that holds versions already is gone on with; then ``original`` isn't read.
    """

    def __init__(self, spark: SparkSession, path: str, original: DataFrame | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        if not self._numbers():
            if original is None:
                raise ValueError(f"No versions below {path}")
            self._store(original)

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """The finished versions: a write that broke off left no _SUCCESS."""
        target, files = self._at(self.path)
        if not files.exists(target):
            return []
        names = [f.getPath().getName() for f in files.listStatus(target)]
        return sorted(int(name[1:]) for name in names if name[:1] == "v" and name[1:].isdigit() and files.exists(self._at(f"{self.path}/{name}/_SUCCESS")[0]))

    def _name(self, number: int) -> str:
        return f"{self.path}/v{number:06d}"

    def _store(self, version: DataFrame) -> None:
        version.write.mode("overwrite").parquet(self._name(max(self._numbers(), default=-1) + 1))

    @property
    def current(self) -> DataFrame:
        return self.spark.read.parquet(self._name(self._numbers()[-1]))

    def edit(self, changed: DataFrame) -> DataFrame:
        self._store(changed)
        return self.current

    def undo(self) -> DataFrame:
        numbers = self._numbers()
        if len(numbers) > 1:
            target, files = self._at(self._name(numbers[-1]))
            files.delete(target, True)
        return self.current

    def reset(self) -> DataFrame:
        return self.edit(self.spark.read.parquet(self._name(self._numbers()[0])))


def with_source(annotations: DataFrame, output_path: str) -> DataFrame:
    """annotations whose source is the output file's name without its extension."""
    from pathlib import PurePath

    return annotations.withColumn("source", F.lit(PurePath(output_path).stem))


def default_reviews_path(output_path: str) -> str:
    """Where reviews of an annotation are kept: ../debug/<stem>_reviews.jsonl beside its folder."""
    from pathlib import PurePath

    path = PurePath(output_path)
    return str(path.parent.parent / "debug" / f"{path.stem}_reviews.jsonl")
