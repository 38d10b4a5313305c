"""Queries over curation and migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import curate, migrate
from gridloom.plans import adapters as A
from gridloom.plans.queries_sets import ANN, DOCS
from gridloom.plans.registry import query

_AS = "SELECT ann_idx, observation_id, {c} AS cluster_id FROM ann"
_GROUPS = f"{DOCS}, {ANN}, grp AS (SELECT cluster_id, min(obs_idx) AS first_idx, string_agg(observation_id, ',' ORDER BY obs_idx) AS members, count(*) AS n FROM docs JOIN ann USING (observation_id) GROUP BY cluster_id)"


def _three(df: DataFrame) -> DataFrame:
    return df.select("ann_idx", "observation_id", "cluster_id")


@query(f"WITH {ANN} " + _AS.format(c="CASE WHEN cluster_id IN ('en_0', 'en_1', 'fr_1') THEN 'en_0' ELSE cluster_id END"))
def merge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(curate.merge_clusters(A.label_annotations(spark, sf_dir), ["fr_1", "en_1", "en_0"])[0])


@query(f"WITH {ANN} " + _AS.format(c="CASE WHEN cluster_id = 'de_1' THEN 'home' ELSE cluster_id END"))
def rename_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(curate.rename_cluster(A.label_annotations(spark, sf_dir), "de_1", "  home  ")[0])


@query(f"WITH {ANN}, s AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM ann) SELECT ann_idx, observation_id, CASE WHEN ann_idx % 7 = 0 AND n > 1 THEN cluster_id || '__outlier_' || substr(sha256(observation_id), 1, 12) ELSE cluster_id END AS cluster_id FROM s")
def outlier_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.label_annotations(spark, sf_dir)
    return _three(curate.outliers_to_singletons(a, a.where("ann_idx % 7 = 0")))


@query(f"WITH {ANN}, o AS (SELECT * FROM ann WHERE ann_idx < 40), h AS (SELECT 'outlier_group_' || substr(sha256(string_agg(observation_id, chr(0) ORDER BY observation_id)), 1, 12) AS g FROM o) SELECT ann_idx, observation_id, CASE WHEN ann_idx < 40 THEN g ELSE cluster_id END AS cluster_id FROM ann, h")
def outlier_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.label_annotations(spark, sf_dir)
    chosen = [r[0] for r in a.where("ann_idx < 40").select("observation_id").collect()]  # a selection made by hand
    return _three(curate.assign_outliers(a, chosen, "together"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.cluster_groups(A.document_observations(spark, sf_dir), A.label_annotations(spark, sf_dir).drop("source"))


@query(f"WITH {_GROUPS} SELECT cluster_id, first_idx, n, md5(members) AS members_md5 FROM grp")
def cluster_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("cluster_id", "first_idx", F.size("observation_ids").cast("long").alias("n"), F.md5(F.array_join("observation_ids", ",")).alias("members_md5"))


@query(f"WITH {_GROUPS} SELECT cluster_id, (row_number() OVER (ORDER BY n = 1, cluster_id) - 1)::BIGINT AS position FROM grp")
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.cluster_order(_groups(spark, sf_dir)).select("cluster_id", "position")


@query(f"""WITH {_GROUPS}, o AS (SELECT cluster_id, row_number() OVER (ORDER BY n = 1, cluster_id) - 1 AS rank FROM grp),
  e AS (SELECT a.observation_id, CASE WHEN a.cluster_id = 'de_1' THEN 'zz' ELSE a.cluster_id END AS cluster_id, rank FROM ann a JOIN o USING (cluster_id)),
  g AS (SELECT cluster_id, count(*) AS n, min(rank) AS rank FROM e GROUP BY cluster_id) SELECT cluster_id, (row_number() OVER (ORDER BY n = 1, rank, cluster_id) - 1)::BIGINT AS position FROM g""")
def cluster_order_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited, _ = curate.rename_cluster(A.label_annotations(spark, sf_dir), "de_1", "zz")
    groups = curate.cluster_groups(A.document_observations(spark, sf_dir), edited)
    return curate.cluster_order(groups, _groups(spark, sf_dir)).select("cluster_id", "position")


@query(f"WITH {_GROUPS} SELECT cluster_id, (row_number() OVER (ORDER BY lower(cluster_id), cluster_id) - 1)::BIGINT AS position FROM grp")
def cluster_order_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.cluster_order(_groups(spark, sf_dir), sort_mode="dictionary").select("cluster_id", "position")


@query(f"""WITH {_GROUPS}, o AS (SELECT cluster_id, row_number() OVER (ORDER BY n = 1, cluster_id) - 1 AS p, count(*) OVER () AS c FROM grp), cur AS (SELECT p FROM o WHERE cluster_id = 'es_1')
  SELECT cluster_id AS next_cluster_id FROM o, cur WHERE cluster_id <> 'es_1' AND cluster_id LIKE '%_0' ORDER BY (o.p - cur.p - 1 + c) % c LIMIT 1""")
def next_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    found = curate.next_unreviewed(curate.cluster_order(groups), groups.where("cluster_id LIKE '%_0'"), "es_1")
    return spark.range(1).select(F.lit(found).alias("next_cluster_id"))


def _reviews(groups: DataFrame) -> DataFrame:
    """A review per cluster: of quality 0 those of an older membership, without the first member."""
    members = F.col("observation_ids")
    stale = F.col("cluster_id").endswith("_0")
    return groups.select("cluster_id", F.when(stale, F.slice(members, 2, 1_000_000)).otherwise(members).alias("observation_ids"), F.slice(members, 2, 2).alias("incorrect_observation_ids"), F.lit("confirmed").alias("status"))


@query(f"WITH {_GROUPS} SELECT cluster_id, cluster_id NOT LIKE '%_0' AS is_current, cluster_id NOT LIKE '%_0' AS applies FROM grp")
def review_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    joined = _reviews(groups).join(groups.select("cluster_id", F.col("observation_ids").alias("members")), "cluster_id")
    return joined.select("cluster_id", curate.review_is_current("members").alias("is_current"), curate.review_applies("members").alias("applies"))


@query(f"WITH {_GROUPS}, m AS (SELECT cluster_id, observation_id, row_number() OVER (PARTITION BY cluster_id ORDER BY obs_idx) - 1 AS pos FROM docs JOIN ann USING (observation_id)) SELECT cluster_id, pos::INT AS pos, observation_id FROM m WHERE pos IN (1, 2) AND cluster_id NOT LIKE '%_0'")
def current_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    reviews = _reviews(groups)
    return curate.current_outliers([reviews, reviews.limit(0)], groups)


@query(f"WITH {_GROUPS}, m AS (SELECT cluster_id, observation_id, row_number() OVER (PARTITION BY cluster_id ORDER BY obs_idx) - 1 AS pos FROM docs JOIN ann USING (observation_id)) SELECT cluster_id, string_agg(observation_id, ',' ORDER BY pos) AS flagged FROM m WHERE pos IN (1, 2) AND cluster_id NOT LIKE '%_0' GROUP BY cluster_id")
def flagged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    return curate.flagged_observations(_reviews(groups), groups).select("cluster_id", F.array_join("incorrect_observation_ids", ",").alias("flagged"))


@query(f"WITH {_GROUPS} SELECT count(*) AS clusters, count(*) FILTER (cluster_id NOT LIKE '%_0') AS reviewed, count(*) FILTER (cluster_id LIKE '%_0') AS pending, sum(CASE WHEN cluster_id NOT LIKE '%_0' THEN least(2, n - 1) ELSE 0 END)::BIGINT AS flagged FROM grp")
def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    return curate.review_progress(groups, _reviews(groups))


@query("SELECT event_type AS cluster_id, arg_max(props, event_id) AS status, min(event_id) AS first_line FROM events GROUP BY event_type")
def combine_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "events").select(F.col("event_type").alias("cluster_id"), F.floor(F.col("event_id") / 1000).cast("int").alias("file_idx"), F.col("event_id").alias("line_no"), F.col("props").alias("status"))
    return curate.combine_reviews(e).select("cluster_id", "status", F.col("first.line_no").alias("first_line"))


@query(f"WITH {ANN} SELECT ann_idx, observation_id, cluster_id, 'old' AS source FROM ann")
def migrate_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy = A.label_annotations(spark, sf_dir).select("ann_idx", "observation_id", F.col("cluster_id").alias("auto_cluster_id"), F.lit("old").alias("baseline"))
    return migrate.convert_legacy(legacy)


@query(f"WITH {DOCS}, g AS (SELECT digest, count(*) AS n FROM docs GROUP BY digest), o AS (SELECT digest, row_number() OVER (ORDER BY n = 1, digest) - 1 AS position FROM g) SELECT digest AS cluster_id, position FROM o WHERE position BETWEEN 48 AND 71")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.document_observations(spark, sf_dir)
    groups = curate.cluster_groups(docs, docs.select(F.col("obs_idx").alias("ann_idx"), "observation_id", F.col("digest").alias("cluster_id")))
    return curate.paginate(curate.cluster_order(groups), 2).select("cluster_id", "position")


@query(f"WITH {_GROUPS} SELECT cluster_id, n FROM grp WHERE contains(lower(cluster_id), 'e')")
def filter_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.filter_clusters(_groups(spark, sf_dir), "E").select("cluster_id", F.size("observation_ids").cast("long").alias("n"))
