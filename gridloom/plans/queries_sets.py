"""Queries over deduplication, grouping, validation, clustering and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import cluster, dedup, evaluate, graph, validate
from gridloom.plans import adapters as A
from gridloom.plans.registry import query

# --- shared pieces of the SQL ---------------------------------------------------------------------

DOCS = "docs AS (SELECT doc_id AS obs_idx, printf('doc_%08d', doc_id) AS observation_id, sha256(text) AS digest, lang, source FROM documents)"
ANN = "ann AS (SELECT l.doc_id AS ann_idx, printf('doc_%08d', l.doc_id) AS observation_id, d.lang || '_' || l.quality AS cluster_id FROM labels l JOIN documents d USING (doc_id))"
OBS = "obs AS (SELECT user_id AS run_id, event_id AS obs_idx, printf('obs_%06d', event_id) AS observation_id, event_type AS activity, props AS structure_str, value FROM events)"
TRANS = (
    "trans AS (SELECT user_id AS run_id, event_id AS trans_idx, printf('trans_%06d', event_id) AS transition_id, printf('obs_%06d', event_id) AS source_observation_id, "
    "printf('obs_%06d', next_id) AS destination_observation_id, event_type, value > 100 AS effective FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_id FROM events) WHERE next_id IS NOT NULL)"
)
HASHES = (
    "hashes AS (SELECT vec_id AS obs_idx, printf('vec_%06d', vec_id) AS observation_id, label, "
    "(SELECT string_agg(substr('0123456789abcdef', 1 + (CASE WHEN embedding[4*g+1] >= 0 THEN 8 ELSE 0 END) + (CASE WHEN embedding[4*g+2] >= 0 THEN 4 ELSE 0 END) + (CASE WHEN embedding[4*g+3] >= 0 THEN 2 ELSE 0 END) + (CASE WHEN embedding[4*g+4] >= 0 THEN 1 ELSE 0 END), 1), '' ORDER BY g) FROM range(16) t(g)) AS feature FROM embeddings)"
)


def metrics_sql(pairs: str, keys: str = "") -> str:
    """Pair counts and scores of a relation ``pairs`` with (keys, p, t), as CTEs ending in ``scored``."""
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return f"""
    cells AS (SELECT {k}p, t, count(*)::DOUBLE AS n FROM {pairs} GROUP BY ALL),
    mp AS (SELECT {k}p, sum(n) AS n FROM cells GROUP BY ALL), mt AS (SELECT {k}t, sum(n) AS n FROM cells GROUP BY ALL),
    c AS (SELECT {k}sum(n) AS rows_, sum(n*(n-1)/2) AS tp, sum(n*ln(n)) AS lc FROM cells {by}),
    a AS (SELECT {k}sum(n*(n-1)/2) AS pp, sum(n*ln(n)) AS lp, count(*) AS np FROM mp {by}),
    b AS (SELECT {k}sum(n*(n-1)/2) AS pa, sum(n*ln(n)) AS la, count(*) AS nt FROM mt {by}),
    j AS (SELECT *, pp - tp AS fp, pa - tp AS fn, rows_*(rows_-1)/2 - pp - pa + tp AS tn FROM c {'JOIN a USING (' + keys + ') JOIN b USING (' + keys + ')' if keys else ', a, b'}),
    scored AS (SELECT *, CASE WHEN pp = 0 THEN 0 ELSE tp/pp END AS precision_, CASE WHEN pa = 0 THEN 0 ELSE tp/pa END AS recall_,
      CASE WHEN tp = 0 THEN 0 ELSE 2*tp/(pp+pa) END AS f1_,
      CASE WHEN fp = 0 AND fn = 0 THEN 1 WHEN (tp+fn)*(fn+tn)+(tp+fp)*(fp+tn) = 0 THEN 0 ELSE 2*(tp*tn-fn*fp)/((tp+fn)*(fn+tn)+(tp+fp)*(fp+tn)) END AS ari_,
      CASE WHEN np <= 1 AND nt <= 1 THEN 1 WHEN ln(rows_) + (lc-lp-la)/rows_ <= 1e-15 THEN 0 ELSE (ln(rows_) + (lc-lp-la)/rows_) / ((2*ln(rows_) - lp/rows_ - la/rows_)/2) END AS nmi_ FROM j)"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- deduplication and sampling -------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT digest, min(obs_idx) AS first_idx, string_agg(observation_id, ',' ORDER BY obs_idx) AS members, count(*) AS n FROM docs GROUP BY digest")
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.dedup_groups(A.document_observations(spark, sf_dir), "digest")
    return groups.select("digest", "first_idx", F.array_join("observation_ids", ",").alias("members"), F.size("observation_ids").cast("long").alias("n"))


@query(f"WITH {DOCS} SELECT obs_idx, observation_id, min(obs_idx) OVER (PARTITION BY digest) AS first_idx FROM docs")
def dedup_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_membership(A.document_observations(spark, sf_dir), "digest")


_SAMPLED = "SELECT obs_idx, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY obs_idx) - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM docs JOIN ann USING (observation_id)) WHERE n <= {k} OR pos IN ({places})"
_FLOORED = ", ".join(f"({i}*(n-1))//2" for i in range(3))


@query(f"WITH {DOCS}, {ANN} " + _SAMPLED.format(keys="digest", k=3, places=_FLOORED))
def dedup_representatives_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.select_representatives(A.document_observations(spark, sf_dir), A.label_annotations(spark, sf_dir), "digest", scope="global")


@query(f"WITH {DOCS}, {ANN} " + _SAMPLED.format(keys="digest, cluster_id", k=3, places=_FLOORED))
def dedup_representatives_within_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.select_representatives(A.document_observations(spark, sf_dir), A.label_annotations(spark, sf_dir), "digest")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_groups(A.document_observations(spark, sf_dir), "digest").withColumnRenamed("first_idx", "group_idx")


@query(f"WITH {DOCS}, {ANN}, g AS (SELECT *, min(obs_idx) OVER (PARTITION BY digest) AS group_idx FROM docs) SELECT group_idx, arg_min(observation_id, obs_idx) AS observation_id FROM g SEMI JOIN ann USING (observation_id) GROUP BY group_idx")
def dedup_first_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_eligible(_groups(spark, sf_dir), A.label_annotations(spark, sf_dir))


@query(f"WITH {DOCS} SELECT min(obs_idx) AS group_idx, arg_min(observation_id, obs_idx) AS observation_id FROM docs GROUP BY digest")
def dedup_first_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_members(_groups(spark, sf_dir))


@query(f"WITH {OBS}, s AS (SELECT *, row_number() OVER (PARTITION BY run_id, activity ORDER BY obs_idx) - 1 AS pos, count(*) OVER (PARTITION BY run_id, activity) AS n FROM obs) SELECT run_id, activity, obs_idx FROM s WHERE n <= 3 OR pos IN (0, round_even((n-1)/2, 0)::BIGINT, n-1)")
def preview_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.preview_sample(A.event_observations(spark, sf_dir), ["run_id", "activity"], "obs_idx", 3).select("run_id", "activity", "obs_idx")


# --- grouping, graph, validation ------------------------------------------------------------------


@query(f"WITH {OBS} SELECT activity AS value, min(obs_idx) AS first_idx, count(*) AS n, md5(string_agg(observation_id, ',' ORDER BY obs_idx)) AS members_md5 FROM obs GROUP BY activity")
def group_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph.group_by(A.event_observations(spark, sf_dir), "activity")
    return g.select("value", "first_idx", F.size("observation_ids").cast("long").alias("n"), F.md5(F.array_join("observation_ids", ",")).alias("members_md5"))


_EDGES = "SELECT {end} AS observation_id, count(*) AS n, min(trans_idx) AS first_idx, string_agg(transition_id, ',' ORDER BY trans_idx) AS transitions FROM trans GROUP BY {end}"


@query(f"WITH {TRANS} " + _EDGES.format(end="source_observation_id"))
def outgoing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.outgoing(A.event_transitions(spark, sf_dir)).withColumn("transitions", F.array_join("transitions", ","))


@query(f"WITH {TRANS} " + _EDGES.format(end="destination_observation_id"))
def incoming_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.incoming(A.event_transitions(spark, sf_dir)).withColumn("transitions", F.array_join("transitions", ","))


@query(f"""WITH {OBS}, t0 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY trans_idx) AS k FROM ({TRANS.split(' AS ', 1)[1].strip('()')})),
  t AS (SELECT run_id, trans_idx, CASE WHEN trans_idx % 97 = 5 THEN 'trans_same' ELSE transition_id END AS transition_id, CASE WHEN trans_idx % 211 = 7 THEN 'obs_unknown' ELSE source_observation_id END AS source_observation_id, destination_observation_id FROM t0),
  x AS (SELECT *, row_number() OVER (PARTITION BY transition_id ORDER BY trans_idx) AS nth, lag(destination_observation_id) OVER (PARTITION BY run_id ORDER BY trans_idx) AS before FROM t)
  SELECT 'transition_unique' AS rule, count(*) AS n, min(trans_idx) AS first_ord FROM x WHERE nth > 1
  UNION ALL SELECT 'source_known', count(*), min(trans_idx) FROM x WHERE source_observation_id NOT IN (SELECT observation_id FROM obs)
  UNION ALL SELECT 'trajectory', count(*), min(trans_idx) FROM x WHERE before IS NOT NULL AND before <> source_observation_id
  UNION ALL SELECT 'lengths', 1, 0""")
def validate_run_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.event_transitions(spark, sf_dir)
    faulty = t.withColumns({
        "transition_id": F.when(F.col("trans_idx") % 97 == 5, F.lit("trans_same")).otherwise(F.col("transition_id")),
        "source_observation_id": F.when(F.col("trans_idx") % 211 == 7, F.lit("obs_unknown")).otherwise(F.col("source_observation_id")),
    })
    found = validate.transition_violations(A.event_observations(spark, sf_dir), faulty)
    return found.groupBy("rule").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


@query(f"""WITH {DOCS}, a0 AS ({ANN.split(' AS ', 1)[1].strip()}),
  a AS (SELECT ann_idx, CASE WHEN ann_idx % 50 = 1 THEN 'doc_unknown' WHEN ann_idx % 31 = 2 THEN 'doc_00000000' ELSE observation_id END AS observation_id, CASE WHEN ann_idx % 17 = 3 THEN '' ELSE cluster_id END AS cluster_id FROM a0),
  x AS (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY ann_idx) AS nth FROM a),
  r AS (SELECT ann_idx AS ord, observation_id AS key, CASE WHEN observation_id NOT IN (SELECT observation_id FROM docs) THEN 'known' WHEN nth > 1 THEN 'unique' WHEN cluster_id = '' THEN 'cluster_id' END AS rule FROM x)
  SELECT ord, key, rule FROM r WHERE rule IS NOT NULL""")
def validate_annotations_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.label_annotations(spark, sf_dir)
    faulty = a.withColumns({
        "observation_id": F.when(F.col("ann_idx") % 50 == 1, F.lit("doc_unknown")).when(F.col("ann_idx") % 31 == 2, F.lit("doc_00000000")).otherwise(F.col("observation_id")),
        "cluster_id": F.when(F.col("ann_idx") % 17 == 3, F.lit("")).otherwise(F.col("cluster_id")),
    })
    return validate.annotation_violations(A.document_observations(spark, sf_dir), faulty).select("ord", "key", "rule")


@query(f"""WITH {DOCS}, g AS (SELECT digest, min(obs_idx) AS group_idx, list(observation_id ORDER BY obs_idx) AS ids FROM docs GROUP BY digest),
  f AS (SELECT group_idx, CASE WHEN group_idx % 40 = 3 THEN 'bad' ELSE digest END AS digest, CASE WHEN group_idx % 60 = 5 THEN list_append(ids, 'doc_unknown') ELSE ids END AS ids FROM g WHERE group_idx % 90 <> 7)
  SELECT 'digest' AS rule, count(*) AS n FROM f WHERE digest = 'bad' UNION ALL SELECT 'known', count(*) FROM f WHERE list_contains(ids, 'doc_unknown') UNION ALL SELECT 'cover', 1""")
def validate_dedup_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _groups(spark, sf_dir).where("group_idx % 90 <> 7")
    faulty = g.select(
        "group_idx", F.when(F.col("group_idx") % 40 == 3, F.lit("bad")).otherwise(F.col("digest")).alias("pixel_sha256"),
        F.when(F.col("group_idx") % 60 == 5, F.array_append("observation_ids", "doc_unknown")).otherwise(F.col("observation_ids")).alias("observation_ids"),
    )
    return validate.dedup_violations(A.document_observations(spark, sf_dir), faulty).groupBy("rule").agg(F.count("*").alias("n"))


# --- clustering -----------------------------------------------------------------------------------


@query(f"WITH {OBS}, f AS (SELECT structure_str, min(obs_idx) AS first_idx FROM obs GROUP BY 1), r AS (SELECT structure_str, (row_number() OVER (ORDER BY first_idx) - 1)::INT AS label FROM f) SELECT obs_idx, label FROM obs JOIN r ON obs.structure_str IS NOT DISTINCT FROM r.structure_str")
def cluster_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.categorical_clusters(A.event_observations(spark, sf_dir), "structure_str").select("obs_idx", "label")


_PAIRS_AT = "pairs AS (SELECT DISTINCT a.feature AS a, b.feature AS b, bit_count(xor(('0x' || a.feature)::UBIGINT, ('0x' || b.feature)::UBIGINT))::INT AS distance FROM hashes a JOIN hashes b ON a.feature < b.feature WHERE bit_count(xor(('0x' || a.feature)::UBIGINT, ('0x' || b.feature)::UBIGINT)) <= {most})"
_PAIRS = _PAIRS_AT.format(most=17)


@query(f"WITH {HASHES}, {_PAIRS} SELECT * FROM pairs")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.hamming_pairs(A.embedding_hashes(spark, sf_dir), "feature", 17)


@query(f"WITH {HASHES}, {_PAIRS_AT.format(most=3)} SELECT * FROM pairs")
def hamming_pairs_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.hamming_pairs(A.embedding_hashes(spark, sf_dir), "feature", 3)


@query(f"WITH {HASHES}, {_PAIRS_AT.format(most=8)} SELECT * FROM pairs")
def hamming_pairs_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.hamming_pairs(A.embedding_hashes(spark, sf_dir), "feature", 8)


@query(f"""WITH RECURSIVE {HASHES}, {_PAIRS}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs UNION SELECT feature, feature FROM hashes),
  reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x), root AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
  o AS (SELECT obs_idx, root FROM hashes JOIN root ON feature = x), f AS (SELECT root, min(obs_idx) AS m FROM o GROUP BY root), l AS (SELECT root, (row_number() OVER (ORDER BY m) - 1)::INT AS label FROM f)
  SELECT obs_idx, label FROM o JOIN l USING (root)""")
def cluster_perceptual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.perceptual_clusters(A.embedding_hashes(spark, sf_dir), "feature", 17).select("obs_idx", "label")


# --- evaluation -----------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ann = A.document_observations(spark, sf_dir), A.label_annotations(spark, sf_dir).drop("source")
    return docs.join(ann, "observation_id").select(F.col("digest").alias("p"), F.col("cluster_id").alias("t"), "source", "lang")


_DOC_PAIRS = f"{DOCS}, {ANN}, prs AS (SELECT digest AS p, cluster_id AS t, docs.source AS s, lang FROM docs JOIN ann USING (observation_id))"
_COUNTS = "tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn"
_ROUNDS = "round(precision_, 6) AS precision, round(recall_, 6) AS recall, round(f1_, 6) AS f1"


@query(f"WITH {_DOC_PAIRS}, {metrics_sql('prs')} SELECT rows_::BIGINT AS n_rows, {_COUNTS}, {_ROUNDS}, round(CASE WHEN pp = 0 THEN 0 ELSE fp/pp END, 6) AS false_merge_rate, round(CASE WHEN pa = 0 THEN 0 ELSE fn/pa END, 6) AS false_split_rate FROM scored")
def pairwise_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.pairwise_metrics(_pairs(spark, sf_dir), "p", "t")
    return _rounded(m.select("n_rows", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")], *evaluate.METRICS), *evaluate.METRICS)


@query(f"WITH {_DOC_PAIRS}, c AS (SELECT s, t, count(*) AS n FROM prs GROUP BY ALL) SELECT sum(x)::BIGINT AS manual_corrections FROM (SELECT sum(n) - max(n) AS x FROM c GROUP BY s)")
def manual_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.manual_corrections(_pairs(spark, sf_dir), "source", "t")


@query(f"WITH {_DOC_PAIRS}, q AS (SELECT lang AS p, t, s FROM prs), {metrics_sql('q', 's')} SELECT s AS source, rows_::BIGINT AS n_rows, round(ari_, 6) AS ari, round(nmi_, 6) AS nmi, np AS predicted_clusters, nt AS actual_clusters FROM scored")
def ari_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.pairwise_metrics(_pairs(spark, sf_dir), "lang", "t", ["source"])
    return _rounded(m.select("source", "n_rows", "ari", "nmi", "predicted_clusters", "actual_clusters"), "ari", "nmi")


@query(f"WITH {_DOC_PAIRS}, q AS (SELECT p, t FROM prs), {metrics_sql('q')}, c2 AS (SELECT p, t, count(*) AS n FROM q GROUP BY ALL) SELECT rows_::BIGINT AS observations, np AS predicted_clusters, nt AS actual_clusters, {_ROUNDS}, round(ari_, 6) AS ari, round(nmi_, 6) AS nmi, (SELECT sum(x)::BIGINT FROM (SELECT sum(n) - max(n) AS x FROM c2 GROUP BY p)) AS manual_corrections, 'digest' AS predicted_source, 'labels' AS reference_source FROM scored")
def evaluate_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = A.document_observations(spark, sf_dir).select("observation_id", F.col("digest").alias("cluster_id"), F.lit("digest").alias("source"), F.col("obs_idx").alias("ann_idx"))
    m = evaluate.evaluate(predicted, A.label_annotations(spark, sf_dir))
    names = ("precision", "recall", "f1", "ari", "nmi")
    return _rounded(m.select("observations", "predicted_clusters", "actual_clusters", *names, "manual_corrections", "predicted_source", "reference_source"), *names)


_BEST = """WITH s AS ({scores}), t AS (SELECT score AS threshold, count(*) AS c, sum(target::INT) AS p FROM s GROUP BY score),
  r AS (SELECT threshold, sum(c) OVER (ORDER BY threshold DESC) AS predicted, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(p) OVER () AS positives FROM t),
  f AS (SELECT threshold, tp::DOUBLE/predicted AS pr, CASE WHEN positives = 0 THEN 0 ELSE tp::DOUBLE/positives END AS re FROM r),
  g AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2*pr*re/(pr+re) END AS f1 FROM f)
  SELECT round(threshold, 6) AS threshold, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM g ORDER BY g.f1 DESC, g.threshold DESC LIMIT 1"""


@query(_BEST.format(scores="SELECT l_discount AS score, l_returnflag = 'R' AS target FROM lineitem"))
def best_f1_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.read(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").alias("target"))
    return _rounded(evaluate.best_f1_operating_point(s, "score", "target"), "threshold", "precision", "recall", "f1")


@query(_BEST.format(scores="SELECT value AS score, event_type = 'purchase' AS target FROM events"))
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.read(spark, sf_dir, "events").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("target"))
    return _rounded(evaluate.best_f1_operating_point(s, "score", "target"), "threshold", "precision", "recall", "f1")


@query(_BEST.format(scores="SELECT value AS score, event_type = 'purchase' AS target FROM events").split("SELECT round(threshold")[0] + "SELECT threshold, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM g")
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.read(spark, sf_dir, "events").groupBy(F.col("value").alias("threshold")).agg(F.count("*").alias("c"), F.count_if(F.col("event_type") == "purchase").alias("t"))
    total = A.read(spark, sf_dir, "events").where("event_type = 'purchase'").count()
    return _rounded(evaluate.precision_recall_curve(s, total), "precision", "recall", "f1")
