"""Queries over reviews, restrictions and the rules of tiles, matrices, paths and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import curate, features, graph, tiles, validate
from gridloom.plans import adapters as A
from gridloom.plans.queries_edit import _GROUPS, _groups, _reviews, _three
from gridloom.plans.queries_sets import ANN, DOCS
from gridloom.plans.registry import query


@query(f"WITH {DOCS}, {ANN}, first AS (SELECT min(obs_idx) AS obs_idx FROM docs GROUP BY digest) SELECT ann_idx, observation_id, cluster_id FROM ann WHERE ann_idx IN (SELECT obs_idx FROM first)")
def restrict_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.document_observations(spark, sf_dir)
    first = docs.groupBy("digest").agg(F.min_by("observation_id", "obs_idx").alias("observation_id"))
    return _three(graph.restrict(A.label_annotations(spark, sf_dir), first))


@query(f"WITH {ANN} SELECT ann_idx, observation_id, cluster_id, 'second_pass' AS source FROM ann")
def annotation_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.with_source(A.label_annotations(spark, sf_dir), "run/annotations/second_pass.jsonl").select("ann_idx", "observation_id", "cluster_id", "source")


@query("SELECT vec_id, label, len(embedding)::BIGINT AS dims FROM embeddings")
def zip_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "embeddings")
    return graph.zip_strict(e.select("vec_id", "label"), e.select("vec_id", F.size("embedding").cast("long").alias("dims")), "vec_id")


_SIZES = "SELECT cluster_id, (CASE WHEN cluster_id LIKE '%_0' THEN n - 1 ELSE n END)::BIGINT AS members, least(2, n - 1)::BIGINT AS incorrect, 'confirmed' AS status FROM grp"


def _sizes(reviews: DataFrame) -> DataFrame:
    return reviews.select("cluster_id", F.size("observation_ids").cast("long").alias("members"), F.size("incorrect_observation_ids").cast("long").alias("incorrect"), "status")


@query(f"WITH {_GROUPS} {_SIZES} WHERE cluster_id <> 'en_1' UNION ALL SELECT 'en_1', 3, 1, 'confirmed'")
def save_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = _reviews(_groups(spark, sf_dir))
    return _sizes(curate.save_review(reviews, "en_1", ["doc_00000003", "doc_00000001", "doc_00000002"], ["doc_00000002"]))


@query(f"WITH {_GROUPS}, r AS ({_SIZES}) SELECT 'haus' AS cluster_id, members, incorrect, status FROM r WHERE cluster_id = 'de_1' UNION ALL SELECT * FROM r WHERE cluster_id LIKE 'fr%'")
def rename_cluster_with_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir)
    reviews = _reviews(groups)
    _, merged, _ = curate.rename_cluster_with_review(A.label_annotations(spark, sf_dir), groups, "de_1", "haus", reviews, reviews.where("cluster_id LIKE 'fr%'"))
    return _sizes(merged)


@query(f"WITH {ANN} SELECT r.rule, count(*) AS n FROM ann, (VALUES ('lost'), ('added')) r(rule) WHERE ann_idx % 10 = 0 GROUP BY r.rule")
def validate_same_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.label_annotations(spark, sf_dir)
    edited = a.withColumn("observation_id", F.when(F.col("ann_idx") % 10 == 0, F.concat("observation_id", F.lit("_x"))).otherwise(F.col("observation_id")))
    return validate.same_observations_violations(a, edited).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {_GROUPS} SELECT CASE WHEN cluster_id LIKE '%_0' THEN 'distinct' ELSE 'subset' END AS rule, cluster_id AS key FROM grp")
def validate_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, twice = F.col("observation_ids"), F.col("cluster_id").endswith("_0")
    reviews = _groups(spark, sf_dir).select("cluster_id", F.when(twice, F.concat(members, F.slice(members, 1, 1))).otherwise(members).alias("observation_ids"), F.when(twice, F.slice(members, 1, 1)).otherwise(F.array(F.lit("nobody"))).alias("incorrect_observation_ids"))
    return validate.review_violations(reviews).select("rule", "key")


@query("""WITH s AS (SELECT vec_id // 10 AS screen, count(*) AS n FROM embeddings GROUP BY 1) SELECT 'grid' AS rule, screen::VARCHAR AS key FROM s WHERE n <> 2 * (CASE WHEN screen % 3 = 0 THEN 4 ELSE 5 END)
  UNION ALL SELECT 'empty', 'none'""")
def validate_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.embedding_tiles(spark, sf_dir).withColumn("observation_id", F.col("screen").cast("string"))
    grids = t.select("observation_id", F.lit(2).alias("rows"), F.when(F.col("screen") % 3 == 0, 4).otherwise(5).alias("cols")).distinct()
    grids = grids.union(spark.range(1).select(F.lit("none"), F.lit(0), F.lit(0)))
    return validate.tile_violations(t, grids).where("rule <> 'grid' OR key <> 'none'").select("rule", "key")


@query("""WITH m AS (SELECT a.n_nationkey::BIGINT AS i, b.n_nationkey::BIGINT AS j, abs(a.n_regionkey - b.n_regionkey) + CASE WHEN a.n_nationkey = 3 AND b.n_nationkey = 4 THEN 1 WHEN a.n_nationkey = 7 AND b.n_nationkey = 7 THEN 2 ELSE 0 END AS d FROM nation a, nation b)
  SELECT 'symmetric' AS rule, i || ',' || j AS key FROM m WHERE (i, j) IN ((3, 4), (4, 3)) UNION ALL SELECT 'diagonal', '7,7'""")
def validate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.read(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_nationkey").cast("long").alias(k), F.col("n_regionkey").alias(f"r{k}")) for k in "ij")
    extra = F.when((F.col("i") == 3) & (F.col("j") == 4), 1).when((F.col("i") == 7) & (F.col("j") == 7), 2).otherwise(0)
    pairs = a.crossJoin(b).select("i", "j", (F.abs(F.col("ri") - F.col("rj")) + extra).cast("double").alias("d"))  # 25 nations
    return validate.matrix_violations(pairs, 25).select("rule", "key")


@query("""SELECT rule, count(*) AS n FROM (SELECT CASE event_id % 50 WHEN 0 THEN 'screenshot_path_escapes' WHEN 1 THEN 'screenshot_path' WHEN 2 THEN 'view_tree_path_escapes' END AS rule FROM events) WHERE rule IS NOT NULL GROUP BY rule""")
def validate_artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 50
    shot = F.when(k == 0, "shots/../../x.png").when(k == 1, F.lit(None).cast("string")).otherwise("shots/../shots/./x.png")
    tree = F.when(k == 2, "/etc/x.json").otherwise("trees/x.json")
    o = A.read(spark, sf_dir, "events").select(F.col("event_id").alias("obs_idx"), F.format_string("obs_%06d", "event_id").alias("observation_id"), shot.alias("screenshot_path"), tree.alias("view_tree_path"))
    return validate.artifact_violations(o).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, (p_size * 14)::INT AS h, 28 AS w FROM part")
def check_divisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.check_divisible(A.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 14).cast("int").alias("h"), F.lit(28).alias("w")), 14)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, max(((l_quantity - 25) / 10)::DOUBLE) AS x, max((l_returnflag = 'R')::INT) AS y FROM lineitem GROUP BY ALL),
  s AS (SELECT l_orderkey, avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) AS loss FROM c GROUP BY 1) SELECT round(avg(loss), 6) AS loss FROM s""")
def paired_batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")  # numbers may repeat in an order
    logits = cells.agg(F.max(((F.col("l_quantity") - 25) / 10).cast("double")).alias("logit"))
    targets = cells.agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("target"))
    cells = tiles.paired_cells(logits, targets, "l_orderkey", "l_linenumber")
    return tiles.batch_loss(cells, "l_orderkey", "logit", "target").select(F.round("loss", 6).alias("loss"))


@query("SELECT event_id, 'v' || (event_id % 3 + 1) AS value FROM events")
def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.plans.lineage import new_path

    e = A.read(spark, sf_dir, "events").select("event_id")
    v = lambda k: F.concat(F.lit("v"), (F.col("event_id") % 3 + k).cast("string")).alias("value")
    history = curate.StoredHistory(spark, new_path(spark, "history"), e.select("event_id", v(1)))
    history.edit(e.select("event_id", v(2)))
    history.edit(e.select("event_id", v(3)))
    history.undo(), history.reset()
    return history.current
