"""Queries over tiles, embeddings, boxes, losses and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.operators import dedup, evaluate, features, images, linkage, similarity, tiles
from gridloom.plans import adapters as A
from gridloom.plans.queries_sets import OBS, TRANS
from gridloom.plans.registry import query
from gridloom.plans.sweep import cuts, sweep

TILES = """t AS (SELECT vec_id // 10 AS screen, (vec_id % 10)::INT AS tile_idx, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) AS v,
  1/(1+exp(-(embedding[1]*8.0)::DOUBLE)) AS p1, 1/(1+exp(-(embedding[2]*8.0)::DOUBLE)) AS p2 FROM embeddings)"""
SCORES = """x AS (SELECT a.screen AS i, b.screen AS j, a.tile_idx AS ta, b.tile_idx AS tb, greatest(0, list_dot_product(a.v, b.v)) AS c, a.p1 AS a1, b.p1 AS b1, a.p2 AS a2, b.p2 AS b2 FROM t a JOIN t b ON a.screen <= b.screen),
  r AS (SELECT i, j, ta, max(c*a1*b1) AS m1, max(c*a2*b2) AS m2 FROM x GROUP BY ALL), q AS (SELECT i, j, tb, max(c*a1*b1) AS m1, max(c*a2*b2) AS m2 FROM x GROUP BY ALL),
  s AS (SELECT screen, sum(p1) AS p1, sum(p2) AS p2 FROM t GROUP BY screen),
  rs AS (SELECT i, j, sum(m1) AS r1, sum(m2) AS r2 FROM r GROUP BY ALL), qs AS (SELECT i, j, sum(m1) AS q1, sum(m2) AS q2 FROM q GROUP BY ALL),
  raw AS (SELECT i, j, (r1/sa.p1 + q1/sb.p1)/2 AS s1, (r2/sa.p2 + q2/sb.p2)/2 AS s2 FROM rs JOIN qs USING (i, j) JOIN s sa ON sa.screen = i JOIN s sb ON sb.screen = j)"""


@query(f"WITH {TILES}, {SCORES} SELECT i, j, round(s1, 5) AS clickable, round(s2, 5) AS scrollable FROM raw")
def element_scores_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarity.element_scores(similarity.prepared_tiles(A.embedding_tiles(spark, sf_dir)))
    return s.select("i", "j", F.round(F.col("scores")[0], 5).alias("clickable"), F.round(F.col("scores")[1], 5).alias("scrollable"))


@query(f"WITH {TILES}, {SCORES}, o AS (SELECT i AS k, s1, s2 FROM raw WHERE i = j) SELECT raw.i, raw.j, round((1 - (least(1, raw.s1/sqrt(oi.s1*oj.s1)) + least(1, raw.s2/sqrt(oi.s2*oj.s2)))/2)::FLOAT::DOUBLE, 5) AS d FROM raw JOIN o oi ON oi.k = raw.i JOIN o oj ON oj.k = raw.j WHERE raw.i < raw.j")
def element_distance_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarity.element_scores(similarity.prepared_tiles(A.embedding_tiles(spark, sf_dir)))
    return similarity.element_distances(s).select("i", "j", F.round(F.col("d").cast("double"), 5).alias("d"))


@query()
def element_distance_hungarian(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarity.element_scores(similarity.prepared_tiles(A.embedding_tiles(spark, sf_dir)), "hungarian")
    return similarity.element_distances(s)


@query("SELECT a.vec_id AS i, b.vec_id AS j, round((1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))::FLOAT::DOUBLE, 5) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def cosine_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "embeddings")
    return similarity.cosine_distances(e, "vec_id", "embedding").select("i", "j", F.round(F.col("d").cast("double"), 5).alias("d"))


@query()
def cluster_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.cluster_embeddings(A.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.8)


@query()
def cluster_element_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.cluster_screens(A.embedding_tiles(spark, sf_dir), 0.5)


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.embedding_tiles(spark, sf_dir).select(F.col("screen").alias("i")).distinct().withColumn("actual", F.col("i") % 5)


@query()
def all_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts(A.embedding_tiles(spark, sf_dir), method="best")


@query()
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = _reference(spark, sf_dir).select("i")
    first = A.read(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("obs_idx")).agg(F.min_by("label", "vec_id").alias("digest"))
    first = first.withColumn("observation_id", F.col("obs_idx").cast("string"))  # screens whose first tiles have the same label count as copies
    kept = dedup.select_representatives(first, first.withColumn("cluster_id", F.lit("all")), "digest", max_per_image=3)
    views = everything.withColumn("view", F.lit("full")).unionByName(kept.select(F.col("obs_idx").alias("i"), F.lit("deduplicated").alias("view")))
    return sweep(A.embedding_tiles(spark, sf_dir), _reference(spark, sf_dir), views, method="best", square=False)[0]


# A table of sweep rows from line items, so that choosing among rows has SQL to compare with.
def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cut_idx"))
    return g.agg((F.max("l_extendedprice") / 1000).alias("distance_threshold"), F.max("l_discount").alias("full_f1"), F.max("l_tax").alias("full_ari"), F.min("l_discount").alias("full_nmi"))


_ROWS = "rows_ AS (SELECT l_orderkey AS cut_idx, max(l_extendedprice)/1000 AS distance_threshold, max(l_discount) AS full_f1, max(l_tax) AS full_ari, min(l_discount) AS full_nmi FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {_ROWS} SELECT cut_idx, distance_threshold, full_f1, full_ari, full_nmi FROM rows_ ORDER BY full_f1 DESC, full_ari DESC, full_nmi DESC, distance_threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_row(_rows(spark, sf_dir))


@query(f"WITH {_ROWS} SELECT cut_idx, distance_threshold, full_f1, full_ari, full_nmi FROM rows_ WHERE distance_threshold <= 30 ORDER BY distance_threshold DESC LIMIT 1")
def row_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.row_at_threshold(_rows(spark, sf_dir), 30.0)


# --- features -------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id // 10 AS o, vec_id % 10 AS tile, embedding, CASE WHEN (vec_id % 10) < 5 THEN 0 ELSE 2 END + CASE WHEN (vec_id % 5) < 2 THEN 0 ELSE 1 END AS q FROM embeddings),
  x AS (SELECT o, q, k, embedding[k]::DOUBLE AS x FROM e, range(1, 65) r(k)),
  s AS (SELECT o, k, avg(x) AS m, stddev_pop(x) AS d, avg(x) FILTER (q = 0) AS q0, avg(x) FILTER (q = 1) AS q1, avg(x) FILTER (q = 2) AS q2, avg(x) FILTER (q = 3) AS q3 FROM x GROUP BY ALL),
  p AS (SELECT o, avg(1/(1+exp(-(embedding[1]*8.0)::DOUBLE))) AS p0, avg(1/(1+exp(-(embedding[2]*8.0)::DOUBLE))) AS p1, max(embedding) FILTER (tile = 0) AS g FROM e GROUP BY o),
  f AS (SELECT s.o, list_concat(max(g)::DOUBLE[], list(m ORDER BY k), list(d ORDER BY k), list(q0 ORDER BY k), list(q1 ORDER BY k), list(q2 ORDER BY k), list(q3 ORDER BY k), [max(p0), max(p1)]) AS v FROM s JOIN p USING (o) GROUP BY s.o)
  SELECT o AS observation_id, len(v) AS dims, round(list_sum(v), 5) AS total, round(v[65], 5) AS v65, round(v[129], 5) AS v129, round(v[193], 5) AS v193, round(v[400], 5) AS v400, round(v[450], 5) AS v450 FROM f""")
def grounding_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.embedding_tiles(spark, sf_dir).withColumnRenamed("screen", "observation_id")
    first = F.max(F.when(F.col("tile_idx") == 0, F.col("vec"))).alias("global_embedding")
    grids = t.groupBy("observation_id").agg(first).select("observation_id", F.lit(2).alias("rows"), F.lit(5).alias("cols"), "global_embedding")
    g = features.grounding_embedding(t, grids, incomplete=True)  # the last screen has as many tiles as there are vectors left
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return g.select("observation_id", F.size("embedding").cast("long").alias("dims"), F.round(total, 5).alias("total"), *[F.round(F.try_element_at("embedding", F.lit(k)), 5).alias(f"v{k}") for k in (65, 129, 193, 400, 450)])


@query("""WITH x AS (SELECT vec_id // 10 AS o, k, avg(embedding[k]::DOUBLE) AS m FROM embeddings, range(1, 65) r(k) WHERE vec_id % 10 >= 3 GROUP BY ALL) SELECT o AS observation_id, round(sum(m), 5) AS total, round(max(m), 5) AS top FROM x GROUP BY o""")
def global_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = A.embedding_tiles(spark, sf_dir).select(F.col("screen").alias("observation_id"), F.col("tile_idx").alias("token_idx"), "vec")
    g = features.global_embedding(tokens, 3)
    return g.select("observation_id", F.round(F.aggregate("global_embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.array_max("global_embedding"), 5).alias("top"))


@query(f"""WITH {OBS}, {TRANS}, n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT observation_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM obs, n JOIN embeddings ON vec_id = obs_idx % n.n),
  t AS (SELECT source_observation_id AS o, destination_observation_id AS d, event_type, coalesce(effective, false) AS e FROM trans),
  st AS (SELECT o, count(*) AS deg, avg(e::INT) AS eff, avg((event_type = (SELECT min(event_type) FROM trans))::INT) AS h1, avg((event_type = (SELECT max(event_type) FROM trans))::INT) AS h2 FROM t GROUP BY o),
  nm AS (SELECT t.o, avg(b.v[1]) AS n1, avg(b.v[64]) AS n4 FROM t JOIN b ON b.observation_id = t.d GROUP BY t.o)
  SELECT b.observation_id, (130 + (SELECT count(DISTINCT event_type) FROM trans))::BIGINT AS dims, round(b.v[1], 5) AS base, round(coalesce(n1, 0), 5) AS near_first, round(coalesce(n4, 0), 5) AS near_last, round(coalesce(h1, 0), 5) AS first_type, round(coalesce(h2, 0), 5) AS last_type, coalesce(deg, 0)::DOUBLE AS degree, round(coalesce(eff, 0), 5) AS effective
  FROM b LEFT JOIN st ON st.o = b.observation_id LEFT JOIN nm ON nm.o = b.observation_id""")
def transition_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "embeddings")
    n = e.count()
    base = A.event_observations(spark, sf_dir).withColumn("vec_id", F.col("obs_idx") % n).join(e, "vec_id").select("observation_id", "embedding")
    out = features.transition_embedding(base, A.event_transitions(spark, sf_dir))
    at = lambda k: F.element_at("embedding", k)
    return out.select(
        "observation_id", F.size("embedding").cast("long").alias("dims"), F.round(at(1), 5).alias("base"), F.round(at(65), 5).alias("near_first"), F.round(at(128), 5).alias("near_last"),
        F.round(at(129), 5).alias("first_type"), F.round(at(-3), 5).alias("last_type"), at(-2).alias("degree"), F.round(at(-1), 5).alias("effective"),
    )


# --- tiles, losses --------------------------------------------------------------------------------

_SIDES = ("greatest(0, least(432, ((l_partkey * 7) % 500 - 20)::DOUBLE))", "greatest(0, least(768, ((l_suppkey * 13) % 800 - 10)::DOUBLE))",
          "greatest(0, least(432, ((l_partkey * 7) % 500 - 20 + l_quantity * 3)::DOUBLE))", "greatest(0, least(768, ((l_suppkey * 13) % 800 - 10 + l_linenumber * 9)::DOUBLE))")


def _cover(tile: int, shrink: float = 1.0, where: str = "true") -> str:
    """SQL for the tiles that the boxes of line items cover on screens of 432 by 768."""
    w, h = int(432 * shrink) // tile, int(768 * shrink) // tile
    sides = ", ".join(f"{side} * {shrink} AS {name}" for side, name in zip(_SIDES, ("x1", "y1", "x2", "y2")))
    return f"""SELECT DISTINCT image, y::INT AS y, x::INT AS x FROM (SELECT image, y, unnest(range(a, b)) AS x FROM (SELECT image, a, b, unnest(range(c, d)) AS y FROM
      (SELECT image, (CASE WHEN w THEN fx1 ELSE tx1 END)::BIGINT AS a, (CASE WHEN w THEN fx2 ELSE tx2 END)::BIGINT AS b, (CASE WHEN w THEN fy1 ELSE ty1 END)::BIGINT AS c, (CASE WHEN w THEN fy2 ELSE ty2 END)::BIGINT AS d FROM
      (SELECT *, fx1 < fx2 AND fy1 < fy2 AS w FROM (SELECT image, ceil(x1/{tile}) AS fx1, ceil(y1/{tile}) AS fy1, least({w}, floor(x2/{tile})) AS fx2, least({h}, floor(y2/{tile})) AS fy2,
      floor(x1/{tile}) AS tx1, floor(y1/{tile}) AS ty1, least({w}, ceil(x2/{tile})) AS tx2, least({h}, ceil(y2/{tile})) AS ty2 FROM (SELECT l_orderkey AS image, {sides} FROM lineitem WHERE {where}))))))"""


def _box() -> Column:
    x, y = (F.col("l_partkey") * 7) % 500 - 20, (F.col("l_suppkey") * 13) % 800 - 10
    return F.array(*[c.cast("double") for c in (x, y, x + F.col("l_quantity") * 3, y + F.col("l_linenumber") * 9)])


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.read(spark, sf_dir, "lineitem")
    return tiles.clamp_boxes(li.select(F.col("l_orderkey").alias("image"), _box().alias("bbox"), F.lit(432).alias("width"), F.lit(768).alias("height")))


@query(f'SELECT image, y AS "row", x AS col FROM ({_cover(16)})')
def bbox_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.box_tiles(_boxes(spark, sf_dir), 16, ["image"])


_GRID = "g AS (SELECT image, r.y::INT AS y, q.x::INT AS x FROM (SELECT DISTINCT l_orderkey AS image FROM lineitem), range(8) r(y), range(4) q(x))"


@query(f"""WITH c AS ({_cover(96)}), {_GRID} SELECT g.image, g.y AS "row", g.x AS col, (c.image IS NOT NULL)::INT AS label FROM g LEFT JOIN c ON c.image = g.image AND c.y = g.y AND c.x = g.x""")
def tile_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return tiles.tile_mask(boxes.select("image", "width", "height").distinct(), tiles.box_tiles(boxes, 96, ["image"]), 96, ["image"])


@query(f"""WITH ca AS ({_cover(48, 0.5, "l_linestatus = 'F'")}), cb AS ({_cover(48, 0.5, "l_linestatus = 'O'")}), {_GRID}
  SELECT g.image, (g.y * 4 + g.x)::INT AS tile_idx, g.y AS "row", g.x AS col, (ca.image IS NOT NULL)::INT AS clickable, (cb.image IS NOT NULL)::INT AS scrollable FROM g LEFT JOIN ca ON ca.image = g.image AND ca.y = g.y AND ca.x = g.x LEFT JOIN cb ON cb.image = g.image AND cb.y = g.y AND cb.x = g.x""")
def sample_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(_box().alias("bbox"))
    of = lambda kind: F.collect_list(F.when(F.col("l_linestatus") == kind, box))
    li = A.read(spark, sf_dir, "lineitem")
    shown = li.groupBy(F.col("l_orderkey").alias("image")).agg(of("F").alias("clickable_elements"), of("O").alias("scrollable_elements")).withColumns({"width": F.lit(432), "height": F.lit(768)})
    return tiles.sample_targets(shown, 0.5, 48, ["image"])


@query("""WITH s AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id) SELECT conv_id, turns, min(conv_id) OVER (PARTITION BY turns) AS first_idx, ((row_number() OVER (PARTITION BY turns ORDER BY conv_id) - 1) // 8)::BIGINT AS chunk FROM s""")
def ragged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return tiles.ragged_chunks(s, "turns", "conv_id", 8)


_BCE = "greatest(x, 0) - x*y + ln(1 + exp(-abs(x)))"


@query(f"WITH c AS (SELECT user_id, value/100 - 2 AS x, (event_type = 'purchase')::INT AS y FROM events), s AS (SELECT user_id, avg({_BCE}) AS l FROM c GROUP BY user_id) SELECT round(avg(l), 6) AS loss FROM s")
def bce_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.read(spark, sf_dir, "events").select("user_id", (F.col("value") / 100 - 2).alias("x"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return tiles.batch_loss(c, "user_id", "x", "y").select(F.round("loss", 6).alias("loss"))


@query(f"WITH c AS (SELECT user_id, value/100 - 2 AS x, (event_type = 'purchase')::INT AS y FROM events), s AS (SELECT user_id, avg({_BCE}) AS l FROM c GROUP BY user_id), b AS (SELECT user_id // 8 AS b, avg(l) AS loss, count(*) AS n FROM s GROUP BY ALL) SELECT round(sum(loss*n)/sum(n), 6) AS loss FROM b")
def validation_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.read(spark, sf_dir, "events").select("user_id", (F.col("value") / 100 - 2).alias("x"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    losses = tiles.sample_losses(c, "user_id", "x", "y").groupBy(F.floor(F.col("user_id") / 8)).agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))
    return tiles.validation_loss(losses).select(F.round("loss", 6).alias("loss"))


@query()
def train_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.train_validation_split(A.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 42)


@query("SELECT vec_id, greatest(1, round_even((vec_id + 1) * 0.25, 0))::INT AS h, greatest(1, round_even((vec_id * 3 + 2) * 0.25, 0))::INT AS w FROM embeddings")
def resize_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "embeddings")
    h, w = images.scaled_size(F.col("vec_id") + 1, F.col("vec_id") * 3 + 2, 0.25)
    return e.select("vec_id", h.alias("h"), w.alias("w"))


_PIXELS = "px AS (SELECT v.vec_id AS image, (k // 7)::INT AS y, (k % 7)::INT AS x, (v.vec_id * 31 + k * 5) % 256 AS r, (v.vec_id * 17 + k * 3) % 256 AS g, (v.vec_id + k * 11) % 256 AS b FROM embeddings v, range(42) t(k))"


@query(f"WITH {_PIXELS}, tl AS (SELECT vec_id AS image, (k // 3)::INT AS tr, (k % 3)::INT AS tc, embedding[k + 1]::DOUBLE * 4 AS p FROM embeddings, range(9) t(k)), j AS (SELECT px.*, greatest(0, least(1, coalesce(p, 0))) * 0.5 AS a FROM px LEFT JOIN tl ON tl.image = px.image AND tr = y // 2 AND tc = x // 2) SELECT image, y, x, round(r/255*(1-a), 5) AS r, round(g/255*(1-a), 5) AS g, round(b/255*(1-a) + a, 5) AS b FROM j")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "embeddings")
    v, k = F.col("vec_id"), F.col("k")
    px = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(41))).alias("k")).select(
        v.alias("image"), F.floor(k / 7).cast("int").alias("y"), (k % 7).cast("int").alias("x"), ((v * 31 + k * 5) % 256).alias("r"), ((v * 17 + k * 3) % 256).alias("g"), ((v + k * 11) % 256).alias("b")
    )
    grid = e.select("vec_id", F.posexplode(F.slice("embedding", 1, 9)).alias("k", "q")).select(v.alias("image"), F.floor(k / 3).cast("int").alias("row"), (k % 3).cast("int").alias("col"), (F.col("q").cast("double") * 4).alias("p"))
    out = images.overlay_pixels(px, grid, 2, 0.5)
    return out.select("image", "y", "x", *[F.round(c, 5).alias(c) for c in "rgb"])
