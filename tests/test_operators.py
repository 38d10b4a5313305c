"""Examples with known results, and properties against brute force."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridloom.operators import cluster, curate, dedup, evaluate, features, graph, images, linkage, similarity, tiles, validate
from gridloom.plans.components import connected_components
from gridloom.plans.ordering import places, positions, previous, running


def logit(p):
    return math.log(p / (1 - p))


def screens(spark, *payloads):
    """tiles of payloads [(vector, p clickable, p scrollable), ...]"""
    rows = [(s, t, [float(x) for x in v], [logit(a), logit(b)]) for s, tiles_ in enumerate(payloads) for t, (v, a, b) in enumerate(tiles_)]
    return spark.createDataFrame(rows, "screen long, tile_idx int, vec array<double>, logits array<double>")


def distances(spark, *payloads, method="best", weights=(1.0, 1.0), chunk=8192):
    prepared = similarity.prepared_tiles(screens(spark, *payloads))
    return {(r.i, r.j): r.d for r in similarity.element_distances(similarity.element_scores(prepared, method, chunk=chunk), weights).collect()}


A = [((1, 0), 0.9, 0.1), ((0, 1), 0.2, 0.8)]
B = [((0.99, 0.01), 0.8, 0.2), ((0.1, 0.9), 0.3, 0.7)]
C = [((-1, 0), 0.9, 0.9)]


@pytest.mark.parametrize("method", ["best", "hungarian"])
def test_element_distances(spark, method):
    d = distances(spark, A, B, C, method=method)
    assert d[0, 1] == pytest.approx(0.0139871, abs=1e-6)
    assert d[0, 2] == d[1, 2] == 1
    assert distances(spark, A, B, C, method=method, chunk=1) == pytest.approx(d, abs=1e-7)


def test_one_to_one_or_reuse(spark):
    two, one = [((1, 0), 0.9, 0.9)] * 2, [((1, 0), 0.9, 0.9)]
    assert distances(spark, two, one)[0, 1] == pytest.approx(0, abs=1e-6)
    assert distances(spark, two, one, method="hungarian")[0, 1] == pytest.approx(0.2928932, abs=1e-6)


def test_low_probability_weighs_less(spark):
    one = [((1, 0), 0.9, 0.9)]
    low, high = ([((1, 0), 0.9, 0.9), ((0, 1), p, p)] for p in (0.1, 0.9))
    assert distances(spark, low, one)[0, 1] == pytest.approx(0.0047368, abs=1e-6)
    assert distances(spark, high, one)[0, 1] == pytest.approx(0.2500001, abs=1e-6)


@pytest.mark.parametrize("weights", [(1.0,), (0.0, 0.0), (-1.0, 2.0), (float("nan"), 1.0)])
def test_bad_weights(spark, weights):
    with pytest.raises(ValueError, match="class_weights|positive"):
        distances(spark, A, B, weights=weights)


def test_bad_method(spark):
    with pytest.raises(ValueError, match="match_method"):
        distances(spark, A, B, method="unknown")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_is_best(n, m, seed):
    score = np.random.default_rng(seed).random((n, m)).round(1)
    small, large = sorted((n, m))
    table = score if n <= m else score.T
    best = max(sum(table[i, c] for i, c in enumerate(cols)) for cols in itertools.permutations(range(large), small))
    assert similarity.assignment_sums(np.stack([score, np.zeros_like(score), score + 1]))[[0, 1, 2]] == pytest.approx([best, 0, best + small])


# --- linkage --------------------------------------------------------------------------------------

D = np.array([[0, 0.1, 0.8], [0.1, 0, 0.8], [0.8, 0.8, 0]], np.float32)


def test_cuts():
    assert linkage.cut_at(D, 0.2) == [0, 0, 1]
    assert linkage.cut_at(D.astype(float), 0.1) == [0, 1, 2]  # not below the threshold
    cuts = linkage.all_cuts(D)
    assert [c["predicted_clusters"] for c in cuts] == [3, 2, 1]
    assert cuts[1]["distance_threshold"] == math.nextafter(float(D[0, 1]), math.inf)
    assert cuts[0]["merge_distance"] is None
    assert [c["predicted_clusters"] for c in linkage.all_cuts(0.5 * (1 - np.eye(3, dtype=np.float32)))] == [3, 1]
    assert linkage.cut_at(np.zeros((0, 0)), 1) == [] and linkage.cut_at(np.zeros((1, 1)), 1) == [0]


def test_zero_distances_need_more_than_zero():
    cuts = linkage.all_cuts(np.zeros((2, 2), np.float32))
    assert cuts[1]["distance_threshold"] == 5e-324 and cuts[1]["labels"] == [0, 0]


@pytest.mark.parametrize("matrix, says", [([[0, 1]], "square"), ([[0, math.inf], [math.inf, 0]], "finite"), ([[0, 1], [0.5, 0]], "symmetric"), ([[1, 0], [0, 0]], "diagonal"), ([[0, -1], [-1, 0]], "negative")])
def test_bad_matrix(matrix, says):
    with pytest.raises(ValueError, match=says):
        linkage.cut_at(np.array(matrix, float), 1)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 9), st.integers(0, 10**6))
def test_linkage_is_average_linkage(n, seed):
    x = np.random.default_rng(seed).random((n, n))
    d = np.triu(x, 1) + np.triu(x, 1).T
    groups, heights = [[i] for i in range(n)], []
    while len(groups) > 1:
        h, a, b = min((d[np.ix_(p, q)].mean(), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        heights.append(h)
        groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
    assert [m[2] for m in linkage.average_linkage(d)] == pytest.approx(heights)
    for cut in linkage.all_cuts(d)[1:]:
        assert linkage.cut_at(d, cut["distance_threshold"]) == cut["labels"]


def test_cluster_embeddings(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.99, 0.01]), (2, [0.0, 1.0])], "k long, v array<double>")
    assert [r.label for r in linkage.cluster_embeddings(v, "k", "v", 0.1).orderBy("i").collect()] == [0, 0, 1]


# --- evaluation -----------------------------------------------------------------------------------


def pairs(spark, predicted, actual):
    return spark.createDataFrame(list(zip(predicted, actual)), "p string, t string")


def brute(predicted, actual):
    tp = fp = fn = tn = 0
    for i, j in itertools.combinations(range(len(predicted)), 2):
        p, t = predicted[i] == predicted[j], actual[i] == actual[j]
        tp, fp, fn, tn = tp + (p and t), fp + (p and not t), fn + (t and not p), tn + (not p and not t)
    return tp, fp, fn, tn


def test_pairwise_example(spark):
    row = evaluate.pairwise_metrics(pairs(spark, "XXXY", "AABB"), "p", "t").first()
    assert (row.precision, row.recall, row.ari) == (pytest.approx(1 / 3), pytest.approx(1 / 2), pytest.approx(0))
    assert row.nmi == pytest.approx(0.3437110, abs=1e-6)
    assert evaluate.manual_corrections(pairs(spark, "XXXY", "AABB"), "p", "t").first()[0] == 1


@pytest.mark.parametrize("labels, ari, nmi", [("012", 0, 0.7336804), ("001", 1, 1), ("000", 0, 0)])
def test_ari_nmi(spark, labels, ari, nmi):
    row = evaluate.pairwise_metrics(pairs(spark, labels, "AAB"), "p", "t").first()
    assert (row.ari, row.nmi) == (pytest.approx(ari, abs=1e-9), pytest.approx(nmi, abs=1e-6))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), min_size=1, max_size=14))
def test_pair_counts(spark, rows):
    row = evaluate.pairwise_metrics(pairs(spark, *zip(*rows)), "p", "t").first()
    assert (row.tp, row.fp, row.fn, row.tn) == brute(*zip(*rows))


def test_null_is_a_label(spark):
    row = evaluate.pairwise_metrics(spark.createDataFrame([(None, "A"), (None, "A"), ("x", None)], "p string, t string"), "p", "t").first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 0, 0, 2)


def test_best_f1(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, t int")
    row = evaluate.best_f1_operating_point(s, "s", "t").first()
    assert (row.threshold, row.precision, row.recall, row.f1) == (0.8, pytest.approx(2 / 3), 1, pytest.approx(0.8))
    with pytest.raises(ValueError):
        evaluate.best_f1_operating_point(s.limit(0), "s", "t")


def test_sweep_rows(spark):
    heads, labels = linkage.cuts_frames(spark, linkage.all_cuts(D), [0, 1, 2])
    reference = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "i long, actual string")
    views = spark.createDataFrame([(v, i) for v in ("full", "deduplicated") for i in range(3)], "view string, i long")
    rows = heads.join(evaluate.sweep_metrics(labels, reference, views), "cut_idx").cache()
    best = evaluate.best_row(rows).first()
    assert (best.predicted_clusters, best.full_f1, best.full_ari) == (2, 1, 1) and best.full_nmi == pytest.approx(1)
    assert evaluate.row_at_threshold(rows, 0.1).first().cut_idx == 0
    assert evaluate.row_at_threshold(rows, 0.2).first().cut_idx == 1
    with pytest.raises(ValueError, match="Unknown view"):
        evaluate.best_row(rows, "other")
    with pytest.raises(ValueError):
        evaluate.row_at_threshold(rows, float("nan"))


def test_evaluate_needs_two(spark):
    a = spark.createDataFrame([("o1", "x", "s", 0)], "observation_id string, cluster_id string, source string, ann_idx long")
    with pytest.raises(Exception, match="two shared"):
        evaluate.evaluate(a, a).collect()


# --- clustering, ordering, components -------------------------------------------------------------


def observations(spark, values_, kind="string"):
    return spark.createDataFrame([(i, f"obs_{i}", v) for i, v in enumerate(values_)], f"obs_idx long, observation_id string, v {kind}")


def labels_of(df):
    return [r.label for r in df.orderBy("obs_idx").collect()]


def test_categorical(spark):
    assert labels_of(cluster.categorical_clusters(observations(spark, ["A", "B", None, "A", None]), "v")) == [0, 1, 2, 0, 2]


def test_perceptual(spark):
    assert labels_of(cluster.perceptual_clusters(observations(spark, ["0" * 16, "0" * 15 + "1", "f" * 16]), "v", 1)) == [0, 0, 1]
    with pytest.raises(ValueError, match="widths"):
        cluster.perceptual_clusters(observations(spark, ["00", "000"]), "v")


@pytest.mark.parametrize("width", [3, 8, 16, 20])
def test_hamming_pairs(spark, width):
    rng = np.random.default_rng(width)
    base = [rng.integers(0, 16, width) for _ in range(6)]
    words = {"".join("%x" % (d ^ (rng.random() < 0.15)) for d in base[k % 6]) for k in range(40)}
    want = {(a, b): bin(int(a, 16) ^ int(b, 16)).count("1") for a, b in itertools.combinations(sorted(words), 2)}
    for most in (4, 1):  # narrow bands, and wide ones where the words are long
        got = cluster.hamming_pairs(observations(spark, sorted(words)), "v", most).collect()
        assert {(r.a, r.b): r.distance for r in got} == {k: d for k, d in want.items() if d <= most}
        assert len(got) == len({(r.a, r.b) for r in got})
    many = cluster._all_pairs(observations(spark, sorted(words)).selectExpr("v AS h"), 4, block=7).collect()
    assert {(r.a, r.b): r.distance for r in many} == {k: d for k, d in want.items() if d <= 4} and len(many) == len({(r.a, r.b) for r in many})


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(40, i) for i in range(40)], [(5, 9), (9, 2), (7, 3), (1, 1)], []])
def test_components(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_running(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 5 AS v")
    rows = sorted(running(df, ["k"], {"total": F.col("v")}).collect())
    assert [r.total for r in rows] == list(itertools.accumulate(r.v for r in rows))
    assert sorted(r.p for r in positions(df, [F.desc("k")], "p").collect()) == list(range(1000))


def test_places_and_previous(spark):
    df = spark.range(500).selectExpr("(id * 7919) % 500 AS k", "CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 5 > 0 THEN 'b' END AS g")
    want = {}
    for r in sorted(df.collect()):
        want.setdefault(r.g, []).append(r.k)
    got = places(df, ["g"], ["k"], "p", "n").collect()
    assert {(r.g, r.k): (r.p, r.n) for r in got} == {(g, k): (p, len(ks)) for g, ks in want.items() for p, k in enumerate(ks)}
    before = sorted((r.k, r.b) for r in previous(df, ["k"], F.col("g"), "b").collect())
    ordered = sorted(df.collect())
    assert before == [(r.k, ordered[i - 1].g if i else None) for i, r in enumerate(ordered)]


def test_scratch_deletes_what_is_not_kept(spark):
    import os

    from gridloom.plans import lineage

    with lineage.scratch():
        gone, kept = lineage.cut(spark.range(3), "a"), lineage.cut(spark.range(4), "b")
        with lineage.scratch():
            inner = lineage.keep(lineage.cut(spark.range(5), "c"))
        lineage.keep(kept)
        assert inner.count() == 5
    paths = [os.path.exists(x._gridloom_path.removeprefix("file:")) for x in (gone, kept, inner)]
    assert kept.count() == 4 and paths == [False, True, False]  # the inner one went with the outer scratch
    assert lineage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# --- deduplication and samples --------------------------------------------------------------------


def test_dedup_groups_and_representatives(spark):
    obs = observations(spark, "abaac").withColumnRenamed("v", "digest")
    groups = dedup.dedup_groups(obs, "digest").orderBy("first_idx").collect()
    assert [r.observation_ids for r in groups] == [["obs_0", "obs_2", "obs_3"], ["obs_1"], ["obs_4"]]
    ann = spark.createDataFrame([(f"obs_{i}", c) for i, c in enumerate("ABACB")], "observation_id string, cluster_id string")
    chosen = lambda scope: [r.obs_idx for r in dedup.select_representatives(obs, ann, "digest", scope=scope, max_per_image=1).orderBy("obs_idx").collect()]
    assert chosen("global") == [0, 1, 4]
    assert chosen("within-cluster") == [0, 1, 3, 4]
    with pytest.raises(ValueError, match="scope"):
        chosen("none")
    with pytest.raises(ValueError, match="max_per_image"):
        dedup.select_representatives(obs, ann, "digest", max_per_image=0)


@pytest.mark.parametrize("n, k, even, preview", [(10, 3, [0, 4, 9], [0, 4, 9]), (4, 3, [0, 1, 3], [0, 2, 3]), (2, 3, [0, 1], [0, 1]), (5, 1, [0], [0])])
def test_sampling_rules(spark, n, k, even, preview):
    row = spark.range(1).select(dedup.evenly_spaced(k, F.lit(n)).alias("e"), dedup.preview_positions(k, F.lit(n)).alias("p")).first()
    assert (row.e, row.p) == (even, preview)


def test_first_eligible(spark):
    groups = spark.createDataFrame([(0, ["o1", "o2"]), (1, ["o3"]), (2, ["o4"])], "group_idx long, observation_ids array<string>")
    ok = spark.createDataFrame([("o2",), ("o3",)], "observation_id string")
    assert [r.observation_id for r in dedup.first_eligible(groups, ok).orderBy("group_idx").collect()] == ["o2", "o3"]


def test_split(spark):
    out = dedup.train_validation_split(spark.range(100), "id", 17, 3)
    assert out.where("split = 'validation'").count() == 17 and out.count() == 100


# --- validation -----------------------------------------------------------------------------------


def run_frames(spark, sources=("obs_000001", "obs_000002"), path="screens/1.png"):
    obs = spark.createDataFrame([(i, f"obs_00000{i}", path, "t.json") for i in (1, 2, 3)], "obs_idx long, observation_id string, screenshot_path string, view_tree_path string")
    trans = spark.createDataFrame([(1, "trans_1", sources[0], "obs_000002"), (2, "trans_2", sources[1], "obs_000003")], "trans_idx long, transition_id string, source_observation_id string, destination_observation_id string")
    return obs, trans


def test_run_rules(spark):
    obs, trans = run_frames(spark)
    validate.enforce(validate.run_violations(obs, trans))
    assert [r.n for r in graph.outgoing(trans).orderBy("observation_id").collect()] == [1, 1]
    assert graph.incoming_of(trans, "obs_000003").first().transition_id == "trans_2"
    with pytest.raises(ValueError, match="Broken N\\+1 trajectory"):
        validate.enforce(validate.run_violations(*run_frames(spark, ("obs_000001", "obs_000001"))))
    with pytest.raises(ValueError, match="escapes run directory"):
        validate.enforce(validate.run_violations(*run_frames(spark, path="a/../../outside.png")))
    with pytest.raises(ValueError, match="unknown source"):
        validate.enforce(validate.transition_violations(obs, trans.withColumn("source_observation_id", F.lit("no"))))
    with pytest.raises(ValueError, match="exactly one more"):
        validate.enforce(validate.transition_violations(obs, trans.limit(1)))


def annotation(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ann_idx long, observation_id string, cluster_id string, source string")


@pytest.mark.parametrize("rows, says", [
    ([("obs_000001", "", "m")], "invalid cluster_id"), ([("obs_000001", "A", "m")] * 2, "Duplicate annotation"), ([("obs_unknown", "A", "m")], "Unknown annotated observation"),
    ([("obs_000001", "A", None)], "invalid source"), ([("obs_unknown", "", "m"), ("obs_000001", "", "m")], "Unknown annotated observation: obs_unknown"),
])
def test_annotation_rules(spark, rows, says):
    obs, _ = run_frames(spark)
    with pytest.raises(ValueError, match=says):
        validate.enforce(validate.annotation_violations(obs, annotation(spark, *rows)))


def test_annotation_fields_and_completeness(spark):
    obs, _ = run_frames(spark)
    a = annotation(spark, ("obs_000003", "Read", "m"), ("obs_000001", "Home", "m"))
    validate.enforce(validate.annotation_violations(obs, a))
    with pytest.raises(ValueError, match="Missing cluster annotations for: obs_000002"):
        validate.enforce(validate.annotation_violations(obs, a, complete=True))
    with pytest.raises(ValueError, match="Abandoned annotation field"):
        validate.enforce(validate.annotation_violations(obs, a.withColumn("fields_present", F.array(F.lit("observation_id"), F.lit("auto_cluster_id")))))


@pytest.mark.parametrize("groups, says", [
    ([["obs_000001"], ["obs_000002"]], "does not cover"), ([["obs_000001", "obs_000001"], ["obs_000002"], ["obs_000003"]], "Duplicate"), ([["obs_000001", "obs_000003", "no"], ["obs_000002"]], "Unknown"),
    ([["obs_000003", "obs_000001"], ["obs_000002"]], "dataset order"), ([["obs_000002"], ["obs_000001", "obs_000003"]], "first occurrence"), ([[], ["obs_000001", "obs_000002", "obs_000003"]], "non-empty"),
])
def test_dedup_rules(spark, groups, says):
    obs, _ = run_frames(spark)
    table = spark.createDataFrame([(i, "a" * 64, g) for i, g in enumerate(groups)], "group_idx long, pixel_sha256 string, observation_ids array<string>")
    with pytest.raises(ValueError, match=says):
        validate.enforce(validate.dedup_violations(obs, table))


def test_matrix_and_tile_rules(spark):
    square = lambda m: spark.createDataFrame([(i, j, float(m[i][j])) for i in range(2) for j in range(2)], "i long, j long, d double")
    validate.enforce(validate.matrix_violations(square([[0, 1], [1, 0]]), 2))
    for matrix, says in (([[0, 1], [2, 0]], "symmetric"), ([[0, -1], [-1, 0]], "negative"), ([[1, 0], [0, 0]], "diagonal"), ([[0, math.nan], [math.nan, 0]], "finite")):
        with pytest.raises(ValueError, match=says):
            validate.enforce(validate.matrix_violations(square(matrix), 2))
    t = screens(spark, A).withColumnRenamed("screen", "observation_id")
    grid = lambda r, c: spark.createDataFrame([(0, r, c)], "observation_id long, rows int, cols int")
    validate.enforce(validate.tile_violations(t, grid(1, 2)))
    with pytest.raises(ValueError, match="patch_grid"):
        validate.enforce(validate.tile_violations(t, grid(2, 2)))
    with pytest.raises(ValueError, match="element_logits"):
        validate.enforce(validate.tile_violations(t.withColumn("logits", F.slice("logits", 1, 1)), grid(1, 2)))
    with pytest.raises(ValueError, match="finite"):
        validate.enforce(validate.tile_violations(t.withColumn("vec", F.array(F.lit(math.inf), F.lit(1.0))), grid(1, 2)))


# --- curation -------------------------------------------------------------------------------------


def clusters(spark, *ids):
    return annotation(spark, *[(f"o{i}", c, "m") for i, c in enumerate(ids)])


def ids_of(df):
    return [r.cluster_id for r in df.orderBy("ann_idx").collect()]


def test_merge(spark):
    a = clusters(spark, "b", "a", "c")
    merged, target = curate.merge_clusters(a, ["b", "a", "b"])
    assert (ids_of(merged), target, ids_of(a)) == (["a", "a", "c"], "a", ["b", "a", "c"])
    assert ids_of(curate.merge_clusters(merged, ["a", "c"])[0]) == ["a"] * 3
    with pytest.raises(ValueError, match="at least two"):
        curate.merge_clusters(a, ["a", "a"])
    with pytest.raises(ValueError, match="Unknown clusters.*: x, y"):
        curate.merge_clusters(a, ["a", "y", "x"])


def test_rename(spark):
    a = clusters(spark, "b", "a")
    assert ids_of(curate.rename_cluster(a, "b", "  home  ")[0]) == ["home", "a"]
    for old, new, says in (("b", " \t", "cannot be empty"), ("x", "y", "Unknown"), ("b", " b ", "different"), ("b", "a", "already exists")):
        with pytest.raises(ValueError, match=says):
            curate.rename_cluster(a, old, new)


def test_outliers(spark):
    a = clusters(spark, "a", "a", "b")
    moved = ids_of(curate.assign_outliers(a, ["o0", "o1", "o2"], "singletons"))
    assert moved[0].startswith("a__outlier_") and moved[1].startswith("a__outlier_") and moved[0] != moved[1] and moved[2] == "b"
    taken = clusters(spark, "a", "a", moved[0], moved[0] + "_2")
    assert ids_of(curate.assign_outliers(taken, ["o0"], "singletons"))[0] == moved[0] + "_3"
    together = ids_of(curate.assign_outliers(a, ["o2", "o0"], "together"))
    assert together[0] == together[2] and together[0].startswith("outlier_group_") and together[1] == "a"
    again = annotation(spark, ("o0", "a", "m"), ("o1", together[0], "m"), ("o2", "b", "m"))
    assert ids_of(curate.assign_outliers(again, ["o2", "o0"], "together"))[0] == together[0] + "_2"
    assert ids_of(curate.assign_outliers(a, [], "together")) == ["a", "a", "b"]
    with pytest.raises(ValueError, match="Unknown outlier observations: x"):
        curate.assign_outliers(a, ["x"], "singletons")
    with pytest.raises(ValueError, match="strategy"):
        curate.assign_outliers(a, ["o0"], "none")


def grouped(spark, **members):
    return spark.createDataFrame([(c, m) for c, m in members.items()], "cluster_id string, observation_ids array<string>")


def order_of(df):
    return [r.cluster_id for r in df.orderBy("position").collect()]


def test_cluster_order(spark):
    g = grouped(spark, singleton_a=["o1"], group_b=["o2", "o3"], singleton_c=["o4"])
    assert order_of(curate.cluster_order(g)) == ["group_b", "singleton_a", "singleton_c"]
    renamed = grouped(spark, zz=["o1"], group_b=["o2", "o3"], aa=["o4"])
    assert order_of(curate.cluster_order(renamed, g)) == ["group_b", "zz", "aa"]
    assert order_of(curate.cluster_order(grouped(spark, B=["1"], a=["2"], ß=["3"]), sort_mode="dictionary")) == ["a", "B", "ß"]
    with pytest.raises(ValueError, match="sort mode"):
        curate.cluster_order(g, sort_mode="none")


def test_next_unreviewed(spark):
    ordered = curate.cluster_order(grouped(spark, a=["1", "2"], b=["3", "4"], c=["5", "6"]))
    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "cluster_id string")
    assert curate.next_unreviewed(ordered, some("a", "c"), "c") == "a"
    assert curate.next_unreviewed(ordered, some("b"), "b") is None
    with pytest.raises(ValueError, match="Unknown current"):
        curate.next_unreviewed(ordered, some("a"), "x")


def test_reviews(spark):
    schema = "cluster_id string, observation_ids array<string>, incorrect_observation_ids array<string>, status string"
    none = spark.createDataFrame([], schema)
    reviews = curate.save_review(curate.save_review(none, "a", ["o1", "o2", "o3"], ["o3", "o2"]), "b", ["o4"], [])
    assert reviews.where("cluster_id = 'a'").first().incorrect_observation_ids == ["o2", "o3"]
    with pytest.raises(ValueError, match="duplicate"):
        curate.save_review(none, "a", ["o1", "o1"], [])
    with pytest.raises(ValueError, match="belong"):
        curate.save_review(none, "a", ["o1"], ["o2"])
    now = grouped(spark, a=["o1"], b=["o4"])
    flags = reviews.join(now.withColumnRenamed("observation_ids", "members"), "cluster_id").select("cluster_id", curate.review_is_current("members").alias("c"), curate.review_applies("members").alias("x"))
    assert {r.cluster_id: (r.c, r.x) for r in flags.collect()} == {"a": (False, True), "b": (True, True)}
    whole = grouped(spark, a=["o1", "o2", "o3"], b=["o4"])
    assert [r.observation_id for r in curate.current_outliers([none, reviews], whole).orderBy("cluster_id", "pos").collect()] == ["o2", "o3"]
    assert curate.flagged_observations(reviews, whole).first().cluster_id == "a"
    assert tuple(curate.review_progress(now, reviews).first()) == (2, 1, 1, 0)
    ann = annotation(spark, ("o1", "a", "m"), ("o4", "b", "m"))
    _, merged, name = curate.rename_cluster_with_review(ann, now, "a", " new ", reviews, none)
    assert name == "new" and [r.cluster_id for r in merged.collect()] == ["new"]


def test_groups_history_pages(spark):
    obs = observations(spark, "xyz")
    ann = annotation(spark, ("obs_2", "B", "m"), ("obs_0", "A", "m"))
    assert [(r.cluster_id, r.observation_ids) for r in curate.cluster_groups(obs, ann).orderBy("first_idx").collect()] == [("A", ["obs_0"]), ("B", ["obs_2"])]
    with pytest.raises(ValueError, match="Missing cluster assignments for: obs_1"):
        curate.cluster_groups(obs, ann, strict=True)
    with pytest.raises(ValueError, match="no assignments"):
        curate.cluster_groups(obs, ann.limit(0))
    with pytest.raises(ValueError, match="Unknown assigned"):
        curate.cluster_groups(obs, annotation(spark, ("no", "A", "m")))
    history = curate.History(ann)
    history.edit(curate.rename_cluster(ann, "A", "C")[0])
    assert history.undo() is ann and history.undo() is ann and history.reset() is ann
    assert curate.page_count(0) == 1 and curate.page_count(25) == 2
    assert curate.default_reviews_path("out/r/annotations/x.jsonl").endswith("r/debug/x_reviews.jsonl")
    assert curate.with_source(ann, "a/b.jsonl").first().source == "b"


# --- features, tiles, images ----------------------------------------------------------------------


def test_grounding(spark):
    t = spark.createDataFrame([(0, i, [float(i)], [0.0, 0.0]) for i in range(4)], "observation_id long, tile_idx int, vec array<double>, logits array<double>")
    g = lambda r, c: spark.createDataFrame([(0, r, c, [7.0])], "observation_id long, rows int, cols int, global_embedding array<double>")
    assert features.grounding_embedding(t, g(2, 2)).first().embedding == pytest.approx([7, 1.5, np.std([0, 1, 2, 3]), 0, 1, 2, 3, 0.5, 0.5])
    assert features.grounding_embedding(t, g(1, 4)).first().embedding == pytest.approx([7, 1.5, np.std([0, 1, 2, 3]), 0.5, 2.5, 0, 0, 0.5, 0.5])
    with pytest.raises(Exception, match="do not match"):
        features.grounding_embedding(t, g(3, 2)).collect()


def test_transition_embedding(spark):
    base = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "observation_id string, embedding array<double>")
    t = spark.createDataFrame([(0, "a", "b", "touch", True), (1, "a", "a", None, None)], "trans_idx long, source_observation_id string, destination_observation_id string, event_type string, effective boolean")
    got = {r.observation_id: r.embedding for r in features.transition_embedding(base, t).collect()}
    assert got == {"a": [1, 2, 2, 3, 0.5, 0.5, 2, 0.5], "b": [3, 4, 0, 0, 0, 0, 0, 0]}
    with pytest.raises(Exception, match="No base embedding of x"):
        features.transition_embedding(base, t.withColumn("destination_observation_id", F.lit("x"))).collect()


@pytest.mark.parametrize("box, size, want", [((0, 0, 32, 32), (32, 32), {(0, 0), (0, 1), (1, 0), (1, 1)}), ((4, 4, 10, 10), (32, 32), {(0, 0)}), ((8, 0, 40, 16), (48, 16), {(0, 1)}), ((-5, -5, -1, -1), (32, 32), set()), ((30, 30, 40, 40), (40, 40), {(1, 1)})])
def test_box_tiles(spark, box, size, want):
    boxes = tiles.clamp_boxes(spark.createDataFrame([(0, [float(x) for x in box], *size)], "image long, bbox array<double>, width int, height int"))
    assert {(r.row, r.col) for r in tiles.box_tiles(boxes, 16, ["image"]).collect()} == want


def test_bad_box(spark):
    with pytest.raises(Exception, match="four numbers"):
        tiles.clamp_boxes(spark.createDataFrame([([1.0, 2.0], 3, 4)], "bbox array<double>, width int, height int")).collect()


def test_ragged(spark):
    s = spark.createDataFrame(list(enumerate([9, 11, 9, 11, 9])), "i long, n long")
    out = tiles.ragged_chunks(s, "n", "i", 2).groupBy("first_idx", "n", "chunk").count().orderBy("first_idx", "chunk").collect()
    assert [(r["count"], r.n) for r in out] == [(2, 9), (1, 9), (2, 11)]


def test_losses(spark):
    rows = [(0, 2.0, 1.0), (0, -3.0, 1.0), (1, 40.0, 0.0)]
    term = lambda x, y, p=1.0: -(p * y * math.log(1 / (1 + math.exp(-x))) + (1 - y) * (-x - math.log1p(math.exp(-x))))
    df = spark.createDataFrame(rows, "s long, x double, y double")
    want = ((term(2, 1) + term(-3, 1)) / 2 + term(40, 0)) / 2
    assert tiles.batch_loss(df, "s", "x", "y").first()[0] == pytest.approx(want)
    assert tiles.batch_loss(df, "s", "x", "y", pos_weight=3.0).first()[0] == pytest.approx(((term(2, 1, 3) + term(-3, 1, 3)) / 2 + term(40, 0)) / 2)
    assert tiles.validation_loss(spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, n long")).first()[0] == 1.25


def test_images():
    flat = np.full((3, 432, 768), 9, np.uint8)
    assert images.difference_hash(flat) == "f" * 16
    slope = np.broadcast_to(np.arange(255, -1, -1, dtype=np.uint8)[None, None], (3, 64, 256))
    assert images.difference_hash(slope) == "0" * 16
    assert images.resize_image(np.zeros((3, 20, 40), np.uint8), 0.25).shape == (3, 5, 10)
    image = np.zeros((3, 6, 8), np.uint8)
    image[:] = np.array([10, 20, 30])[:, None, None]
    import hashlib

    assert images.pixel_sha256(image) == hashlib.sha256(bytes([0, 0, 0, 3, 0, 0, 0, 6, 0, 0, 0, 8]) + bytes([10]) * 48 + bytes([20]) * 48 + bytes([30]) * 48).hexdigest()
    out = images.overlay(np.zeros((3, 5, 5)), np.array([[1, 0], [0, 0.5]]), 2, 1.0)
    assert out[:, 0, 0].tolist() == [0, 0, 1] and out[:, 0, 2].max() == 0 and out[2, 2, 2] == 0.5 and out[:, 4, 4].max() == 0
    for bad in (dict(tile=0), dict(opacity=2.0), dict(probabilities=np.zeros((9, 9)))):
        with pytest.raises(ValueError):
            images.overlay(**({"image": np.zeros((3, 5, 5)), "probabilities": np.zeros((2, 2)), "tile": 2, "opacity": 1.0} | bad))


def test_zip_and_dimensions(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "k long, a string")
    assert graph.zip_strict(a, a.withColumnRenamed("a", "b"), "k").count() == 2
    with pytest.raises(Exception, match="equally long"):
        graph.zip_strict(a, a.limit(1).withColumnRenamed("a", "b"), "k").collect()
    with pytest.raises(ValueError, match="dimensions must match"):
        distances(spark, [((1, 0), 0.9, 0.9)], [((1, 0, 0), 0.9, 0.9)])


def test_sample_targets(spark):
    schema = "image long, width int, height int, clickable_elements array<struct<bbox: array<double>>>, scrollable_elements array<struct<bbox: array<double>>>"
    screen = spark.createDataFrame([(0, 64, 64, [([0.0, 0.0, 64.0, 32.0],)], None)], schema)
    rows = tiles.sample_targets(screen, 0.5, 16, ["image"]).orderBy("tile_idx").collect()
    assert [(r.tile_idx, r.clickable, r.scrollable) for r in rows] == [(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0)]


# --- stored histories, shapes, cuts by components, hot groups -------------------------------------


def test_stored_history(spark, tmp_path):
    v = lambda *ids: clusters(spark, *ids).coalesce(1)
    history = curate.StoredHistory(spark, f"{tmp_path}/h", v("a", "b"))
    history.edit(v("c", "b"))
    history.edit(v("d", "b"))
    assert ids_of(history.undo()) == ["c", "b"]
    assert ids_of(curate.StoredHistory(spark, f"{tmp_path}/h").current) == ["c", "b"]
    assert ids_of(history.reset()) == ["a", "b"] and ids_of(history.undo()) == ["c", "b"]
    assert ids_of(history.undo()) == ["a", "b"] and ids_of(history.undo()) == ["a", "b"]
    with pytest.raises(ValueError, match="No versions"):
        curate.StoredHistory(spark, f"{tmp_path}/none")


def test_shapes_of_losses_and_scores(spark):
    cells = lambda rows, name: spark.createDataFrame(rows, f"s int, c int, {name} double")
    logits, targets = [(0, 0, 1.0), (0, 1, -1.0), (1, 0, 2.0)], [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 1.0)]
    paired = lambda l, t: tiles.paired_cells(cells(l, "logit"), cells(t, "target"), "s", "c")
    assert paired(logits, targets).count() == 3
    for l, t, says in ((logits[:2], targets, "same number of samples"), (logits, targets[:2], "same number of samples"), (logits, targets[1:], "one row per patch token"), (logits[1:], targets, "one row per patch token")):
        with pytest.raises(Exception, match=says):
            paired(l, t).collect()
    with pytest.raises(ValueError, match="same number of elements"):
        evaluate.best_f1_operating_point(spark.createDataFrame([(0.5, 1), (0.4, None)], "p double, y int"), "p", "y")


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.9])
def test_cut_by_components(spark, threshold):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 0.15, (8, 2)) for c in ((0, 0), (1, 0), (3, 3))])
    d = np.linalg.norm(points[:, None] - points[None], axis=2).astype(np.float32)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(24) for j in range(i + 1, 24)], "i long, j long, d float")
    got = linkage.cut_by_components(pairs, spark.range(24).withColumnRenamed("id", "i"), threshold)
    assert [r.label for r in got.orderBy("i").collect()] == linkage.cut_at(d, threshold)


def test_hot_groups_are_ranked_by_range(spark, monkeypatch):
    from gridloom.plans import ordering

    rows = spark.range(200).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 'a', concat('b', id))) AS k", "199 - id AS o")
    want = {(r.k, r.o): (r.p, r.n) for r in places(rows, ["k"], ["o"], "p", "n").collect()}
    monkeypatch.setattr(ordering, "HOT_GROUP", 20)
    assert {(r.k, r.o): (r.p, r.n) for r in places(rows, ["k"], ["o"], "p", "n").collect()} == want
    assert sorted(p for (k, _), (p, n) in want.items() if k == "a" and n == 67) == list(range(67))


def test_mean_vectors_of_many_places(spark):
    v = np.random.default_rng(0).normal(size=(12, 200))
    df = spark.createDataFrame([(k % 3, x.tolist()) for k, x in enumerate(v)], "k int, v array<double>")
    got = {r.k: r.m for r in features._mean_vectors(df, "k", "v", "m", 200).collect()}
    assert all(np.allclose(got[k], v[k::3].mean(0)) for k in range(3))


def test_class_overlays(spark):
    image = np.arange(3 * 4 * 6, dtype=np.uint8).reshape(3, 4, 6)
    bgr = bytearray(image[::-1].transpose(1, 2, 0).tobytes())
    logits = [[0.0, 50.0], [-50.0, 50.0], [0.0, -50.0], [50.0, 0.0], [0.0, 0.0], [1.0, 2.0]]
    df = spark.createDataFrame([((4, 6, 3, bgr), logits, 2, 3), (None, logits, 2, 3)], "image struct<height:int,width:int,nChannels:int,data:binary>, logits array<array<double>>, rows int, cols int")
    got = [r.overlays for r in images.with_class_overlays(df, 2).collect()]
    want = images.class_overlays(image, np.array(logits), (2, 3), 2)
    assert got[1] is None and [bytes(x) for x in got[0]] == [np.rint(w * 255).astype(np.uint8).transpose(1, 2, 0).tobytes() for w in want]
    assert np.allclose(want[1][:, :2, 2:4], image[:, :2, 2:4] / 255 * 0.5 + np.array([0, 0, 1])[:, None, None] * 0.5)
    with pytest.raises(ValueError, match="three colour planes"):
        images.overlay(image[:2], np.zeros((1, 1)), 2, 0.5)
    with pytest.raises(ValueError, match="lie in an image"):
        images.overlay(image, np.zeros((3, 3)), 2, 0.5)


# --- larger and odder tables ------------------------------------------------------------------------


def test_grounding_of_an_incomplete_screen(spark, tmp_path):
    """The last screen may have fewer tiles: the query gives SQL's row for it."""
    import duckdb

    import __spark_entry__ as entry
    from tests.conftest import DATA, values

    e = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id < 26 AND vec_id <> 13 OR vec_id IN (41, 57, 58)")
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["grounding_embedding"]).df()
    got = entry.queries()["grounding_embedding"](spark, str(tmp_path)).toPandas()
    assert list(got.columns) == list(want.columns) and len(got) == 5
    assert values(got, list(got.columns)) == values(want, list(got.columns))


@pytest.mark.parametrize("rounds", [50, 0])
def test_cut_vectors_is_average_linkage(rounds):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(1, 6)) + 0.4 * rng.normal(size=(40, 6)) for _ in range(5)] + [np.zeros((2, 6))])
    v = np.concatenate([v, np.repeat(v[:3], 20, 0)])
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    d = np.maximum(1 - unit @ unit.T, 0).astype(np.float32)
    np.fill_diagonal(d, 0)
    for threshold in (0.05, 0.3, 0.8, 0.95):  # from 1 on the null vectors tie
        assert linkage.cut_vectors(unit, threshold, rounds=rounds) == linkage.cut_at((d + d.T) / 2, threshold)


def test_many_vectors_make_no_distances(spark, monkeypatch):
    from gridloom.operators import similarity

    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(60)], "k long, v array<double>")
    want = linkage.cluster_embeddings(v, "k", "v", 0.4).orderBy("i").collect()
    monkeypatch.setattr(linkage, "DENSE", 10)
    monkeypatch.setattr(similarity, "cosine_distances", None)
    assert linkage.cluster_embeddings(v, "k", "v", 0.4).orderBy("i").collect() == want


def test_condensed_linkage_and_labels_made_in_tasks(spark):
    """The same merges, and the same cuts, as from the square; heights tie here."""
    rng = np.random.default_rng(9)
    d = np.triu(rng.integers(1, 30, (25, 25)) / 32, 1).astype(np.float32)
    items = list(range(100, 125))
    pairs = spark.createDataFrame([(items[i], items[j], float(d[i, j])) for i in range(25) for j in range(i + 1, 25)], "i long, j long, d float").repartition(5)
    held = linkage.condensed_distances(pairs, items)
    assert (held.square() == d + d.T).all() and (linkage.distance_matrix(pairs, items) == d + d.T).all()
    merges = linkage.condensed_linkage(held)
    assert merges == linkage.average_linkage(d + d.T)
    want, got = linkage.cuts_frames(spark, linkage.all_cuts(d + d.T), items), linkage.merges_frames(spark, merges, items)
    for a, b in zip(want, got):
        assert a.schema.simpleString() == b.schema.simpleString() and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Every vector is written to one block; blocks meet without a shuffle of pairs."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "k long, v array<double>")
    out = similarity.cosine_distances(df, "k", "v", block_rows=10)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r.i, r.j): r.d for r in out.collect()}
    assert got.keys() == {(i, j) for i in range(90) for j in range(i + 1, 90)}
    assert all(abs(d - (1 - unit[i] @ unit[j])) < 1e-6 for (i, j), d in got.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroupsIn" not in plan


def test_distances_work_out_all_pairs_once(spark):
    rng = np.random.default_rng(1)
    rows = [(k, t, rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for k in range(9) for t in range(2 + k % 2)]
    tiles_ = similarity.prepared_tiles(spark.createDataFrame(rows, "screen long, tile_idx int, vec array<double>, logits array<double>"))
    for method in similarity.SCORERS:
        scores = similarity.element_scores(tiles_, method, block_screens=2)
        out = similarity.element_distances(scores)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert sorted(out.collect()) == sorted(similarity.element_distances(scores.select("*")).collect())


def test_rows_of_distances_take_few_bytes(spark, tmp_path):
    """Rounded distances in Parquet: some two bytes each and the dictionaries, next to nothing for the keys."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2500, 64)).astype(np.float32)
    df = spark.createDataFrame([(7 * k, x.tolist()) for k, x in enumerate(v)], "k long, v array<float>").repartition(3)
    out = similarity.cosine_distances(df, "k", "v").select("i", "j", F.round(F.col("d").cast("double"), 5).alias("d"))
    out.write.parquet(str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.count() == back.select("i", "j").distinct().count() == 2500 * 2499 // 2 and back.where("i >= j").count() == 0
    assert sum(f.stat().st_size for f in (tmp_path / "o").glob("*.parquet")) < 5 * back.count()


def test_many_distances_are_in_a_file(spark, monkeypatch):
    """The same merges, with the distances in a file's pages and not in the driver's own memory."""
    import mmap

    rng = np.random.default_rng(12)
    d = np.triu(rng.integers(1, 30, (40, 40)) / 32, 1).astype(np.float32)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(40) for j in range(i + 1, 40)], "i long, j long, d float").repartition(7)
    want = linkage.condensed_linkage(linkage.condensed_distances(pairs, list(range(40))))
    monkeypatch.setattr(linkage, "HELD", 100)
    monkeypatch.setattr(linkage, "_PART", 90)
    held = linkage.condensed_distances(pairs, list(range(40)))
    base = held.d
    while isinstance(base, np.ndarray):
        base = base.base
    assert isinstance(base.obj if isinstance(base, memoryview) else base, mmap.mmap)
    assert (held.square() == d + d.T).all() and linkage.condensed_linkage(held) == want
    with pytest.raises(ValueError, match="finite"):
        linkage.condensed_distances(pairs.withColumn("d", F.when((F.col("i") == 3) & (F.col("j") == 9), F.lit(float("nan"))).otherwise(F.col("d"))), list(range(40)))


def test_distances_are_not_joined(spark):
    """All pairs of screens meet their own scores where they are made; nothing of their number is shuffled or sorted."""
    plan = similarity.element_distances(similarity.element_scores(similarity.prepared_tiles(screens(spark, A, B, C))))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Join") == 0


def test_scores_of_cuts_come_from_merges(spark):
    """The same as from a row per cut and observation: ties, no label, one label twice, observations on one view or none."""
    rng = np.random.default_rng(8)
    n = 30
    d = np.triu(rng.integers(1, 60, (n, n)) / 64, 1).astype(np.float32)
    merges, items = linkage.average_linkage(d + d.T), [3 * k for k in range(n)]
    _, labels = linkage.merges_frames(spark, merges, items)
    reference = spark.createDataFrame([(3 * k, None if k % 7 == 0 else f"c{k % 4}") for k in range(n - 2)] + [(6, "c1"), (1, "c0"), (9999, "c9")], "i long, actual string")
    views = spark.createDataFrame([("full", 3 * k) for k in range(n)] + [("deduplicated", 3 * k) for k in range(1, n, 2)] + [("full", 9999)], "view string, i long")
    want, got = evaluate.sweep_metrics(labels, reference, views), evaluate.merges_metrics(merges, items, reference, views)
    assert want.dtypes == got.dtypes
    want, got = (x.orderBy("cut_idx").collect() for x in (want, got))
    assert len(want) == len(got) > 10
    for a, b in zip(want, got):
        assert a.asDict() == pytest.approx(b.asDict(), abs=1e-9)
    with pytest.raises(Exception, match="two observations"):
        evaluate.merges_metrics(merges, items, reference, views.where("view = 'full' AND i < 5 AND i > 0 OR i = 9999")).collect()


@pytest.mark.parametrize("name", ["all_cuts", "threshold_sweep"])
def test_sweeps_make_no_row_per_cut_and_screen(spark, name):
    import __spark_entry__ as entry
    from tests.conftest import DATA

    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "PythonUDF" not in plan
