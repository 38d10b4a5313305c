"""Files: JSONL, runs, annotations, deduplication, migrations, sinks, images, the command line."""

import hashlib
import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.operators import images, migrate
from gridloom.sources import jsonl, sinks
from gridloom.streaming import appended


def png(path, color, size=(8, 6), *, level=9, text=b""):
    """A PNG of one RGB color."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(color) * size[0] for _ in range(size[1]))
    note = chunk(b"tEXt", b"note\0" + text) if text else b""
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", *size, 8, 2, 0, 0, 0)) + note + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b""))


def lines(path, *records):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records), encoding="utf-8")
    return str(path)


@pytest.fixture
def run_dir(tmp_path):
    root = tmp_path / "run"
    (root / "screens").mkdir(parents=True)
    colors = [(10, 20, 30), (90, 80, 70), (10, 20, 30)]
    for i, c in enumerate(colors, 1):
        png(root / "screens" / f"{i}.png", c, level=i, text=b"x" * i if i > 1 else b"")
        (root / "screens" / f"{i}.json").write_text("{}")
    (root / "run.json").write_text('{"run_id": 7}')
    lines(root / "observations.jsonl", *[{"observation_id": f"obs_00000{i}", "screenshot_path": f"screens/{i}.png", "view_tree_path": f"screens/{i}.json", "activity": ".Main"} for i in (1, 2, 3)])
    lines(
        root / "transitions.jsonl",
        {"transition_id": "t1", "source_observation_id": "obs_000001", "destination_observation_id": "obs_000002", "event": {"event_type": "touch"}, "droidbot_effective": True}, "",
        {"transition_id": "t2", "source_observation_id": "obs_000002", "destination_observation_id": "obs_000003"},
    )
    return root


def test_jsonl(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", {"observation_id": "é", "cluster_id": "A", "extra": 1}, "", "  ", {"observation_id": "b"})
    rows = jsonl.read_jsonl(spark, path, jsonl.ANNOTATION).orderBy("line_no").collect()
    assert [(r.line_no, r.observation_id, r.cluster_id) for r in rows] == [(1, "é", "A"), (4, "b", None)]
    assert sorted(rows[0].fields_present) == ["cluster_id", "extra", "observation_id"]
    with pytest.raises(ValueError, match="Invalid JSON in .*:2"):
        jsonl.read_jsonl(spark, lines(tmp_path / "b.jsonl", {}, "{oops"), jsonl.ANNOTATION)
    with pytest.raises(ValueError, match="Expected an object in .*:2"):
        jsonl.read_jsonl(spark, lines(tmp_path / "c.jsonl", "", "[1]"), jsonl.ANNOTATION)


def test_run(spark, run_dir):
    run = jsonl.load_run(spark, str(run_dir))
    assert run.run_id == "7" and run.observations.count() == 3
    assert [(r.event_type, r.effective) for r in run.transitions.orderBy("trans_idx").collect()] == [("touch", True), ("unknown", False)]
    with pytest.raises(ValueError, match="escapes run directory"):
        run.artifact("../x")
    (run_dir / "screens" / "2.json").unlink()
    with pytest.raises(FileNotFoundError, match="obs_000002"):
        jsonl.load_run(spark, str(run_dir))
    jsonl.load_run(spark, str(run_dir), check=False)
    (run_dir / "transitions.jsonl").unlink()
    with pytest.raises(FileNotFoundError, match="transitions.jsonl"):
        jsonl.load_run(spark, str(run_dir))


def test_annotations(spark, run_dir, tmp_path):
    run = jsonl.load_run(spark, str(run_dir))
    path = lines(tmp_path / "a.jsonl", {"observation_id": "obs_000003", "cluster_id": "Read", "source": "m"}, {"observation_id": "obs_000001", "cluster_id": "Home", "source": "m", "note": 1})
    assert [r.cluster_id for r in jsonl.load_annotations(spark, run, path).orderBy("ann_idx").collect()] == ["Read", "Home"]
    with pytest.raises(ValueError, match="Missing cluster annotations for: obs_000002"):
        jsonl.load_annotations(spark, run, path, complete=True)
    bad = lines(tmp_path / "b.jsonl", {"observation_id": "obs_000003", "cluster_id": "Read", "source": "m", "manual_functional_state_label": ""})
    with pytest.raises(ValueError, match="Abandoned"):
        jsonl.load_annotations(spark, run, bad)


def test_records_and_assignments(spark, tmp_path):
    path = lines(tmp_path / "r.jsonl", {"cluster_id": "a", "status": "old"}, {"cluster_id": "b", "status": "x"}, {"cluster_id": "a", "status": "new"})
    assert {r.cluster_id: r.status for r in jsonl.records_by_key(spark, path, "cluster_id", jsonl.REVIEW).collect()} == {"a": "new", "b": "x"}
    assert jsonl.records_by_key(spark, str(tmp_path / "none.jsonl"), "cluster_id", jsonl.REVIEW).count() == 0
    one = lines(tmp_path / "1.jsonl", {"observation_id": "o2", "cluster_id": "A", "source": "s"}, {"observation_id": "o1", "cluster_id": "B"})
    two = lines(tmp_path / "2.jsonl", {"observation_id": "o2", "source": None}, {"observation_id": "o1", "cluster_id": "C"})
    merged = jsonl.load_assignments(spark, [one, two]).orderBy("first").collect()
    assert [(r.observation_id, r.cluster_id, r.source) for r in merged] == [("o2", "A", None), ("o1", "C", None)]
    with pytest.raises(ValueError, match="lacks observation_id"):
        jsonl.load_assignments(spark, [lines(tmp_path / "3.jsonl", {"cluster_id": "x"})])


def test_dedup_file(spark, run_dir, tmp_path):
    out = str(tmp_path / "dedup.jsonl")
    cli.main(["deduplicate", str(run_dir), out], spark)
    got = [json.loads(x) for x in open(out)]
    assert [g["observation_ids"] for g in got] == [["obs_000001", "obs_000003"], ["obs_000002"]]
    assert got[0]["pixel_sha256"] == hashlib.sha256(struct.pack(">III", 3, 6, 8) + bytes([10]) * 48 + bytes([20]) * 48 + bytes([30]) * 48).hexdigest()
    run = jsonl.load_run(spark, str(run_dir))
    assert jsonl.load_dedup_groups(spark, run, out).count() == 2
    with pytest.raises(FileExistsError):
        cli.main(["deduplicate", str(run_dir), out], spark)
    cli.main(["deduplicate", str(run_dir), out, "--overwrite"], spark)


def test_cluster_and_benchmark_commands(spark, run_dir, tmp_path, capsys):
    out = tmp_path / "out"
    cli.main(["cluster", str(run_dir), str(out), "--baseline", "activity"], spark)
    path = out / "7" / "annotations" / "activity.jsonl"
    assert [json.loads(x) for x in path.open()] == [{"observation_id": f"obs_00000{i}", "cluster_id": "activity_0000", "source": "activity"} for i in (1, 2, 3)]
    cli.main(["hash", str(run_dir), str(tmp_path / "h.jsonl")], spark)
    assert json.loads(open(tmp_path / "h.jsonl").readline()) == {"observation_id": "obs_000001", "extractor": "difference_hash_64", "feature": "f" * 16}
    cli.main(["cluster", str(run_dir), str(out), "--baseline", "perceptual", "--features", str(tmp_path / "h.jsonl")], spark)
    reference = lines(tmp_path / "ref.jsonl", *[{"observation_id": f"obs_00000{i}", "cluster_id": c, "source": "m"} for i, c in ((1, "A"), (2, "B"), (3, "A"))])
    capsys.readouterr()
    cli.main(["benchmark", str(run_dir), str(path), reference], spark)
    scores = json.loads(capsys.readouterr().out)
    assert scores["observations"] == 3 and scores["recall"] == 1.0 and scores["tp"] == 1


def test_image_listing(spark, run_dir, tmp_path):
    assert [os.path.basename(r.path) for r in jsonl.list_images(spark, str(run_dir)).collect()] == ["1.png", "2.png", "3.png"]
    with pytest.raises(NotADirectoryError):
        jsonl.list_images(spark, str(tmp_path / "no"))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.txt").write_text("x")
    with pytest.raises(ValueError, match="No supported images"):
        jsonl.list_images(spark, str(tmp_path / "empty"))
    rows = images.with_pixel_digest(jsonl.read_images(spark, str(run_dir / "screens" / "*.png"))).orderBy("path").collect()
    assert rows[0].pixel_sha256 == rows[2].pixel_sha256 != rows[1].pixel_sha256


def test_pairing(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert jsonl.pair_by_stem(paths("a/x.png"), paths("b/x.json")).first().annotation == "b/x.json"
    with pytest.raises(Exception, match="without annotation"):
        jsonl.pair_by_stem(paths("a/x.png"), paths("b/y.json")).collect()
    got = jsonl.pair_processed(paths("f_10.pt", "f_2.pt", "f_3.pt"), paths("t_2.pt", "t_10.pt")).orderBy("id").collect()
    assert [(r.id, r.feature) for r in got] == [("10", "f_10.pt"), ("2", "f_2.pt")]


def test_features(spark):
    obs = spark.createDataFrame([("a",), ("b",)], "observation_id string")
    feats = spark.createDataFrame([("a", "a"), ("b", "c")], "observation_id string, payload_id string")
    assert jsonl.load_features(feats.where("payload_id = 'a'"), obs, obs.where("observation_id = 'a'")).count() == 1
    for f, w, says in ((feats, spark.createDataFrame([("x",)], "observation_id string"), "Unknown"), (feats.limit(0), obs, "Missing"), (feats, obs, "another observation")):
        with pytest.raises((ValueError, FileNotFoundError), match=says):
            jsonl.load_features(f, obs, w)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "ä", "s")], "n long, observation_id string, source string")
    path = sinks.write_jsonl(df, str(tmp_path / "x" / "o.jsonl"), ["n"], columns=["observation_id", "source"])
    assert open(path, encoding="utf-8").read() == '{"observation_id": "ä", "source": "s"}\n{"observation_id": "b", "source": null}\n'
    with pytest.raises(FileExistsError):
        sinks.write_jsonl(df, path, ["n"], overwrite=False)
    with pytest.raises(Exception):
        sinks.write_jsonl(df.withColumn("source", F.raise_error(F.lit("no")).cast("string")), path, ["n"], columns=["source"])
    assert "ä" in open(path, encoding="utf-8").read() and os.listdir(tmp_path / "x") == ["o.jsonl"]
    assert open(sinks.write_csv(df, str(tmp_path / "t.csv"), ["n"])).read() == "n,observation_id,source\n1,ä,s\n2,b,\n"
    with pytest.raises(ValueError, match="no rows"):
        sinks.write_csv(df.limit(0), str(tmp_path / "e.csv"), ["n"])
    labels = spark.createDataFrame([(1, "o1", 3)], "obs_idx long, observation_id string, label int")
    with pytest.raises(ValueError, match="one label per"):
        sinks.write_assignments(labels, labels.limit(0), str(tmp_path / "l.jsonl"), "dino")
    sinks.write_assignments(labels, labels, str(tmp_path / "l.jsonl"), "dino")
    assert json.loads((tmp_path / "l.jsonl").read_text())["cluster_id"] == "dino_0003"
    with pytest.raises(ValueError, match="cluster_id"):
        sinks.write_cluster_assignments(spark.createDataFrame([(0, "o", "", "s")], "ann_idx long, observation_id string, cluster_id string, source string"), str(tmp_path / "c.jsonl"))


def test_resumable(spark):
    todo = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    work = lambda df: df.withColumn("error", F.when(F.col("k") == "b", "bad"))
    done, failed = sinks.resumable(todo, todo.where("k = 'a'"), "k", work)
    assert [r.k for r in done.collect()] == ["c"] and [(r.k, r.error) for r in failed.collect()] == [("b", "bad")]


def test_migration(spark, tmp_path):
    obs = spark.createDataFrame([(1, "o1"), (2, "o2")], "obs_idx long, observation_id string")
    old = [{"observation_id": "o2", "auto_cluster_id": "B", "baseline": "old"}, {"observation_id": "o1", "auto_cluster_id": "A", "baseline": "old"}]
    path = lines(tmp_path / "legacy.jsonl", *old)
    before = open(path).read()
    backup = migrate.migrate_in_place(spark, obs, path)
    assert backup.endswith("legacy.legacy.jsonl") and open(backup).read() == before
    assert [json.loads(x) for x in open(path)] == [{"observation_id": o, "cluster_id": c, "source": "old"} for o, c in (("o2", "B"), ("o1", "A"))]
    with pytest.raises(FileExistsError):
        migrate.migrate_in_place(spark, obs, path)
    mixed = lines(tmp_path / "mixed.jsonl", old[0], old[1] | {"baseline": "new"})
    with pytest.raises(ValueError, match="Cannot infer source"):
        migrate.convert_file(spark, obs, mixed, str(tmp_path / "o.jsonl"))
    migrate.convert_file(spark, obs, mixed, str(tmp_path / "o.jsonl"), "manual")
    with pytest.raises(ValueError, match="exactly"):
        migrate.convert_file(spark, obs, lines(tmp_path / "more.jsonl", old[0] | {"x": 1}), str(tmp_path / "p.jsonl"))
    with pytest.raises(ValueError, match="Missing cluster annotations"):
        migrate.migrate_all(spark, obs, {mixed: str(tmp_path / "q.jsonl"), lines(tmp_path / "part.jsonl", old[0]): str(tmp_path / "r.jsonl")}, None, "manual")
    assert not (tmp_path / "q.jsonl").exists()


def test_reviews(spark, tmp_path):
    review = lambda c, s: {"cluster_id": c, "observation_ids": ["o"], "incorrect_observation_ids": [], "status": s}
    one, two = lines(tmp_path / "1.jsonl", review("b", "x"), review("a", "x")), lines(tmp_path / "2.jsonl", review("b", "confirmed"))
    out = migrate.combine_review_files(spark, [one, str(tmp_path / "none.jsonl"), two], str(tmp_path / "o.jsonl"))
    assert [(r["cluster_id"], r["status"]) for r in map(json.loads, open(out))] == [("b", "confirmed"), ("a", "x")]
    with pytest.raises(FileExistsError):
        migrate.combine_review_files(spark, [one], out)


def test_sweep_artifacts(spark, tmp_path):
    from gridloom.plans import sweep as s

    vectors = [(1.0, 0.0), (0.99, 0.01), (-1.0, 0.0)]
    tiles = spark.createDataFrame([(i, 0, list(v), [2.0, 2.0]) for i, v in enumerate(vectors)], "screen long, tile_idx int, vec array<double>, logits array<double>")
    reference = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "i long, actual string")
    names = spark.createDataFrame([(i, i, f"obs_{i}") for i in range(3)], "i long, obs_idx long, observation_id string")
    rows, labels, matrix = s.sweep(tiles, reference)
    record = s.write_artifacts(rows.cache(), labels, matrix, names, str(tmp_path / "o"), 0.01, {"match_method": "hungarian"})
    assert record["best_full"]["full_f1"] == 1 and matrix.shape == (3, 3)
    assert sorted(os.listdir(tmp_path / "o")) == ["assignments.jsonl", "distances.npy", "summary.json", "sweep.csv", "sweep.svg"]
    assert [json.loads(x)["cluster_id"] for x in open(tmp_path / "o" / "assignments.jsonl")] == ["element_matching_0000", "element_matching_0000", "element_matching_0001"]
    assert open(tmp_path / "o" / "sweep.svg").read().count("<polyline") == 3


def test_appended_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "a.jsonl", {"observation_id": "o1", "cluster_id": "A", "source": "s"}, {"observation_id": "o2", "cluster_id": "B", "source": "s"})
    query = appended.latest_assignments(appended.read_appended(spark, str(tmp_path / "in"), jsonl.ANNOTATION), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    lines(tmp_path / "in" / "b.jsonl", {"observation_id": "o1", "cluster_id": "C", "source": "s"})
    query.processAllAvailable()
    query.stop()
    assert {r.observation_id: r.cluster_id for r in appended.read_latest(spark, str(tmp_path / "out")).collect()} == {"o1": "C", "o2": "B"}


def test_lines_of_split_files(spark, tmp_path):
    """Line numbers are those in the file however many tasks read it, after every kind of line end."""
    texts = {"a.jsonl": "".join(f'{{"k": {i}}}' + ("\r\n" if i % 5 == 0 else "\n") + ("\n" if i % 7 == 0 else "") for i in range(400)), "b.jsonl": '{"k": 1}\n\n{"k": 2}'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        read = jsonl.read_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() >= 1
        got = sorted((r.path.rsplit("/")[-1], r.line_no, r.line) for r in read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = sorted((name, k, line) for name, text in texts.items() for k, line in enumerate(text.replace("\r\n", "\n").split("\n"), 1) if line.strip())
    assert got == want


def test_resume(spark, run_dir, tmp_path):
    run = jsonl.load_run(spark, str(run_dir))
    record = lambda c: [{"observation_id": f"obs_00000{i}", "cluster_id": c, "source": "m"} for i in (1, 2, 3)]
    original, output = lines(tmp_path / "a.jsonl", *record("A")), str(tmp_path / "out.jsonl")
    assert {r.cluster_id for r in jsonl.resume_annotations(spark, run, original, output).collect()} == {"A"}
    lines(tmp_path / "out.jsonl", *record("B"))
    assert {r.cluster_id for r in jsonl.resume_annotations(spark, run, original, output).collect()} == {"B"}
    lines(tmp_path / "out.jsonl", *record("B")[:2])
    with pytest.raises(ValueError, match="Missing cluster annotations"):
        jsonl.resume_annotations(spark, run, original, output)


def test_plot_goes_below_zero(spark, tmp_path):
    rows = spark.createDataFrame([(0.0, 0.5, -0.25, 0.0), (2.0, 1.0, 0.5, 1.0)], "distance_threshold double, full_f1 double, full_ari double, full_nmi double")
    svg = open(sinks.write_metric_plot(rows, str(tmp_path / "p.svg"))).read()
    assert "Distance threshold" in svg and "Score" in svg and ">2</text>" in svg and ">-0.2</text>" in svg and ">1.0</text>" in svg
    heights = [float(p.split(",")[1]) for line in svg.split("\n") if "<polyline" in line for p in line.split('points="')[1].split('"')[0].split()]
    assert min(heights) == 60 and max(heights) == 480 and os.listdir(tmp_path) == ["p.svg"]
    with pytest.raises(ValueError, match="no rows"):
        sinks.write_metric_plot(rows.limit(0), str(tmp_path / "q.svg"))


def test_resumable_parts(spark, tmp_path):
    seen = []

    def work(rows):
        seen.append(1)
        return rows.withColumn("y", F.col("id") * 2)

    run = lambda f: {(r.id, r.y) for r in sinks.resumable_parts(spark.range(50), f"{tmp_path}/o", "id", 4, f).collect()}
    want = {(i, 2 * i) for i in range(50)}
    assert run(work) == want and len(seen) == 4
    os.unlink(tmp_path / "o" / "part=00002" / "_SUCCESS")
    assert run(work) == want and len(seen) == 5
    with pytest.raises(ValueError):
        sinks.resumable_parts(spark.range(1), str(tmp_path), "id", 0, work)
