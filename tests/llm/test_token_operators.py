"""Packing, token counts, sharding, BPE, vectors, the pipeline: brute force, and nulls, empties, ties, repeats, clashing names."""

import hashlib
import itertools
import os
import zlib

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, embed_dedup, packing, queries, sharding, token_counts
from tests.conftest import DATA, values
from tests.llm.test_text_operators import components, documents

RANKS, PATTERN = queries.RANKS, queries.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


# --- 8: BPE ---------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from(["a", "the", "ing", " ", "  ", "\n", "é", "1", "!!", "=", "日本", "'s", "\t", "x" * 9, "　", "<|endoftext|>", "\x1c", "🙂"]), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=30)))
def test_encode(text):
    assert bpe.load_encoder(RANKS, PATTERN).encode(text).tolist() == packing._fast(RANKS, PATTERN).encode_ordinary(text)


@pytest.mark.parametrize("seed", range(40))
def test_prefix_table(reference, seed):
    rng = np.random.default_rng(seed)
    piece = bytes(rng.choice(list(b"abetin ghsoETz"), int(rng.integers(1, 400))).tolist())
    exact = lambda b: list(reference._core_bpe.encode_single_piece(b)) if b else []
    table = bpe.PrefixTable(bpe.load_vocabulary(RANKS), piece[: len(piece) // 3])
    table.append(piece[len(piece) // 3 :])
    end = int(rng.integers(0, len(piece) + 1))
    assert table.ids() == exact(piece) and table.ids(end) == exact(piece[:end])
    start, stop = sorted(rng.integers(0, len(piece) + 1, 2).tolist())
    new = bytes(rng.choice(list(b"thinge"), 3).tolist())
    made = table.edit(start, stop, new)
    assert table.piece == piece[:start] + new + piece[stop:] and table.ids() == exact(table.piece)
    assert made <= len(new) + len(piece) - stop


def test_edit_stops_early():
    vocabulary = bpe.load_vocabulary(RANKS)
    piece = b" the thing in there" * 200
    table = bpe.PrefixTable(vocabulary, piece)
    assert table.edit(100, 101, b"x") < 4 * vocabulary.longest
    assert table.ids() == bpe.PrefixTable(vocabulary, table.piece).ids()


def test_long_texts_are_cut_where_pieces_begin(monkeypatch, reference):
    text = "It's a test, isn't it?  Yes\n\n 42 ½ times. " * 30
    monkeypatch.setattr(bpe, "CHUNK", 17)
    assert "".join(bpe.chunks(text)) == text and len(list(bpe.chunks(text))) > 20
    assert bpe.load_encoder(RANKS, PATTERN).encode(text).tolist() == reference.encode_ordinary(text)
    assert list(bpe.chunks("x" * 100)) == ["x" * 100]


def test_memo_forgets_but_answers():
    seen = []
    memo = bpe.Memo(lambda k: seen.append(k) or -k, 3)
    assert [memo[k] for k in (1, 2, 3, 1, 4, 5, 6, 7, 1)] == [-1, -2, -3, -1, -4, -5, -6, -7, -1] and len(memo) <= 3 and len(memo.before) <= 3


def test_bpe_query(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op8_bpe(spark, DATA).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_odd_rows(spark):
    df = documents(spark, None, "", "a  b", extra=True)
    out = bpe.decode(bpe.encode(df, ["doc_id", "ids"], "text", RANKS, PATTERN), ["doc_id", "ids"], "ids", RANKS).orderBy("doc_id").collect()
    assert [(len(r.ids), bytes(r.bytes)) for r in out] == [(0, b""), (0, b""), (3, b"a  b")]
    assert bpe.encode(df.limit(0), ["doc_id"], "text", RANKS, PATTERN).count() == 0


# --- 4: packing -----------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 30))
def test_best_fill(counts, room):
    picked, total = packing.best_fill(sorted(counts.items(), reverse=True), room)
    sums = {sum(n * c for n, c in zip(counts, take)) for take in itertools.product(*[range(c + 1) for c in counts.values()])}
    assert total == max(s for s in sums if s <= room) == sum(n * c for n, c in picked.items())
    assert all(c <= counts[n] for n, c in picked.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 9), max_size=8))
def test_windows_use_everything_once(counts):
    used = dict.fromkeys(counts, 0)
    for picked, times in packing.fill_windows(counts, 16):
        assert times >= 1 and sum(n * c for n, c in picked.items()) <= 16
        for n, c in picked.items():
            used[n] += c * times
    assert used == counts


@pytest.mark.parametrize("window", [4, 10_000])
@pytest.mark.parametrize("seed", range(6))
def test_packer(monkeypatch, window, seed):
    monkeypatch.setattr(packing, "WINDOW_PIECES", window)
    rng = np.random.default_rng(seed)
    docs = {k: rng.integers(0, 999, int(rng.integers(1, 70))).astype("<u4") for k in range(60)}
    packer, rows = packing.Packer(16, 0), []
    for k, ids in docs.items():
        rows += packer.add(k, ids)
    rows += packer.flush(last=True)
    check_rows(rows, docs, 16)
    assert not packer.held


def check_rows(rows, docs, capacity):
    """Rows (key, start, ids, total, sequence, offset) hold every id once, and no sequence needs padding."""
    by_doc, by_sequence = {k: [] for k in docs}, {}
    for key, start, ids, total, sequence, offset in rows:
        assert total == len(docs[key]) and len(ids)
        by_doc[key].append((start, ids))
        by_sequence.setdefault(sequence, []).append((offset, len(ids)))
    for key, ids in docs.items():
        parts = sorted(by_doc[key], key=lambda x: x[0])
        assert [s for s, _ in parts] == list(np.cumsum([0, *(len(i) for _, i in parts)])[:-1])
        assert (np.concatenate([i for _, i in parts]) == ids).all()
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1])
        size = sum(n for _, n in parts)
        assert size == capacity or size < capacity and size & (size - 1) == 0


def test_packing_query(spark, tokenizer):
    docs = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op4_packing(spark, DATA).collect()
    check_rows([(r.doc_id, r.start, docs[r.doc_id][r.start : r.start + r.length], r.doc_tokens, r.sequence_id, r.offset) for r in rows], docs, 1024)
    assert all(zlib.crc32(docs[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)


def test_packing_added_tokens(spark):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "<|endoftext", "no token"]
    want = {k: [*whole.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    got = {k: [] for k in want}
    for r in sorted(packing.pack(documents(spark, *texts), "doc_id", "text", RANKS, PATTERN).collect(), key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == want and got[0] == [64, 220, 50256, 275, 0]


def test_packing_odd_rows(spark):
    df = documents(spark, None, "", "word " * 3000, "one", extra=True)
    df = df.union(df.where("doc_id = 3")).union(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = packing.pack(df, "doc_id", "text", RANKS, PATTERN).collect()
    assert sum(r.length for r in rows if r.doc_id in (0, 1)) == 2 and sum(r.length for r in rows if r.doc_id == 3) == 2 * 2
    assert sum(r.length for r in rows if r.doc_id == 2) == next(r.doc_tokens for r in rows if r.doc_id == 2) > 2900
    assert any(r.doc_id is None for r in rows)
    assert packing.pack(df.limit(0), "doc_id", "text", RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "text", RANKS, PATTERN, capacity=0)


# --- 6: token counts ------------------------------------------------------------------------------


def test_token_counts(spark, reference):
    lengths = np.array([len(reference.encode_ordinary(r.text)) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()])
    out = queries.op6_token_counts(spark, DATA)
    rows = {r.n_tokens: r for r in out.collect()}
    assert set(rows) == set(lengths.tolist())
    for n, r in rows.items():
        cut = np.minimum(lengths, n).sum()
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens, r.cut_docs, r.cut_tokens) == ((lengths == n).sum(), (lengths >= n).sum(), lengths[lengths >= n].sum(), cut, (lengths > n).sum(), lengths.sum() - cut)
        assert r.share_up_to == pytest.approx((lengths <= n).mean())
    limits = [0, 100, 513, 10**9]
    assert {r.limit: r.total_tokens for r in token_counts.truncated_totals(out, limits).collect()} == {k: np.minimum(lengths, k).sum() for k in limits}
    for r in token_counts.quantiles(out, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == np.sort(lengths)[int(np.ceil(r.share * len(lengths))) - 1]


def test_token_counts_odd_rows(spark):
    df = documents(spark, None, "", "a b", extra=True)
    got = token_counts.suffix_sums(token_counts.length_histogram(df, "text", RANKS, PATTERN)).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.n_docs, r.docs_at_least) for r in got] == [(0, 2, 3), (2, 1, 1)]
    assert token_counts.suffix_sums(token_counts.length_histogram(df.limit(0), "text", RANKS, PATTERN)).count() == 0


# --- 7: sharding ----------------------------------------------------------------------------------


def test_sharding_query(spark):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, DATA).toPandas()
    for r in rows.to_dict("records"):
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))
    loads = rows.groupby("shard")["size"].sum()
    assert len(rows) == len(texts) and len(loads) == 8 and loads.max() - loads.min() < 0.01 * loads.mean()
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_map_versions():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 256).tolist()
    first = sharding.SlotMap.fixed(5, 256)
    even = first.rebalanced(sizes)
    loads = np.bincount(even.shard_of, sizes)
    assert (even.version, loads.max() - loads.min() < 50) == (2, True)
    grown = even.grown(sizes)
    assert all(a == b or b == 5 for a, b in zip(even.shard_of, grown.shard_of))
    after = np.bincount(grown.shard_of, sizes)
    assert after[5] == pytest.approx(sum(sizes) / 6, rel=0.05) and after.max() < loads.max()


def test_stored_slot_map(spark, tmp_path):
    path = f"{tmp_path}/maps/corpus"
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows, _ = sharding.shard(df, 4, slots=64, path=path)
    first = sharding.SlotMap.load(spark, path)
    assert first.version >= 2 and sharding.SlotMap.load(spark, path, 1) == sharding.SlotMap.fixed(4, 64)
    edited = first.moved({s: (first.shard_of[s] + 1) % 4 for s in (3, 7)})
    edited.save(spark, path)
    again = sharding.SlotMap.load(spark, path)
    assert again == edited and [s for s in range(64) if again.shard_of[s] != first.shard_of[s]] == [3, 7]
    with pytest.raises(Exception, match="already exists"):
        edited.save(spark, path)
    later, _ = sharding.shard(df, 4, slots=64, stored=again, path=path)
    last = sharding.SlotMap.load(spark, path)
    assert last.version > again.version
    stay = {s for s in range(len(again.shard_of)) if last.shard_of[s] == again.shard_of[s]}
    assert len(stay) > 50 and {(r.virtual_slot, r.shard) for r in later.collect() if r.virtual_slot in stay} <= set(enumerate(again.shard_of))
    assert rows.count() == later.count()
    with pytest.raises(ValueError):
        again.moved({10_000: 0})
    with pytest.raises(ValueError):
        sharding.shard(df, 5, slots=64, stored=again)


def test_slots_are_split_by_rows(spark):
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).union(spark.range(200).select("id", F.repeat(F.lit("x"), 5000).alias("text")))
    rows, stored = sharding.shard(df, 4, slots=64)
    held = rows.groupBy("virtual_slot").count().toPandas()["count"]
    assert held.max() < 5200 / 16 and stored.groupBy("version").count().count() == 3
    assert sorted(r.slot for r in rows.where("shard = 0").collect()) == list(range(rows.where("shard = 0").count()))


def test_sharding_odd_rows(spark):
    df = documents(spark, None, "", "a", extra=True).union(documents(spark, *["same text"] * 1, extra=True).withColumn("doc_id", F.lit(None).cast("long")).crossJoin(spark.range(200)).drop("id"))
    rows, stored = sharding.shard(df, 3)
    out = rows.toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(out) == 203 and len(loads) == 3 and loads.max() - loads.min() <= 12  # the repeated row's slot was split
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert [r.version for r in stored.select("version").distinct().orderBy("version").collect()] == [1, 2, 3]
    assert sharding.shard(df.limit(0), 3)[0].count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, 0)


# --- 10: vectors ----------------------------------------------------------------------------------


def brute_links(rows, cosine):
    ok = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and all(np.isfinite(r[1])) and any(r[1])]
    v = np.array([np.array(r[1], np.float32).astype(float) for r in ok])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in ok])
    near = (v @ v.T >= cosine) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    ids = [r[0] for r in ok]
    return dict(zip(ids, near.sum(1).tolist())), components([(ids[a], ids[b]) for a, b in np.argwhere(near)], ids)


@pytest.mark.parametrize("block", [2048, 100])
def test_vectors(spark, block):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12))
    rows = [(i, (base[rng.integers(60) if i % 3 else 0] + rng.normal(size=12) * rng.choice([0, 0.02, 0.1, 0.2])).tolist(), int(rng.integers(2))) for i in range(600)]
    rows += [(600, [2 * x for x in rows[1][1]], rows[1][2]), (601, None, 1), (602, [], 1), (603, [0.0] * 12, 1), (604, [float("nan")] + [1.0] * 11, 1), (605, rows[0][1], None), (606, [None] * 12, 1), (607, [float("inf")] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("node", "root", "lab", "emb", "n", "src", "k")})
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, block=block).collect()}
    counts, roots = brute_links(rows, 0.98)
    assert {i: r.n_links for i, r in got.items()} == {i: counts.get(i, 0) for i in got}
    assert {i: r.component_id for i, r in got.items()} == {i: roots.get(i, i) for i in got}
    assert all(r.kept == (r.component_id == i) for i, r in got.items()) and len(got) == len(rows)


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.0, 0.0], 0), (3, [1e30, 0.0], 0), (4, [1e-30, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect())
    assert got == [(0, 4, 1, False), (1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True), (3, 4, 1, False), (4, 4, 1, False)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_like_sql(spark, duck):
    got = queries.op10_embeddings(spark, DATA).toPandas()
    want = duck.sql(queries.OP10_SQL).df()
    assert values(got, sorted(got.columns)) == values(want, sorted(want.columns))


def test_clustered_vectors_are_mostly_not_compared():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    v = np.repeat(centres, 50, axis=0) + 0.01 * rng.normal(size=(2000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ones, seen = np.ones(2000, np.int64), []
    got, _, _ = embed_dedup.links(v, None, ones, None, 0.98, seen)
    assert (got == ((v @ v.T >= 0.98).sum(1) - 1)).all() and seen[0] < 2000 * 2000 / 2 / 5
    got_a, got_b, _ = embed_dedup.links(v[:700], v[700:], ones[:700], ones[700:], 0.98, seen)
    near = v[:700] @ v[700:].T >= 0.98
    assert (got_a == near.sum(1)).all() and (got_b == near.sum(0)).all()


def test_cells_of_a_label(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 8))
    rows = [(k, (centres[k % 30] + rng.choice([0.02, 0.3]) * rng.normal(size=8)).tolist(), 0) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    counts, roots = brute_links(rows, 0.98)
    for block in (40, 150):
        got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, block=block).collect()}
        assert {i: r.n_links for i, r in got.items()} == {i: counts.get(i, 0) for i in got}
        assert {i: r.component_id for i, r in got.items()} == {i: roots.get(i, i) for i in got}


def test_cover_tree_covers():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tree = embed_dedup.CoverTree(v, 0.05)
    for k, level in enumerate(tree.levels):
        assert level["start"][0] == 0 and level["end"][-1] == 200 and (level["start"][1:] == level["end"][:-1]).all()
        for start, end, centre, radius in zip(level["start"], level["end"], level["centre"], level["radius"]):
            far = np.linalg.norm(v[tree.order[start:end]] - v[centre], axis=1).max()
            assert far <= radius + 1e-7 and (k + 1 == len(tree.levels) or radius <= 2 / 2**k + 1e-7)


# --- the pipeline ---------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    sf = DATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns, before = docs.columns, docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == columns and 0 < after.count() <= before.count()
        if name == "quality rules":
            left = [labels.get(r.doc_id) for r in after.collect()]
            assert left.count(0) <= 2 and left.count(1) >= 0.95 * sum(labels.get(r.doc_id) == 1 and len(r.text.split()) >= 10 for r in before.collect())
        before = after
    last = p.STAGES[-1][1](spark, before, sf).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in before.collect()}
    tokens = {r.doc_id: r.doc_tokens for r in last}
    whole = p.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()  # where documents are cut depends on the tasks' rows
    assert {r.doc_id: r.n for r in whole} == tokens


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    text = " ".join(f"word{i} und{i}" for i in range(60))
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 34", None, "s", 5), (4, text, "en", None, None), (4, text, "en", None, None), (5, text + " more", "en", "s", 1), (None, "other " + text[::-1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"n_words": F.lit(1), "score": F.lit("x"), "n_lines_removed": F.lit(9), "Kept": F.lit(True)})
    kept = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.where("Kept").count() == out.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        kept = stage(spark, kept, str(tmp_path)).cache()
    near = p.near_dedup(spark, docs, str(tmp_path)).collect()
    assert [r.doc_id for r in near if r.doc_id == 4] == [4] and not any(r.doc_id == 5 for r in near)
    assert p.pack(spark, docs, str(tmp_path)).where("doc_id = 4").agg(F.sum("length") / F.max("doc_tokens")).first()[0] == 2
    assert kept.count() >= 1


def test_pipeline_drops_near_copies(spark, tmp_path):
    """Copies with scattered changes, an appended passage or a cut end are gone after the SimHash stage, wherever line dedup left some of their lines; other documents are whole."""
    import corpus_pipeline as p

    rng = np.random.default_rng(9)
    rows, copies = [], []
    for k in range(12):
        lines = [[f"w{rng.integers(5000)}" for _ in range(rng.integers(12, 30))] for _ in range(12)]
        rows.append((k, "\n".join(map(" ".join, lines))))
        if k % 3 == 0:  # a word of every other line
            near = [[*x[:-1], f"new{rng.integers(5000)}"] if i % 2 else x for i, x in enumerate(lines)]
        elif k % 3 == 1:
            near = [*lines, [f"more{rng.integers(5000)}" for _ in range(20)]]
        else:
            near = lines[:-1]
        copies.append(100 + k)
        rows.append((100 + k, "\n".join(map(" ".join, near))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = p.line_dedup_stage(spark, docs, str(tmp_path))
    kept = {r.doc_id: r.text for r in p.near_dedup(spark, left, str(tmp_path)).collect()}
    assert not kept.keys() & set(copies) and {i: t for i, t in rows if i < 100} == kept
    alone = {r.doc_id for r in p.near_dedup(spark, docs, f"{tmp_path}/nothing").collect()}
    assert alone == set(range(12))
