"""SimHash, lines, HTML, quality, language: brute force, and nulls, empties, ties, repeats, clashing names."""

import collections
import html
import re

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridloom.llm import html_extract, langid, line_dedup, quality, queries, simhash
from tests.conftest import DATA

DOCS = "doc_id long, text string"


def documents(spark, *texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    clash = ("root", "src", "component_id", "h", "at", "doc", "removed", "word", "n_words", "score", "kept", "ids", "slot", "shard", "node", "size", "block", "lang_pred")
    return df.withColumns({c: F.lit("x") for c in clash}) if extra else df


def components(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


# --- 1: SimHash -----------------------------------------------------------------------------------


def slow_fingerprint(text, n):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(st.sampled_from("aB é\t\n ."), max_size=60)), st.integers(1, 5))
def test_fingerprint(text, n):
    assert simhash.fingerprint(text, n) == slow_fingerprint(text, n)


@pytest.mark.parametrize("bands, bits", [(simhash.CODES_3, 3), (simhash.CODES_8, 8)])
def test_anchors_cover(bands, bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**64, 300, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, bits, replace=False):
            y[k] ^= np.uint64(1 << int(b))
    row_x, at_x, home = simhash.anchors(x, bands, bits)
    row_y, at_y, _ = simhash.anchors(y, bands, bits)
    assert (np.bincount(row_x[home]) == len(bands)).all()
    homes, replicas = set(zip(row_x[home], at_x[home])), set(zip(row_y, at_y))
    assert {r for r, _ in homes & replicas} == set(range(300))


def test_simhash_components(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_simhash(spark, DATA).collect()}
    prints = {r.doc_id: slow_fingerprint(r.text, 3) for r in docs.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == components(links, ids)


def test_simhash_odd_rows(spark):
    docs = documents(spark, None, "", " \n", "a b c d", "a b c d", "A b c D", "other words entirely here", extra=True)
    docs = docs.union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).union(docs.where("doc_id = 3"))
    rows = simhash.near_duplicates(docs, words=3).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5, None)} == {3}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_hot_anchor(spark, monkeypatch):
    rng = np.random.default_rng(5)
    prints = [0x0123456789ABCDEF]
    for _ in range(400):
        prints.append(prints[rng.integers(len(prints))] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    prints += rng.integers(0, 2**63, 100).tolist()
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in set(prints)], "f long")
    ids = [r.f for r in nodes.collect()]
    u = {i: int(np.int64(i).astype(np.uint64)) for i in ids}
    want = components([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (u[a] ^ u[b]).bit_count() <= 3], ids)
    monkeypatch.setattr(simhash, "HOT_ROWS", 16)
    got = [(r.src, r.dst) for r in simhash.links(nodes, "f", ["f"], "f", simhash.CODES_3, 3, 3).collect()]
    assert components(got, ids) == want


def test_similar_documents(spark):
    base = [f"w{i * i % 97}x{i}" for i in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    docs = documents(spark, " ".join(base), " ".join(near), " ".join(base), " ".join(reversed(base)), None)
    assert [r.component_id for r in simhash.similar_documents(docs).orderBy("doc_id").collect()] == [0, 0, 0, 3, 4]


def test_similar_documents_with_appended_and_cut_passages(spark):
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(3000)}"
    texts = []
    for k in range(40):
        base = [word() for _ in range(200 + 20 * k)]
        more = [word() for _ in range(len(base) * (8 + k % 10) // 100)]
        texts += [" ".join(base + more), " ".join(base)]
    prints = [simhash.fingerprints(t, simhash._STAGE) for t in texts]
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(prints[a][1:], prints[b][1:]))
    want = components([(a, a + 1) for a in range(0, 80, 2) if apart(a, a + 1) <= simhash.SIMILAR_BITS], range(80))
    assert sum((prints[a][0] ^ prints[a + 1][0]).bit_count() > 8 and want[a + 1] == a for a in range(0, 80, 2)) > 5
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(documents(spark, *texts)).collect()} == want


# --- 2: lines -------------------------------------------------------------------------------------


def line_words(line):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if w]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def slow_dedup(texts):
    """texts: {id: text}; the same by comparing all lines, by edit similarity alone."""
    places = [(d, p, line_words(line)) for d, t in sorted(texts.items()) for p, line in enumerate(t.split("\n"))]
    forms = {}
    for d, p, words in places:
        if words:
            forms.setdefault(tuple(words), (d, p))
    items = list(forms)
    links = [(forms[items[i]], forms[items[j]]) for i, j in similar_by_edits(items)]
    root = components(links, list(forms.values()))
    kept = {at for at, r in root.items() if at == r}
    return {d: "\n".join(line for p, line in enumerate(t.split("\n")) if not line_words(line) or (d, p) in kept) for d, t in texts.items()}


def test_lines_like_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r.text for r in queries.op2_lines(spark, DATA).collect()}
    assert got == slow_dedup({r.doc_id: r.text for r in docs.collect()})


def test_near_lines(spark):
    words = [f"word{i}" for i in range(400)]
    texts = {0: " ".join(words), 1: " ".join(words[:7] + ["other"] + words[8:]), 2: "A, b!\na B\n--\n--", 3: "a b c", 4: " ".join(words[::-1])}
    rng = np.random.default_rng(1)
    for k in range(5, 40):  # a dense group of near copies
        texts[k] = " ".join(w if rng.random() > 0.01 else f"x{rng.integers(1000)}" for w in words)
    df = spark.createDataFrame(sorted(texts.items()), DOCS)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == slow_dedup(texts)
    assert got[1] == "" and got[2] == "A, b!\n--\n--" and got[4] == texts[4]


def similar_by_edits(forms, similarity=0.8):
    """Pairs of indices of word lists whose edit similarity is at least that; an edit takes one word at most from what two bags share."""
    bags, out = [collections.Counter(f) for f in forms], set()
    for j, b in enumerate(forms):
        for i, a in enumerate(forms[:j]):
            longer = max(len(a), len(b))
            most = int(longer * (1 - similarity) + 1e-9)
            if abs(len(a) - len(b)) <= most and (bags[i] & bags[j]).total() >= longer - most and edits(a, b) <= most:
                out.add((i, j))
    return out


def test_lines_by_edit_similarity_alone(spark):
    rng = np.random.default_rng(3)
    lines = []
    for n in [*range(1, 27), 30, 50, 100]:
        for share in (0, 5, 10, 20):
            base = [f"w{n}x{i}x{share}" for i in range(n)]
            lines.append(base)
            near, many = list(base), n * share // 100 or 1
            for k in range(many):  # evenly spread, the hardest case: no long run stays
                at = (2 * k + 1) * len(near) // (2 * many)
                near[at : at + 1] = [[], [f"new{n}x{k}x{share}"], [near[at], f"add{n}x{k}x{share}"]][rng.integers(3)]
            lines.append(near)
    lines = [x for x in lines if x]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], DOCS)
    root = components(similar_by_edits(lines), range(len(lines)))
    got = {r.doc_id for r in line_dedup.dedup_lines(df).where("text <> ''").collect()}
    assert got == {k for k, r in root.items() if k == r}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, similarity=0.7)


def test_lines_odd_rows(spark):
    docs = documents(spark, None, "", "x y\n\nx y", "x Y", extra=True)
    docs = docs.union(docs.where("doc_id = 2")).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines_kept", "n_lines_removed"]
    rows = sorted(((r.doc_id is None, r.doc_id or 0), r.text, r.n_lines_kept, r.n_lines_removed, r.root) for r in out.fillna("null", ["text"]).collect())
    assert [r[1:] for r in rows] == [("null", 0, 0, "x"), ("", 1, 0, "x"), ("", 1, 2, "x"), ("", 1, 2, "x"), ("", 0, 1, "x"), ("x Y", 1, 0, "x")]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_stay_native(spark):
    plans = []
    for step in (line_dedup.distinct_lines(documents(spark, "a").withColumn("__row", F.lit(1)), "doc_id", "text"), line_dedup.dedup_lines(documents(spark, "a b\nA b"))):
        plans.append(step._jdf.queryExecution().toString())
    assert not re.search("Python|Pandas|Arrow", "".join(plans))


@pytest.mark.parametrize("n", [5, 10, 20, 50])
def test_lines_recall(spark, n):
    """Of lines edited to a similarity of 0.8, evenly and at random places, at least 0.97 go."""
    rng = np.random.default_rng(n)
    lines = []
    for k in range(200):
        base = [f"{k}w{i}" for i in range(n)]
        near, many = list(base), n // 5
        for i, at in enumerate([(2 * m + 1) * n // (2 * many) for m in range(many)] if k % 2 else rng.choice(n, many, replace=False)):
            near[at] = f"{k}new{i}"
        lines += [base, near]
    kept = {r.doc_id for r in line_dedup.dedup_lines(documents(spark, *map(" ".join, lines))).where("text <> ''").collect()}
    assert kept >= set(range(0, 400, 2)) and len(kept) <= 206


def test_lines_with_the_same_and_null_ids(spark):
    rows = [(None, "uniq one\nalpha beta"), (None, "alpha beta\n===="), (1, "alpha beta\n---"), (2, "alpha beta"), (2, "alpha beta\nown line"), (2, "alpha beta")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in got) == [(0, "===="), (0, "uniq one\nalpha beta"), (1, "---"), (2, ""), (2, ""), (2, "own line")]


def test_permuted_lines_make_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(8)]
    lines = list({tuple(rng.permutation(words)) for _ in range(700)})
    pairs, cut = {}, line_dedup.cut

    def counted(df, label):
        made = cut(df, label)
        pairs[label] = pairs.get(label, 0) + made.count() * (label == "line-pairs")
        return made

    monkeypatch.setattr(line_dedup, "cut", counted)
    got = {r.doc_id for r in line_dedup.dedup_lines(documents(spark, *map(" ".join, lines))).where("text <> ''").collect()}
    root = components(similar_by_edits(lines), range(len(lines)))
    assert got == {k for k, r in root.items() if k == r} and 0 < pairs["line-pairs"] < 20 * len(lines)


def test_hot_blocks_are_dealt_to_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(6)
    head = [f"h{i}" for i in range(4)]
    lines = [head + [f"w{rng.integers(6)}" for _ in range(5)] for _ in range(150)]
    lines = [list(x) for x in {tuple(x) for x in lines}]
    root = components(similar_by_edits(lines), range(len(lines)))
    monkeypatch.setattr(line_dedup, "HOT", 16)
    got = {r.doc_id for r in line_dedup.dedup_lines(documents(spark, *map(" ".join, lines))).where("text <> ''").collect()}
    assert got == {k for k, r in root.items() if k == r}


def test_cells_are_worked_off_in_rounds(spark, monkeypatch):
    """Lines of 7 to 19 words with one passage in common: dealt by length, compared in rounds, none lost."""
    rng = np.random.default_rng(8)
    head = [f"h{i}" for i in range(4)]
    lines = [head + [f"w{rng.integers(3)}" for _ in range(rng.integers(3, 16))] for _ in range(160)]
    lines += [[*x[:-1], "edited"] for x in lines[:40]]
    lines = [list(x) for x in {tuple(x): 0 for x in lines}]
    rounds, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, label: rounds.append(label) or cut(df, label))
    for name, value in (("HOT", 16), ("STEPPED", 8), ("ROUND", 60)):
        monkeypatch.setattr(line_dedup, name, value)
    got = {r.doc_id for r in line_dedup.dedup_lines(documents(spark, *map(" ".join, lines))).where("text <> ''").collect()}
    root = components(similar_by_edits(lines), range(len(lines)))
    assert got == {k for k, r in root.items() if k == r} and rounds.count("line-near") > 5


def test_lines_without_a_partner_are_not_met(spark, monkeypatch):
    """Of 80 lines with one passage in common, only two that are alike beyond it bring their words to cells, and each once."""
    rng = np.random.default_rng(9)
    head = [f"h{i}" for i in range(4)]
    lines = [[f"u{k}x{i}" for i in range(8)] + head + [f"v{k}x{rng.integers(99)}{i}" for i in range(8)] for k in range(80)]
    lines[70] = [*lines[7][:19], "edited"]
    met, cut = [], line_dedup.cut

    def counted(df, label):
        made = cut(df, label)
        met.append(made.count()) if label == "line-meeting" else None
        return made

    monkeypatch.setattr(line_dedup, "cut", counted)
    monkeypatch.setattr(line_dedup, "_neighbours", lambda blocks, similarity: blocks.select(F.col("k1").alias("a"), F.col("k1").alias("b")).limit(0))
    monkeypatch.setattr(line_dedup, "SMALL", 1)
    got = {r.doc_id for r in line_dedup.dedup_lines(documents(spark, *map(" ".join, lines))).where("text <> ''").collect()}
    assert got == set(range(80)) - {70} and met == [2]


def test_bags_lose_no_similar_pair(spark):
    """Whatever is within ``most`` edits passes the bags; lines of the same few words in other numbers don't."""
    rng = np.random.default_rng(10)
    lines = [[f"w{x}" for x in rng.choice(5, 60, p=p)] for p in rng.dirichlet(np.ones(5), 20)]
    lines += [[*x[:k], *x[k + 3 :], "new"] for k, x in enumerate(lines)] + [[x if rng.random() > 0.18 else f"e{rng.integers(9)}" for x in y] for y in lines]
    bags = [collections.Counter(xxhash.xxh64_intdigest(w) % 16 for w in x) for x in lines]
    rows = [(a, b, max(len(lines[a]), len(lines[b])) // 5) for a in range(len(lines)) for b in range(a)]
    side = lambda k: (len(lines[k]), *(bags[k][i] for i in range(16)))
    names = [f"{c}_{x}" for c in "ab" for x in ("n", *line_dedup._BAGS)]
    df = spark.createDataFrame([(a, b, m, *side(a), *side(b)) for a, b, m in rows], ["a", "b", "most", *names])
    passed = {(r.a, r.b) for r in df.where(line_dedup._bags_allow("a_", "b_", F.col("most"))).select("a", "b").collect()}
    alike = {(a, b) for a, b, m in rows if edits(lines[a], lines[b]) <= m}
    assert alike and alike <= passed and len(passed) < len(rows) / 2


def test_words_of_one_letter_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_LETTERS", 40)
    lines = [[f"w{i}" for i in range(k, k + 14)] for k in (0, 3)] + [["w0", "x1", *(f"w{i}" for i in range(2, 14))]]
    got = {r.doc_id for r in line_dedup.dedup_lines(documents(spark, *map(" ".join, lines))).where("text <> ''").collect()}
    assert got == {0, 1}


def test_lines_read_words_once(spark, monkeypatch):
    """Texts are read again for words once, also where lines of a large block have a partner without being neighbours."""
    rng = np.random.default_rng(11)
    head = [f"c{k}" for k in range(3)]
    lines = [[f"u{k}x{i}" for i in range(8)] + head + [f"v{k}x{rng.integers(99)}{i}" for i in range(8)] for k in range(80)]
    lines[70] = [*lines[7][:17], "edited", "too"]
    read, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df, label: read.append(label) or cut(df, label))
    monkeypatch.setattr(line_dedup, "_neighbours", lambda blocks, similarity: blocks.select(F.col("k1").alias("a"), F.col("k1").alias("b")).limit(0))
    monkeypatch.setattr(line_dedup, "SMALL", 1)
    got = {r.doc_id for r in line_dedup.dedup_lines(documents(spark, *map(" ".join, lines))).where("text <> ''").collect()}
    assert got == set(range(80)) - {70} and read.count("line-words") == 1


@pytest.mark.parametrize("fresh", [0, 1, 1000])
def test_lines_whose_words_share_characters(spark, monkeypatch, fresh):
    """Pairs with such words are told apart by other characters, however few there are."""
    monkeypatch.setattr(line_dedup, "_LETTERS", 30)
    monkeypatch.setattr(line_dedup, "_FRESH", fresh)
    rng = np.random.default_rng(12)
    lines = [[f"w{x}" for x in rng.permutation(12)] for _ in range(3)]
    lines += [[f"e{k}{i}" if rng.random() < 0.25 else w for i, w in enumerate(lines[k % 3])] for k in range(90)]
    lines = [list(x) for x in {tuple(x): 0 for x in lines}]
    got = {r.doc_id for r in line_dedup.dedup_lines(documents(spark, *map(" ".join, lines))).where("text <> ''").collect()}
    root = components(similar_by_edits(lines), range(len(lines)))
    assert got == {k for k, r in root.items() if k == r}


# --- 3: HTML --------------------------------------------------------------------------------------


def test_article_text(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = queries.op3_html(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


LONG = "Some long paragraph of running text, which goes on and on until it is clearly the content of a page."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<nav><a>Home</a></nav><footer>x</footer>", ""), ("<p>a &lt; b&nbsp;c &amp d", "a < b c & d"),
    (f"<body><header><h1>Site</h1></header><div id=c><h1>T</h1><p>{LONG}<p>Short.<ul><li>one<li>two</ul></div><aside>{LONG}</aside><div class='cookie-notice'>{LONG}</div></body>", f"T\n\n{LONG}\n\nShort.\n\none\n\ntwo"),
    (f"<article><p>{LONG}</p><section class=comments><p>{LONG}</p></section><form><label>{LONG}</label></form><script>if (a < b) x('</p>')</script></article><article class='comment'>{LONG}</article>", LONG),
    (f"<main><p>{LONG}</p><p>x</p></main><div class='side-bar'><p>{LONG}</p></div><div hidden>{LONG}</div>", f"{LONG}\n\nx"),
    (f"<article><p><b>{LONG}<br><p>next</p></b></article><div class=ad>{LONG}</div>", f"{LONG}\n\nnext"),
])
def test_pages(page, want):
    assert html_extract.main_text(page)[0] == want


OTHER = "Another paragraph, which is about as long as the first one and is a part of the same article on the page."


@pytest.mark.parametrize("tag, attribute", [
    ("div", "post no-comments"), ("div", "content has-sidebar"), ("div", "entry share-enabled"), ("div", "two-side layout"), ("article", "post comments-open"), ("body", "single-post comments-open"), ("div", "right-sidebar"), ("form", "page"),
])
def test_names_of_states_keep_the_page(tag, attribute):
    page = f"<{tag} class='{attribute}'><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul><h1>Title</h1><p>{LONG}</p><p>So.</p><p>{OTHER}</p><p>Short end.</p><div>Copyright 2020 Example <a href=/b>About</a></div></{tag}>"
    text = html_extract.main_text(page)[0]
    if tag != "article":
        assert text == f"Title\n\n{LONG}\n\nSo.\n\n{OTHER}\n\nShort end."
    assert LONG in text and OTHER in text


@pytest.mark.parametrize("name, kind", [
    ("comments", "sure"), ("post-comments", "sure"), ("commentList", "sure"), ("ad-slot-1", "sure"), ("cookie_banner", "sure"), ("leftSidebar", "likely"), ("side-bar", "likely"), ("related-posts", "likely"), ("site-header", "likely"),
    ("no-comments", ""), ("has-sidebar", ""), ("entry-header", ""), ("post comments-open", ""), ("article", ""), ("adventure", ""), ("shared", ""),
])
def test_name_mark(name, kind):
    assert html_extract.name_mark(name) == kind


def test_marked_blocks_go_however_long():
    page = f"<div><p>{LONG}</p><p>{OTHER}</p></div><div id=comments>{'<p>' + LONG + '</p>'}{5 * f'<p>{LONG}</p>'}</div><div class=ads><p>{LONG}</p></div>"
    assert html_extract.main_text(page)[0] == f"{LONG}\n\n{OTHER}"
    assert html_extract.main_text(f"<p>{LONG} <span class=ad>Buy</span>end</p><p>{OTHER}</p>")[0] == f"{LONG} end\n\n{OTHER}"


def test_html_in_parts(monkeypatch):
    page = f"<article><p>{LONG} &eacute;&amp; <b>bold</b></p><p>{LONG}</p></article>"
    want = html_extract.main_text(page)
    for part in (1, 2, 7):
        monkeypatch.setattr(html_extract, "_PART", part)
        assert html_extract.main_text(page) == want


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "<p>a"), (1, "<p>a")], "page_id long, html string").withColumn("n_lines_x", F.lit(1))
    assert sorted((r.page_id or 0, r.text) for r in html_extract.extract(df, ["page_id"]).collect()) == [(0, "a"), (1, ""), (1, "a")]
    assert html_extract.extract(df.limit(0), ["page_id"]).count() == 0


# --- 5: quality -----------------------------------------------------------------------------------


def slow_counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.none(), st.text(st.sampled_from("abé#\t\n  |\x1c"), max_size=120)))
def test_counts(text):
    assert quality.text_counts(text.encode() if text is not None else None)[:5] == slow_counts(text)


def test_repeats_with_a_large_vocabulary():
    words = [b"w%d" % i for i in range(9000)] + [b"w%d" % i for i in range(100, 107)]
    assert quality.repeated_words(words) == 14


def test_quality_held_out(spark):
    sf = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.quality(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").toPandas()
    assert len(out) > 100 and (out["kept"] == (out["quality"] == 1)).mean() > 0.97


def test_forest_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600) > 0.6) ^ (rng.random(600) < 0.1)).astype(float)
    forest = quality.fit_forest(x, y, [1, 0, -1])
    grid = np.repeat(rng.random((50, 1, 3)), 30, axis=1)
    for column, sign in ((0, 1), (2, -1)):
        line = grid.copy()
        line[:, :, column] = np.linspace(0, 1, 30)
        s = forest.scores(line.reshape(-1, 3)).reshape(50, 30)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.85


def test_flat_arrays_walk_like_trees():
    rng = np.random.default_rng(1)
    x, y = rng.random((200, 2)), rng.integers(0, 2, 200).astype(float)
    f = quality.fit_forest(x, y, [0, 0], trees=5)

    def walk(row, at):
        while f.feature[at] >= 0:
            at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
        return f.value[at]

    want = [1 / (1 + np.exp(-(f.base + sum(walk(r, t) for t in f.roots)))) for r in x]
    assert f.scores(x) == pytest.approx(want)


def test_quality_odd_rows(spark):
    docs = documents(spark, None, "", "word " * 30, " ".join(f"w{i}" for i in range(40)), extra=True)
    docs = docs.union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(3, None), (None, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    rows = quality.quality(docs, labels).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in rows) == [(0, True, False), (0, True, False), (30, True, False), (40, False, True), (40, False, True)]
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0


# --- 9: language ----------------------------------------------------------------------------------


def test_language_held_out(spark):
    sf = DATA.replace("0.001", "0.01")
    rows = queries.op9_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(held) > 250 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert rows["score"].between(0, 1).all()
    import zlib

    assert (rows["held_out"] == rows["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12])
def test_codewords_differ(n):
    code = langid.codewords(n)
    apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= (1 if n == 2 else 2) and len(set(map(tuple, code.T))) == code.shape[1]


def test_codes_correct_errors():
    code = langid.codewords(7)
    trust = np.full(code.shape, 1 / code.shape[1])
    model = langid.Model(list("abcdefg"), code, np.eye(code.shape[1]), np.zeros(code.shape[1]), trust)
    flipped = code.copy()
    flipped[:, :10] *= -1  # 10 of 63 bits wrong, the least distance being 32
    assert model.predict(flipped)[0].tolist() == list(range(7))


def test_features_in_parts(monkeypatch):
    text = "Größe über Straßen, and some English too. " * 50
    want = langid.features(text)
    monkeypatch.setattr(langid, "_CHUNK", 100)
    assert (langid.features(text) == want).all()


def test_language_odd_rows(spark):
    df = documents(spark, None, "", "123 !?", "hello there my friend", "hallo mein lieber freund", extra=True).withColumn("lang", F.expr("CASE doc_id WHEN 3 THEN 'en' WHEN 4 THEN 'de' END"))
    model = langid.fit(df, "doc_id", "text", "lang")
    rows = langid.identify(df, ["doc_id"], "text", model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "de"] and [r.score for r in rows[:3]] == [0, 0, 0]
    one = langid.fit(df.where("doc_id = 3"), "doc_id", "text", "lang")
    assert langid.identify(df, ["doc_id"], "text", one).orderBy("doc_id").collect()[4].lang_pred == "en"
    none = langid.fit(df.where("lang IS NULL"), "doc_id", "text", "lang")
    assert none is None and langid.identify(df, ["doc_id"], "text", none).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.limit(0), ["doc_id"], "text", model).count() == 0
