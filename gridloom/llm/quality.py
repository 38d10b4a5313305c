"""Quality rules: gradient-boosted trees over statistics of a document.

One pass over whole texts gives the statistics; everything after reads numbers only. Trees are fitted
in numpy on a bounded sample of labelled rows (``SAMPLE``, the smallest hashes of the id), by histogram
splits on the logistic loss. Features in ``MONOTONE`` may only raise (1) or lower (-1) the score:
a split against its sign is refused, and the midpoint of a split bounds what lies below either side.
A fitted model is five numpy arrays over all nodes of all trees, and scoring walks every row of a batch
through every tree at once.

Base rules fail documents of fewer than ten words, or with over a fifth of their words in repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridloom.plans.lineage import ship

#: Most labelled rows that a fit uses.
SAMPLE = 20_000
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_OTHER = bytes(set(range(256)) - set(SYMBOLS))
_CONTINUED = bytes(range(0x80, 0xC0))  # bytes that go on with a code point

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_bytes")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_rate", "line_words")
#: Sign of a feature's effect on quality, where it is fixed.
MONOTONE = {"symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "mark_rate": -1}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    code = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    bits = max(1, (len(index) - 1).bit_length())
    if bits * width <= 63:
        windows = code[:n].copy()
        for k in range(1, width):
            windows = windows << bits | code[k : k + n]
    else:  # rank the windows one word at a time, so that nothing collides
        windows = code[:n]
        for k in range(1, width):
            windows = np.unique(windows * len(index) + code[k : k + n], return_inverse=True)[1]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(twice)[0]
    covered[at] += 1
    np.subtract.at(covered, at + width, 1)
    return int((np.cumsum(covered) > 0).sum())


def text_counts(raw: bytes | None) -> tuple[int, ...]:
    """The numbers named in COUNTS of a whole UTF-8 text; null: none."""
    raw = raw or b""
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    solid = raw.translate(None, SPACE)
    return (
        len(words),
        len(solid.translate(None, _CONTINUED)),
        len(raw.translate(None, _OTHER)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(solid) - len(solid.translate(None, b"0123456789")),
        len(solid) - len(solid.translate(None, b"!?")),
        len(raw),
    )


def with_counts(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Columns ``keep`` of df and the counts of every whole text; kept columns of the counts' names give way to them."""
    ship(df.sparkSession)
    keep = [c for c in keep if c.lower() not in COUNTS]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = source.drop("__text")
    for name in COUNTS:
        schema = schema.withColumn(name, F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([text_counts(x.as_py()) for x in batch.column(len(keep))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(made[:, k]) for k in range(len(COUNTS)))], names=[*keep, *COUNTS])

    return source.mapInArrow(run, schema.schema)


def feature_matrix(counts: np.ndarray) -> np.ndarray:
    """FEATURES of rows of COUNTS."""
    c = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}
    words, chars, lines = (np.maximum(1, c[x]) for x in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
         c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / words, c["n_words"] / lines], axis=1,
    )


@dataclass
class Forest:
    """All nodes of all trees: a leaf has feature -1; rows go left where their feature is at most the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality of every row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[at]
            onward = np.where(x[rows, feature] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(feature < 0, at, onward)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: list[int], *, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 4.0) -> Forest:
    """Boosted trees for 0/1 labels; signs has 1, -1 or 0 for every feature."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1)
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def best_split(rows, g, h, low, high):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        out = (1e-6, -1, 0, 0.0)
        for f, sign in enumerate(signs):
            if not len(edges[f]):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = (np.clip(-a / (b + penalty), low, high) for a, b in ((gl, hl), (gr, hr)))
            whole = np.clip(-total_g / (total_h + penalty), low, high)
            cost = lambda a, b, v: a * v + (b + penalty) * v * v / 2
            gain = cost(total_g, total_h, whole) - cost(gl, hl, vl) - cost(gr, hr, vr)
            gain = np.where((hl < least / 4) | (hr < least / 4) | (sign * (vr - vl) < 0), -1, gain)
            k = int(np.argmax(gain))
            if gain[k] > out[0]:
                out = (float(gain[k]), f, k, float(vl[k] + vr[k]) / 2)
        return out

    def grow(rows, g, h, level, low, high) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, 0.0])
        _, f, k, middle = best_split(rows, g, h, low, high) if level < depth else (0, -1, 0, 0.0)
        if f < 0:
            value = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
            nodes[at][4] = rate * value
            margin[rows] += rate * value
            return at
        side = binned[rows, f] <= k
        bounds = {0: (low, high, low, high), 1: (low, middle, middle, high), -1: (middle, high, low, middle)}[signs[f]]
        left = grow(rows[side], g, h, level + 1, *bounds[:2])
        right = grow(rows[~side], g, h, level + 1, *bounds[2:])
        nodes[at] = [f, float(edges[f][k]), left, right, 0.0]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Forest(feature, threshold, left, right, value, np.array(roots), base, depth)


def fit(df: DataFrame, labels: DataFrame, doc: str, text: str, label: str, sample: int = SAMPLE) -> Forest | None:
    """A forest from the texts of at most ``sample`` labelled rows; none if their labels don't have both classes."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).select(F.col(doc).alias("__doc"), F.col(label).cast("double").alias("__label"))
    chosen = marked.orderBy(F.xxhash64("__doc"), "__doc", "__label").limit(sample)
    rows = df.select(F.col(f"`{doc}`").alias("__id"), F.col(f"`{text}`").alias("__t")).join(F.broadcast(chosen), F.col("__id") == F.col("__doc"))  # ``sample`` rows at most
    counts = with_counts(rows, ["__doc", "__label"], "__t")
    got = counts.orderBy("__doc", "__label", *COUNTS).limit(sample).toPandas()
    if got["__label"].nunique() < 2:
        return None
    return fit_forest(feature_matrix(got[list(COUNTS)].to_numpy()), got["__label"].to_numpy(float), [MONOTONE.get(f, 0) for f in FEATURES])


def verdicts(counts: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """counts with base_failed, score (null without a model) and kept."""
    ship(counts.sparkSession)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    if forest is None:
        return counts.withColumns({"base_failed": failed, "score": F.lit(None).cast("double"), "kept": ~failed})
    keep = counts.columns
    schema = counts.withColumn("score", F.lit(None).cast("double")).schema
    places = [keep.index(c) for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in places], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(feature_matrix(x)), pa.float64())], names=[*keep, "score"])

    scored = counts.mapInArrow(run, schema)
    return scored.withColumns({"base_failed": failed, "kept": ~failed & (F.col("score") >= threshold)})


def quality(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc, counts, base_failed, score, kept) for every row of df, by trees fitted on the rows that ``labels`` (doc, 0 or 1) covers.

    A null or empty text has no words and so fails the base rules. Null ids and null labels take no
    part in fitting; repeated rows are scored alike; empty labels, or labels of one class, leave the
    base rules alone; an empty table gives no rows. Other columns are left out.
    """
    return verdicts(with_counts(df, [doc], text), fit(df, labels, doc, text, label))
