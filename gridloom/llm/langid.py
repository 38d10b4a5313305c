"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier per bit, ridge regression on
hashed byte n-grams, predicts the bits of a text; decoding chooses the language whose codeword has
the least loss, bits weighted by how well their classifier does on that language's training texts.
Classifiers may err on a few bits without changing the choice. Texts whose two nearest codewords are
about equally far are flagged as ambiguous.

Fitting uses a bounded sample: at most ``SAMPLE`` labelled rows, equally many a language, the smallest
hashes of the id. Only the text is an input of a prediction. Of codewords that are equally near, the
first language by name is chosen, with score 0. Texts of any length are read whole, in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.plans.lineage import ship

#: Most labelled rows, of all languages together, that a fit uses.
SAMPLE = 2000
DIMENSIONS = 4096
_CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
#: A-Z and a-z and bytes of longer code points stay themselves; everything else is a word break.
_FOLD = np.array([b if chr(b).isalpha() and b < 128 or b > 127 else 32 for b in range(256)], np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of a text's hashed byte 2- and 3-grams, lower-cased; a vector of length 1."""
    counts = np.zeros(DIMENSIONS)
    raw = b" " + text.lower().encode() + b" "
    for k in range(0, len(raw), _CHUNK):  # grams that begin in a part; two bytes more end them
        a = _FOLD[np.frombuffer(raw, np.uint8, min(_CHUNK + 2, len(raw) - k), k)].astype(np.uint32)
        two = a[:-1] << 8 | a[1:]
        three = two[:-1] << 8 | a[2:]
        two, three = two[:_CHUNK], three[:_CHUNK]
        for gram, salt in ((two[two != 0x2020], 1), (three[three & 0xFFFF != 0x2020], 3)):
            counts += np.bincount((gram * np.uint32(2654435761) + np.uint32(salt * 40503)) >> np.uint32(20), minlength=DIMENSIONS)
    return np.sqrt(counts / max(1, counts.sum()))


def codewords(n: int) -> np.ndarray:
    """n codewords as rows of +1 and -1: the exhaustive code up to seven languages, beyond it the best spread of fixed random ones."""
    if n <= 7:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).reshape(-1, n).T
    length, rng, best, spread = 10 * (n - 1).bit_length(), np.random.default_rng(n), None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, length))
        apart = (length - code @ code.T) / 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > spread and (np.abs(code.sum(0)) < n).all():
            best, spread = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # dimension x bit
    bias: np.ndarray
    trust: np.ndarray  # language x bit; a language's sum to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted exponential loss of every text's margins against every codeword."""
        margins = np.clip(x @ self.weights + self.bias, -2, 2)
        return np.einsum("kb,nkb->nk", self.trust, np.exp(-2 * self.code[None] * margins[:, None]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score): 1 for a perfect match, 0 if the next codeword is as near."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        loss = self.losses(x)
        order = np.argsort(loss, axis=1, kind="stable")
        first, second = (np.take_along_axis(loss, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
        return order[:, 0], (second - first) / (second + first)


def fit_model(x: np.ndarray, languages: list[str], penalty: float = 0.02) -> Model:
    """A model of rows of features, which are centred in place, and their languages."""
    names = sorted(set(languages))
    which = np.searchsorted(names, languages)
    code = codewords(len(names))
    if len(names) == 1:
        return Model(names, code, np.zeros((x.shape[1], 0)), np.zeros(0), np.zeros((1, 0)))
    goal = code[which]
    centre, bias = x.mean(0, dtype=float), goal.mean(0)
    x -= centre.astype(x.dtype)
    gram = (x @ x.T).astype(float)
    gram[np.diag_indices_from(gram)] += penalty
    solved = np.linalg.solve(gram, goal - bias)
    del gram
    weights = x.T @ solved.astype(x.dtype) if x.dtype == np.float32 else x.T @ solved
    right = (np.sign(x @ weights + bias) == goal).astype(float)
    bias = bias - centre @ weights
    trust = np.stack([right[which == k].mean(0) for k in range(len(names))]) + 1e-6
    return Model(names, code, weights, bias, trust / trust.sum(1, keepdims=True))


def fit(df: DataFrame, doc: str, text: str, lang: str, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` rows of df with a language and a letter in their text; none without any."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(doc).alias("o"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(sample).collect()}
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    # of every language, at first about four times what is wanted, by the hash alone; no sort sees more
    share = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(min(1.0, 4 * (each + 16) / n)))])
    some = rows.where(F.col("l").isin(list(sizes))).where((F.col("o") / F.lit(2.0**64) + 0.5) <= share[F.col("l")])
    some = some.withColumn("h", F.xxhash64("t"))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("o", "h"))).where(F.col("k") <= each)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()).astype(np.float32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(made, pa.binary())], names=["l", "k", "x"])

    got = some.select("t", "l", "k").mapInArrow(run, "l string, k int, x binary").toArrow()
    # in the order of languages and hashes, whatever the partitions; one copy of the features at a time
    languages = got["l"].to_pylist()
    order = sorted(range(len(languages)), key=lambda i: (languages[i], at[i])) if (at := got["k"].to_pylist()) else []
    x = np.empty((len(order), DIMENSIONS), np.float32)
    place = np.argsort(order)
    k = 0
    for chunk in got["x"].chunks:
        for value in chunk:
            x[place[k]] = np.frombuffer(value.as_buffer(), np.float32)
            k += 1
    del got
    return fit_model(x, [languages[i] for i in order])


#: Below this score the two nearest codewords are about as near.
AMBIGUOUS = 0.05


def identify(df: DataFrame, keep: list[str], text: str, model: Model | None) -> DataFrame:
    """Columns ``keep`` of df with lang_pred, score (0 to 1) and ambiguous, from whole texts.

    ``und`` with score 0 for null texts, texts without a letter, and any text if there is no model.
    Rows are independent: repeats get the same answer, an empty table no rows. Kept columns of the new
    columns' names give way to them.
    """
    ship(df.sparkSession)
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score", "ambiguous")]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = source.drop("__text").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(None).cast("double"), "ambiguous": F.lit(True)}).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                texts = [t.as_py() for t in batch.column(len(keep))]
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                rows = [i for i, t in enumerate(texts) if model and has_letter(t)]
                if rows:
                    best, got = model.predict(np.stack([features(texts[i]) for i in rows]))
                    score[rows] = got
                    for i, b in zip(rows, best):
                        lang[i] = model.languages[b]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang), pa.array(score), pa.array(score < AMBIGUOUS)], names=[*keep, "lang_pred", "score", "ambiguous"])

    return source.mapInArrow(run, schema)


def held_out(doc: str):
    """The documents that no fit may see: crc32 of the id as text, mod 3, is 1. A null id isn't one."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
