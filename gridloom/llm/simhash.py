"""SimHash near-duplicate detection by anchor-point covering.

Anchors are the words of a covering code. A perfect code puts every fingerprint within the covering
radius R of exactly one anchor, its home; two fingerprints at most ``t`` bits apart meet at the home
of either one, since the other is within R + t of it. So every fingerprint is replicated to all anchors
within R + t, and per anchor its home fingerprints are compared with everything replicated there.

The 64 bits are covered in bands, each by a product of perfect codes (binary Golay 23, Hamming
2^r - 1, odd repetition); among b bands of a pair within T bits, one holds at most T // b of them,
so replication per band goes to R + T // b only. The search is exact: it finds every pair whose probe
fingerprints differ in at most T bits. ``CODES_3`` (two bands, 3 bits) makes about 20 rows of a
fingerprint at 2^18 anchors a band; ``CODES_8`` (three bands, 8 bits) about 90 rows at 2^12.

Rows of an anchor beyond ``HOT_ROWS`` are dealt to a grid of cells, in which every home chunk still
meets every replica chunk. A task returns a spanning set of links for the fingerprints it saw, never
all pairs of a dense group, and the links become components by distributed contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gridloom.plans.components import connected_components
from gridloom.plans.lineage import cut, keep, scratch, ship

#: One tuple of codes per band, as (kind, length); lengths sum to 64. Each code is perfect.
CODES_3 = ((("golay", 23), ("hamming", 7), ("repeat", 1), ("repeat", 1)),) * 2
CODES_8 = ((("golay", 23),), (("golay", 23),), (("hamming", 15), ("repeat", 3)))
HOT_ROWS = 20_000
_PAIRS = 2_000_000
#: Bands of three least hashes each: of two texts that share a part J of their shingles, a band agrees with chance J^3.
BANDS = 24
_SALTS = np.random.default_rng(42).integers(0, 2**63, 3 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- fingerprints -------------------------------------------------------------------------------


def _majority(data: bytes, starts: list[int], ends: list[int], seed: int, least: np.ndarray | None = None) -> int:
    """Bit i is set if it is set in over half the hashes of data[start:end]; ``least`` takes the least hash by each salt."""
    digest, n, ones = xxhash.xxh64_digest, len(starts), np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        raw = b"".join([digest(data[s:e], seed) for s, e in zip(starts[k : k + 65536], ends[k : k + 65536])])
        if least is not None:
            hashes = np.frombuffer(raw, "<u8")
            for j in range(0, len(hashes), 1024):
                np.minimum(least, (hashes[j : j + 1024, None] * _SALTS).min(0), out=least)
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | bytes | None, words: int, seed: int = 42) -> int:
    """64-bit SimHash of a text's word shingles, repeats included.

    A-Z are lower-cased, words are runs without ASCII white space, a shingle's words are joined by
    a space and hashed by XXH64. Fewer words than a shingle: the whole sequence; none (or null): 0.
    """
    return fingerprints(text, ((words, seed),))[0]


def fingerprints(text: str | bytes | None, kinds: tuple[tuple[int, int], ...], banded: int | None = None) -> list:
    """A fingerprint for every (words, seed) of kinds, splitting the text once, and the bands of kind number ``banded`` as bytes."""
    least = np.full(3 * BANDS, 2**64 - 1, np.uint64)
    raw = text.encode() if isinstance(text, str) else text or b""
    tokens = raw.lower().split()
    if not tokens:
        return [0] * len(kinds) + ([_bands(least)] if banded is not None else [])
    data = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    out = []
    for k, (words, seed) in enumerate(kinds):
        n = max(1, len(tokens) - words + 1)
        out.append(_majority(data, starts[:n], ends[min(words, len(tokens)) - 1 :], seed, least if k == banded else None))
    return out if banded is None else [*out, _bands(least)]


def _bands(least: np.ndarray) -> bytes:
    """BANDS signed 64-bit numbers below 0, so that none is a covering code's anchor; bands differ by their number."""
    keys = [xxhash.xxh64_intdigest(least[3 * k : 3 * k + 3].tobytes(), k) for k in range(BANDS)]
    return (np.array(keys, np.uint64) | np.uint64(1 << 63)).tobytes()


def with_fingerprints(df: DataFrame, text: str, kinds: tuple[tuple[int, int], ...], names: tuple[str, ...], keep: list[str], banded: int | None = None) -> DataFrame:
    """Columns ``keep`` of df and one signed BIGINT fingerprint per kind; with ``banded``, also __bands of that kind."""
    ship(df.sparkSession)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = source.drop("__text")
    for name in names:
        schema = schema.withColumn(name, F.lit(0).cast("long"))
    extra = [] if banded is None else ["__bands"]
    for name in extra:
        schema = schema.withColumn(name, F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, bands = np.empty((batch.num_rows, len(kinds)), np.uint64), []
            for i, value in enumerate(batch.column(len(keep))):
                found = fingerprints(value.as_py(), kinds, banded)
                made[i] = found[: len(kinds)]
                bands += found[len(kinds) :]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(made[:, k].view(np.int64)) for k in range(len(kinds))), *([pa.array(bands, pa.binary())] if extra else [])], names=[*keep, *names, *extra])

    return source.mapInArrow(run, schema.schema)


# --- covering codes -----------------------------------------------------------------------------


@cache
def _code(kind: str, n: int, extra: int):
    """A perfect code's coset table: syndromes of bytes of a word, and per syndrome its error patterns by excess over the radius.

    Returns (byte tables, offsets, counts[syndrome, excess allowed], patterns).
    """
    if kind == "golay":
        radius, columns, value = 3, [], 1
        for _ in range(n):  # powers of x modulo the generator polynomial
            columns.append(value)
            value <<= 1
            value ^= 0xC75 if value >> 11 else 0
    elif kind == "hamming":
        radius, columns = 1, list(range(1, n + 1))
    else:  # repetition
        radius, columns = n // 2, [1 << i for i in range(n - 1)] + [(1 << (n - 1)) - 1]
    tables = []
    for low in range(0, n, 8):
        table = np.zeros(256, np.int64)
        for i, column in enumerate(columns[low : low + 8]):
            table ^= np.where(np.arange(256) >> i & 1, column, 0)
        tables.append(table)
    n_syndromes = 1 << {"golay": 11, "hamming": n.bit_length(), "repeat": n - 1}[kind]
    patterns, syndromes, excess = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    word, syndrome, top = patterns[0], syndromes[0], np.full(1, -1)
    for weight in range(1, min(n, radius + extra) + 1):  # each pattern grows by a higher bit
        room = n - 1 - top
        word, syndrome, first = (np.repeat(x, room) for x in (word, syndrome, top + 1))
        top = first + np.arange(len(word)) - np.repeat(np.cumsum(room) - room, room)
        word, syndrome = word | 1 << top, syndrome ^ np.asarray(columns)[top]
        patterns.append(word), syndromes.append(syndrome), excess.append(np.full(len(word), max(0, weight - radius)))
    word, syndrome, over = (np.concatenate(x) for x in (patterns, syndromes, excess))
    order = np.lexsort((over, syndrome))
    counts = np.stack([np.bincount(syndrome[over <= e], minlength=n_syndromes) for e in range(extra + 1)], 1)
    total = counts[:, extra]
    return tables, np.cumsum(total) - total, counts, word[order], over[order]


def anchors(probe: np.ndarray, bands, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for all anchors of uint64 fingerprints; an anchor is its code word, the band above bit 32."""
    extra, shift, out = bits // len(bands), 0, []
    for band, codes in enumerate(bands):
        row = np.arange(len(probe))
        anchor, spent, at = np.zeros(len(probe), np.int64), np.zeros(len(probe), np.int64), 0
        for kind, n in codes:
            tables, offsets, counts, patterns, over = _code(kind, n, extra)
            value = (probe >> np.uint64(shift) & np.uint64((1 << n) - 1)).astype(np.int64)
            syndrome = np.zeros(len(probe), np.int64)
            for k, table in enumerate(tables):
                syndrome ^= table[value >> 8 * k & 255]
            many = counts[syndrome[row], extra - spent]
            at_pattern = np.repeat(offsets[syndrome[row]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            row, anchor, spent = (np.repeat(x, many) for x in (row, anchor, spent))
            anchor, spent = anchor | (value[row] ^ patterns[at_pattern]) << at, spent + over[at_pattern]
            shift, at = shift + n, at + n
        out.append((row, anchor | band << 32, spent == 0))
    return tuple(np.concatenate(x) for x in zip(*out))


# --- comparing per anchor -----------------------------------------------------------------------


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the given links: (node, the component's smallest node), without the roots."""
    nodes, index = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = index[: len(left)], index[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    far = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[far], nodes[label[far]]


def _links(group: np.ndarray, home: np.ndarray, prints: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among rows sorted by group: each home row against all rows of its group."""
    first = np.concatenate(([True], group[1:] != group[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    bounds = np.append(np.nonzero(first)[0], len(group))
    end = np.repeat(bounds[1:], np.diff(bounds))
    homes = np.nonzero(home & (end - start > 1))[0]
    found_a, found_b, held, k = [], [], 0, 0
    load = np.cumsum(end[homes] - start[homes])
    while k < len(homes):
        upto = max(k + 1, int(np.searchsorted(load, (load[k - 1] if k else 0) + _PAIRS, "right")))
        part = homes[k:upto]
        many = end[part] - start[part]
        i = np.repeat(part, many)
        j = np.repeat(start[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        apart = np.zeros(len(i), np.uint8)
        for column in prints:
            apart += np.bitwise_count((column[i] ^ column[j]).view(np.uint64))  # of a signed number it would count the magnitude's bits
        near = (apart <= most) & (ids[i] != ids[j])
        if near.any():
            found_a.append(ids[i[near]]), found_b.append(ids[j[near]])
            held += len(found_a[-1])
            if held > _PAIRS:
                a, b = spanning(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b, held = [a], [b], len(a)
        k = upto
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return spanning(np.concatenate(found_a), np.concatenate(found_b))


def _compare(most: int, n_prints: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def flush(last: bool):
            nonlocal held, n
            columns = [np.concatenate(x) for x in zip(*held)]
            cut_at = len(columns[0])
            if not last:  # the last group may go on in the next batch
                same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
                cut_at = int(np.argmax(same))
            if cut_at:
                anchor, cell, home, *prints = (c[:cut_at] for c in columns)
                change = np.concatenate(([0], np.cumsum((anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1]))))
                a, b = _links(change, home, prints[:n_prints], prints[n_prints], most)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])
            held = [[c[cut_at:] for c in columns]]
            n = len(held[0][0])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
                if n >= 8 * HOT_ROWS:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def _replicate(bands, bits: int, n_prints: int):
    names = ["anchor", "home", *[f"p{i}" for i in range(n_prints)], "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[: n_prints + 2]]
            for k in range(0, batch.num_rows, 2048):
                some = [c[k : k + 2048] for c in columns]
                row, anchor, home = anchors(some[0].view(np.uint64), bands, bits)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), *(pa.array(c[row]) for c in some[1:])], names=names)
                if batch.num_columns > n_prints + 2:  # every row of a band is at home
                    keys = np.frombuffer(b"".join(batch.column(n_prints + 2)[k : k + 2048].to_pylist()), np.int64)
                    row = np.repeat(np.arange(len(some[0])), BANDS)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.ones(len(keys), bool)), *(pa.array(c[row]) for c in some[1:])], names=names)

    return run


def links(nodes: DataFrame, probe: str, prints: list[str], node: str, bands, bits: int, most: int, also: tuple[str, ...] = ()) -> DataFrame:
    """Spanning links (src, dst) of nodes whose prints differ in at most ``most`` bits together, out of those whose probe prints differ in at most ``bits`` bits, or that agree on a band of ``also``."""
    ship(nodes.sparkSession)
    fields = ", ".join(f"p{i} long" for i in range(len(prints)))
    rows = nodes.select(probe, *prints, node, *also).mapInArrow(_replicate(bands, bits, len(prints)), f"anchor long, home boolean, {fields}, id long")
    hot = cut(rows.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("m")).where(F.col("n") > HOT_ROWS), "simhash-hot")
    if hot.isEmpty():
        dealt = rows.withColumn("cell", F.lit(0))
    else:
        chunks = lambda c: F.ceil(F.greatest(c, F.lit(1)) / HOT_ROWS).cast("int")
        grid = hot.select("anchor", chunks(F.col("m")).alias("ch"), chunks(F.col("n")).alias("cr"))
        spread = rows.join(grid, "anchor", "left").withColumns({"ch": F.coalesce("ch", F.lit(1)), "cr": F.coalesce("cr", F.lit(1))})
        own = F.xxhash64("id")
        as_home = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("cr") - 1), lambda r: F.struct((F.pmod(own, F.col("ch")) * F.col("cr") + r).cast("int").alias("cell"), F.lit(True).alias("home"))))
        as_row = F.transform(F.sequence(F.lit(0), F.col("ch") - 1), lambda h: F.struct((h * F.col("cr") + F.pmod(own, F.col("cr"))).cast("int").alias("cell"), F.lit(False).alias("home")))
        copies = F.when((F.col("ch") == 1) & (F.col("cr") == 1), F.array(F.struct(F.lit(0).alias("cell"), F.col("home")))).otherwise(F.concat(F.coalesce(as_home, F.slice(as_row, 1, 0)), as_row))
        dealt = spread.withColumn("copy", F.explode(copies)).select("anchor", "copy.home", *[f"p{i}" for i in range(len(prints))], "id", "copy.cell")
    columns = ["anchor", "cell", "home", *[f"p{i}" for i in range(len(prints))], "id"]
    return dealt.select(columns).repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(_compare(most, len(prints)), "src long, dst long")


def components(prints: DataFrame, doc: str, probe: str, marks: list[str], bands, bits: int, most: int, also: tuple[str, ...] = ()) -> DataFrame:
    """``prints`` with ``component_id``: the smallest id of any document reachable by links, itself included.

    Rows with the same fingerprints are linked. They are merged first, so a group of copies, however
    large, is one node; only nodes are replicated, and a single join hands the component back.
    """
    keys = [probe, *[m for m in marks if m != probe], *also]
    with scratch():
        nodes = prints.groupBy(*keys).agg(F.min(doc).alias("__least")).withColumn("__node", F.col(probe) if len(keys) == 1 else F.xxhash64(*keys))
        nodes = cut(nodes, "simhash-nodes")
        roots = connected_components(links(nodes, probe, marks, "__node", bands, bits, most, also).distinct())
        rooted = nodes.join(roots.withColumnRenamed("node", "__node"), "__node", "left").withColumn("root", F.coalesce("root", "__node"))
        linked = rooted.groupBy("root").agg(F.min("__least").alias("component_id"))
        of_node = keep(cut(rooted.join(linked, "root").select(*keys, "component_id"), "simhash-components"))
    return prints.join(of_node, keys)


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", *, words: int = 5, bits: int = 3) -> DataFrame:
    """(doc, fingerprint, component_id) for every row: components of fingerprints at most ``bits`` (3) differing bits apart.

    Null or empty texts have fingerprint 0 and link like any other; rows with a null id take part and
    get the smallest id of their component that isn't null; repeated rows share a component; an empty
    table gives no rows. Other columns of df, whatever their names, are left out.
    """
    if bits != 3:
        raise ValueError("CODES_3 covers 3 bits")
    prints = cut(with_fingerprints(df, text, ((words, 42),), ("__print",), [doc]), "simhash-prints")
    out = components(prints, doc, "__print", ["__print"], CODES_3, bits, bits)
    return out.select(F.col(f"`{doc}`"), F.lower(F.lpad(F.hex("__print"), 16, "0")).alias("fingerprint"), "component_id")


#: Of two 64-bit prints of five-word shingles: at most 25 of 128 bits differ, a SimHash similarity of 0.8.
SIMILAR_BITS = math.floor(128 * (1 - 0.8))
_STAGE = ((2, 42), (5, 42), (5, 43))


def similar_documents(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, component_id): components of texts whose 128-bit SimHash over five-word shingles agrees in 0.8 of its bits or more.

    Candidates are the pairs whose 64-bit prints of two-word shingles differ in at most 8 bits, and those
    that agree on one of 24 bands of three least hashes of five-word shingles: a Jaccard similarity J of
    those is missed with chance (1 - J^3)^24, which is 0.0001 at 0.69 (128-bit prints 0.8 alike in
    expectation) and nothing at 0.8. Nulls and ties as in near_duplicates. Texts without a word are alike.
    """
    names = ("__probe", "__p1", "__p2")
    prints = cut(with_fingerprints(df, text, _STAGE, names, [doc], banded=1), "simhash-prints")
    return components(prints, doc, "__probe", ["__p1", "__p2"], CODES_8, 8, SIMILAR_BITS, ("__bands",)).select(F.col(f"`{doc}`"), "component_id")
