"""Packing token ids into windows by minimum bin slack.

A document's ids (with a separator after them) are cut into whole windows, each a sequence of its
own, and one remaining piece. Remaining pieces gather, and a bitset subset-sum program over the
multiset of their lengths picks, beside the longest piece left, the lengths that fill a window closest
to its capacity. Walking back through the program's steps gives the count of every length; the pick
is repeated as often as the counts allow. What stays short of its window is cut to fill windows
exactly, and a task's last ids go into sequences whose lengths are powers of two, so nothing is padded.

Every task packs the rows that it reads, within a bounded buffer: no shuffle, and a lost task is
simply run again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gridloom.llm.bpe import chunks, load_ranks
from gridloom.plans.lineage import ship

#: Remaining pieces that one round of packing picks from.
WINDOW_PIECES = 8192


def best_fill(lengths: list[tuple[int, int]], room: int) -> tuple[dict[int, int], int]:
    """The counts of lengths, out of (length, count) pairs, whose sum is closest to room from below, and that sum."""
    reach, steps, goal = 1, [], 1 << room
    keep = (goal << 1) - 1
    for length, count in lengths:
        if length > room:
            continue
        steps.append((length, count, reach))
        left, part = min(count, room // length), 1
        while left:  # 1, 2, 4, ... and the rest of the copies
            part = min(part, left)
            reach |= reach << length * part & keep
            left, part = left - part, part * 2
        if reach & goal:
            break
    total = at = reach.bit_length() - 1
    counts: dict[int, int] = {}
    for length, count, before in reversed(steps):
        taken = 0
        while not before >> at & 1:
            at, taken = at - length, taken + 1
        if taken:
            counts[length] = taken
    return counts, total


def fill_windows(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(counts of lengths in a window, number of such windows) until nothing is left of ``counts``, the longest lengths first."""
    left = sorted(((n, c) for n, c in counts.items() if c), reverse=True)
    while left:
        longest = left[0][0]
        rest = [(longest, left[0][1] - 1), *left[1:]] if left[0][1] > 1 else left[1:]
        picked, _ = best_fill(rest, capacity - longest)
        picked[longest] = picked.get(longest, 0) + 1
        times = min(c // picked[n] for n, c in left if n in picked)
        yield picked, times
        left = [(n, c) for n, c in ((n, c - times * picked.get(n, 0)) for n, c in left) if c]


class Packer:
    """Takes documents one by one and hands out rows (key, start, ids, document's ids, sequence, offset)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.held: list[tuple] = []  # (key, start, ids, document's ids)

    def add(self, key, ids) -> Iterator[tuple]:
        total = len(ids)
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            yield from self._place([(key, start, ids[start : start + self.capacity], total)])
        if whole < total:
            self.held.append((key, whole, ids[whole:], total))
            if len(self.held) >= WINDOW_PIECES:
                yield from self.flush()

    def _place(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, total in pieces:
            yield key, start, ids, total, self.sequence, offset
            offset += len(ids)
        self.sequence += 1

    def _cut(self, pieces: list[tuple], sizes: Iterator[int]) -> Iterator[list[tuple]]:
        """The pieces dealt in order to sequences of the given sizes, cut where one is full; the last list is what didn't fill one."""
        size, row, used = next(sizes, 0), [], 0
        for key, start, ids, total in pieces:
            while size and len(ids) >= size - used:
                part = size - used
                row.append((key, start, ids[:part], total))
                yield row
                start, ids, row, used, size = start + part, ids[part:], [], 0, next(sizes, 0)
            if len(ids):
                row.append((key, start, ids, total))
                used += len(ids)
        yield row

    def flush(self, last: bool = False) -> Iterator[tuple]:
        by_length: dict[int, list[tuple]] = {}
        for piece in self.held:
            by_length.setdefault(len(piece[2]), []).append(piece)
        short: list[tuple] = []
        for picked, times in fill_windows({n: len(x) for n, x in by_length.items()}, self.capacity):
            full = sum(n * c for n, c in picked.items()) == self.capacity
            for _ in range(times):
                pieces = [by_length[n].pop() for n, c in picked.items() for _ in range(c)]
                if full:
                    yield from self._place(pieces)
                else:
                    short += pieces
        tokens = sum(len(x[2]) for x in short)
        *rows, self.held = self._cut(short, iter([self.capacity] * (tokens // self.capacity)))
        for row in rows:
            yield from self._place(row)
        if last:
            tokens = sum(len(x[2]) for x in self.held)
            *rows, self.held = self._cut(self.held, iter([1 << k for k in reversed(range(tokens.bit_length())) if tokens >> k & 1]))
            for row in rows:
                yield from self._place(row)


@cache
def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the ``tokenizers`` file beside a rank file, if there is one, by their text."""
    beside = Path(path).with_suffix(".json")
    return {t["content"]: t["id"] for t in json.loads(beside.read_text("utf-8"))["added_tokens"]} if beside.exists() else {}


def parts_of(text: str, added: dict[str, int]) -> Iterator[str]:
    """A text cut at the added tokens, which are parts of their own, and into chunks between them."""
    if not any(token in text for token in added):
        yield from chunks(text)
        return
    for part in re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text):
        yield from [part] if part in added else chunks(part)


@cache
def _fast(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def pack(df: DataFrame, doc: str, text: str, path: str, pattern: str, *, capacity: int = 1024, separator: int = 0) -> DataFrame:
    """Pieces (doc, start, length, doc_tokens, sequence_id, offset, ids) of all documents' ids, each followed by the separator.

    ``path`` is a rank file; ids are those of the vocabulary's ``tokenizers`` file of the same name, with
    its added tokens where a text holds them, and none put around the text. ids are little-endian unsigned 32-bit numbers, as binary. Sequences hold exactly
    ``capacity`` ids, or a power of two of them (the ends of tasks); sequence ids are unique, not
    gapless. A null or empty text is the separator alone. Rows are packed as they come, so repeated ids
    and null ids are documents of their own; an empty table gives no rows; other columns are left out.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    ship(df.sparkSession)
    source = df.select(F.col(f"`{doc}`"), F.col(f"`{text}`").alias("__text"))
    numbers = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = source.drop("__text")
    for name in numbers:
        schema = schema.withColumn(name, F.lit(None).cast("long"))
    schema = schema.withColumn("ids", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode, added, end = _fast(path, pattern), added_tokens(path), np.array([separator], "<u4")
        packer, rows, kind = Packer(capacity, TaskContext.get().partitionId() << 40), [], None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            key, start, ids, total, sequence, offset = zip(*rows)
            columns = (start, [len(x) for x in ids], total, sequence, offset)
            return pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in key], kind), *(pa.array(x, pa.int64()) for x in columns), pa.array([x.tobytes() for x in ids], pa.binary())], names=[doc, *numbers, "ids"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, value in zip(*batch.columns):
                parts = [np.array([added[part]] if part in added else encode.encode_ordinary(part), "<u4") for part in parts_of(value.as_py() or "", added)]
                for row in packer.add(key, np.concatenate([*parts, end])):
                    rows.append(row)
                    if len(rows) >= 4096:
                        yield batch_of(rows)
                        rows = []
        rows += packer.flush(last=True)
        for k in range(0, len(rows), 4096):
            yield batch_of(rows[k : k + 4096])

    return source.mapInArrow(run, schema)
