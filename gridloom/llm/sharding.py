"""Sharding through fixed virtual slots.

A record's hash puts it into one of thousands of virtual slots, for good. Shards only hold slots: a
versioned map says which, and is stored by name: ``SlotMap.save`` and ``SlotMap.load``. Bytes are
aggregated per slot, and a shard that is too full gives slots away by an edit of the map, a new version;
records are never hashed anew. A slot that alone holds far more than its share of bytes or of rows (a hot
record, repeated) is split into further slots first, which is an edit too.

DataFrame operations only; what reaches the driver is one row per slot, a fixed number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridloom.plans.lineage import cut

SLOTS = 4096
#: A slot is split if it holds more than 1 / (shards * SPLIT) of all bytes or rows.
SPLIT = 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] at a version; parts[slot] has a split slot's first extra slot and number of parts."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    parts: tuple[tuple[int, int, int], ...] = ()  # slot, its first extra slot, number of parts

    @staticmethod
    def fixed(shards: int, slots: int = SLOTS) -> SlotMap:
        """Version 1: slots dealt round, whatever they hold."""
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def split(self, sizes: list[int], counts: list[int]) -> SlotMap:
        """Slots that hold too many bytes or rows, split into parts of about a slot's fair share; the same map if there are none. A part isn't split again."""
        slots = len(self.shard_of) - sum(n for _, _, n in self.parts)
        known = {slot for slot, _, _ in self.parts}
        shard_of, parts = list(self.shard_of), list(self.parts)
        for slot in range(slots):
            over = [(held[slot], sum(held)) for held in (sizes, counts) if held[slot] * self.shards * SPLIT > sum(held)]
            if over and slot not in known:
                n = min(SLOTS, max(math.ceil(held * slots / total) for held, total in over))
                if n > 1:
                    parts.append((slot, len(shard_of), n))
                    shard_of += [k % self.shards for k in range(n)]
        return replace(self, version=self.version + 1, shard_of=tuple(shard_of), parts=tuple(parts)) if len(parts) > len(self.parts) else self

    def moved(self, moves: dict[int, int]) -> SlotMap:
        """The next version, with the named slots in other shards."""
        if any(not 0 <= slot < len(self.shard_of) or not 0 <= shard < self.shards for slot, shard in moves.items()):
            raise ValueError("A move names a slot or shard that the map hasn't")
        return replace(self, version=self.version + 1, shard_of=tuple(moves.get(s, shard) for s, shard in enumerate(self.shard_of)))

    def rebalanced(self, sizes: list[int]) -> SlotMap:
        """Slots move from the fullest to the emptiest shard, each time the one that evens the two out best, until no move helps."""
        shard_of, held = list(self.shard_of), [[] for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            held[shard].append(slot)
        loads = [sum(sizes[s] for s in slots) for slots in held]
        while True:
            high, low = max(range(self.shards), key=loads.__getitem__), min(range(self.shards), key=loads.__getitem__)
            gap = loads[high] - loads[low]
            movable = [s for s in held[high] if 0 < sizes[s] < gap]
            if not movable:
                break
            slot = min(movable, key=lambda s: (abs(gap - 2 * sizes[s]), s))
            held[high].remove(slot), held[low].append(slot)
            loads[high], loads[low], shard_of[slot] = loads[high] - sizes[slot], loads[low] + sizes[slot], low
        return replace(self, version=self.version + 1, shard_of=tuple(shard_of))

    def grown(self, sizes: list[int]) -> SlotMap:
        """One more shard, into which slots move from the fullest shards until it has its share; no other slot moves."""
        shard_of, loads = list(self.shard_of), [0] * (self.shards + 1)
        for slot, shard in enumerate(shard_of):
            loads[shard] += sizes[slot]
        share = sum(loads) / (self.shards + 1)
        while True:
            high = max(range(self.shards), key=loads.__getitem__)
            room = min(share - loads[-1], loads[high] - loads[-1])
            movable = [s for s, shard in enumerate(shard_of) if shard == high and 0 < sizes[s] <= room]
            if not movable:
                break
            slot = min(movable, key=lambda s: (-sizes[s], s))
            shard_of[slot], loads[high], loads[-1] = self.shards, loads[high] - sizes[slot], loads[-1] + sizes[slot]
        return replace(self, version=self.version + 1, shards=self.shards + 1, shard_of=tuple(shard_of))

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, shards, slot, shard, part_of), one row per slot; part_of is the slot that it is a part of, if any."""
        slot, part_of = F.col("id"), F.lit(None).cast("long")
        for whole, first, n in self.parts:
            part_of = F.when((slot >= first) & (slot < first + n), F.lit(whole).cast("long")).otherwise(part_of)
        return spark.range(len(self.shard_of)).select(F.lit(self.version).alias("version"), F.lit(self.shards).alias("shards"), slot.alias("slot"), lookup(self.shard_of, slot).cast("int").alias("shard"), part_of.alias("part_of"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Stores this version below path, a folder that holds one map's versions; a version is never written twice."""
        self.table(spark).coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/v{self.version:09d}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the last one if none is named. A table of slots, whose number is fixed, reaches the driver."""
        if version is None:
            top = spark._jvm.org.apache.hadoop.fs.Path(path)
            names = [f.getPath().getName() for f in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)]
            version = max(int(name[1:]) for name in names if name[:1] == "v" and name[1:].isdigit())
        rows = spark.read.parquet(f"{path.rstrip('/')}/v{version:09d}").orderBy("slot").collect()
        parts: dict[int, list[int]] = {}
        for r in rows:
            if r["part_of"] is not None:
                parts.setdefault(r["part_of"], []).append(r["slot"])
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows), tuple((whole, min(s), len(s)) for whole, s in sorted(parts.items(), key=lambda x: min(x[1]))))


def lookup(values: tuple[int, ...], at: Column) -> Column:
    """values[at], from a constant that the optimizer folds into an array."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>"), at.cast("int") + 1)


def slot_sizes(rows: DataFrame, n: int, slot: str = "slot", size: str = "size") -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot."""
    sizes, counts = [0] * n, [0] * n
    for r in rows.groupBy(slot).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect():
        sizes[r[slot]], counts[r[slot]] = r["b"], r["n"]
    return sizes, counts


def shard(df: DataFrame, shards: int, doc: str = "doc_id", text: str = "text", slots: int = SLOTS, *, stored: SlotMap | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, size, text_crc32, virtual_slot, shard, slot) and the map's versions (version, slot, shard, bytes, rows).

    With ``stored``, a map of as many shards, its slots are rebalanced instead of a new map's: rows of
    slots that don't move stay in their shards. With ``path``, every new version is saved there.

    size is the text's UTF-8 bytes (null: none) plus one; sizes of shards are near equal; slot is the
    row's place in its shard, gapless from 0, by virtual slot and id. A record is its id and text, so
    repeated rows share a slot until that is split; null ids are hashed like any other; an empty table
    gives no rows. Other columns are left out.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.col(f"`{text}`").cast("binary")
    rows = df.select(
        F.col(f"`{doc}`").alias("__doc"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(f"`{doc}`"), raw), F.lit(slots)).alias("slot"), F.monotonically_increasing_id().alias("__row"),
    )
    rows = cut(rows, "shard-rows")
    sizes, counts = slot_sizes(rows, slots)
    versions = [stored or SlotMap.fixed(shards, slots)]
    if versions[0].shards != shards or len(versions[0].shard_of) != slots + sum(n for _, _, n in versions[0].parts):
        raise ValueError("the stored map has other numbers of shards or slots")
    whole = versions[0].split(sizes, counts)
    if whole != versions[0]:
        versions.append(whole)
    if whole.parts:
        of = {slot: (first, n) for slot, first, n in whole.parts}
        first, n = (lookup(tuple(of.get(s, (0, 1))[k] for s in range(slots)), F.col("slot")) for k in (0, 1))
        rows = rows.withColumn("slot", F.when(n > 1, first + F.pmod(F.xxhash64("__row"), n)).otherwise(F.col("slot")))
        sizes, counts = slot_sizes(rows, len(whole.shard_of))
    versions.append(whole.rebalanced(sizes))
    for version in versions[1 if stored else 0 :] if path else ():
        version.save(df.sparkSession, path)
    places, filled = [], [0] * shards
    for slot, owner in enumerate(versions[-1].shard_of):
        places.append(filled[owner])
        filled[owner] += counts[slot]
    order = Window.partitionBy("slot").orderBy("__doc", "text_crc32", "size", "__row")
    out = rows.select(
        F.col("__doc").alias(doc), "size", "text_crc32", F.col("slot").alias("virtual_slot"), lookup(versions[-1].shard_of, F.col("slot")).cast("int").alias("shard"),
        (lookup(tuple(places), F.col("slot")) + F.row_number().over(order) - 1).alias("slot"),
    )
    stored = None
    for version in versions:
        known = len(version.shard_of)
        table = version.table(df.sparkSession).drop("shards", "part_of").withColumns({"bytes": lookup(tuple(sizes[:known]), F.col("slot")), "rows": lookup(tuple(counts[:known]), F.col("slot"))})
        stored = table if stored is None else stored.union(table)
    return out, cut(stored, "shard-map")
