"""Shards by fixed virtual slots.

A record's key is hashed into one of some thousand slots, for good. A small versioned table says which shard each slot
belongs to. Bytes are added up per slot, and rebalancing edits the table: it moves as few slots as it needs from heavy
shards to light ones, so only the rows of moved slots change place. Everything that reaches the driver has one row per
slot, however large the input.

The map is a table with a row for each version and slot. A run loads the last version, edits it if the shards have become
uneven or their number is another, and writes the edit as the next version; earlier ones stay for readers that use them.

A record is its id and text, so many records without an id are spread as well; equal records share a slot, and a slot of many
rows is numbered in cells by stored row number, however alike its rows are. Slots of shards that are no more are dealt to the
others. A null text has no bytes; an empty input gives an empty result. Other columns are not looked at. Texts are hashed whole, whatever their length.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.shared import written

SLOTS = 4096
#: The map is edited when the heaviest and the lightest shard differ by more than this part of the mean.
UNEVEN = 0.001
#: A slot's rows are numbered in cells of about so many; more where that would make over MOST_CELLS cells beside one for each slot.
CELL_ROWS, MOST_CELLS = 1_000_000, 100_000


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each slot; ``version`` counts the edits."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def frame(self, spark: SparkSession, first_row: list[int] | None = None, cells: list[int] | None = None) -> DataFrame:
        """The map as a table (version, shards, vslot, shard, first_row, cells)."""
        first_row, cells = first_row or [0] * len(self.shard_of), cells or [1] * len(self.shard_of)
        rows = json.dumps([{"v": s, "s": n, "f": f, "c": c} for s, (n, f, c) in enumerate(zip(self.shard_of, first_row, cells, strict=True))])
        parsed = F.explode(F.from_json(F.lit(rows), "array<struct<v:int,s:int,f:long,c:long>>")).alias("x")
        own = [F.col(f"x.{c}").alias(name) for c, name in (("v", "vslot"), ("s", "shard"), ("f", "first_row"), ("c", "cells"))]
        return spark.range(1).select(parsed).select(F.lit(self.version).alias("version"), F.lit(self.shards).alias("shards"), *own)

    def store(self, spark: SparkSession, path: str) -> None:
        """Writes this version beside those that ``path`` has; a version is written once."""
        self.frame(spark).drop("version", "first_row", "cells").coalesce(1).write.parquet(f"{path}/version={self.version}")


def stored_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The last version of the map at ``path``; None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    rows = table.join(F.broadcast(table.agg(F.max("version").alias("version"))), "version").orderBy("vslot").collect()  # a row for each slot
    return SlotMap(rows[0]["version"], rows[0]["shards"], tuple(r["shard"] for r in rows))


def initial_map(shards: int, slots: int = SLOTS) -> SlotMap:
    return SlotMap(1, shards, tuple(s % shards for s in range(slots)))


def rebalanced(old: SlotMap, weight: list[int], shards: int | None = None) -> SlotMap:
    """The next version of the map: slots go from the heaviest to the lightest shard while that narrows the gap.

    Slots whose shard is no more go first, the heaviest of them to the lightest shard. A step moves one slot, or swaps two, whichever brings the pair nearest to its mean.
    """
    shards = shards or old.shards
    shard_of = list(old.shard_of)
    held: list[set[int]] = [set() for _ in range(shards)]
    load = [0] * shards
    for s in sorted(range(len(shard_of)), key=lambda s: (shard_of[s] >= shards, -weight[s], s)):
        if shard_of[s] >= shards:
            shard_of[s] = min(range(shards), key=lambda n: (load[n], len(held[n]), n))
        held[shard_of[s]].add(s)
        load[shard_of[s]] += weight[s]
    while True:
        top, low = max(range(shards), key=lambda n: (load[n], -n)), min(range(shards), key=lambda n: (load[n], n))
        gap = load[top] - load[low]
        best, left = None, gap
        small = sorted((weight[s], s) for s in held[low])
        for s in sorted(held[top]):
            for back in (None, *_near(small, weight[s] - gap / 2)):
                moved = weight[s] - (weight[back] if back is not None else 0)
                if 0 < moved < gap and abs(gap - 2 * moved) < left:
                    best, left = (s, back), abs(gap - 2 * moved)
        if best is None:
            break
        for s, a, b in ((best[0], top, low), (best[1], low, top)):
            if s is not None:
                held[a].remove(s)
                held[b].add(s)
                load[a] -= weight[s]
                load[b] += weight[s]
                shard_of[s] = b
    return replace(old, version=old.version + 1, shards=shards, shard_of=tuple(shard_of))


def _near(small: list[tuple[int, int]], want: float) -> list[int]:
    """The slots on both sides of the wanted weight."""
    from bisect import bisect_left

    i = bisect_left(small, (want, -1))
    return [s for _, s in small[max(0, i - 1) : i + 1]]


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_weights(df: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot, from columns ``vslot`` and ``size``."""
    size, rows = [0] * slots, [0] * slots
    for x in df.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).toLocalIterator():
        size[x["vslot"]], rows[x["vslot"]] = x["b"], x["n"]
    return size, rows


def placed(df: DataFrame, slot_map: SlotMap, rows: list[int], order: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``shard`` and the gapless place in it, ``slot``; numbering runs cell by cell, so no task holds a shard or a full slot.

    ``df`` is a stored table with ``row``, a number of its own for each row, which tells the cells of a slot.
    """
    first, seen = [], [0] * slot_map.shards
    for s, n in enumerate(slot_map.shard_of):
        first.append(seen[n])
        seen[n] += rows[s]
    most = max(cell_rows, -(-sum(rows) // MOST_CELLS))
    where = slot_map.frame(df.sparkSession, first, [max(1, -(-n // most)) for n in rows]).drop("shards")
    dealt = df.join(F.broadcast(where), "vslot").withColumn("__cell", F.pmod(F.xxhash64("row"), "cells"))
    held = dealt.groupBy("vslot", "__cell").agg(F.count(F.lit(1)).alias("__held"))
    before = F.sum("__held").over(W.partitionBy("vslot").orderBy("__cell")) - F.col("__held")
    held = held.select("vslot", "__cell", before.alias("__before"))  # at most MOST_CELLS rows and one for each slot
    numbered = dealt.withColumn("__n", F.row_number().over(W.partitionBy("vslot", "__cell").orderBy(*order, "row")))
    out = numbered.join(F.broadcast(held), ["vslot", "__cell"])
    return out.withColumn("slot", F.col("first_row") + F.col("__before") + F.col("__n") - 1).select(*[c for c in df.columns if c != "row"], "version", "shard", "slot")


def even(weight: list[int], slot_map: SlotMap) -> bool:
    """Whether no shard has more than ``UNEVEN`` of the mean above the lightest one."""
    load = [0] * slot_map.shards
    for s, n in enumerate(slot_map.shard_of):
        load[n] += weight[s]
    return (max(load) - min(load)) * slot_map.shards <= UNEVEN * sum(load)


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Deals ``docs`` (doc_id, text) to shards of nearly equal bytes, by the map stored at ``map_path`` if one is given.

    Returns doc_id, size (UTF-8 bytes and one), text_crc32, vslot, version, shard, slot. Which of equal rows gets which place
    makes no difference.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(
        F.col("doc_id"),
        (F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), slots=slots).alias("vslot"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = written(base, "sizes")  # row numbers are fixed by being stored
    size, rows = slot_weights(base, slots)
    spark = docs.sparkSession
    known = stored_map(spark, map_path) if map_path else None
    if known is not None and len(known.shard_of) != slots:
        raise ValueError(f"the stored map has {len(known.shard_of)} slots")
    slot_map = known or initial_map(shards, slots)
    if known is None or slot_map.shards != shards or not even(size, slot_map):
        edited = rebalanced(slot_map, size, shards)
        if (edited.shard_of, edited.shards) != (slot_map.shard_of, slot_map.shards) or known is None:
            slot_map = edited
            if map_path:
                slot_map.store(spark, map_path)
    return placed(base, slot_map, rows, ["doc_id", "text_crc32", "size"])
