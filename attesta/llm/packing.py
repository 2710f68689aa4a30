"""Best-fit packing of token pieces into sequences of a fixed capacity, planned over a histogram of lengths.

The plan is made from how many pieces have each length, not from the pieces: lengths go from long to short, each into the
tightest sequences that still hold it, a whole group of equal sequences at a time. Its size depends on the capacity, not
on the input. Pieces then take their planned places by rank: a piece's rank among those of its length is its number
within a (length, bucket) group plus the sizes of the buckets before, so the most common length has many groups. Buckets go
by stored row number, so equal pieces are spread as well.

Null and empty texts are one piece with the end id alone. Rows with equal id and text are packed each for itself. An empty
table gives no pieces. Texts are read whole, and other columns are not looked at. The plan's ties go to the sequence opened
last.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.arrow_text import runs
from attesta.llm.shared import checkpoint
from attesta.llm.token_ids import encoder

CAPACITY = 1024
#: Pieces in a (length, bucket) group, about; there are as many buckets as that takes.
BUCKET_ROWS = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece: its document's id, number, start and length, and the CRC-32 of its ids (and the ids).

    A text longer than ``capacity`` ids is cut from its end, so only the first piece may be shorter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for rows, data, offsets in runs(batches):
            ids, first = enc.encode(data, offsets)
            out: list[list] = [[], [], [], [], [], []]
            for i, doc in enumerate(rows.column("doc_id").to_pylist()):
                own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for col, v in zip(out, (doc, n, a, b - a, zlib.crc32(own[a:b].tobytes()), own[a:b].astype(np.int32) if with_ids else None), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))[: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, PIECES + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest first, over counts of lengths.

    Returns rows (length, rank, sequence, offset, n): the n pieces of that length from that rank on stand at ``offset``
    in the n sequences from that number on; and the number of sequences.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give(room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((sequence, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                sequence, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[i]
            else:
                room, sequence, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            whole = min(n, left // each)
            for layer in range(each if whole else 0):
                rows.append((length, rank + layer * whole, sequence, capacity - room + layer * length, whole))
            give(room - each * length, sequence, whole)
            rank, left, sequence, n = rank + each * whole, left - each * whole, sequence + whole, n - whole
            if n and left:  # fewer are left than one more sequence would hold
                rest = min(left, each)
                rows += [(length, rank + k, sequence, capacity - room + k * length, 1) for k in range(rest)]
                give(room - rest * length, sequence, 1)
                rank, left, sequence, n = rank + rest, left - rest, sequence + 1, n - 1
            give(room, sequence, n)
    return rows, opened


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """``pieces`` with ``rank``, gapless from 0 within each length. ``pieces`` is stored, so its rows keep their numbers."""
    cols = pieces.columns
    dealt = pieces.withColumn("__row", F.monotonically_increasing_id())
    dealt = dealt.withColumn("__b", F.pmod(F.xxhash64("__row"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy("length").orderBy("__b")) - F.col("__n")
    sizes = sizes.select(F.col("length").alias("__l"), F.col("__b").alias("__b2"), before.alias("__before"))
    numbered = dealt.withColumn("__i", F.row_number().over(W.partitionBy("length", "__b").orderBy("__row")) - 1)
    joined = numbered.join(sizes, (F.col("length") == F.col("__l")) & (F.col("__b") == F.col("__b2")))
    return joined.select(*cols, (F.col("__before") + F.col("__i")).alias("rank"))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces``, a checkpoint or another stored table, with ``sequence_id`` and ``offset`` from the plan."""
    counts = {x["length"]: x["count"] for x in pieces.groupBy("length").count().collect()}
    rows, _ = plan(counts, capacity)
    total = sum(counts.values())
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 48) + table[:, 1]
    out = ranked(pieces, max(16, -(-total // BUCKET_ROWS)))
    schema = [f for f in pieces.schema.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            sequence = table[at, 2] + rank - table[at, 1] if len(at) else at
            offset = table[at, 3] if len(at) else at
            keep = [b.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*(f.name for f in schema), "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    return out.mapInArrow(work, StructType([*schema]).add("sequence_id", LongType()).add("offset", LongType()))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents with their places: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(checkpoint(tokenised_pieces(docs, tokenizer, end_id, capacity, with_ids)), capacity)
