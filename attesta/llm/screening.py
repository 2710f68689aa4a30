"""A count-min sketch of pairs of longs that only tells whether a pair was counted once.

A cell needs two bits: seen, and seen again. Each task fills a sketch of its own rows; sketches are merged block by block, in
two steps, so no task meets more than some blocks of a part of the tasks. What the driver gathers and broadcasts is one sketch,
whose size is a parameter. A pair may be called common though it is not; it is never called single wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StructField, StructType

ROWS = 4
#: Cells of a row at least and, by default, at most: a sketch of at most 4 x 2**24 cells of two bits, which is 16 MB.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 24
#: Cells of a block, and parts of the tasks that are merged first.
BLOCK, PARTS = 1 << 16, 64


def cells_for(n: int, most: int = MOST_CELLS) -> int:
    """Cells of a row for ``n`` pairs: about four each, a power of two, between the least and the most."""
    return min(most, max(LEAST_CELLS, 1 << (4 * max(n, 1) - 1).bit_length()))


def _cells(batch: pa.RecordBatch, cells: int) -> list[np.ndarray]:
    """The cell of each pair in each row of the sketch, by double hashing."""
    a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (0, 1))
    step = b | np.uint64(1)
    return [((a + np.uint64(j) * step) >> np.uint64(8)).astype(np.int64) & (cells - 1) for j in range(ROWS)]


def _merged(seen: list[bytes], again: list[bytes]) -> tuple[bytes, bytes]:
    one = two = np.zeros(len(seen[0]), np.uint8)
    for s, t in zip(seen, again, strict=True):
        s, t = np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)
        one, two = one | s, two | t | (one & s)
    return one.tobytes(), two.tobytes()


def sketch(pairs: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits "seen" and "seen again" of all ``ROWS * cells`` cells, over the two long columns of ``pairs``."""

    size = min(BLOCK, cells)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * cells, np.uint8)
        for batch in batches:
            for j, at in enumerate(_cells(batch, cells)):
                where, n = np.unique(at + j * cells, return_counts=True)
                counts[where] = np.minimum(counts[where] + np.minimum(n, 2), 2)
        blocks = counts.reshape(-1, size)
        part = TaskContext.get().partitionId() % PARTS
        for k in np.flatnonzero(blocks.any(axis=1)):
            seen, again = (np.packbits(blocks[k] >= m).tobytes() for m in (1, 2))
            yield pa.RecordBatch.from_pydict({"block": [int(k)], "part": [part], "seen": [seen], "again": [again]}, schema)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        seen, again = _merged(table["seen"].to_pylist(), table["again"].to_pylist())
        return pa.Table.from_pydict({"block": [key[0].as_py()], "part": [0], "seen": [seen], "again": [again]}, schema)

    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("seen", pa.binary()), ("again", pa.binary())])
    kinds = "block int, part int, seen binary, again binary"
    filled = pairs.mapInArrow(fill, kinds)
    merged = filled.groupBy("block", "part").applyInArrow(merge, kinds).groupBy("block").applyInArrow(merge, kinds)
    out = np.zeros((2, ROWS * cells // 8), np.uint8)
    for r in merged.select("block", "seen", "again").toLocalIterator():
        at = slice(r["block"] * size // 8, (r["block"] + 1) * size // 8)
        out[0, at], out[1, at] = np.frombuffer(r["seen"], np.uint8), np.frombuffer(r["again"], np.uint8)
    return out[0], out[1]


def with_single(rows: DataFrame, first: str, second: str, most_cells: int = MOST_CELLS) -> DataFrame:
    """``rows`` with ``single``: true where the sketch proves that no other row has this pair of longs. ``rows`` is read three
    times: store it before."""
    cells = cells_for(rows.count(), most_cells)
    shared = rows.sparkSession.sparkContext.broadcast(sketch(rows.select(first, second), cells)[1])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = shared.value
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(first), batch.column(second)], [first, second])
            single = np.zeros(batch.num_rows, bool)
            for j, at in enumerate(_cells(pair, cells)):
                at = at + j * cells
                single |= (again[at >> 3] >> (7 - (at & 7))) & 1 == 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single)], [*batch.schema.names, "single"])

    return rows.mapInArrow(judge, StructType([*rows.schema.fields, StructField("single", BooleanType())]))
