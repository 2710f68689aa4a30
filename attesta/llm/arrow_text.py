"""Vector work on the bytes of Arrow text columns, for functions that run inside ``mapInArrow`` tasks.

A batch is handled in runs of rows of a few megabytes, so a task's memory is bounded by that and by its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

RUN_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text (or one row), each with :func:`utf8` of the column."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
            part = batch.slice(at, to - at)
            yield part, *utf8(part.column(column))
            at = to


def lookup(chars: str | bytes, rest: bool = False) -> np.ndarray:
    """A table of 256 flags: true for ``chars``, or for all others."""
    table = np.full(256, rest)
    table[list(chars if isinstance(chars, bytes) else chars.encode())] = not rest
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = lookup(b"\x20\x09\x0a\x0b\x0c\x0d")


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes that stay inside a row, and each row's first word's number."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    flag = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], flag[:-1]))
    starts = np.flatnonzero(flag & (~before | edge[:-1]))
    after = np.concatenate((flag[1:], [False]))
    ends = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES)
            up, down = np.full(n, BASE), np.full(n, INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each of the given spans, which are in order and do not overlap. ``fold`` maps bytes first."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
        lo, hi = starts[at], ends[to - 1]
        up, down = _POWERS.get(int(hi - lo))
        part = data[lo:hi]
        value = (fold[part] if fold is not None else part).astype(np.uint64) + np.uint64(1)
        value *= up[: hi - lo]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * BASE)
        at = to
    return out


def packed_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., packed): the texts compressed for a shuffle, about a third of their size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for part, data, offsets in runs(batches):
            raw = data.tobytes()
            packed = [squeeze.compress(raw[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(packed, pa.binary())], names=[*keys, "packed"])

    return rows.select(*keys, "text").mapInArrow(work, ", ".join(f"{k} long" for k in keys) + ", packed binary")


def unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)
