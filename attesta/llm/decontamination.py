"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents.

Texts are read as words. All windows of the same number of words form one pattern set. A shift table over blocks of two
words says how far a search position may jump without missing a window; where it may not jump, the hash of the last
block selects the patterns to compare, and the words themselves are compared. Positions advance side by side in many
stretches of the documents at once.

Null texts have no words and no hits. Items without an id are not searched for; several rows with one id are one item.
Documents are judged row by row, so repeated ids and rows make no difference. An empty table of documents gives an empty
result, an empty benchmark no hits. Texts are read whole; helper columns give way to names that the input has.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrow_text import LOWER, lookup, mixed, runs, span_hashes, words
from attesta.llm.shared import matching_rows, row_key

WINDOW = 10
#: Most bytes of benchmark text whose patterns go to every task; a larger benchmark is searched for in several passes.
BLOCK_BYTES = 16 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
IS_WORD = lookup(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
STRETCH = 256


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(ASCII_LOWER))


def windows_of(items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[tuple[str, ...], set[int]]:
    """All windows, with the ids of the items that have them."""
    found: dict[tuple[str, ...], set[int]] = defaultdict(set)
    for item, text in items:
        own = item_words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            found[tuple(own[i : i + window])].add(item)
    return found


def block_key(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    return a if b is None else mixed(a * np.uint64(3) + b)


class WuManber:
    """Searches arrays of word hashes for patterns of ``m`` words."""

    def __init__(self, m: int, patterns: list[tuple[str, ...]]) -> None:
        flat = "".join(w for p in patterns for w in p).encode()
        ends = np.cumsum([len(w.encode()) for p in patterns for w in p])
        starts = np.concatenate(([0], ends[:-1]))
        self.m, self.block = m, min(2, m)
        self.hashes = span_hashes(np.frombuffer(flat, np.uint8), starts, ends).reshape(-1, m)
        bits = max(12, int(len(patterns) * m).bit_length() + 3)
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int64)
        for last in range(self.block, m + 1):
            np.minimum.at(self.shift, self._block(self.hashes, last) & self.mask, m - last)
        suffix = self._block(self.hashes, m)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.words = [" ".join(p).encode() for p in patterns]

    def _block(self, rows: np.ndarray, last: int) -> np.ndarray:
        return block_key(rows[:, last - self.block], rows[:, last - 1] if self.block == 2 else None)

    def candidates(self, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows may start, and the number of the pattern; all words of the two have equal hashes."""
        m = self.m
        begin, end = first[:-1] + m, first[1:] + 1  # a window's words end before these places
        n = np.maximum(0, -(-(end - begin) // STRETCH))
        row = np.repeat(np.arange(len(n)), n)
        at = begin[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        to = np.minimum(at + STRETCH, end[row])
        stops = []
        while len(at):
            key = block_key(w[at - self.block], w[at - 1] if self.block == 2 else None)
            jump = self.shift[key & self.mask]
            stop = jump == 0
            stops.append((at[stop], key[stop]))
            at = at + np.maximum(jump, 1)
            on = at < to
            at, to = at[on], to[on]
        if not stops:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, key = (np.concatenate(x) for x in zip(*stops, strict=True))
        lo, hi = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        which = np.repeat(np.arange(len(at)), hi - lo)
        pattern = self.order[lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
        start = at[which] - m
        same = np.ones(len(start), bool)
        for j in range(m):
            same &= w[start + j] == self.hashes[pattern, j]
        return start[same], pattern[same]


def hits(docs: DataFrame, windows: dict[tuple[str, ...], set[int]]) -> DataFrame:
    """(__id, __text, doc_id, n_words, spans, items) for each row: word spans of the occurrences, and the items' ids."""
    groups: dict[int, list[tuple[str, ...]]] = defaultdict(list)
    for p in sorted(windows):
        groups[len(p)].append(p)
    owners = {m: [sorted(windows[p]) for p in ps] for m, ps in groups.items()}
    made: dict[int, WuManber] = {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, patterns in groups.items():
            if m not in made:
                made[m] = WuManber(m, patterns)
        for rows, data, offsets in runs(batches):
            starts, ends, first = words(data, offsets, IS_WORD)
            w = span_hashes(data, starts, ends, LOWER)
            spans: dict[int, set] = defaultdict(set)
            items: dict[int, set] = defaultdict(set)
            for m, search in made.items():
                begin, pattern = search.candidates(w, first)
                row = np.searchsorted(first, begin, "right") - 1
                for b, p, r in zip(begin.tolist(), pattern.tolist(), row.tolist(), strict=True):
                    if b" ".join(LOWER[data[starts[i] : ends[i]]].tobytes() for i in range(b, b + m)) == search.words[p]:
                        spans[r].add((b - int(first[r]), b - int(first[r]) + m))
                        items[r].update(owners[m][p])
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in ("__id", "__text", "doc_id")),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([[{"begin": a, "end": b} for a, b in sorted(spans.get(i, ()))] for i in range(n)], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                    pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.int64())),
                ],
                names=["__id", "__text", "doc_id", "n_words", "spans", "items"],
            )

    rows = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "__id long, __text long, doc_id long, n_words long, spans array<struct<begin:int,end:int>>, items array<long>")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(__id, __text, doc_id, n_words, n_hit, spans, items) for each row of ``docs``.

    A benchmark of more than ``block_bytes`` is searched for in blocks of items, one pass over the documents each.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        one = hits(docs, windows_of([(x["item_id"], x["text"]) for x in own.collect()], window))
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        per_key = found.groupBy("__id", "__text").agg(F.first("n_words").alias("n_words"), all_of("spans"), all_of("items"))
        found = docs.select(*row_key(), F.col("doc_id").cast("long").alias("doc_id")).join(per_key, ["__id", "__text"])
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"] - 1))))
    return found.select("__id", "__text", "doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), "spans", "items")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with all its columns, less the rows in which a window occurs."""
    return matching_rows(docs, scan(docs, benchmark, window).filter("n_hit > 0"), "left_anti")
