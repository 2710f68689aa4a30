"""Similarity join of word-shingle sets by their Jaccard coefficient, with signature trees.

1. Every text becomes the set of its distinct 5-word shingles, as 64-bit hashes. Texts with equal sets are one *class*,
   named by the sum of the set's hashes; from here on there is a row for each class, however many copies it has. A second
   sum tells sets apart that share a name; such names, of which there are hardly any, are replaced.
2. Two sets of coefficient t or more share one of their first n - ceil(t n) + 1 shingles in any common order. The order
   used puts shingles that are common in a bounded sample last. All classes that share such a shingle are named after the
   lowest of them, and all with one name form a *group*: near copies share many shingles, and still meet in few groups.
3. The classes of a group are the leaves of a signature tree: a node holds the OR of its leaves' bitmaps and the range of
   their set sizes. A dual traversal drops pairs of nodes whose largest possible overlap cannot reach t.
4. The pairs that are left are compared on their full sets; the links are joined into components.

Steps 3 and 4 run twice: first all pairs of small groups, and in each large group the most central class against the
rest, then the most central of those that it cannot be linked with, and so on, a few times; then in large groups all
against all, where nodes whose leaves are known to be of one component are dropped. Near copies of one text lie around it,
so the class with the most of what the group has in common is linked to most of those that are linked at all: the first
pass joins them with a comparison each, a group of near copies is not spelled out in pairs, and the second pass misses no
link between different components.

A token or group that very many classes share meets no single task. Tokens are counted with partial aggregates, and those
above a limit are joined in parts. A group above a limit is dealt to blocks: in the first pass each block is compared with
pivots chosen in one of them, in the second the classes outside the group's largest component with all, block by block.

Texts without words, and null texts, have an empty set, no links, and their own id as component. A null id takes part in
links; a component's id is null only if all its ids are. Repeated rows and ties share a class; an empty table gives an empty
result. Texts of any length are read whole. Columns of the input other than doc_id and text are not looked at, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrow_text import LOWER, lookup, mixed, packed_texts, runs, span_hashes, unpack, words
from attesta.llm.components import components
from attesta.llm.shared import discard, fresh, hot_limit, sample_rows, written

WORDS = 5
#: The coefficient from which two sets are linked, in hundredths.
PERCENT = 80
#: The sample that tells common shingles: so many documents, those with the smallest id hashes, and the least count there.
SAMPLE_DOCS, SAMPLE_COUNT = 4000, 3
#: Least and most bits of a class's bitmap; it has four to eight for each shingle.
LEAST_BITS, MOST_BITS = 64, 1 << 15
LEAVES = 16
#: Classes of a group, or of each tree of a large one, that a pass compares with the rest; at most LEAVES, or all of them.
PIVOTS = (8, None)
#: A token of more postings, and a group of more classes, is dealt to several tasks.
HOT_ROWS, BLOCK = 50_000, 1024
#: Bytes of bitmaps that a step of the traversal compares at once.
STEP_BYTES = 16 << 20
#: Names that different sets share; more of them than chance allows would mean a broken hash.
MOST_MIXED = 10_000
IS_WORD = lookup(b"\x20\x09\x0a\x0b\x0c\x0d", rest=True)


@dataclass(frozen=True)
class Rule:
    words: int = WORDS
    percent: int = PERCENT

    def prefix(self, n: np.ndarray | int):
        return n - -(-self.percent * n // 100) + 1

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, first = words(data, offsets, IS_WORD)
    w = span_hashes(data, starts, ends, LOWER)
    whole = max(0, len(w) - size + 1)
    key = np.zeros(whole, np.uint64)
    for j in range(size):
        key = mixed(key * np.uint64(3) + w[j : j + whole])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(key[a : b - size + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for i in range(a, b):
                one = mixed(one * np.uint64(5) + w[i : i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def width(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (4 * n - 1).bit_length()))


def bitmap(own: np.ndarray) -> bytes:
    bits = width(len(own))
    flags = np.zeros(bits, bool)
    flags[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (the last axis has 64-bit words) at half their width."""
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


def narrowed(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        bits = folded(bits)
    return bits


def most_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """The largest overlap that two sets with these bitmaps and sizes can have."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) > len(y):
        x = folded(x)
    while len(y) > len(x):
        y = folded(y)
    count = lambda v: int(np.bitwise_count(v).sum())
    return min(n_a - count(x & ~y), n_b - count(y & ~x))


def class_sums(own: np.ndarray) -> tuple[int, int]:
    return tuple(int(mixed(x).sum(dtype=np.uint64).astype(np.int64)) for x in (own, own ^ np.uint64(0x9E3779B97F4A7C15)))


def class_of(own: np.ndarray, shared_names: frozenset[int] = frozenset()) -> int:
    first, second = class_sums(own) if shared_names else (int(mixed(own).sum(dtype=np.uint64).astype(np.int64)), 0)
    return second if first in shared_names else first


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, row_no, n, class, second, bits) for each row; ``row_no`` tells rows apart that share an id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in runs(batches):
            sets = shingle_sets(data, offsets, rule.words)
            sums = [class_sums(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in ("doc_id", "row_no")),
                    pa.array([len(x) for x in sets], pa.int64()),
                    *(pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)),
                    pa.array([bitmap(x) for x in sets], pa.binary()),
                ],
                names=["doc_id", "row_no", "n", "class", "second", "bits"],
            )

    return docs.mapInArrow(work, "doc_id long, row_no long, n long, class long, second long, bits binary")


def named_classes(sketch: DataFrame) -> DataFrame:
    """(class, low, n, bits, mixed) of the sets with words; ``mixed``: different sets share the name."""
    lowest_id = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_no").alias("no"))
    out = sketch.filter("n > 0").groupBy("class").agg(
        F.min(lowest_id).alias("low"), F.first("n").alias("n"), F.first("bits").alias("bits"), (F.min("second") != F.max("second")).alias("mixed")
    )
    return written(out, "classes")


def common_shingles(docs: DataFrame, rule: Rule) -> np.ndarray:
    """Hashes that ``SAMPLE_COUNT`` or more documents of the sample have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in runs(batches):
            sets = shingle_sets(data, offsets, rule.words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64), pa.int64())], names=["h"])

    some = sample_rows(docs.select("doc_id", "row_no", "text"), SAMPLE_DOCS, "doc_id", "row_no").select("text")
    many = some.mapInArrow(work, "h long").groupBy("h").count().filter(F.col("count") >= SAMPLE_COUNT)
    return np.sort(np.array([x["h"] for x in many.select("h").collect()], np.int64).view(np.uint64))


def postings(docs: DataFrame, rule: Rule, common: np.ndarray, shared_names: frozenset[int] = frozenset()) -> DataFrame:
    """(token, class): the first shingles of each set, those of ``common`` last in the order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in runs(batches):
            seen: dict[int, np.ndarray] = {}
            for own in shingle_sets(data, offsets, rule.words):
                if len(own) and (name := class_of(own, shared_names)) not in seen:
                    if len(common):
                        known = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
                        own = np.concatenate((own[~known], own[known]))
                    seen[name] = own[: rule.prefix(len(own))]
            took = [len(p) for p in seen.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(0, np.uint64), *seen.values()]).view(np.int64), pa.int64()),
                    pa.array(np.repeat(np.array(list(seen), np.int64), took), pa.int64()),
                ],
                names=["token", "class"],
            )

    return docs.select("text").mapInArrow(work, "token long, class long")


def shared_groups(rows: DataFrame) -> DataFrame:
    """(lo, class): for each token that two classes or more have among their first shingles, those classes under the name
    of the lowest. ``rows`` must be cheap to read again."""
    ends = rows.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("many"))
    limit = hot_limit(rows.count(), HOT_ROWS)
    parts = F.ceil(F.col("many") / limit).cast("int")
    shared = written(ends.filter("lo <> hi").select("token", "lo", parts.alias("parts")), "tokens")
    hot = shared.filter("parts > 1").select("token", "parts")
    dealt = rows.join(F.broadcast(hot), "token", "left").select("token", "class", F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    keys = shared.select("token", "lo", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    out = written(dealt.join(keys, ["token", "part"]).select("lo", "class").distinct(), "shared")
    discard(shared)
    return out


# Signature trees


@dataclass
class Tree:
    """Levels from the leaves up; each has the OR of the bitmaps, the size range, and the one component, or -1."""

    bits: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    spare: list[np.ndarray]  # most shingles of a leaf that share a bit with others of it
    label: list[np.ndarray]

    @staticmethod
    def of(bits: np.ndarray, n: np.ndarray, label: np.ndarray) -> Tree:
        spare = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
        t = Tree([bits], [n], [n], [spare], [label])
        while len(t.low[-1]) > 1:
            at = np.arange(0, len(t.low[-1]), LEAVES)
            lo, hi = np.minimum.reduceat(t.label[-1], at), np.maximum.reduceat(t.label[-1], at)
            t.bits.append(np.bitwise_or.reduceat(t.bits[-1], at, axis=0))
            t.low.append(np.minimum.reduceat(t.low[-1], at))
            t.high.append(np.maximum.reduceat(t.high[-1], at))
            t.spare.append(np.maximum.reduceat(t.spare[-1], at))
            t.label.append(np.where(lo == hi, lo, -1))
        return t

    def may_link(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether some leaf under node x and some leaf under node y can reach the coefficient."""
        low, high = self.low[level], self.high[level]
        sizes = (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
        apart = (self.label[level][x] < 0) | (self.label[level][x] != self.label[level][y])
        overlap = np.bitwise_count(self.bits[level][x] & self.bits[level][y]).sum(1, dtype=np.int64)
        overlap += np.minimum(self.spare[level][x], self.spare[level][y])
        return sizes & apart & ((100 + percent) * overlap >= percent * (low[x] + low[y]))

    def pairs(self, percent: int, pivots: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Leaf pairs that the dual traversal is left with; ``pivots``: only those of the first so many leaves."""
        top = len(self.low) - 1
        zero, found = np.zeros(1, np.int64), []
        todo = [(top, zero, zero)] if top else []
        most = max(1, STEP_BYTES // self.bits[0].itemsize // self.bits[0].shape[1] // LEAVES**2)
        while todo:
            level, x, y = todo.pop()
            if len(x) > most:
                todo.append((level, x[most:], y[most:]))
                x, y = x[:most], y[:most]
            n, size = len(x), len(self.low[level - 1])
            cx = np.repeat(x * LEAVES, LEAVES**2) + np.tile(np.repeat(np.arange(LEAVES), LEAVES), n)
            cy = np.repeat(y * LEAVES, LEAVES**2) + np.tile(np.arange(LEAVES), n * LEAVES)
            ok = (cy < size) & ((cx <= cy) if level > 1 else (cx < cy))
            if pivots is not None:
                ok &= cx < (pivots if level == 1 else 1)
            cx, cy = cx[ok], cy[ok]
            ok = self.may_link(level - 1, cx, cy, percent)
            if level > 1:
                todo.append((level - 1, cx[ok], cy[ok]))
            else:
                found.append((cx[ok], cy[ok]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (none, none)


def centrality(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """About the mean coefficient of each row's set with the others, from the part of the rows that has each of its bits."""
    raw = bits.view(np.uint8)
    step = max(1, STEP_BYTES // (8 * raw.shape[1]))
    flags = lambda i: np.unpackbits(raw[i : i + step], axis=1, bitorder="little")
    part = sum(flags(i).sum(0, dtype=np.int64) for i in range(0, len(raw), step)) / len(raw)
    common = np.concatenate([flags(i) @ part for i in range(0, len(raw), step)])
    return common / (n + n.mean() - common)


def pivot_classes(name: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int, pivots: int | None) -> np.ndarray:
    """Which rows are pivots: the most central one, then the most central of those that no pivot so far may be linked to."""
    if pivots is None:
        return np.ones(len(name), bool)
    out, open_ = np.zeros(len(name), bool), np.ones(len(name), bool)
    order = np.lexsort((name, -centrality(bits, n)))
    spare = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
    for _ in range(pivots):
        if not len(order := order[open_[order]]):
            break
        i = order[0]
        overlap = np.bitwise_count(bits & bits[i]).sum(1, dtype=np.int64) + np.minimum(spare, spare[i])
        open_ &= (100 + percent) * overlap < percent * (n + n[i])
        out[i], open_[i] = True, False
    return out


def tree_pairs(name: np.ndarray, n: np.ndarray, label: np.ndarray, raw: list[bytes], percent: int, pivots: int | None, given: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The pairs of a group that its trees leave; ``pivots``: only those of the classes that ``given`` marks, or that
    :func:`pivot_classes` names.

    There is a tree for each width of bitmaps, with all wider ones folded in whose sizes can be linked.
    """
    wide = np.array([8 * len(x) for x in raw])
    label = np.unique(label, return_inverse=True)[1]  # not below 0: -1 stands for nodes of several components
    out: set[tuple[int, int]] = set()
    for w in np.unique(wide).tolist():
        top = n[wide == w].max()
        rows = np.flatnonzero((wide == w) | ((wide > w) & (percent * n <= 100 * top)))
        bits = np.stack([narrowed(np.frombuffer(raw[i], np.uint64), w // 64) for i in rows])
        first = given[rows] if pivots is not None and given is not None and given.any() else pivot_classes(name[rows], n[rows], bits, percent, pivots)
        order = np.lexsort((bits[:, 0], n[rows], ~first))
        x, y = Tree.of(bits[order], n[rows][order], label[rows][order]).pairs(percent, None if pivots is None else int(first.sum()))
        a, b = name[rows][order][x], name[rows][order][y]
        out.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
    return sorted(out)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in order of ``lo`` as tables that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        key = batch.column("lo").to_numpy()
        if not len(key) or key[0] == key[-1] == held[0].column("lo")[0].as_py():
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column("lo").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def candidate_pairs(groups: DataFrame, rule: Rule, pivots: int | None) -> DataFrame:
    """(a, b), a < b: pairs of classes that a group's signature trees leave, from (lo, class, n, bits, label, pivot).

    Groups are streamed in order of name. A task holds one group or block of a group at a time, some hundred bytes to some
    kilobytes for each class.
    """
    percent = rule.percent

    def small_pairs(key: np.ndarray, name: np.ndarray, n: np.ndarray, label: np.ndarray, raw: list[bytes]) -> list[tuple[int, int]]:
        """The same for many groups of at most LEAVES classes, which are trees of one level, side by side."""
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        after = np.repeat(first + size, size) - np.arange(len(key)) - 1  # rows of the group after each
        x = np.repeat(np.arange(len(key)), after)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)
        ok = (100 * n[x] >= percent * n[y]) & (100 * n[y] >= percent * n[x]) & (label[x] != label[y])
        out = []
        for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
            if rule.linked(most_common(raw[i], int(n[i]), raw[j], int(n[j])), int(n[i]), int(n[j])):
                out.append((min(int(name[i]), int(name[j])), max(int(name[i]), int(name[j]))))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()

        def flush(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            key, name, n, label = (whole.column(c).to_numpy() for c in ("lo", "class", "n", "label"))
            if not len(key):
                return
            given = whole.column("pivot").to_numpy()
            raw = whole.column("bits").to_pylist()
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            few = np.flatnonzero(np.repeat(size <= LEAVES, size))
            got = small_pairs(key[few], name[few], n[few], label[few], [raw[i] for i in few]) if len(few) else []
            for f, s in zip(first[size > LEAVES].tolist(), size[size > LEAVES].tolist(), strict=True):
                at = slice(f, f + s)
                got += tree_pairs(name[at], n[at], label[at], raw[at], percent, pivots, given[at])
            if len(done) > 100_000:
                done.clear()
            new = [p for p in dict.fromkeys(got) if p not in done]
            done.update(new)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in new], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for whole in whole_groups(batches):
            yield from flush(whole)

    ordered = groups.repartition("lo").sortWithinPartitions("lo").select("lo", "class", "n", "bits", "label", "pivot")
    return ordered.mapInArrow(work, "a long, b long").distinct()


def chosen_pivots(blocks: DataFrame, rule: Rule, pivots: int) -> DataFrame:
    """(lo, class): the pivots of each width of bitmaps, from one block (lo, class, n, bits) of each group."""
    percent = rule.percent

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches):
            key, name, n = (whole.column(c).to_numpy() for c in ("lo", "class", "n"))
            raw = whole.column("bits").to_pylist()
            wide = np.array([len(x) for x in raw])
            out: list[tuple[int, int]] = []
            for lo in np.unique(key).tolist():
                for w in np.unique(wide[key == lo]).tolist():
                    at = np.flatnonzero((key == lo) & (wide == w))
                    bits = np.stack([np.frombuffer(raw[i], np.uint64) for i in at])
                    out += [(lo, c) for c in name[at][pivot_classes(name[at], n[at], bits, percent, pivots)].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["lo", "class"])

    ordered = blocks.repartition("lo").sortWithinPartitions("lo").select("lo", "class", "n", "bits")
    return ordered.mapInArrow(work, "lo long, class long")


def blocks_of(n: str, salt: int = 0) -> Column:
    """A class's block of as many as column ``n`` says; 0 where it is null."""
    return F.pmod(F.xxhash64("class", F.lit(salt)), F.coalesce(n, F.lit(1))).cast("int")


def first_groups(shared: DataFrame, hot: DataFrame, bits: DataFrame, rule: Rule, pivots: int) -> DataFrame:
    """The rows of :func:`candidate_pairs` for the first pass. Blocks of ``hot`` groups (lo, parts) have pivots of one of them."""
    rows = shared.join(F.broadcast(hot), "lo", "left").withColumn("part", blocks_of("parts"))
    rows = rows.join(bits, "class")
    key = F.when(F.col("part") == 0, F.col("lo")).otherwise(F.xxhash64("lo", "part"))
    own = rows.select(key.alias("lo"), "class", "n", "bits", F.col("class").alias("label"), F.lit(False).alias("pivot"))
    if hot.isEmpty():
        return own
    chosen = written(chosen_pivots(rows.filter("parts > 1 and part = 0"), rule, pivots), "pivots")
    more = chosen.join(F.broadcast(hot), "lo").withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts") - 1))).join(bits, "class")
    return own.unionByName(more.select(key.alias("lo"), "class", "n", "bits", F.col("class").alias("label"), F.lit(True).alias("pivot")))


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sets reach the coefficient; ``texts`` has (class, packed)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sets: dict[int, np.ndarray] = {}
            ok = []
            cols = (rows.column(c).to_pylist() for c in ("a", "packed_a", "packed_b"))
            for a, pa_, pb in zip(*cols, strict=True):
                if a not in sets:
                    sets = {a: unpacked_set(pa_, rule.words)}
                b = unpacked_set(pb, rule.words)
                ok.append(rule.linked(len(np.intersect1d(sets[a], b, assume_unique=True)), len(sets[a]), len(b)))
            yield rows.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda k: texts.select(F.col("class").alias(k), F.col("packed").alias(f"packed_{k}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "packed_a", "packed_b").mapInArrow(work, "a long, b long")


def unpacked_set(packed: bytes, size: int) -> np.ndarray:
    raw = np.frombuffer(unpack(packed), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]), size)[0]


def join(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, row_no, n_shingles, class, component_id, first) for each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest id that the row's document is connected to. ``first`` is true for one row of each
    component: the one with the smallest id, then the smallest ``row_no``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_no"), "text")
    sketch = written(sketches(rows, rule), "sketches")
    classes = named_classes(sketch)
    shared_names = frozenset(x["class"] for x in classes.filter("mixed").select("class").limit(MOST_MIXED + 1).collect())
    if len(shared_names) > MOST_MIXED:
        raise ValueError("too many different sets share a name")
    if shared_names:
        sketch = sketch.withColumn("class", F.when(F.col("class").isin(*shared_names), F.col("second")).otherwise(F.col("class")))
        classes = named_classes(sketch)
    posted = written(postings(rows, rule, common_shingles(rows, rule), shared_names), "postings")
    shared = shared_groups(posted)
    discard(posted)
    limit = hot_limit(shared.count(), BLOCK)
    hot = written(shared.groupBy("lo").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("lo", F.ceil(F.col("n") / limit).cast("int").alias("parts")), "hot")

    bits = classes.select("class", "n", "bits")
    links, tried, found = None, None, None
    for pivots in PIVOTS:
        groups = first_groups(shared, hot, bits, rule, pivots) if found is None else mixed_groups(shared, hot, bits, found, limit)
        pairs = candidate_pairs(groups, rule, pivots)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if links is not None and pairs.isEmpty():
            continue
        texts = class_texts(rows, classes, pairs)
        new = verified(pairs, texts, rule)
        links = written(new if links is None else links.unionByName(new), "links")
        discard(texts)
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = components(links)

    discard(shared, hot)
    named = classes.join(found, F.col("class") == F.col("node"), "left").select("class", "low", F.coalesce("root", "class").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("first_of"))
    ids = named.select("class", "root").join(low, "root").select(F.col("class").alias("__class"), "first_of")
    out = sketch.join(ids, (F.col("class") == F.col("__class")) & (F.col("n") > 0), "left")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_no").alias("no"))
    return out.select(
        "doc_id",
        "row_no",
        F.col("n").alias("n_shingles"),
        "class",
        F.when(F.col("first_of").isNull(), F.col("doc_id")).otherwise(F.col("first_of.id")).alias("component_id"),
        F.coalesce(own == F.col("first_of"), F.lit(True)).alias("first"),
    )


def mixed_groups(shared: DataFrame, hot: DataFrame, bits: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """The rows of :func:`candidate_pairs` for large groups with more than one component, which is their ``label``.

    Of a ``hot`` group the classes outside its largest component meet all of the group, a block of the ones with a block
    of the others in each task.
    """
    labelled = shared.join(found.select(F.col("node").alias("class"), "root"), "class", "left").select("lo", "class", F.coalesce("root", "class").alias("label"))
    labelled = labelled.join(F.broadcast(hot), "lo", "left")
    plain = labelled.filter("parts is null")
    ends = plain.groupBy("lo").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count(F.lit(1)).alias("many"))
    ends = ends.filter((F.col("first") != F.col("last")) & (F.col("many") > LEAVES)).select("lo")
    out = plain.join(ends, "lo", "left_semi").select("lo", "class", "label")
    if not hot.isEmpty():
        sizes = labelled.filter("parts is not null").groupBy("lo", "label", "parts").agg(F.count(F.lit(1)).alias("n"))
        rest = F.sum("n") - F.max("n")
        plan = sizes.groupBy("lo", "parts").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.ceil(rest / limit).cast("int").alias("others")).filter("others > 0")
        plan = written(plan, "blocks").withColumnRenamed("parts", "all_parts")
        rows = labelled.filter("parts is not null").drop("parts").join(F.broadcast(plan), "lo")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        as_all = rows.withColumn("i", each("others")).withColumn("j", blocks_of("all_parts"))
        as_other = rows.filter("label <> main").withColumn("i", blocks_of("others", 1)).withColumn("j", each("all_parts"))
        both = as_all.unionByName(as_other).select(F.xxhash64("lo", "i", "j").alias("lo"), "class", "label")
        out = out.unionByName(both.distinct())
    return out.join(bits, "class").withColumn("pivot", F.lit(False))


def class_texts(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, packed) for the classes that ``pairs`` names, from the class's first row."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    keys = classes.join(wanted, "class").select("class", F.col("low.id").alias("__low"), F.col("low.no").alias("__no"))
    found = packed_texts(rows, ["doc_id", "row_no"]).join(keys, F.col("doc_id").eqNullSafe(F.col("__low")) & (F.col("row_no") == F.col("__no"))).select("class", "packed")
    return written(found.dropDuplicates(["class"]), "texts")


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` with all its columns, and of each component only its first row."""
    a, b, c, d, e, n = (fresh(docs.columns, x) for x in ("__own_id", "__own_no", "__alone", "__first_id", "__first_no", "__shingles"))
    keep = join(docs, rule).filter("first").select(F.col("doc_id").alias(d), F.col("row_no").alias(e), F.col("n_shingles").alias(n)).distinct()
    keyed = docs.withColumns({a: F.col("doc_id").cast("long"), b: F.xxhash64("text")})
    kept = keyed.join(keep, F.col(a).eqNullSafe(F.col(d)) & (F.col(b) == F.col(e)))
    # Of rows with equal id and text one stays; those without words are no copies of each other.
    alone = kept.withColumn(c, F.when(F.col(n) == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    return alone.dropDuplicates([a, b, c]).select(*docs.columns)
