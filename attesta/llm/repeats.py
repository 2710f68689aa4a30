"""Removal of byte strings that occur twice: threshold-bounded interval expansion.

Every string of ``LENGTH`` bytes that starts at two places of the corpus is removed at all of them. Places that can be
such are found first: in each window of that length the 64-byte gram with the smallest hash is an *anchor*, so two equal
windows share an anchor, and an anchor that occurs once has no part in any repeat.

The occurrences of an anchor are an interval of the corpus' suffix array: their suffixes from the anchor on are sorted,
with the common prefix of neighbours. The bytes before them are that interval's part of the Burrows-Wheeler transform.
Extending the interval backwards by each of these bytes, level by level (a stable counting sort, as in the LF mapping),
gives the intervals of longer strings: a neighbours' common prefix is one more than the least one between their old
places. Intervals of one suffix are dropped, and a window is a repeat as soon as a common prefix reaches the length.

Equal texts are one text here, with all bytes removed if it is long enough. Equal surroundings of an anchor go to the
interval once per task; an anchor with very many different surroundings is split by longer strings that every window in
question contains. Such a string with very many different surroundings of its own, as at the edge of a passage that very
many texts share, is expanded to the windows themselves, each by its own key. Null and empty texts have no bytes. Rows are judged one by one, so repeated ids make no difference, an
empty table gives an empty result, and other columns are not looked at. Anchors are counted with partial aggregates, and
one with very many occurrences is joined in parts.

What is compared how: equal texts are told by two 64-bit hashes, equal surroundings of one anchor, and windows with keys of
their own, by a 128-bit digest and the key; all other repeats byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.arrow_text import _POWERS, mixed, packed_texts, runs
from attesta.llm.shared import discard, hot_limit, written

LENGTH, GRAM = 200, 64
#: An anchor with more occurrences is split by strings of LENGTH - STEP + 1 bytes, and its rows are dealt to several tasks.
#: One of these strings with more surroundings is split into the windows that contain it.
MANY, STEP = 50_000, 16
#: Crowded strings are told from one in so many texts, by hash; that deals the work and changes no result.
SHARE = 16
#: What the keys of windows are salted with; those of strings take smaller numbers.
OWN_KEY = 1 << 20
BLOCK = 1 << 20
#: Hashes that different texts share; more of them than chance allows would mean a broken hash.
MOST_MIXED = 10_000


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which :func:`span_key` gets the hash of any span of ``data``."""
    up, down = _POWERS.get(len(data) + 1)
    value = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64))), down


def span_key(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    return mixed((sums[b] - sums[a]) * down[a] + np.asarray(salt).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def sliding(values: np.ndarray, width: int, op: np.ufunc, empty: int) -> np.ndarray:
    """``op`` over each run of ``width`` values."""
    n = len(values)
    pad = np.full((-n) % width, empty, np.uint64)
    rows = np.concatenate((values, pad)).reshape(-1, width)
    before, after = op.accumulate(rows, 1).ravel(), op.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return op(after[: n - width + 1], before[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows that lie in one row."""
    width = length - GRAM + 1
    places, hashes = [], []
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        sums, down = prefix_sums(part)
        first = np.arange(len(part) - GRAM + 1)
        h = span_key(sums, down, first, first + GRAM)
        low = sliding(h, width, np.minimum, 2**64 - 1)
        row = np.searchsorted(offsets, at + np.arange(len(low)), "right")
        low[at + np.arange(len(low)) + length > offsets[np.minimum(row, len(offsets) - 1)]] = 0
        edge = np.zeros(width - 1, np.uint64)
        high = sliding(np.concatenate((edge, low, edge)), width, np.maximum, 0)
        own = np.flatnonzero((high == h) & (high > 0))
        places.append(own + at)
        hashes.append(h[own])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, one = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[one]


def anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """(h, tid, pos) of the anchors of all texts; a task gives a text once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, data, offsets in runs(batches):
            tid = part.column("tid").to_numpy()
            place, h = anchors(data, offsets, length)
            row = np.searchsorted(offsets, place, "right") - 1
            new = np.zeros(part.num_rows, bool)
            for i, t in enumerate(tid.tolist()):
                if t not in seen:
                    seen.add(t)
                    new[i] = True
            keep = new[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[keep].view(np.int64)), pa.array(tid[row[keep]], pa.int64()), pa.array((place - offsets[row])[keep], pa.int64())], names=["h", "tid", "pos"]
            )

    return rows.select("tid", "text").mapInArrow(work, "h long, tid long, pos long")


def repeated_anchors(found: DataFrame) -> DataFrame:
    """(h, tid, pos, many) of the anchors that occur at two places or more. ``found`` must be cheap to read again."""
    ends = found.groupBy("h").agg(*[f(c).alias(f"{k}_{c}") for c in ("tid", "pos") for k, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n"))
    limit = hot_limit(found.count(), MANY)
    ends = ends.filter("lo_tid <> hi_tid or lo_pos <> hi_pos").select("h", (F.col("n") > MANY).alias("many"), F.ceil(F.col("n") / limit).cast("int").alias("parts"))
    shared = written(ends, "shared")
    hot = shared.filter("parts > 1").select("h", "parts")
    dealt = found.join(F.broadcast(hot), "h", "left").select("h", "tid", "pos", F.pmod(F.xxhash64("tid"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    keys = shared.select("h", "many", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    out = written(dealt.join(keys, ["h", "part"]).select("h", "tid", "pos", "many").distinct(), "anchors")
    discard(shared)
    return out


SURROUNDINGS = "key long, fh binary, tid long, pos long, reach int, kind int, bytes binary"


def surroundings(texts: DataFrame, length: int, crowded: tuple[int, ...] = ()) -> DataFrame:
    """What stands around each anchor, from (tid, packed, at), as rows of ``SURROUNDINGS``.

    kind 0: the bytes from ``reach`` before ``pos`` on; null bytes are a window of its own, which only an equal one matches.
    kind 1: the same ``fh`` was met again by the task. kind 2: a further place of an ``fh`` that the task has met; the
    ``reach`` bytes from ``pos`` on are repeats. Strings with a key in ``crowded`` give way to the windows around them.
    """
    hot = np.sort(np.array(crowded, np.int64).view(np.uint64))

    def cuts(p: np.ndarray, h: np.ndarray, many: np.ndarray, size: int, sums: np.ndarray, down: np.ndarray):
        """(key, place, begin, end): the windows around an anchor, or those of STEP neighbouring starts."""
        few = p[~many]
        yield h[~many], few, np.maximum(few - (length - GRAM), 0), np.minimum(few + length, size)
        starts = [np.zeros(0, np.int64)]
        for j in range(0, length - GRAM + 1, STEP):
            q = p[many] - j
            ok = (q >= 0) & (q + length - STEP + 1 <= size)
            q = q[ok]
            key = span_key(sums, down, q, q + length - STEP + 1, j + 1)
            left = np.minimum(q, min(STEP, length - GRAM + 1 - j) - 1)
            full = np.isin(key, hot)
            yield key[~full], q[~full], (q - left)[~full], np.minimum(q[~full] + length, size)
            first, n = (q - left)[full], left[full] + 1
            starts.append(np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        start = np.unique(np.concatenate(starts))  # a window may hold several crowded strings
        start = start[start + length <= size]
        yield span_key(sums, down, start, start + length, OWN_KEY), start, start, start + length

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        seen: dict[tuple[int, bytes], bool] = {}
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            names = [x.split()[0] for x in SURROUNDINGS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for rows in batches:
            tids, packed, at = rows.column("tid").to_pylist(), rows.column("packed"), rows.column("at")
            flat, ends = at.flatten(), np.concatenate(([0], np.cumsum(at.value_lengths().to_numpy())))
            pos, h = flat.field("pos").to_numpy(), flat.field("h").to_numpy().view(np.uint64)
            many = flat.field("many").to_numpy(zero_copy_only=False).astype(bool)
            for i, tid in enumerate(tids):
                raw = open_.decompress(packed[i].as_py())
                own = slice(ends[i], ends[i + 1])
                sums, down = prefix_sums(np.frombuffer(raw, np.uint8))
                again: list[tuple[int, int]] = []
                for key, place, a, b in cuts(pos[own], h[own], many[own], len(raw), sums, down):
                    whole = len(hot) > 0 and place is a
                    for k, p, x, y in zip(key.view(np.int64).tolist(), place.tolist(), a.tolist(), b.tolist(), strict=True):
                        if y - x < length:
                            continue
                        f = hashlib.blake2b(raw[x:y], digest_size=16, salt=(p - x).to_bytes(4, "little")).digest()
                        if (k, f) not in seen:
                            seen[k, f] = False
                            out.append((k, f, tid, p, p - x, 0, None if whole else raw[x:y]))
                            continue
                        if not seen[k, f]:
                            seen[k, f] = True
                            out.append((k, f, tid, p, 0, 1, None))
                        again.append((x, y))
                for x, y in union(again):
                    out.append((tid, bytes(16), tid, x, y - x, 2, None))
                if len(out) > 4096:
                    yield batch()
                    out.clear()
        yield batch()

    return texts.mapInArrow(work, SURROUNDINGS)


def crowded_keys(found: DataFrame, n_anchors: int, length: int) -> tuple[int, ...]:
    """The keys with too many surroundings for one task, from ``found``: those of one in ``SHARE`` texts with the
    ``n_anchors`` anchors that have many. At most as many keys as :func:`hot_limit` allows."""
    limit = hot_limit(n_anchors * -(-(length - GRAM + 1) // STEP), MANY) / SHARE
    full = found.filter("kind = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return tuple(r["key"] for r in full.select("key").collect())


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with those joined that overlap or touch."""
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [(x, y) for x, y in out]


def expand(key: np.ndarray, left: list[bytes], right: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Which windows of each surrounding are repeats: a flag for each number of bytes before the anchor.

    ``left`` has the bytes before the anchor, ``right`` those from it on. Surroundings with one ``key`` are compared.
    """
    n = len(key)
    reach, ahead = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    deep = int(reach.max(initial=0))
    before = np.frombuffer(b"".join(x[::-1].ljust(deep, b"\0") for x in left), np.uint8).reshape(n, deep) if deep else np.zeros((n, 0), np.uint8)
    wide = -(-length // 8) * 8
    after = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in right), np.uint8).reshape(n, wide)
    marks = np.zeros((n, deep + 1), bool)
    parts = after.view(">u8").astype(np.uint64)
    order = np.lexsort([*parts.T[::-1], key])
    same = after[order[1:]] == after[order[:-1]]
    common = np.where(same.all(1), wide, same.argmin(1))
    common = np.minimum(common, np.minimum(ahead[order[1:]], ahead[order[:-1]]))
    common = np.concatenate(([-1], np.where(key[order[1:]] == key[order[:-1]], common, -1))).astype(np.int64)
    interval = np.cumsum(common < 0)
    for level in range(deep + 1):
        hit = np.flatnonzero((common >= 0) & (common + level >= length))
        marks[order[hit], level] = True
        marks[order[hit - 1], level] = True
        if level == deep:
            break
        at = np.flatnonzero(reach[order] > level)
        at = at[np.argsort(interval[at] * 256 + before[order[at], level], kind="stable")]
        byte = interval[at] * 256 + before[order[at], level]
        joined = np.flatnonzero(byte[1:] == byte[:-1]) + 1
        new = np.full(len(at), -1, np.int64)
        if len(joined):
            bounds = np.stack((at[joined - 1] + 1, at[joined] + 1), 1).ravel()
            new[joined] = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
        alone = (new < 0) & np.append(new[1:] < 0, True)
        order, common = order[at[~alone]], new[~alone]
        interval = np.cumsum(common < 0)
        if not len(order):
            break
    return marks


def repeat_spans(rows: DataFrame, length: int) -> DataFrame:
    """(tid, begin, end): repeats, from the rows of :func:`surroundings`; spans may overlap."""

    def judged(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        key, tid, pos = (whole.column(c).to_numpy() for c in ("key", "tid", "pos"))
        named = whole.column("fh").to_pylist()
        fh = np.frombuffer(b"".join(named), np.uint64).reshape(-1, 2)
        reach, kind = whole.column("reach").to_numpy().astype(np.int64), whole.column("kind").to_numpy()
        got = [(tid[kind == 2], pos[kind == 2], (pos + reach)[kind == 2])]
        own = np.flatnonzero(kind == 0)
        if len(own):
            new = np.concatenate(([True], (key[own[1:]] != key[own[:-1]]) | (fh[own[1:]] != fh[own[:-1]]).any(1)))
            which = np.cumsum(new) - 1  # the distinct surrounding of each row
            one = own[new]
            raw = whole.column("bytes").take(pa.array(one)).to_pylist()
            size = np.array([length if x is None else len(x) for x in raw])
            raw = [x or b"" for x in raw]
            times = np.bincount(which)
            again = {(int(key[i]), named[i]) for i in np.flatnonzero(kind == 1)}
            if again:
                times += np.array([(int(key[i]), named[i]) in again for i in one])
            marks = expand(key[one], [x[:r] for x, r in zip(raw, reach[one].tolist(), strict=True)], [x[r:] for x, r in zip(raw, reach[one].tolist(), strict=True)], length)
            full = times[which] > 1
            begin = (pos - reach)[own]
            got.append((tid[own[full]], begin[full], (begin + size[which])[full]))
            padded = np.pad(marks, ((0, 0), (1, 1))).astype(np.int8)
            r, lo = np.nonzero(np.diff(padded, axis=1) == 1)
            _, hi = np.nonzero(np.diff(padded, axis=1) == -1)  # levels lo to hi - 1, row by row as above
            place = own[new][r]
            single = times[r] == 1
            got.append((tid[place][single], (pos[place] - hi + 1)[single], (pos[place] - lo + length)[single]))
        cols = [np.concatenate(c) for c in zip(*got, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["tid", "begin", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            k = batch.column("key").to_numpy()
            if not len(k) or k[0] == k[-1] and k[0] == held[0].column("key")[0].as_py():
                continue
            whole = pa.Table.from_batches(held)
            keys = whole.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from judged(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
        if held:
            yield from judged(pa.Table.from_batches(held))

    return rows.repartition("key").sortWithinPartitions("key", "fh", "tid", "pos").mapInArrow(work, "tid long, begin long, end long")


def text_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid, text), a text's ``tid`` being its own; and (tid, first, copies) of the distinct texts.

    A hash that different texts share, as a second one tells, is replaced by the second.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), F.xxhash64(F.lit("second"), text).alias("second"), text.alias("text"))
    classes = lambda r: written(r.groupBy("tid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), (F.min("second") != F.max("second")).alias("mixed")), "classes")
    found = classes(rows)
    shared = [x["tid"] for x in found.filter("mixed").select("tid").limit(MOST_MIXED + 1).collect()]
    if len(shared) > MOST_MIXED:
        raise ValueError("too many different texts share a hash")
    if shared:
        rows = rows.withColumn("tid", F.when(F.col("tid").isin(*shared), F.col("second")).otherwise(F.col("tid")))
        found = classes(rows)
    return rows.select("doc_id", "tid", "text"), found.select("tid", "first", "copies")


def for_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tid, packed, at): the text of the rows that ``wanted`` (tid, __first, at) names; equal rows give it again."""
    keyed = wanted.withColumnRenamed("tid", "__tid")
    return packed_texts(rows, ["doc_id", "tid"]).join(keyed, (F.col("tid") == F.col("__tid")) & F.col("doc_id").eqNullSafe(F.col("__first"))).select("tid", "packed", "at")


def spans_by_text(rows: DataFrame, classes: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, first, copies, spans) from the two tables of :func:`text_rows`: for each distinct text the smallest id, how often it occurs, and its repeats.

    ``spans`` are the maximal runs of removed bytes as (begin, end), null if there are none but through copies.
    """
    occurrences = written(anchor_rows(rows, length), "occurrences")
    shared = repeated_anchors(occurrences)
    discard(occurrences)

    def around(texts: DataFrame, anchors_: DataFrame, crowded: tuple[int, ...] = ()) -> DataFrame:
        at = anchors_.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "many"))).alias("at"))
        wanted = at.join(classes.select("tid", F.col("first").alias("__first")), "tid")
        return surroundings(for_texts(texts, wanted), length, crowded)

    some = F.pmod("tid", F.lit(SHARE)) == 0
    hot = shared.filter("many")
    n_hot = hot.count()
    crowded = crowded_keys(around(rows.filter(some), hot.filter(some)), n_hot, length) if n_hot else ()
    found = written(repeat_spans(around(rows, shared, crowded), length), "repeats")
    discard(shared)
    merged = found.groupBy("tid").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    return classes.join(merged.withColumn("spans", joined(F.col("spans"))), "tid", "left")


def joined(spans: Column) -> Column:
    """Sorted spans with those joined that overlap or touch."""
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")

    def step(acc: Column, s: Column) -> Column:
        touch = s["begin"] <= acc["end"]
        done = F.when(touch, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end")))))
        return F.struct(F.when(touch, acc["begin"]).otherwise(s["begin"]).alias("begin"), F.when(touch, F.greatest(acc["end"], s["end"])).otherwise(s["end"]).alias("end"), done.alias("done"))

    start = F.struct(spans[0]["begin"].alias("begin"), spans[0]["end"].alias("end"), none.alias("done"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end")))))


def cut(texts: DataFrame) -> DataFrame:
    """(tid, kept): the bytes of (tid, packed, at) outside the spans ``at``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor()
        for rows in batches:
            kept = []
            for packed, spans in zip(rows.column("packed").to_pylist(), rows.column("at").to_pylist(), strict=True):
                raw, at, out = open_.decompress(packed), 0, []
                for s in spans:
                    out.append(raw[at : s["begin"]])
                    at = s["end"]
                kept.append(b"".join([*out, raw[at:]]))
            yield pa.RecordBatch.from_arrays([rows.column("tid"), pa.array(kept, pa.binary())], names=["tid", "kept"])

    return texts.mapInArrow(work, "tid long, kept binary")


def removal(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256) for each row: the removed spans, and the hash of the bytes that stay."""
    rows, classes = text_rows(docs)
    by_text = written(spans_by_text(rows, classes, length).filter("copies > 1 or spans is not null"), "spans")
    partly = by_text.filter("copies = 1").select("tid", F.col("first").alias("__first"), F.col("spans").alias("at"))
    kept = cut(for_texts(rows, partly)).select("tid", F.sha2("kept", 256).alias("__sha"))
    known = by_text.select(F.col("tid").alias("__tid"), "copies", "spans").join(kept.withColumnRenamed("tid", "__t"), F.col("__tid") == F.col("__t"), "left").drop("__t")
    own = rows.select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("__own"))
    all_ = own.join(known, F.col("tid") == F.col("__tid"), "left")
    gone = (F.coalesce("copies", F.lit(1)) > 1) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    return all_.select(
        "doc_id",
        "n_bytes",
        F.when(gone, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("__sha", "__own")).alias("kept_sha256"),
    )
