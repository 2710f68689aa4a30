import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import awkward, frame, prose

from attesta.llm import repeats
from attesta.llm.shared import table


def brute(rows, length=200):
    at = defaultdict(list)
    raw = [(t or "").encode() for _, t in rows]
    for i, b in enumerate(raw):
        for k in range(len(b) - length + 1):
            at[hash(b[k : k + length])].append((i, k))
    gone = [np.zeros(len(b), bool) for b in raw]
    for places in at.values():
        if len(places) > 1:
            for i, k in places:
                gone[i][k : k + length] = True
    out = []
    for (d, _), b, g in zip(rows, raw, gone, strict=True):
        edges = np.diff(np.concatenate(([0], g.astype(np.int8), [0])))
        out.append((str(d), len(b), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()))
    return sorted(out)


def result(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    got = df.select("doc_id", "n_bytes", removed.alias("r"), F.size("spans").alias("n"), "kept_sha256").collect()
    return sorted((str(g.doc_id), g.n_bytes, g.r, g.n, g.kept_sha256) for g in got)


@pytest.mark.parametrize("many", [50_000, 3])
def test_removal_is_brute_force(spark, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    rng = random.Random(6)
    passages = [prose(70 + i, 60) for i in range(4)]
    texts = ["a" * 500, "b" * 199 + "c" * 200, "c" * 201, "ab" * 300, passages[0][:200], "x" + passages[0][:200]]
    for i in range(60):
        parts = [prose(1000 + i, rng.randint(5, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 150)
            parts += [p[a : a + rng.choice([150, 199, 200, 201, 260, 1000])], prose(rng.randrange(10**6), 12)]
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-1] + "!", "!" + texts[-2], texts[-3].replace("th", "ht", 1)]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    assert result(repeats.removal(frame(spark, rows))) == brute([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    assert result(repeats.removal(frame(spark, awkward(), extra))) == brute([(r[0], r[1]) for r in awkward()])


def test_on_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert result(repeats.removal(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert repeats.removal(frame(spark, [])).count() == 0


def test_long_texts_have_the_anchors_of_all_windows(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 700)
    data = np.frombuffer(prose(3, 900).encode(), np.uint8)
    off = np.array([0, 150, 1500, 1500, len(data)])
    at, _ = repeats.anchors(data, off)
    for a, b in zip(off, off[1:], strict=False):
        for s in range(a, b - 200 + 1):
            assert ((at >= s) & (at <= s + 200 - repeats.GRAM)).any()


def test_edges_of_a_common_passage_are_no_single_group(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", 10)
    monkeypatch.setattr(repeats, "SHARE", 1)
    p = prose(5, 70)
    texts = [f"{prose(2000 + i, 20)} {p} {prose(3000 + i, 20)}" for i in range(80)] + [p[:210] + "é" * 90, "é" * 90 + p[-210:]]
    texts += [f"{prose(2000, 20)} {p}", f"{p} {prose(3000, 20)}"]
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)]
    seen, sizes, judge = [], [], repeats.repeat_spans
    find = repeats.crowded_keys
    monkeypatch.setattr(repeats, "crowded_keys", lambda *a: seen.append(find(*a)) or seen[-1])

    def judged(found, length):
        sizes.append(max(r["n"] for r in found.filter("kind = 0").groupBy("key").agg(F.count_distinct("fh").alias("n")).collect()))
        return judge(found, length)

    monkeypatch.setattr(repeats, "repeat_spans", judged)
    assert result(repeats.removal(frame(spark, rows))) == brute([(r[0], r[1]) for r in rows])
    assert seen[0] and sizes[0] <= 10 * 4
