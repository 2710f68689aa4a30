import random
import re

import numpy as np
import pytest
from texts import awkward, frame, prose

from attesta.llm import components, jaccard
from attesta.llm.shared import table


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)])


def brute(rows, percent=80):
    """Sorted (id, set size, component id) as text."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in by[x] if j < i}
        for j in near:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((str(d), len(sets[i]), str(low.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def near_copies(seed, n=60):
    rng = random.Random(seed)
    out = []
    for f in range(4):
        base = prose(seed * 10 + f, rng.choice([6, 30, 150])).split()
        for _ in range(n // 4):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(["zz", "yy", "Th"])
            out.append(" ".join(own + base[: rng.choice([0, 0, 5])]))
    passage = prose(99, 60)
    out += [prose(300 + i, 40) + " " + passage for i in range(40)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_brute_force(spark, seed):
    texts = near_copies(seed)
    rows = [(i * 7 % 997, t, "", "", 0) for i, t in enumerate(texts)]
    assert result(jaccard.join(frame(spark, rows))) == brute([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("percent", [45, 80])
def test_hot_tokens_and_groups_are_split(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard, "HOT_ROWS", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rule = jaccard.Rule(percent=percent)
    texts = near_copies(3, 240)
    rows = [(i * 7 % 997, t, "", "", 0) for i, t in enumerate(texts)]
    assert result(jaccard.join(frame(spark, rows), rule)) == brute([(r[0], r[1]) for r in rows], percent)


def test_all_widths_meet():
    rng = np.random.default_rng(3)
    small = np.unique(rng.integers(0, 2**63, 64).astype(np.uint64))
    sets = [small] + [np.unique(np.concatenate((small, rng.integers(0, 2**63, k).astype(np.uint64)))) for k in (65, 200, *range(300, 320))]
    names = np.array([jaccard.class_of(s) for s in sets])
    got = jaccard.tree_pairs(names, np.array([len(s) for s in sets]), np.arange(len(sets)), [jaccard.bitmap(s) for s in sets], 20, None)
    assert {tuple(sorted((int(names[0]), int(b)))) for b in names[1:3]} <= set(got)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_rows(spark, extra):
    docs = frame(spark, awkward(), extra)
    assert result(jaccard.join(docs)) == brute([(r[0], r[1]) for r in awkward()])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((str(r.doc_id) for r in kept.collect()))
    assert ids.count("1") == 1 and "2" not in ids and {"3", "4", "5", "6", "7", "8", "10"} <= set(ids)


def test_on_the_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert result(jaccard.join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert jaccard.join(frame(spark, [])).count() == jaccard.keep_one(frame(spark, [])).count() == 0


@pytest.mark.parametrize("pivots", [None, 2, 8])
def test_trees_drop_no_link(pivots, monkeypatch):
    monkeypatch.setattr(jaccard, "STEP_BYTES", 1 << 18)
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(90):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(20, 90))).astype(np.uint64))
        sets += [np.unique(np.concatenate((base[k:], rng.integers(0, 2**63, k).astype(np.uint64)))) for k in (0, 1, 2, 6)]
    names = np.array([jaccard.class_of(s) for s in sets])
    trees, choose = [], jaccard.pivot_classes

    def chosen(name, *rest):
        trees.append((set(name.tolist()), set(name[out := choose(name, *rest)].tolist())))
        return out

    monkeypatch.setattr(jaccard, "pivot_classes", chosen)
    got = jaccard.tree_pairs(names, np.array([len(s) for s in sets]), np.arange(len(sets)), [jaccard.bitmap(s) for s in sets], 80, pivots)
    assert len(trees) > 1 and all(1 <= len(first) <= (pivots or len(every)) for every, first in trees)
    if pivots is None:
        trees = [(set(names.tolist()), set(names.tolist()))]
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            if jaccard.Rule().linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                pair = int(min(names[i], names[j])), int(max(names[i], names[j]))
                assert pair in got or not any(first & set(pair) and every >= set(pair) for every, first in trees)
    assert len(got) < (60 * sum(len(first) for _, first in trees) if pivots else 600)


def test_central_pivots_join_a_family():
    """Random edits of one text: the pivots link what links at all but a few, and so little is left to compare."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[k:], rng.integers(0, 2**63, k).astype(np.uint64)))) for base, k in ((rng.permutation(base), int(k)) for k in rng.integers(2, 17, 500))]
    names, n = np.array([jaccard.class_of(s) for s in sets]), np.array([len(s) for s in sets])
    bits, by = [jaccard.bitmap(s) for s in sets], {jaccard.class_of(s): s for s in sets}
    label = names.copy()
    for pivots in jaccard.PIVOTS[:-1]:
        got = jaccard.tree_pairs(names, n, label, bits, 80, pivots)
        assert len(got) <= pivots * len(sets)
        for a, b in got:
            if jaccard.Rule().linked(len(np.intersect1d(by[a], by[b])), len(by[a]), len(by[b])):
                x, y = label[names == a][0], label[names == b][0]
                label[label == max(x, y)] = min(x, y)
    left = jaccard.tree_pairs(names, n, label, bits, 80, None)
    of = dict(zip(names.tolist(), label.tolist(), strict=True))
    assert len(left) < len(sets) ** 2 // 16 and all(of[a] != of[b] for a, b in left)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(-5, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x in linked}


def test_bitmaps_drop_no_link():
    rng = np.random.default_rng(7)
    for n in (1, 3, 60, 900, 20_000):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for k in (0, n // 12, n // 3):
            other = np.unique(np.concatenate((base[k:], rng.integers(0, 2**63, k).astype(np.uint64))))
            most = jaccard.most_common(jaccard.bitmap(base), len(base), jaccard.bitmap(other), len(other))
            assert most >= len(np.intersect1d(base, other))
    a, b = (np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(2))
    assert not jaccard.Rule().linked(jaccard.most_common(jaccard.bitmap(a), 3000, jaccard.bitmap(b), 3000), 3000, 3000)
