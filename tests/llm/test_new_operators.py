"""Tries, manifests and exact copies against brute force, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from test_small_operators import base_of
from texts import awkward, frame, prose

from attesta.llm import exact, manifest, quality, queries as Q, screening, tries
from attesta.llm.shared import numbered

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        base = c - (abs(c) % 5) * (1 if c > 0 else -1) if c is not None else None
        built[c] = (own.get(base, [])[:h] if h else []) + turns[h:]
    number = lambda c: (c is None, c or 0)
    members = defaultdict(list)
    for c in sorted(built, key=number):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = [str(c) for c in cs if len(built[c]) == len(node) and c is not None]
        out.append((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(children), len(leaves), saved, sha(",".join(ends))))
    return sorted(out, key=str)


def some_turns(n=80, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -5, 2**62, 2**62 + 1, 4096, 5000]:
        base = rng.choice([0, 1, 2, 3])
        for turn in range(rng.randint(0, 12)):
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), f"{'é' * base} {turn if rng.random() < 0.8 else rng.randint(0, 9)}"))
    return rows + [(None, 0, "user", "x"), (None, 1, None, None), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "a", "tie")]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_trie(spark, extra):
    rows = some_turns()
    df = spark.createDataFrame(rows, TURNS)
    if extra:
        for name in ("depth", "n", "p1", "pos", "size", "tail", "single", "bytes"):
            df = df.withColumn(name, F.lit("clash"))
    assert trie_rows(tries.conversation_trie(df)) == brute_trie(rows)


def test_trie_of_copies_and_of_one_long_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 60) for t in range(3)]
    rows += [(100, t, "user", f"turn {t % 50}") for t in range(9000)] + [(101, t, "user", f"turn {t % 50}") for t in range(8999)]
    got = trie_rows(tries.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(4)))
    assert max(r[1] for r in got) == 9000
    want = {(r[0], r[1]): r for r in brute_trie([r for r in rows if r[0] < 100])}
    for r in got:
        if r[1] and r[0] < 100:
            assert r == want[r[0], r[1]]
    deep = {r[1]: r for r in got if r[0] == 100}
    h = zlib.crc32(b"101") % 9
    assert deep[8999][3] == 2 and deep[9000][3] == 1 and deep[9000][5] == 1 and h < 9
    sizes = [len(f"turn {t % 50}") for t in range(8999)]
    assert deep[1][6] == sum(sizes) and deep[5000][6] == sum(sizes[4999:])


def test_trie_when_the_sketch_is_full(spark, monkeypatch):
    monkeypatch.setattr(screening, "LEAST_CELLS", 16)
    rows = some_turns(40, 5)
    assert trie_rows(tries.conversation_trie(spark.createDataFrame(rows, TURNS), most_cells=16)) == brute_trie(rows)


def test_sketch_proves_only_single_pairs(spark):
    rng = random.Random(1)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(3000)]
    rows = pairs + pairs[:1000] + pairs[:500]
    got = screening.with_single(spark.createDataFrame(rows, "a long, b long").repartition(6), "a", "b").filter("single").collect()
    told = {(r.a, r.b) for r in got}
    assert told <= set(pairs[1000:]) and len(told) > 1900


def test_empty_trie(spark):
    assert tries.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_numbering_over_borders(spark):
    rows = [(g, i, i) for g, n in (("a", 5000), ("b", 3), (None, 700), ("c", 1)) for i in range(n)]
    got = numbered(spark.createDataFrame(rows, "g string, v long, row long").repartition(7), ["g"], ["v", "row"]).collect()
    assert all(r.pos == r.v and r.size == {"a": 5000, "b": 3, None: 700, "c": 1}[r.g] for r in got) and len(got) == len(rows)


def brute_manifest(rows):
    def leaf(doc, text, lang, source, n):
        said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        return sha("".join(map(said, (doc, source, lang, n, text))))

    def climb(level):
        """Levels of hashes from the ground to the top."""
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            j = i ^ 1
            out.append((level[j] if j < i else "", level[j] if i < j < len(level) else ""))
            i //= 2
        return out

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([r[2] for r in sorted(by_lang[x], key=lambda r: r[:3])]) for x in langs}
    over = climb([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, _, h, r) in enumerate(sorted(by_lang[x], key=lambda r: r[:3])):
            proof = siblings(trees[x], i) + siblings(over, k)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(*r[:4], r[4] + 1) if hit else h
            for left, right in proof:
                node = sha(left + node + right)
            root = over[-1][0]
            out.append((r[0], h, trees[x][-1][0], root, sha("".join(a + b for a, b in proof)), node, node == root))
    return sorted(out, key=str)


def manifest_rows(spark, folder):
    df = Q.op12_merkle_manifest(spark, folder)
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("many", [0, 5000])
def test_manifest(spark, tmp_path, many):
    rows = awkward() + [(100 + i, f"text {i}", ["en", "fr", "nl"][i % 8 // 6 + i % 16 // 15], "s", i) for i in range(many)]
    if many:
        rows += [(9_000_000, "last", "en", "s", 2**63 - 1)] * 3
    frame(spark, rows, extra=True).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest_rows(spark, str(tmp_path)) == brute_manifest(rows)


def test_manifest_of_one_and_of_none(spark, tmp_path):
    one = [(7, "x", None, None, None)]
    frame(spark, one).write.parquet(f"{tmp_path}/documents.parquet")
    assert manifest_rows(spark, str(tmp_path)) == brute_manifest(one)
    assert manifest.manifest(frame(spark, [])).count() == 0


def brute_copies(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda d: (d is None, d or 0))
        out += [(d, ids[0], len(ids), k == 0, sha(text)) for k, d in enumerate(ids)]
    return sorted(out, key=str)


COPIES = [(1000 + i, "a  very\tcommon text", "en", "a", i) for i in range(300)] + [(None, "a very common text ", "en", "a", 1)] * 40 + [(5, "a very\ncommon text", "en", "a", 1)]


@pytest.mark.parametrize("fragment", [1000, 10])
def test_exact_copies(spark, fragment):
    rows = awkward() + COPIES + COPIES[-2:]
    got = exact.assign(frame(spark, rows, extra=True).repartition(5), fragment).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_copies(rows)


def test_keep_first(spark):
    rows = awkward() + COPIES
    kept = exact.keep_first(frame(spark, rows, extra=True), 20)
    assert kept.columns == frame(spark, rows, extra=True).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in brute_copies(rows) if r[3]), key=str)
    assert exact.keep_first(frame(spark, [])).count() == 0 and exact.assign(frame(spark, [])).count() == 0


def brute_kept(rows):
    """What is left of (doc_id, text, source, n_chars): boilerplate lines of a host go, and so do depleted and bad texts."""
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    normal = lambda x: re.sub(f"[{space}]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    words = lambda x: [w for w in re.split(f"[{space}]+", x) if w]
    hosts, holders = defaultdict(set), defaultdict(set)
    for _, text, host, _ in rows:
        hosts[host].add(text)
        for x in (text or "").split("\n"):
            if words(x):
                holders[host, normal(x)].add(text)
    often = {k for k, v in holders.items() if len(v) > 5 and len(v) > 0.01 * len(hosts[k[0]])}
    out = []
    for doc, text, host, n in rows:
        lines = (text or "").split("\n")
        gone = [bool(words(x)) and (host, normal(x)) in often for x in lines]
        _, _, _, _, repeated = base_of(text)
        total, lost = len(words(text or "")), sum(len(words(x)) for x, g in zip(lines, gone) if g)
        if total >= 50 and 100 * repeated <= 50 * total and lost <= 0.5 * total:
            left = "\n".join(x for x, g in zip(lines, gone) if not g) if any(gone) else text
            out.append((doc, left, host, len(left) if any(gone) else n))
    return sorted(out, key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_boilerplate_lines_leave_the_texts(spark, extra):
    own = lambda i, n: "\n".join(f"{prose(1000 * i + k, 7)} of {i}" for k in range(n))
    rows = [(i, f"Home |  About {i}\n{own(i, 12)}\n\nAll rights reserved 20{i % 90 + 10}\nhome | about 7", "en", "site", 5) for i in range(40)]
    rows += [(200 + i, "\n".join(["Home | About", "All rights reserved 1999"] * 12) + f"\n{own(300 + i, 2)}", "en", "site", 1) for i in range(8)]
    rows += [(400 + i, f"Home | About 1\n{own(500 + i, 12)}", "en", None, None) for i in range(4)] + awkward() + [rows_ for rows_ in [(3, f"Home | About 9\n{own(3, 12)}", "en", "site", 1)] * 2]
    got = quality.keep_good(frame(spark, rows, extra=extra).repartition(3))
    assert got.columns == frame(spark, rows, extra=extra).columns
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "source", "n_chars").collect()), key=str) == brute_kept([(r[0], r[1], r[3], r[4]) for r in rows])


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_merkle_manifest", "op13_exact_dedup"])
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_against_sql(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, folder).select(*want.columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want.fetchall(), key=str)
