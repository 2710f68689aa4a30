"""The registered queries' own columns against brute force, on a table of awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from test_jaccard import brute as components
from test_repeats import brute as repeats_of
from test_small_operators import BYTE, SECRETS, WORD, base_of, base_spans, brute_hits, crc, plain_ids
from texts import awkward, frame

from attesta.llm import pii, queries as Q

ITEMS = [(1, "none of it"), (2, "another text"), (3, "with the same"), (11, "x")]
PRIVATE = [
    (60, "Call (555) 123-4567 or +1 555-123-4567, card 4111 1111 1111 1111, not 4111 1111 1111 1112.", "en", "a", 0),
    (61, "a.b@example.org on 2024-02-29, 31.12.1999 and 02/28/2001 at 10.0.255.7 not 10.0.256.7 nor 2023-02-30", "en", "a", 0),
    (62, "again a.b@example.org and 10.0.255.7", "en", "b", 0),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("contract"))
    rows = awkward() + [(50 + i, t, "en", "a", 0) for i, t in enumerate(SECRETS)] + PRIVATE
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [(r[0], r[1]) for r in rows]


def got(spark, tables, name, *columns):
    df = Q.queries()[name](spark, tables[0])
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_op1(spark, tables):
    rows = got(spark, tables, "op1_packing", "doc_id", "piece", "start", "length", "ids_crc32")
    want = []
    for doc, text in tables[1]:
        ids = [*plain_ids(BYTE, text), 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(doc, n, a, b - a, crc(ids[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert rows == sorted(want, key=str)


def test_op2(spark, tables):
    rows = got(spark, tables, "op2_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    bases = [(d, base_of(t)) for d, t in tables[1]]
    want = sorted(((d, *b, b[0] < 50 or 100 * b[4] > 50 * b[0]) for d, b in bases), key=str)
    assert [r[:7] for r in rows] == want
    assert not any(r[6] and r[7] for r in rows)


def test_op3(spark, tables):
    rows = got(spark, tables, "op3_sharding", "doc_id", "size", "text_crc32", "law", "grown_shard")
    raw = [(d, (t or "").encode()) for d, t in tables[1]]
    assert rows == sorted(((d, len(b) + 1, zlib.crc32(b), "bytes", None) for d, b in raw), key=str)
    places = defaultdict(list)
    for shard, slot in got(spark, tables, "op3_sharding", "shard", "slot"):
        places[shard].append(slot)
    assert set(places) <= set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())


def test_op5(spark, tables):
    rows = {r.doc_id: r for r in Q.op5_pii(spark, tables[0]).collect() if (r.doc_id or 0) >= 60}
    assert (rows[60].n_phone, rows[60].n_card, rows[60].n_email) == (2, 1, 0)
    assert (rows[61].n_email, rows[61].n_date, rows[61].n_ip) == (1, 3, 1)
    for doc, text, *_ in PRIVATE:
        new = rows[doc].text
        assert new != text and re.sub("[0-9A-Za-z]+", "x", new) == re.sub("[0-9A-Za-z]+", "x", text)
    assert "4111 1111 1111 1112" in rows[60].text and "10.0.256.7" in rows[61].text and "2023-02-30" in rows[61].text
    mail = lambda t: re.findall(r"\S+@example\.org", t)
    assert mail(rows[61].text) == mail(rows[62].text) != mail(PRIVATE[1][1])
    back = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame([(d, r.text) for d, r in rows.items()], "doc_id long, text string"), Q.PII_KEY, back=True).collect()}
    assert back == {d: t for d, t, *_ in PRIVATE}
    others = Counter((r.doc_id, r.text) for r in Q.op5_pii(spark, tables[0]).collect() if (r.doc_id or 0) < 50)
    assert others == Counter((d, t) for d, t in tables[1] if (d or 0) < 50)


def test_op6(spark, tables):
    rows = got(spark, tables, "op6_secret_scan", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    names = ("assign", "access", "hex")
    want = []
    for doc, text in tables[1]:
        spans = base_spans(text or "")
        said = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        want.append((doc, *(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    assert rows == sorted(want, key=str)
    for doc, text, spans in got(spark, tables, "op6_secret_scan", "doc_id", "n_random", "spans"):
        parts = [s.split(":") for s in spans.split(",") if s]
        assert sum(p[0] == "random" for p in parts) == text
        assert [(int(a), (*names, "random").index(k)) for k, a, _ in parts] == sorted((int(a), (*names, "random").index(k)) for k, a, _ in parts)
        fixed = [(int(a), names.index(k), int(b)) for k, a, b in parts if k != "random"]
        assert any(fixed == base_spans(t or "") for d, t in tables[1] if d == doc)


def test_op7(spark, tables):
    rows = got(spark, tables, "op7_token_files", "doc_id", "n_tokens", "ids_crc32")
    ids = [(d, [*plain_ids(WORD, t), 1]) for d, t in tables[1]]
    assert rows == sorted(((d, len(x), crc(x)) for d, x in ids), key=str)
    starts = sorted((r[0], r[1]) for r in got(spark, tables, "op7_token_files", "start", "n_tokens"))
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


def test_op8(spark, tables):
    rows = got(spark, tables, "op8_ngram_jaccard", "doc_id", "n_shingles", "component_id")
    assert sorted((str(d), n, str(c)) for d, n, c in rows) == components(tables[1])


def test_op9(spark, tables):
    rows = got(spark, tables, "op9_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = []
    for doc, text in tables[1]:
        n, hit, ids = brute_hits(text, ITEMS)
        want.append((doc, n, hit, len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), hit > 0))
    assert rows == sorted(want, key=str)


def test_op10(spark, tables):
    rows = got(spark, tables, "op10_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((str(r[0]), *r[1:]) for r in rows) == repeats_of(tables[1])
