"""Canonical requests, retention by partition, and re-opening as changes come in."""

import hashlib
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attesta.functions import canonical


def test_canonical_json(spark):
    texts = ["", 'say "x"\\', "tab\tline\nret\r\b\f", "\x00\x01\x1f\x7f", "é ✓   😀", "a/b</script>"]
    numbers = [0.0, -0.0, 1.0, 0.1, 1e-4, 1.5e-5, 123456789.0, 1.25e7, 1e15, 1e16, 1.5e22, -2.5e-7, 3.0e-3, 1e100, 12345678901234.5]
    rows = [(t, numbers[i % len(numbers)], i if i % 3 else None, i % 2 == 0, [t, None, "z"], {"b": 1, "a": None, "é": 3} if i % 4 else None, (None, [1.5, 2.0])) for i, t in enumerate(texts * 4)]
    df = spark.createDataFrame(rows, "t string, d double, n long, b boolean, a array<string>, m map<string,int>, s struct<z:string,y:array<double>>")
    whole = df.select(F.struct("t", "d", "n", "b", "a", "m", "s").alias("x"))
    got = [r[0] for r in whole.select(canonical.canonical_json(F.col("x"), whole.schema["x"].dataType)).collect()]
    want = [json.dumps({"t": t, "d": d, "n": n, "b": b, "a": a, "m": m, "s": {"z": s[0], "y": s[1]}}, sort_keys=True, ensure_ascii=False) for t, d, n, b, a, m, s in rows]
    assert got == want


def test_doubles_are_written_by_their_digits(spark):
    import random

    rng = random.Random(4)
    numbers = [float(f"{rng.randint(-10**6, 10**6)}e{rng.randint(-30, 30)}") for _ in range(500)] + [float(i) / 8 for i in range(-40, 40)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select("i", canonical.json_double(F.col("x")).alias("s")).collect()
    assert [r.s for r in sorted(got)] == [json.dumps(x) for x in numbers]


def test_request_key(spark):
    row = ("m/1", "v2", 'sys "é"', "user\n", "stance", {"type": "object", "a": "b"}, 1200, None)
    df = spark.createDataFrame([row], "model string, prompt_version string, system string, user string, schema_name string, schema map<string,string>, max_tokens int, reasoning map<string,boolean>")
    want = hashlib.sha256(json.dumps(list(row), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert df.select(canonical.request_key(df.schema)).first()[0] == want


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_cleanup_touches_expired_hours_only(spark, tmp_path):
    from attesta.streaming import cleanup as C

    at = lambda h, m=0: datetime(2024, 5, 1) + timedelta(hours=h, minutes=m)
    spaces = spark.createDataFrame([(i, at(i % 10, i % 3 * 20)) for i in range(60)], "workspace_id long, created timestamp")
    C.stored_by_expiry(spaces, f"{tmp_path}/spaces", F.col("created") + F.expr("INTERVAL 24 HOURS"))
    docs = spark.createDataFrame([(i % 70, i) for i in range(700)], "workspace_id long, doc_id long")
    C.stored_with_parent(docs, f"{tmp_path}/docs", "workspace_id", spark.read.parquet(f"{tmp_path}/spaces"))
    paths = {"spaces": f"{tmp_path}/spaces", "docs": f"{tmp_path}/docs"}
    before = files(tmp_path)
    run = C.cleanup_pass(paths, f"{tmp_path}/counts")
    ticks = spark.createDataFrame([(at(24 + 5),), (at(24 + 2),)], "at timestamp")
    run(ticks, 0)
    counts = lambda: {r.table: r.deleted for r in spark.read.parquet(f"{tmp_path}/counts/batch=0").collect()}
    over = [i for i in range(60) if i % 10 + (i % 3 > 0) <= 5]
    assert counts() == {"spaces": len(over), "docs": 10 * len(over) + 100}
    after = {k: v for k, v in files(tmp_path).items() if "/counts/" not in k}
    assert after == {k: before[k] for k in after} and 0 < len(after) < len(before)
    assert {k.split("expires=")[1][:10] for k in after} == {f"20240502{h:02d}" for h in range(6, 11)}
    run(ticks, 0)  # the batch is repeated
    assert counts()["spaces"] == len(over) and {k for k in files(tmp_path) if "/counts/" not in k} == set(after)
    left = {r.workspace_id for r in C.alive(spark, paths["spaces"], "2024-05-02 05:30:00").collect()}
    assert left == {i for i in range(60) if at(i % 10 + 24, i % 3 * 20) > at(29, 30)} - set(over)


def test_reopening_survives_a_repeated_batch(spark, tmp_path):
    from attesta.operators.rounds import reopened
    from attesta.streaming import reopening as R

    outcomes = spark.createDataFrame([(f"o{i}", "partial", False, i == 5, i == 6) for i in range(9)], "outcome_id string, label string, edited boolean, approved boolean, failed boolean")
    parts = [(f"o{i}", n, f"q{n}?", "p1" if (i, n) != (7, 1) else "p0", "m", None if (i, n) != (3, 1) else 5, [f"c{i}", f"c{n + 20}"]) for i in range(9) for n in (1, 2)]
    stored = spark.createDataFrame([p for p in parts if p[:2] != ("o8", 2)], "outcome_id string, part_n int, question string, stance_prompt string, model string, statement_id long, chunk_ids array<string>")
    deployed = spark.createDataFrame([p[:3] for p in parts], "outcome_id string, part_n int, question string")
    R.start(str(tmp_path), outcomes, stored, deployed, "p1", "m", buckets=4)
    kind = "chunk_id string, outcome_id string, part_n int, gone boolean"
    batches = [[("c1", None, None, True), ("x", "o2", 1, False)], [("c9", "o4", 2, False), ("x", None, None, True)], [("c1", "o1", 1, False), ("c1", "o1", 2, False), ("zz", "o3", 1, False)], [("c5", None, None, True)]]
    write = R.reopening_pass(str(tmp_path), "p1", "m")
    now = {(p[0], p[1]): set(p[6]) for p in parts}
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, kind), n)
        if n == 1:  # crashed after the batch was put in place: it comes again
            write(spark.createDataFrame(rows, kind), n)
        gone = {r[0] for r in rows if r[3]}
        now = {k: v - gone for k, v in now.items()}
        for c, o, p, g in rows:
            if not g and c not in gone:
                now[o, p].add(c)
        found = spark.createDataFrame([(o, p, c) for (o, p), v in now.items() for c in v], "outcome_id string, part_n int, chunk_id string")
        want = sorted((r.outcome_id, r.reasons) for r in reopened(outcomes, stored, found, deployed, "p1", "m").collect())
        assert sorted((r.outcome_id, r.reasons) for r in R.open_outcomes(spark, str(tmp_path)).collect()) == want
    assert ["o4", "o6", "o7", "o8"] == [o for o, _ in want]


def test_reopening_reads_touched_buckets_only(spark, tmp_path):
    from attesta.streaming import reopening as R

    spark.range(100).select(F.col("id").cast("string").alias("chunk_id"), (F.col("id") % 8).cast("int").alias("bucket")).write.partitionBy("bucket").parquet(f"{tmp_path}/holders")
    plan = R._pruned(spark, str(tmp_path), "holders", [3])
    assert "PartitionFilters: [isnotnull(bucket" in plan._jdf.queryExecution().toString()


PASSAGES = "workspace_id string, chunk_id string, doc_id string, filename string, line_start int, heading string, text string, flags array<string>, record boolean"


def test_tenants_with_equal_ids(spark, tmp_path):
    from attesta.operators import decisions as D
    from attesta.operators import retrieval as R
    from attesta.operators.tenants import in_tenants, of_tenants

    rows = [("a", f"c{i}", f"d{i % 3}", f"f{i % 3}", i, "Access", f"Backups are kept for {i} days and tested", [], False) for i in range(6)]
    rows += [("a", "r1", "s", "s.csv", 1, "Systems", "System: Vault; Owner: ops", [], True), ("b", "r1", "s", "s.csv", 1, "Systems", "System: Ledger; Owner: fin", [], True)]
    rows += [("b", f"c{i}", f"d{i % 2}", f"f{i % 2}", i, "Access", f"Backups live in Vault and Ledger, batch {i}", [], False) for i in range(4)] + [("c", "c0", "d0", "f0", 0, "", "Backups of c", [], False)]
    spark.createDataFrame(rows, PASSAGES).write.partitionBy("workspace_id").parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    items = spark.createDataFrame([(w, 1, "Are backups tested?", None) for w in ("a", "b")] + [("b", 2, "Where do backups live?", None)], "workspace_id string, item_id long, question string, topic string")
    own = of_tenants(chunks, items, "workspace_id")
    got = in_tenants(lambda i, c: R.retrieve(i, c, tenant="workspace_id"), "workspace_id", ("item_id", "chunk_id", "doc_id"), items, own, inside=True)
    assert got.schema["item_id"].dataType.simpleString() == "bigint"
    found = sorted((r.workspace_id, r.item_id, r.chunk_id, r.idx) for r in got.collect())
    alone = []
    for w in ("a", "b"):
        alone += [(w, r.item_id, r.chunk_id, r.idx) for r in R.retrieve(items.filter(f"workspace_id = '{w}'"), chunks.filter(f"workspace_id = '{w}'")).collect()]
    assert found == sorted(alone)
    assert ("b", 2, "r1") in {x[:3] for x in found} and not any(x[0] == "c" for x in found)  # a record row that b's own passages name

    items.write.parquet(f"{tmp_path}/items")
    plan = of_tenants(chunks, spark.read.parquet(f"{tmp_path}/items").filter("item_id = 2"), "workspace_id")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters")[1]

    passage = "workspace_id string, item_id long, idx int, chunk_id string, doc_id string, filename string, line_start int, text string, flags array<string>, record boolean, evidence_allowed boolean, status string, scope string, as_of date, effective_date date"
    stance = "workspace_id string, item_id long, ord int, passage_idx int, stance string, quote string"
    said = spark.createDataFrame([(w, 1, 1, "c1", "d1", "f.md", 1, "backups are tested daily", [], False, True, "final", None, None, None) for w in ("a", "b")], passage)
    stances = spark.createDataFrame([("a", 1, 1, 1, "yes", "backups are tested"), ("b", 1, 1, 1, "no", "backups are tested")], stance)
    told = in_tenants(D.decide, "workspace_id", ("item_id",), items, said, stances)
    assert sorted((r.workspace_id, r.item_id, r.label, r.value) for r in told.collect()) == [("a", 1, "verified", "Yes"), ("b", 1, "verified", "No"), ("b", 2, "unknown", None)]


def test_drafts_may_name_their_own_documents(spark):
    from attesta.operators.decisions import mentioned

    drafts = spark.createDataFrame([(1, "a", 'See "Access Policy" and the incident response plan.'), (2, "b", "The access policy says so."), (3, "a", "")], "item_id long, workspace_id string, text string")
    docs = spark.createDataFrame([("a", "access-policy_v2.md"), ("a", "Incident Response-plan.docx"), ("a", "plan.md"), ("b", "other access.md"), (None, "access-policy.md")], "workspace_id string, filename string")
    got = {r.item_id: sorted(r.names) for r in mentioned(drafts, docs, "workspace_id").collect()}
    assert got[1] == ["access policy", "incident response plan"] and 3 not in got and got[2] == ["other access"]


def test_sheet_lines(spark):
    from datetime import date

    from attesta.sources.lines import sheet_lines

    rows = [("s", 1, ["Vendors", None]), ("s", 2, ["", "As at 2024-02-30"]), ("s", 3, ["last updated: 2024-03-01"]), ("s", 4, ["as of 2024-13-01"]), ("s", 5, ["Name", "Seen", "Next due"]), ("s", 6, [" ", "", ""]), ("s", 7, ["A", "2020-01-01", "2031-01-01"]), ("s", 8, ["as of 2025-01-01"]),
            ("t", 1, ["Name", "Seen", "Next due"]), ("t", 2, ["B", "2020-01-01", "2031-01-01"]), ("t", 3, ["C", "2020-99-01", ""]), ("u", 1, ["only a title, as of 2024-01-01"])]
    got = {(r.sheet_id, r.n): (r.text, r.kind, r.as_of) for r in sheet_lines(spark.createDataFrame(rows, "sheet_id string, row int, cells array<string>")).collect()}
    assert got == {
        ("s", 1): ("Vendors", "text", None), ("s", 2): ("As at 2024-02-30", "text", None), ("s", 3): ("last updated: 2024-03-01", "text", None), ("s", 4): ("as of 2024-13-01", "text", None),
        ("s", 5): ("Name: A; Seen: 2020-01-01; Next due: 2031-01-01", "record", date(2024, 3, 1)), ("s", 6): ("Name: as of 2025-01-01", "record", date(2024, 3, 1)),
        ("t", 1): ("Name: B; Seen: 2020-01-01; Next due: 2031-01-01", "record", date(2020, 1, 1)), ("t", 2): ("Name: C; Seen: 2020-99-01", "record", None), ("u", 1): ("only a title, as of 2024-01-01", "text", None),
    }
