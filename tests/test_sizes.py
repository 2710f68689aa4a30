"""What grows with the input is neither sent to the driver nor to every task, and results at sizes where their form changes."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import decisions, interview, redaction, rounds
from attesta.operators import keys as K
from attesta.operators import retrieval as R
from attesta.operators import scoring as G
from attesta.plans import corpus, keys

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [keys.derived_key, keys.gap_key, keys.sheet_problems, keys.key_problems])
def test_fact_sheets_meet_by_sorting(spark, query):
    # The least numbers of traps by kind are a few given rows.
    assert not [x for x in plan(query(spark, SF)).splitlines() if "BroadcastHashJoin" in x and "[kind#" not in x]


def test_sheet_rules_move_no_texts(spark):
    shown = plan(keys.sheet_problems(spark, SF))
    assert "Expand" not in shown
    sheet = {k: v.limit(5) for k, v in keys.sheet(spark, SF).items()} | {"statements": spark.createDataFrame([(1, 1, 1, "no", ["placeholder"], "It [x"), (2, 2, 1, "yes", [], "It is")], "statement_id long, doc_id long, control_id long, stance string, flags array<string>, text string")}
    traps = [(1, "placeholder", [1], [1]), (2, "placeholder", [1, 2], [1]), (3, "scope", [1, 2], [1]), (4, "disagree", [1, 2], [1]), (5, "date", [1], [1])]
    sheet["traps"] = spark.createDataFrame(traps, "trap_id long, kind string, statements array<long>, controls array<long>")
    sheet["documents"] = spark.createDataFrame([(1, "a", "policy", "final", "x", True, None), (2, "b", "record", "final", "y", True, None)], "doc_id long, filename string, kind string, status string, scope string, evidence_allowed boolean, dated date")
    got = {(r.rule, r.key) for r in K.sheet_problems(sheet, {}).collect() if "unknown" not in r.rule}
    both = "needs yes and no from two documents about one control"
    assert got == {("needs flagged placeholders", "2"), ("two scopes are a scope trap", "4"), (both, "5"), ("a record must be dated after the others", "5")}


def test_lines_do_not_travel_under_words_that_no_quote_needs(spark):
    key = spark.createDataFrame([("a", [(1, "Item 12345 is")], [], "x", None), ("b", [(1, "So Item")], [], "x", None)], "code string, evidence array<struct<doc_id:long,text:string>>, traps array<string>, expected_label string, conflict_trap long")
    lines = spark.createDataFrame([(1, i, f"So Item {i} is kept") for i in range(12300, 12500)] + [(1, 1, None)], "doc_id long, n long, text string")
    words = lines.select(F.split("text", " ").alias("w"))
    assert sorted(K._unasked(spark.createDataFrame([("12345",), ("Item",)], "__w string"), words)) == ["So", "is", "kept"]
    traps = spark.createDataFrame([], "trap_id long")
    assert K.key_problems(key, lines, traps).collect() == []
    assert [r.key for r in K.key_problems(key, lines.filter("n <> 12345"), traps).collect()] == ["a/1"]


def test_scores_meet_their_keys_by_sorting(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "run_id int, code string, fill string")
    assert "BroadcastHashJoin" not in plan(G.set_scores(rows, rows.filter("code = 'a'"), ["run_id"], ["code", "fill"]))
    both = spark.createDataFrame([("a", "conflict", None, True, False, None, ["1"], ["b"])], "code string, expected_label string, expected_value string, must_ask boolean, honest_negative boolean, conflict_trap bigint, traps array<string>, fills array<string>")
    traps = spark.createDataFrame([(1, "scope")], "trap_id bigint, kind string")
    results = spark.createDataFrame([(1, "a", "conflict", None, "date", None, True, 1.0, 5)], "run_id int, code string, label string, value string, rule string, scope_note string, newer_record boolean, cost_usd double, latency_ms int")
    cites = spark.createDataFrame([(1, "a", True, "final", False, True)], "run_id int, code string, evidence_allowed boolean, status string, placeholder boolean, valid boolean")
    shown = plan(G.run_scores(both, traps, results, cites, rows.select("run_id", "code"), rows))
    assert not [x for x in shown.splitlines() if "BroadcastHashJoin" in x and "[run_id" not in x]


def test_names_meet_texts_by_sorting(spark):
    people = spark.createDataFrame([("Ann Lee",)], "name string")
    lines = spark.createDataFrame([(1, 1, "Ask Ann Lee")], "doc_id long, n int, text string")
    files = spark.createDataFrame([(1, "by_Ann_Lee.md")], "file_id long, filename string")
    for got in (redaction.redact_lines(lines, people), redaction.redact_filenames(files, people)):
        assert "BroadcastHashJoin" not in plan(got)
    assert redaction.redact_lines(lines, people).first().text == "Ask <PERSON>"


def test_spans_of_a_name_are_looked_for_once(spark):
    people = spark.createDataFrame([("Ann Lee",)], "name string")
    files = spark.createDataFrame([(1, "call 12 Main Street_(555) 123-4567_by_Ann_Lee.md"), (2, None), (3, "x.md")], "file_id long, filename string")
    got = redaction.redact_filenames(files, people)
    # A pattern is asked three times and its cue once.
    assert got._jdf.queryExecution().analyzed().toString().count("github_pat_") == 4
    assert "REPARTITION_BY_NUM" in plan(got)
    assert {r.file_id: r.redacted for r in got.collect()} == {1: "call <ADDRESS>_<PHONE>_by_<PERSON>.md", 2: None, 3: "x.md"}


def test_report_lines_write_numbers_without_exponents(spark):
    values = {"a": 11855434.0, "b": 9999999.5, "c": -123456789012.25, "d": 0.00012, "e": 0.5, "f": 1e7, "g": 0.0}
    metrics = spark.createDataFrame(list(values.items()), "metric string, value double")
    rules = metrics.select("metric", F.lit(">=").alias("op"), F.lit(2e7).alias("target"), F.lit(False).alias("gating"))
    got = [r.line for r in G.report_lines(G.gates(metrics, rules)).collect()]
    assert [x.split(" | ")[1:3] for x in got if "≥" in x or ">=" in x] == [[str(v), ">= 20000000.0"] for v in values.values()]


def _passages(spark):
    rows = [("1#1", 1, "a.md", 1, "Head", "Keys are kept, key by key", False), ("2#1", 2, "b.csv", 1, "Systems", "System: Keys; Owner: team", True)]
    got = spark.createDataFrame(rows, "chunk_id string, doc_id long, filename string, line_start int, heading string, text string, record boolean")
    return got.withColumn("flags", F.array().cast("array<string>"))


def test_index_is_made_inside_a_passage(spark):
    index = R.postings(_passages(spark).filter("doc_id = 1"))
    assert "Exchange" not in plan(index)
    assert [tuple(r)[1:] for r in index.collect()] == [("head", 0, True, 3), ("kept", 3, True, 3), ("key", 1, True, 3), ("key", 4, False, 3), ("key", 6, False, 3)]


@pytest.mark.parametrize("phrases", [None, ["kept key"]])
def test_what_an_item_hits_does_not_travel(spark, phrases):
    items = spark.createDataFrame([(1, "Which keys", None, phrases)], "item_id long, question string, topic string, phrases array<string>")
    chunks = _passages(spark)
    got = R.scored(items, chunks, R.postings(chunks), ("filename",))
    assert phrases or "hashpartitioning(item_id" not in plan(got)
    assert sorted(r.chunk_id for r in got.collect()) == ["1#1", "2#1"]


def test_texts_do_not_travel_for_a_hop(spark):
    chunks = _passages(spark)
    chosen = chunks.filter("doc_id = 1").withColumn("item_id", F.lit(1).cast("long"))
    got = R.record_hop(chosen, chunks, few=True)
    assert "hashpartitioning(token" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [(1, "2#1", 1)]


@pytest.mark.parametrize("phrases", [None, ["kept key"]])
def test_both_ways_of_scoring_agree(spark, monkeypatch, phrases):
    items = spark.createDataFrame([(1, "Which keys of the team", None, phrases), (2, "Owner kept", None, phrases), (3, "Zebra", None, None)], "item_id long, question string, topic string, phrases array<string>")
    rows = _passages(spark)
    chunks = rows.unionByName(rows.withColumns({"chunk_id": F.concat(F.lit("9"), "chunk_id"), "text": F.concat(F.lit("team kept key and "), "text")}))
    found = lambda: R.scored(items, chunks, R.postings(chunks), ("filename",))
    quick = found()
    assert "MapInArrow" in plan(quick)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, found().collect())) != []


def test_phrases_are_found_where_places_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_CELLS", 10**9)
    given = [(1, "old key", None, ["old key of the team", "key of key", "team"]), (2, "Zebra", None, ["lost key, old"]), (3, "old", None, None)]
    items = spark.createDataFrame(given, "item_id long, question string, topic string, phrases array<string>")
    words = ["old", "key", "of", "the", "team", "lost", "key of key", "word"]
    said = [" ".join(words[(i * k + k * k // 3) % 8] for k in range(1, 12)) for i in range(120)] + ["old key of the team", "lost key old old key of key", "word"]
    chunks = spark.createDataFrame([(f"{i}#1", "Head", t) for i, t in enumerate(said)], "chunk_id string, heading string, text string")
    found = lambda: R.scored(items, chunks, R.postings(chunks))
    shown = plan(found())
    assert shown.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(item_id" not in shown
    quick = [sorted(map(tuple, found().collect()))]
    monkeypatch.setattr(R, "BLOCK_CELLS", 40)
    quick.append(sorted(map(tuple, found().collect())))
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    assert quick == [sorted(map(tuple, found().collect()))] * 2 and len(quick[0]) > 100


def test_only_the_densest_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_CELLS", 10**9)
    items = spark.createDataFrame([(1, "Which keys", None)], "item_id long, question string, topic string")
    rows = [(f"{i}#1", i, "a.md", 1, "Head", "key " * (i // 2 % 50 + 1) + "word", False) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, filename string, line_start int, heading string, text string, record boolean").coalesce(1)
    every = R.scored(items, chunks, R.postings(chunks)).collect()
    few = R.scored(items, chunks, R.postings(chunks), best=3).collect()
    assert len(every) == 200 and len(few) < 60
    top = sorted({r.density for r in every})[-1]
    assert {r.chunk_id for r in every if r.density == top} == {r.chunk_id for r in few if r.density == top}
    # Items whose words stand nowhere find nothing.
    assert R.scored(items.withColumn("question", F.lit("Zebra")), chunks, R.postings(chunks)).collect() == []


@pytest.mark.parametrize("best", [None, 2])
def test_blocks_without_a_word_asked_for(spark, monkeypatch, best):
    monkeypatch.setattr(R, "TASK_CELLS", 10**9)
    monkeypatch.setattr(R, "BLOCK_CELLS", 1)
    items = spark.createDataFrame([(1, "Which keys", None)], "item_id long, question string, topic string")
    rows = [(f"{i}#1", i, "a.md", 1, "Head", "key" if i % 40 == 0 else "word", False) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, filename string, line_start int, heading string, text string, record boolean").coalesce(1)
    got = R.scored(items, chunks, R.postings(chunks), ("filename",), best=best).collect()
    assert sorted(r.chunk_id for r in got) == ["0#1", "120#1", "160#1", "40#1", "80#1"]


def test_lines_in_sql_stay_in_their_row(spark):
    assert "Exchange" not in plan(corpus.lines_in_sql(spark, SF))


def test_a_missing_text_holds_no_quote(spark):
    rows = spark.createDataFrame([(1, None, "one two three"), (2, "x\none two three four", "one two three"), (3, "x", "one")], "i int, text string, quote string")
    got = rows.select("i", decisions.quote_line(F.col("text"), F.lit(False), F.lit(5), F.col("quote")).alias("q")).collect()
    assert {r.i: tuple(r.q) for r in got} == {1: (None, "containment"), 2: (6, None), 3: (None, "quote-length")}


def test_fills_are_decided_where_their_statement_is(spark):
    candidates = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1)], "statement_id long, item_id long, n int")
    dealt = rounds.dealt_by_statement(candidates)
    said = [(1, 1, "Keys are kept here"), (1, 2, "Logs are kept there"), (2, 1, "Keys are kept here")]
    rows = dealt(spark.createDataFrame(said, "statement_id long, idx int, text string"))
    none = {k: F.lit(None).cast(t) for k, t in (("scope", "string"), ("as_of", "date"), ("effective_date", "date"))}
    passages = rows.withColumns({
        "chunk_id": F.col("idx").cast("string"), "doc_id": F.col("statement_id"), "filename": F.lit("a.md"), "line_start": F.col("idx"), "flags": F.array().cast("array<string>"),
        "record": F.lit(False), "evidence_allowed": F.lit(True), "status": F.lit("final"), **none,
    })
    # Statement 2 has no candidate 8, and item 8 of statement 1 only a made-up quote.
    given = [(1, 7, 1, "yes", "keys are"), (1, 7, 2, "yes", "Logs are kept"), (1, 8, 1, "no", "Nobody wrote this"), (2, 7, 1, "irrelevant", "Keys are kept"), (2, 8, 1, "no", "Keys are kept")]
    stances = spark.createDataFrame(given, "statement_id long, item_id long, ord int, stance string, quote string").withColumn("passage_idx", F.col("ord"))
    got = rounds.decided_fills(dealt(candidates), passages, dealt(stances))
    assert [x for x in plan(got).splitlines() if "Exchange" in x and "REPARTITION" not in x] == []
    assert [tuple(r)[:4] for r in got.collect()] == [(1, 7, "verified", "Yes")]
    both = passages.join(candidates.select("statement_id", "item_id"), "statement_id")
    assert rounds.decided_fills(candidates, both, stances).collect() == got.collect()


def test_a_statement_meets_its_area_once(spark):
    items = spark.createDataFrame([(1, i, i % 2, "A", None, "unknown", False, False) for i in range(12)], "run_id int, item_id int, position int, topic string, function string, label string, approved boolean, edited boolean")
    statements = spark.createDataFrame([("s", 1, 2, "A", None), ("t", 1, 99, "A", None), ("u", 1, None, "A", None)], "statement_id string, run_id int, item_id int, topic string, function string")
    got = interview.fill_candidates(statements, items, 3)
    assert "hashpartitioning(statement_id" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("s", 0, 1), ("s", 4, 2), ("s", 6, 3), ("t", 0, 1), ("t", 2, 2), ("t", 4, 3)]


def test_texts_do_not_travel_for_a_leak(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The old KEYS are kept"), (2, "old keys are lost, keys are kept"), (3, None), (4, "monkeys are")], "doc_id long, text string")
    told = [("a", "old keys are"), ("b", "keys are kept"), ("c", "key"), ("d", "--"), ("e", "keys are"), ("f", "e"), ("g", "no such words")]
    private = spark.createDataFrame(told, "private_id string, private string")
    got = G.leaks(texts, private)
    assert "hashpartitioning(w#" not in plan(got) and "hashpartitioning(doc_id#" not in plan(got)
    want = [("a", 1), ("b", 1), ("c", 2), ("d", 0), ("e", 2), ("f", 3), ("g", 0)]
    assert sorted(map(tuple, got.collect())) == want
    for most in ("FEW_PRIVATE", "FEW_SHORT"):
        monkeypatch.setattr(G, most, 0)
        assert sorted(map(tuple, G.leaks(texts, private).collect())) == want
