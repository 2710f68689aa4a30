"""Queries on later rounds: re-decisions, re-opened outcomes, hops and tenants in retrieval, uses, exports and cell rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import decisions as D
from attesta.operators import interview as I
from attesta.operators import redaction
from attesta.operators import retrieval as R
from attesta.operators import rounds as O
from attesta.operators.joins import merged_join
from attesta.plans import base, evidence
from attesta.plans.base import sql, table, written

# Re-decisions


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Answers as decided before a change, their stances, the passages as they are now, and the changed documents.

    Documents that a label calls bad are cleared and final now; those that it calls toxic are gone.
    """
    rows = evidence.passages(spark, sf_dir)
    place = F.row_number().over(W.partitionBy("item_id").orderBy("idx"))
    rows = written(rows.withColumn("idx", place), "stored")
    stances = written(evidence.stances(rows), "stances")
    decided = D.decide(rows.select("item_id").distinct(), rows, stances)
    ids = rows.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    answers = decided.join(ids, "item_id").withColumn("edited", F.col("item_id") % 9 == 0).withColumn("approved", F.col("item_id") % 2 == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").dropDuplicates(["doc_id"])
    chunks = rows.drop("item_id", "idx").join(labels, "doc_id", "left").filter("coalesce(toxic, 0) <> 1")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False))
    chunks = chunks.withColumns({"evidence_allowed": F.col("evidence_allowed") | bad, "status": F.when(bad, "final").otherwise(F.col("status")), "scope": F.when(~bad, F.col("scope"))}).drop("quality", "toxic")
    return written(answers, "answers"), stances, written(chunks, "now"), labels.filter("quality = 0 or toxic = 1").select("doc_id")


def redecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.redecide(*_stored(spark, sf_dir)).select("item_id", "label", "value", F.size("citations").alias("n_citations"), "approved")


def stream_redecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, as changed documents come in by a stream of labels."""
    from attesta.streaming import jobs

    answers, stances, chunks, _ = _stored(spark, sf_dir)
    out = base.shared_folder(spark, "redecided")
    changes = jobs.folder_stream(spark, f"{sf_dir}/labels*.parquet", table(spark, sf_dir, "labels")).filter("quality = 0 or toxic = 1").select("doc_id")
    jobs.run_batches(changes, jobs.redecide_pass(lambda s: (answers, stances, chunks), f"{out}/rows"), f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("item_id", "label", "value", F.size("citations").alias("n_citations"), "approved")


def side_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.side_citations(evidence._decisions(spark, sf_dir)).select("item_id", F.col("side").cast("long").alias("side"), F.col("place").cast("long").alias("place"), F.col("citation").cast("long").alias("citation"))


def gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents are an outcome, each run of their passages a part."""
    from attesta.operators.outcomes import gap_check as whole

    got = evidence._decisions(spark, sf_dir)
    n = (F.col("item_id") % 100_000 + 1).cast("int")
    parts = got.select("item_id", F.floor(F.col("item_id") / 100_000).alias("outcome_id"), n.alias("part_n"), F.concat(F.lit("Part "), n.cast("string"), F.lit("?")).alias("question"))
    return whole(got, parts).select("outcome_id", "label", "status", "citations", F.regexp_count("explanation", F.lit(r"Part \d+\?")).cast("long").alias("told"))


# Outcomes that must be judged again


def _numbered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("outcome_id"), n.alias("part_n"), "p_partkey", F.concat("p_name", F.lit("?")).alias("question"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Outcomes of a brand and size with parts; the suppliers of a part's order lines are the passages found for it."""
    k = F.col("p_partkey")
    rows = _numbered_parts(spark, sf_dir)
    deployed = rows.select("outcome_id", "part_n", "question")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("chunk_id"), "l_shipdate")
    before = line.filter("l_shipdate < '1998-03-01'").groupBy("p_partkey").agg(F.collect_set("chunk_id").alias("chunk_ids"))
    found = rows.join(line.filter("l_shipdate < '1998-06-01'"), "p_partkey").select("outcome_id", "part_n", "chunk_id")
    stored = rows.filter(k % 29 > 0).join(before, "p_partkey", "left").select(
        "outcome_id", "part_n", F.when(k % 23 == 0, F.lower(F.col("question"))).when(k % 13 == 0, F.concat("question", F.lit("?"))).otherwise(F.col("question")).alias("question"),
        F.when(k % 17 == 0, "p0").otherwise("p1").alias("stance_prompt"), F.lit("m").alias("model"), F.when(k % 3 == 0, k).alias("statement_id"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
    )
    total = F.sum("p_partkey")
    outcomes = rows.groupBy("outcome_id").agg(total.alias("t")).select(
        "outcome_id", F.when(F.col("t") % 7 == 0, "user_confirmed").when(F.col("t") % 7 == 1, "na").otherwise("partial").alias("label"), (F.col("t") % 11 == 0).alias("edited"), (F.col("t") % 10 == 0).alias("approved"), (F.col("t") % 8 == 0).alias("failed")
    )
    return outcomes, stored, found, deployed


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reopened(*_parts(spark, sf_dir), "p1", "m").select("outcome_id", F.array_join("reasons", ", ").alias("reasons"))


def parts_after_reopening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored parts that stay, and fills that are dismissed, per brand."""
    outcomes, stored, found, deployed = _parts(spark, sf_dir)
    fills = stored.select("outcome_id", (F.col("part_n") - 1).alias("part_n"), F.when(F.col("part_n") % 2 == 1, "open").otherwise("accepted").alias("status"))
    kept, after = O.after_reopening(O.reopened(outcomes, stored, found, deployed, "p1", "m"), stored, fills)
    brand = F.substring_index("outcome_id", "-", 1)
    n = kept.groupBy(brand.alias("brand")).agg(F.count(F.lit(1)).alias("kept"))
    return n.join(after.groupBy(brand.alias("brand")).agg(F.count_if(F.col("status") == "dismissed").alias("dismissed")), "brand", "full")


def part_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stored, _, deployed = _parts(spark, sf_dir)
    return O.current_parts(stored, deployed, "p1", "m").select("outcome_id", "part_n", "current")


def machine_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes, stored, _, _ = _parts(spark, sf_dir)
    one = lambda df: df.withColumn("run_id", F.lit(1)).withColumnRenamed("outcome_id", "item_id")
    return O.machine_judged(one(outcomes), one(stored.filter("part_n > 1"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def worded_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each suggestion is about: the whole item's question, or one part's."""
    outcomes, stored, _, deployed = _parts(spark, sf_dir)
    items = outcomes.select(F.col("outcome_id").alias("item_id"), F.concat(F.lit("Whole of "), "outcome_id").alias("question"))
    rows = stored.select(F.col("outcome_id").alias("item_id"), (F.col("part_n") - 1).alias("part_n"))
    return O.worded(rows, items, deployed)


# Retrieval with record rows, and within tenants


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of systems: each benchmark item's longest word is one, as a record row."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    name = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    rows = table(spark, sf_dir, "benchmark").select("item_id", name.alias("name")).filter("name is not null")
    return rows.select(
        F.lit(-1).cast("long").alias("doc_id"), F.concat(F.lit("sheet#"), F.col("item_id").cast("string")).alias("chunk_id"), F.col("item_id").cast("int").alias("line_start"), F.col("item_id").cast("int").alias("line_end"),
        F.concat(F.lit("System: "), "name", F.lit("; Owner: team "), (F.col("item_id") % 7).cast("string")).alias("text"), F.lit("Systems").alias("heading"), F.array().cast("array<string>").alias("flags"), F.lit(None).cast("date").alias("as_of"), F.lit(True).alias("record"), F.lit("sheet.csv").alias("filename"),
    )


def retrieve_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and record rows for each item, with up to three rows that the chosen passages name."""
    sheet = written(_inventory(spark, sf_dir), "sheet")
    rows = base.chunks(spark, sf_dir).unionByName(sheet, allowMissingColumns=True)
    got = R.retrieve(base.questions(spark, sf_dir), rows, base.index(spark, sf_dir).unionByName(R.postings(sheet), allowMissingColumns=True), store=written)
    return got.select("item_id", "chunk_id", F.col("idx").cast("long").alias("idx"))


def tenant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores within each workspace: its own passages, counts and totals alone."""
    rows = base.chunks(spark, sf_dir)
    items = base.questions(spark, sf_dir).withColumn("workspace_id", F.concat(F.lit("w"), (F.col("item_id") % 3).cast("string")))
    return R.scored(items, rows, base.index(spark, sf_dir), tenant="workspace_id")


# Uses, exports, statements


def document_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are documents; order lines are passages, orders are answers, big ones with a statement of their own."""
    s, line, o = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    chunks = line.select(key.alias("chunk_id"), F.col("l_suppkey").alias("doc_id"))
    held = line.filter("l_quantity = 50 and l_returnflag = 'A' and l_tax = 0.08").groupBy("l_orderkey").agg(F.collect_list(key).alias("chunk_ids"))
    cents = (F.col("o_totalprice") * 100).cast("long")
    answers = o.join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.when(F.col("o_totalprice") > 450_000, cents % 200).alias("statement_id"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))
    suggestions = table(spark, sf_dir, "customer").filter("c_acctbal < -900").select((F.col("c_custkey") % 150).alias("statement_id"))
    questions = table(spark, sf_dir, "part").filter("p_size = 1").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("statement_id"))
    return O.document_uses(s.select(F.col("s_suppkey").alias("doc_id")), chunks, answers, suggestions, questions)


def searched_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("code"), F.col("p_type").alias("label"))
    return O.searched(p, "WIDGET", ["ECONOMY", "PROMO"]).unionByName(O.searched(p, "#13", [])).groupBy("code", "label").agg(F.count(F.lit(1)).alias("n"))


def compacted_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are recordings by user and kind, the last counts; those of the users with orders are used."""
    rec = table(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("event_type").alias("step"), F.col("event_id").alias("line"), "value")
    used = table(spark, sf_dir, "orders").select(F.explode(F.array(*[F.concat_ws("/", F.col("o_custkey").cast("string"), F.lit(k)) for k in ("click", "view", "error")])).alias("key"))
    return O.compacted(rec, used, ["error"]).select("key", "line", "value")


def verifier_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows and characters each file of the bundle has."""
    return O.verifier_bundle(base.corpus_lines(spark, sf_dir), base.meta(spark, sf_dir), base.questions(spark, sf_dir)).groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("content")).alias("chars"))


def ingested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the three tables that ingest writes, by workspace."""
    path = base.shared_folder(spark, "ingested")
    O.ingest_tables(base.corpus(spark, sf_dir).withColumn("workspace_id", F.concat(F.lit("w"), (F.col("doc_id") % 3).cast("string"))), path)
    out = None
    for name in ("documents", "lines", "chunks"):
        n = spark.read.parquet(f"{path}/{name}").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns as accepted answers, with a mail address and blank lines put in."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    answer = F.concat(F.lit("  Ask  jo.doe@example.org "), F.substring("text", 1, 40), F.lit("\n \n"), F.regexp_replace("text", r"[0-9@:=\-]", ""))
    rows = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("statement_id"), F.lit("2024-05-01 10:00:00").cast("timestamp").alias("accepted_at"), answer.alias("answer"))
    return O.statement_lines(rows).groupBy("statement_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.startswith("text", F.lit("Ask <EMAIL>"))).alias("mails"), F.min(F.col("said_on").cast("string")).alias("said_on"))


def decided_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines are a statement's passages, judged for every open part of the same brand as the first line's part."""
    line, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    first = line.groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"))
    statements = first.join(p, "p_partkey").select(F.col("l_orderkey").alias("statement_id"), F.lit(1).alias("run_id"), F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("topic"), F.lit(None).cast("string").alias("function"))
    items = p.select("p_partkey", F.lit(1).alias("run_id"), F.col("p_partkey").alias("item_id"), F.col("p_size").alias("position"), F.col("p_brand").alias("topic"), F.lit(None).cast("string").alias("function"), F.lit("unknown").alias("label"), (F.col("p_size") > 40).alias("approved"), F.lit(False).alias("edited"))
    candidates = written(I.fill_candidates(statements, items), "candidates")
    dealt = O.dealt_by_statement(candidates)
    candidates = dealt(candidates)
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    said = dealt(line.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").withColumn("idx", place).filter("idx <= 8")  # a statement's first clean passages
    rows = candidates.select("statement_id", "item_id").join(said.hint("shuffle_hash"), F.col("statement_id") == F.col("l_orderkey"))
    text = F.concat(F.lit("Line "), F.col("l_partkey").cast("string"), F.lit(" is kept in order"))
    passages = said.withColumnRenamed("l_orderkey", "statement_id").select(
        "statement_id", "idx", F.concat_ws("#", F.col("statement_id").cast("string"), F.col("idx").cast("string")).alias("chunk_id"), F.col("statement_id").alias("doc_id"), F.lit("answer.md").alias("filename"), F.col("idx").alias("line_start"), text.alias("text"),
        F.array().cast("array<string>").alias("flags"), F.lit(False).alias("record"), F.lit(True).alias("evidence_allowed"), F.lit("final").alias("status"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("date").alias("as_of"), F.lit(None).cast("date").alias("effective_date"),
    )
    h = (F.col("l_partkey") + F.col("item_id")) % 7
    stances = rows.select("statement_id", "item_id", F.col("idx").alias("ord"), F.col("idx").alias("passage_idx"), F.when(h < 2, "yes").when(h == 2, "partial").otherwise("irrelevant").alias("stance"), text.alias("quote"))
    return O.decided_fills(candidates, passages, stances).select("statement_id", "item_id", "label", "value")


# Cells and file names


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    when = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("timestamp")).otherwise(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '13:05:59' HOUR TO SECOND"))
    price = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice"))
    cells = [O.cell_text(F.col("o_totalprice") > 1000, "boolean"), O.cell_text(when.cast("date"), "date"), O.cell_text(when, "timestamp"), O.cell_text(price, "double"), O.cell_text(F.concat(F.lit(" “"), "o_orderpriority", F.lit("”  x")), "string"), O.cell_text(F.lit(None).cast("string"), "string")]
    return o.select("o_orderkey", F.concat_ws("|", *cells).alias("cells"))


def scrubbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(O.scrubbed(F.replace("text", F.lit("e"), F.lit("\0")))).alias("digest"))


def column_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("p_partkey") % 18278 + 1).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", O.column_letter(k).alias("letters"), O.column_index(O.column_letter(k)).alias("number"))


def redacted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are people, whose names stand in lines and in names of files."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey").cast("string")
    first, last = F.concat(F.lit("Ann"), F.translate(n, "0123456789", "abcdefghij")), F.concat(F.lit("Lee"), F.translate(n, "0123456789", "klmnopqrst"))
    name = F.concat_ws(" ", first, last)
    people = c.select(name.alias("name"))
    lines = c.select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("n"), F.concat(F.lit("Reach "), name, F.lit(" or a.b@c.org; ask "), last, F.lit(" on 555-123-4567, password = \"hunter2hunter2\"")).alias("text"))
    files = c.select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("notes_from_"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("_ghp_"), F.repeat(F.lit("a1"), 20), F.lit("_2026.md")).alias("filename"))
    said = redaction.redact_lines(lines, people).select(F.col("doc_id").alias("c_custkey"), F.col("text").alias("line"))
    return merged_join(said, redaction.redact_filenames(files, people).select(F.col("file_id").alias("c_custkey"), F.col("redacted").alias("file")), "c_custkey")


def queries() -> dict:
    return {
        "d8_gap_check": gap_check, "d10_redecided": redecided, "t6_stream_redecided": stream_redecided, "j19_side_citations": side_citations, "d11_reopened": reopened, "d11_parts_after": parts_after_reopening, "p9_part_currency": part_currency, "p8_machine_judged": machine_judged,
        "j18_worded_suggestions": worded_suggestions, "d4_retrieve_hops": retrieve_hops, "p1_tenant_scores": tenant_scores, "j9_document_uses": document_uses, "p11_searched_answers": searched_answers, "s7_compacted_recordings": compacted_recordings,
        "s18_verifier_bundle": verifier_bundle, "s10_ingested_tables": ingested_tables, "d15_statement_lines": statement_lines, "d14_decided_fills": decided_fills, "f3_cell_texts": cell_texts, "f25_scrubbed_texts": scrubbed_texts, "f28_column_letters": column_letters,
        "f12_redacted_names": redacted_names,
    }


def _redecided_sql() -> str:
    """All items twice, before and after the change, the latter under numbers of their own."""
    both = evidence._PASSAGES.replace(
        "ranked AS (SELECT *, (doc_id // 4)", "ranked0 AS (SELECT *, (doc_id // 4)"
    ).replace(
        "all_items AS (SELECT item_id FROM ranked UNION SELECT doc_id // 4 * 100000 + 99999 FROM documents),",
        """bad AS (SELECT doc_id FROM labels WHERE quality = 0 AND toxic <> 1), gone AS (SELECT doc_id FROM labels WHERE toxic = 1),
ranked AS (SELECT * FROM ranked0 UNION ALL BY NAME SELECT * REPLACE (item_id + 1000000000000 AS item_id, evidence_allowed OR doc_id IN (FROM bad) AS evidence_allowed, CASE WHEN doc_id IN (FROM bad) THEN 'final' ELSE status END AS status, CASE WHEN doc_id IN (FROM bad) THEN NULL ELSE scope END AS scope) FROM ranked0),
all_items AS (SELECT DISTINCT item_id FROM ranked),""",
    )
    return sql("chunks", both + """, ci AS (SELECT item_id, string_agg(chunk_id || stance || note, '|' ORDER BY idx) AS c FROM k WHERE kept GROUP BY 1),
        hit AS (SELECT DISTINCT item_id FROM ranked0 WHERE doc_id IN (FROM bad)), lost AS (SELECT DISTINCT item_id FROM ranked0 WHERE doc_id IN (FROM gone)),
        v AS (SELECT f.item_id, label, value, n_citations, coalesce(c, '') AS c FROM f LEFT JOIN ci USING (item_id))
        SELECT a.item_id, b.label, b.value, b.n_citations, false AS approved FROM v a JOIN v b ON b.item_id = a.item_id + 1000000000000
        WHERE a.item_id IN (FROM hit) AND a.item_id NOT IN (FROM lost) AND a.item_id % 9 <> 0 AND (a.label <> b.label OR a.value IS DISTINCT FROM b.value OR a.c <> b.c)""")


_PARTS = """WITH r AS (SELECT p_brand || '-' || p_size AS outcome_id, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS part_n, p_partkey AS k, p_name || '?' AS question FROM part),
fo AS (SELECT k, list_sort(list(DISTINCT l_suppkey) FILTER (l_shipdate < '1998-03-01')) AS old, list_sort(list(DISTINCT l_suppkey) FILTER (l_shipdate < '1998-06-01')) AS new FROM r JOIN lineitem ON l_partkey = k GROUP BY 1),
st AS (SELECT r.*, CASE WHEN k % 23 = 0 THEN lower(question) WHEN k % 13 = 0 THEN question || '?' ELSE question END AS q, k % 17 = 0 AS other, k % 3 = 0 AS mine, coalesce(old, []) AS old, coalesce(new, []) AS new FROM r LEFT JOIN fo USING (k) WHERE k % 29 > 0),
cu AS (SELECT *, q = question AND (NOT other OR mine) AS current FROM st),
oc AS (SELECT outcome_id, sum(k) AS t FROM r GROUP BY 1),
re AS (SELECT oc.outcome_id, list_filter([CASE WHEN t % 8 = 0 THEN 'failed' END, CASE WHEN oc.outcome_id IN (SELECT outcome_id FROM r WHERE k % 29 = 0) THEN 'part missing' END,
  CASE WHEN oc.outcome_id IN (SELECT outcome_id FROM cu WHERE NOT mine AND NOT current) THEN 'not current' END, CASE WHEN oc.outcome_id IN (SELECT outcome_id FROM cu WHERE NOT mine AND current AND old <> new) THEN 'evidence changed' END], lambda x: x IS NOT NULL) AS reasons
  FROM oc WHERE t % 11 <> 0 AND t % 10 <> 0 AND t % 7 <> 1 AND (t % 7 <> 0 OR oc.outcome_id IN (SELECT outcome_id FROM st)))
"""

_HOPS = """, tk AS (SELECT chunk_id, doc_id, filename, line_start, text, flags, record, regexp_extract_all(text, '[\\pL\\pN]+') AS ws FROM chunks),
ids AS (SELECT *, trim(regexp_extract(text, '^[^:;]+: ([^;]+)', 1)) AS name FROM tk WHERE record),
first5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS idx FROM cl WHERE c <= CASE WHEN record THEN 3 ELSE 2 END) WHERE idx <= 5),
nm AS (SELECT DISTINCT f.item_id, i.chunk_id, i.doc_id, i.filename, i.line_start, i.name FROM first5 f JOIN tk t ON t.chunk_id = f.chunk_id JOIN ids i ON list_contains(t.ws, i.name) WHERE (f.item_id, i.chunk_id) NOT IN (SELECT (item_id, chunk_id) FROM first5)),
nw AS (SELECT DISTINCT lower(name) AS name FROM nm),
cm AS (SELECT w AS name FROM (SELECT DISTINCT chunk_id, lower(unnest(ws)) AS w FROM tk) JOIN nw ON nw.name = w GROUP BY 1 HAVING count(*) > 5),
ow AS (SELECT nm.*, CASE WHEN (item_id, doc_id) IN (SELECT (item_id, doc_id) FROM first5) THEN 0 ELSE 1 END AS own FROM nm),
lk AS (SELECT *, min((own, filename, line_start, chunk_id)) OVER (PARTITION BY item_id, name) AS f FROM ow), se AS (SELECT *, dense_rank() OVER (PARTITION BY item_id ORDER BY f) AS seen FROM lk),
hp AS (SELECT * FROM (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY own, filename, line_start, chunk_id) AS hop FROM se WHERE seen <= 32 AND lower(name) NOT IN (SELECT name FROM cm)) WHERE hop <= 3),
hc AS (SELECT item_id, count(*) AS hops FROM hp GROUP BY 1),
rs AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id, record ORDER BY rank) AS c2 FROM cl WHERE (item_id, chunk_id) NOT IN (SELECT (item_id, chunk_id) FROM hp)),
r8 AS (SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS idx FROM rs WHERE c2 <= CASE WHEN record THEN 3 ELSE 2 END)
SELECT r8.item_id, chunk_id, idx + CASE WHEN idx > 5 THEN coalesce(hops, 0) ELSE 0 END AS idx FROM r8 LEFT JOIN hc ON hc.item_id = r8.item_id WHERE idx <= 8 - coalesce(hops, 0)
UNION ALL SELECT hp.item_id, hp.chunk_id, n + hop FROM hp JOIN (SELECT item_id, max(idx) AS n FROM first5 GROUP BY 1) z ON z.item_id = hp.item_id"""


def _hops_sql() -> str:
    whole = sql("post asked", evidence._FUSED.replace("PARTITION BY item_id, doc_id ORDER BY rank", "PARTITION BY item_id, doc_id, record ORDER BY rank") + _HOPS)
    sheet = """SELECT *, false AS record FROM flagged JOIN meta USING (doc_id) UNION ALL BY NAME SELECT -1 AS doc_id, 'sheet#' || item_id AS chunk_id, item_id AS line_start, 'System: ' || name || '; Owner: team ' || (item_id % 7) AS text, 'Systems' AS heading, []::VARCHAR[] AS flags, 'sheet.csv' AS filename, true AS record
      FROM (SELECT item_id, list_sort(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: {'n': length(w), 'w': w}))[-1].w AS name FROM benchmark) WHERE name IS NOT NULL"""
    assert whole.count("SELECT * FROM flagged JOIN meta USING (doc_id)") == 1
    return whole.replace("SELECT * FROM flagged JOIN meta USING (doc_id)", sheet)


def oracle_sql() -> dict[str, str]:
    redecided_ = _redecided_sql()
    return {
        "d8_gap_check": sql("chunks", evidence._PASSAGES + """, pl AS (SELECT item_id // 100000 AS outcome_id, item_id, CASE label WHEN 'verified' THEN CASE value WHEN 'Yes' THEN 'covered' ELSE 'not_met' END WHEN 'partial' THEN 'partly_covered' WHEN 'conflict' THEN 'documents_disagree' ELSE 'gap' END AS p FROM f),
            o AS (SELECT outcome_id, CASE WHEN bool_or(p = 'documents_disagree') THEN 'documents_disagree' WHEN bool_or(p = 'not_met') THEN 'not_met' WHEN bool_and(p = 'covered') THEN 'covered' WHEN bool_and(p = 'gap') THEN 'gap' ELSE 'partly_covered' END AS label FROM pl GROUP BY 1),
            cn AS (SELECT item_id // 100000 AS outcome_id, count(DISTINCT (doc_id, line, quote, stance)) AS n FROM k WHERE kept GROUP BY 1)
            SELECT o.outcome_id, label, CASE label WHEN 'documents_disagree' THEN 'Documents disagree' WHEN 'not_met' THEN 'Not met' WHEN 'covered' THEN 'Covered' WHEN 'gap' THEN 'Gap' ELSE 'Partly covered' END AS status, coalesce(n, 0) AS citations,
              (SELECT count(*) FROM pl WHERE pl.outcome_id = o.outcome_id AND (p = label OR (label = 'partly_covered' AND p = 'covered'))) * (label <> 'gap')::INT AS told FROM o LEFT JOIN cn USING (outcome_id)"""),
        "d10_redecided": redecided_, "t6_stream_redecided": redecided_,
        "j19_side_citations": sql("chunks", evidence._PASSAGES + """, ks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY idx) - 1 AS citation FROM k WHERE kept),
            s AS (SELECT item_id, unnest(CASE WHEN newer = 'no' THEN ['no', 'yes'] ELSE ['yes', 'no'] END) AS stance, unnest([0, 1]) AS side FROM f WHERE label = 'conflict')
            SELECT s.item_id, side, row_number() OVER (PARTITION BY s.item_id, side ORDER BY citation) - 1 AS place, citation FROM s JOIN ks ON ks.item_id = s.item_id AND ks.stance = s.stance"""),
        "d11_reopened": _PARTS + "SELECT outcome_id, array_to_string(reasons, ', ') AS reasons FROM re WHERE len(reasons) > 0",
        "d11_parts_after": _PARTS + """, op AS (SELECT outcome_id FROM re WHERE len(reasons) > 0), x AS (SELECT string_split(outcome_id, '-')[1] AS brand, outcome_id IN (FROM op) AS o, mine, part_n FROM st),
            kp AS (SELECT brand, count(*) AS kept FROM x WHERE NOT o OR mine GROUP BY 1), ds AS (SELECT brand, count(*) FILTER (o AND part_n = 1) AS dismissed FROM x GROUP BY 1) SELECT brand, kept, dismissed FROM kp FULL JOIN ds USING (brand)""",
        "p9_part_currency": _PARTS + "SELECT outcome_id, part_n, current FROM cu",
        "p8_machine_judged": _PARTS + """SELECT label, count(*) AS n FROM (SELECT outcome_id, CASE WHEN t % 7 = 0 THEN 'user_confirmed' WHEN t % 7 = 1 THEN 'na' ELSE 'partial' END AS label FROM oc)
            WHERE label = 'partial' OR label = 'user_confirmed' AND outcome_id IN (SELECT outcome_id FROM st WHERE part_n > 1) GROUP BY 1""",
        "j18_worded_suggestions": _PARTS + "SELECT st.outcome_id AS item_id, st.part_n - 1 AS part_n, CASE WHEN st.part_n = 1 THEN 'Whole of ' || st.outcome_id ELSE r.question END AS wording FROM st LEFT JOIN r ON r.outcome_id = st.outcome_id AND r.part_n = st.part_n - 1",
        "d4_retrieve_hops": _hops_sql(),
        "p1_tenant_scores": sql("post asked", """, p AS (SELECT post.*, workspace_id FROM post JOIN chunks USING (chunk_id)), nn AS (SELECT workspace_id, count(*) AS n FROM chunks GROUP BY 1), df AS (SELECT workspace_id, term, count(*) AS df FROM p GROUP BY 1, 2), sz AS (SELECT chunk_id, count(*) AS size FROM p GROUP BY 1),
            hit AS (SELECT item_id, chunk_id, sum(tf) AS tf, sum(ln(n / df)::DECIMAL(18, 9)) AS weight FROM (SELECT *, 'w' || (item_id % 3) AS workspace_id FROM asked) JOIN df USING (workspace_id, term) JOIN nn USING (workspace_id) JOIN p USING (workspace_id, term) GROUP BY 1, 2)
            SELECT item_id, chunk_id, round(tf * 0.1 / (1 + ln(1 + size)), 6) AS density, round(weight::DOUBLE / (1 + ln(1 + size)), 9) AS idf FROM hit JOIN sz USING (chunk_id)"""),
        "j9_document_uses": """WITH u AS (SELECT l_suppkey AS d FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey) IN (SELECT (l_orderkey, l_linenumber, l_partkey) FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'A' AND l_tax = 0.08 AND l_orderkey IN (SELECT o_orderkey FROM orders))
            UNION SELECT trunc(o_totalprice * 100)::BIGINT % 200 FROM orders WHERE o_totalprice > 450000 UNION SELECT c_custkey % 150 FROM customer WHERE c_acctbal < -900 UNION SELECT p_partkey FROM part WHERE p_size = 1 AND p_partkey % 2 = 0)
            SELECT s_suppkey AS doc_id, s_suppkey IN (FROM u) AS used FROM supplier""",
        "p11_searched_answers": """WITH a AS (SELECT p_brand AS code, p_type AS label FROM part WHERE (contains(lower(p_name), 'widget') OR contains(lower(p_brand), 'widget')) AND p_type IN ('ECONOMY', 'PROMO') UNION ALL SELECT p_brand, p_type FROM part WHERE contains(p_name, '#13') OR contains(p_brand, '#13'))
            SELECT code, label, count(*) AS n FROM a GROUP BY 1, 2""",
        "s7_compacted_recordings": """SELECT user_id || '/' || event_type AS key, event_id AS line, value FROM events WHERE event_type IN ('click', 'view') AND user_id IN (SELECT o_custkey FROM orders) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
        "s18_verifier_bundle": sql("lines meta items", """SELECT 'docs/' || doc_id || '.txt' AS file, count(*) AS rows, sum(length(n || chr(9) || text))::BIGINT AS chars FROM lines GROUP BY 1
            UNION ALL SELECT 'documents.csv', count(*), sum(length(doc_id || ',' || filename || ',' || status || ',' || coalesce(scope, '')))::BIGINT FROM meta UNION ALL SELECT 'questions.csv', count(*), sum(length(item_id || ',' || topic))::BIGINT FROM items"""),
        "s10_ingested_tables": sql("lines flagged", """SELECT 'w' || (doc_id % 3) AS workspace_id, count(*) AS n, 'documents' AS "table" FROM documents GROUP BY 1 UNION ALL SELECT 'w' || (doc_id % 3), count(*), 'lines' FROM lines GROUP BY 1 UNION ALL SELECT 'w' || (doc_id % 3), count(*), 'chunks' FROM flagged GROUP BY 1"""),
        "d15_statement_lines": r"""SELECT conv_id || '-' || turn AS statement_id, 1 + len(list_filter(string_split(substr(text, 1, 40), chr(10)), lambda x: regexp_matches(x, '\S')))::BIGINT - (regexp_matches(string_split(substr(text, 1, 40), chr(10))[1], '\S'))::BIGINT
              + len(list_filter(string_split(regexp_replace(text, '[0-9@:=\-]', '', 'g'), chr(10)), lambda x: regexp_matches(x, '\S')))::BIGINT AS lines, 1::BIGINT AS mails, '2024-05-01' AS said_on FROM conversations WHERE role = 'assistant'""",
        "d14_decided_fills": """WITH f AS (SELECT l_orderkey, min(l_partkey) AS own FROM lineitem GROUP BY 1), s AS (SELECT f.*, p_brand FROM f JOIN part ON p_partkey = own),
            c AS (SELECT l_orderkey, p.p_partkey AS item_id FROM s JOIN part p ON p.p_brand = s.p_brand AND p.p_partkey <> own AND p.p_size <= 40 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY p.p_size, p.p_partkey) <= 8),
            l AS (SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 8),
            j AS (SELECT c.l_orderkey, item_id, (l_partkey + item_id) % 7 AS h FROM c JOIN l USING (l_orderkey))
            SELECT l_orderkey AS statement_id, item_id, CASE WHEN bool_and(h < 2) THEN 'verified' ELSE 'partial' END AS label, CASE WHEN bool_and(h < 2) THEN 'Yes' ELSE 'Partial' END AS value FROM j WHERE h <= 2 GROUP BY 1, 2""",
        "f3_cell_texts": """SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'TRUE' ELSE 'FALSE' END || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' 13:05' END || '|' ||
            CASE WHEN o_orderkey % 3 = 0 OR o_totalprice = floor(o_totalprice) THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END || '|"' || o_orderpriority || '" x|' AS cells FROM orders""",
        "f25_scrubbed_texts": "SELECT doc_id, md5(replace(text, 'e', '')) AS digest FROM documents",
        "f28_column_letters": """WITH k AS (SELECT p_partkey, (p_partkey % 18278)::INT AS i FROM part) SELECT p_partkey, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(65 + (i - 26) // 26) || chr(65 + (i - 26) % 26)
            ELSE chr(65 + (i - 702) // 676) || chr(65 + (i - 702) // 26 % 26) || chr(65 + (i - 702) % 26) END AS letters, i + 1 AS number FROM k""",
        "f12_redacted_names": "SELECT c_custkey, 'Reach <PERSON> or <EMAIL>; ask <PERSON> on <PHONE>, <SECRET>' AS line, 'notes_from_<PERSON>_<SECRET>_2026.md' AS file FROM customer",
    }
