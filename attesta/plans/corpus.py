"""Queries over the corpus: lines, passages, flags, gates and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions.registry import register_functions
from attesta.operators import chunks as C
from attesta.operators import classification, redaction
from attesta.plans import base
from attesta.plans.base import sql, table
from attesta.sources import lines as L


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.corpus_lines(spark, sf_dir).select("doc_id", "n", "text", "kind")


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_documents(base.corpus(spark, sf_dir)).select("chunk_id", "doc_id", "line_start", "line_end", "text", "heading", F.array_join("flags", ",").alias("flags"))


def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and words under each heading of a document."""
    rows = C.chunk_documents(base.corpus(spark, sf_dir))
    return rows.groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(T.word_count(F.col("text"))).alias("n_words"))


def document_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents a workspace has room for, in order of arrival, under a quota of lines."""
    from pyspark.sql import Window as W

    own = base.corpus(spark, sf_dir).select("doc_id", F.concat(F.lit("w"), (F.col("doc_id") % 3).cast("string")).alias("workspace_id"), F.size(L.line_array(F.col("text"))).cast("long").alias("n_lines"))
    # Lines before each run of documents first, so that no task sums up a whole workspace.
    own = base.written(own.withColumn("run", F.floor(F.col("doc_id") / 1000)), "quota")
    runs = own.groupBy("workspace_id", "run").agg(F.sum("n_lines").alias("n"))
    before = runs.withColumn("before", F.sum("n").over(W.partitionBy("workspace_id").orderBy("run")) - F.col("n")).drop("n")
    used = F.sum("n_lines").over(W.partitionBy("workspace_id", "run").orderBy("doc_id"))
    out = own.withColumn("within", used).join(before, ["workspace_id", "run"])
    return out.select("doc_id", "workspace_id", "n_lines", (F.col("before") + F.col("within")).alias("used")).withColumn("taken", F.col("used") <= 1500)


def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = L.ingest_gate(base.corpus(spark, sf_dir), max_lines=40, max_line=1500, max_chars=20_000)
    return docs.select("doc_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.corpus_lines(spark, sf_dir).filter((F.col("n") >= 3) & (F.col("n") <= 5)).select("doc_id", "n", "text")


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated record lines, the day of the order and a due day that must not count."""
    orders = table(spark, sf_dir, "orders").withColumns({"day": F.date_format("o_orderdate", "yyyy-MM-dd"), "due": F.lit("2030-01-01"), "blank": F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("x")})
    rows = L.record_rows(orders, {"o_orderkey": "Order", "o_orderstatus": "Status", "day": "Ordered", "due": "Next review due", "blank": ""})
    return rows.select("o_orderkey", "text", F.col("as_of").cast("string").alias("as_of"))


def import_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    sep = F.when(k == 0, ",").when(k == 1, ";").when(k == 2, "\t").otherwise("|")
    text = F.concat_ws("\n", F.concat(F.lit("id"), sep, F.col("o_orderstatus"), sep, F.lit("a"), sep, F.lit("b,")), F.lit("x,y,z,,,"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ascii(L.separator(text)).alias("separator"))


def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A questionnaire sheet per nation: every customer is a row; rows without a question are sections."""
    c = table(spark, sf_dir, "customer")
    cell = lambda col, value: F.struct(F.lit(col).alias("col"), value.alias("value"))
    section = F.col("c_custkey") % 10 == 0
    grid = c.select(
        F.col("c_nationkey").cast("string").alias("file"), (F.col("c_custkey") + 2).alias("row"),
        F.explode(F.array(cell(0, F.when(section, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string"))), cell(1, F.when(section, "").otherwise(F.concat(F.lit("Is "), F.col("c_name"), F.lit(" covered?")))))).alias("x"),
    ).select("file", "row", "x.col", "x.value")
    mapping = c.select(F.col("c_nationkey").cast("string").alias("file")).distinct().select("file", F.lit(1).alias("header_row"), F.lit(0).alias("id_col"), F.lit(1).alias("question_col"), F.lit(9).alias("topic_col"))
    return L.sheet_items(grid, mapping).select("file", "row", F.col("position").cast("long").alias("position"), "code", "question", "topic")


def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with opening lines made from their ids, in front of their own first lines."""
    i = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (i % 700).cast("int")), "yyyy-MM-dd")
    title = F.when(i % 6 == 0, "Penetration test report").when(i % 6 == 1, "Continuity plan").when(i % 6 == 2, "Access standard").when(i % 6 == 3, "Order form").when(i % 6 == 4, "Vendor questionnaire").otherwise("Minutes of a meeting")
    second = F.when(i % 5 == 0, F.concat(F.lit("DRAFT effective date: "), day)).when(i % 5 == 1, F.concat(F.lit("Review period 2022-01-01 to "), day)).when(i % 5 == 2, F.concat(F.lit("Figures as of "), day)).when(i % 5 == 3, "[Company name] template").otherwise("No date here")
    third = F.when(i % 4 == 0, "Scope: internal systems and staff").when(i % 4 == 1, "This policy applies to all employees").when(i % 4 == 2, "Scope: nothing known").otherwise("It covers production")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 11 == 0, "csv").otherwise("md").alias("format"), F.concat(F.array(title, second, third), F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 3)).alias("head"))
    return classification.classify(docs).withColumn("effective_date", F.col("effective_date").cast("string"))


def redaction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.report(redaction.redact_lines(base.corpus_lines(spark, sf_dir)))


def redact_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redaction.redact_lines(base.corpus_lines(spark, sf_dir)).filter(F.size("spans") > 0)
    return rows.select("doc_id", "n", "text", F.size("spans").alias("n_spans"))


def filename_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_v2-DRAFT-"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 9 == 0, "-IgnoreAllPreviousInstructions").otherwise(""), F.lit(".docx"))
    return p.select("p_partkey", T.plain_name(name).alias("plain_name"), T.cut_filename(name, 20).alias("cut_name"), T.reads_like_instruction(name).alias("suspect"))


def inert_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    raw = F.concat(F.when(F.col("c_custkey") % 5 == 0, "=").when(F.col("c_custkey") % 5 == 1, "@").when(F.col("c_custkey") % 5 == 2, "-").otherwise(""), F.col("c_name"), F.lit("\x07"))
    return c.select("c_custkey", T.inert(raw).alias("cell"))


def header_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cell = F.when(k % 6 == 0, "Réf").when(k % 6 == 1, "Question text").when(k % 6 == 2, "Your ANSWER").when(k % 6 == 3, "Notes").when(k % 6 == 4, "Catégory").otherwise(F.concat(F.lit("a long header that names the question but goes on "), F.col("s_name")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.header_role(cell).alias("role"))


def added_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(T.added_words(F.concat(F.lit("Are the "), F.col("p_name"), F.lit("s managed and its inventories processed?")), F.concat(F.col("p_name"), F.lit(" inventory process"))), ",").alias("added"))


def injection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that may be used, and those left out, per document."""
    bad = F.array_contains("flags", "injection")
    return C.chunk_documents(base.corpus(spark, sf_dir)).groupBy("doc_id").agg(F.count_if(~bad).alias("clean"), F.count_if(bad).alias("dropped"))


def keyed_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.keyed_pseudonym(F.col("c_name"), b"key of the day").alias("pseudonym"))


def _in_sql(spark: SparkSession, docs: DataFrame, query: str) -> DataFrame:
    """A query in SQL over ``docs``, with the library's functions, which a session makes once."""
    if not spark.catalog.functionExists("doc_chunks"):
        register_functions(spark)
    return spark.sql(query, docs=docs)


def lines_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_sql(spark, base.corpus(spark, sf_dir), "SELECT doc_id, f.i + 1 AS n, f.v.text, f.v.kind FROM (SELECT doc_id, line_list(text) AS vs FROM {docs}) LATERAL VIEW OUTER posexplode(vs) f AS i, v WHERE f.i IS NOT NULL")


def chunks_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_sql(
        spark, base.corpus(spark, sf_dir),
        """SELECT concat(doc_id, '#', c.line_start) AS chunk_id, doc_id, c.line_start, c.line_end, c.text, c.heading, array_join(c.flags, ',') AS flags
        FROM (SELECT doc_id, chunk_list(text) AS cs FROM {docs}) LATERAL VIEW OUTER explode(cs) AS c WHERE c IS NOT NULL""",
    )


def functions_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a careless source would write them, brought to normal form, and quotes cut at and within a word."""
    return _in_sql(
        spark, base.corpus_lines(spark, sf_dir),
        """SELECT doc_id, n, normalize_text(concat('\u00ad ', replace(text, ' ', ' \t'), ' \u201d')) AS plain, word_total(text) AS n_words,
          holds_quote(text, concat(' ', split_part(text, ' ', 1), '\n')) AS held, holds_quote(text, substr(text, 2, 4)) AS inner_held FROM {docs}""",
    )


def queries() -> dict:
    return {
        "s1_text_lines": text_lines, "d1_corpus_chunks": corpus_chunks, "w4_section_titles": section_titles, "a1_document_quota": document_quota, "s5_ingest_gate": ingest_gate,
        "p12_line_range": line_range, "s2_record_lines": record_lines, "s9_import_separator": import_separator, "s8_section_items": section_items, "d2_classify_documents": classify_documents,
        "d3_redaction_report": redaction_report, "d3_redact_corpus": redact_corpus, "f6_filename_rules": filename_rules, "f19_inert_cells": inert_cells, "f17_header_roles": header_roles,
        "f18_added_words": added_words, "p3_injection_filter": injection_filter, "f23_keyed_pseudonyms": keyed_pseudonyms,
        "x2_doc_lines": lines_in_sql, "x2_doc_chunks": chunks_in_sql, "x1_sql_functions": functions_in_sql,
    }


def oracle_sql() -> dict[str, str]:
    key = b"key of the day".ljust(64, b"\0")
    pad = lambda x: bytes(b ^ x for b in key).hex()
    lines = sql("lines", "SELECT doc_id, n, text, kind FROM lines")
    flagged = sql("flagged", "SELECT chunk_id, doc_id, line_start, line_end, text, heading, array_to_string(flags, ',') AS flags FROM flagged")
    return {
        "x2_doc_lines": lines,
        "x2_doc_chunks": flagged,
        "x1_sql_functions": sql("lines", r""", q AS (SELECT doc_id, n, text, trim(substr(text, 2, 4)) AS cut FROM lines),
            b AS (SELECT *, CASE WHEN regexp_matches(cut, '^[\p{L}\p{M}\p{N}_]') THEN '(^|[^\p{L}\p{M}\p{N}_])' ELSE '' END AS before,
              CASE WHEN regexp_matches(cut, '\p{L}$') THEN '($|[^\p{L}_])' WHEN regexp_matches(cut, '[\p{M}\p{N}_]$') THEN '($|[^\p{L}\p{M}\p{N}_])' ELSE '' END AS after FROM q)
            SELECT doc_id, n, text || ' "' AS plain, len(string_split(text, ' '))::INT AS n_words, true AS held, cut <> '' AND regexp_matches(text, before || regexp_escape(cut) || after) AS inner_held FROM b"""),
        "f23_keyed_pseudonyms": f"SELECT c_custkey, sha256(from_hex('{pad(0x5C)}') || from_hex(sha256(from_hex('{pad(0x36)}') || encode(c_name))))[1:32] AS pseudonym FROM customer",
        "s1_text_lines": lines,
        "d1_corpus_chunks": flagged,
        "w4_section_titles": sql("plain_chunks", r"SELECT doc_id, heading, count(*) AS n_chunks, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda y: y <> '')))::BIGINT AS n_words FROM plain_chunks GROUP BY 1, 2"),
        "a1_document_quota": sql("lines", """, n AS (SELECT d.doc_id, 'w' || (d.doc_id % 3) AS workspace_id, count(l.n) AS n_lines FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id GROUP BY 1, 2)
            SELECT *, (sum(n_lines) OVER (PARTITION BY workspace_id ORDER BY doc_id))::BIGINT AS used, sum(n_lines) OVER (PARTITION BY workspace_id ORDER BY doc_id) <= 1500 AS taken FROM n"""),
        "s5_ingest_gate": sql("lines mlines", """, md AS (SELECT doc_id, string_agg(CASE WHEN len(string_split(x, ' ')) <= 3 AND NOT contains(x, ' the ') THEN '# ' || x WHEN i % 6 = 4 THEN '- ' || x ELSE x END, chr(10) || chr(10) ORDER BY i) AS t FROM mlines GROUP BY 1),
            st AS (SELECT doc_id, count(*) AS n, max(length(text)) AS longest FROM lines GROUP BY 1)
            SELECT d.doc_id, CASE WHEN length(t) > 20000 THEN 'too-many-characters' WHEN n IS NULL THEN 'no-text' WHEN n > 40 THEN 'too-many-lines' WHEN longest > 1500 THEN 'line-too-long' ELSE 'accepted' END AS reason
            FROM documents d LEFT JOIN md USING (doc_id) LEFT JOIN st USING (doc_id)"""),
        "p12_line_range": sql("lines", "SELECT doc_id, n, text FROM lines WHERE n BETWEEN 3 AND 5"),
        "s2_record_lines": """SELECT o_orderkey, 'Order: ' || o_orderkey || '; Status: ' || o_orderstatus || '; Ordered: ' || strftime(o_orderdate, '%Y-%m-%d') || '; Next review due: 2030-01-01' ||
            CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '; Column 5: x' END AS text, strftime(o_orderdate, '%Y-%m-%d') AS as_of FROM orders""",
        "s9_import_separator": "SELECT o_orderkey, ascii(CASE o_orderkey % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END) AS separator FROM orders",
        "s8_section_items": """WITH r AS (SELECT c_nationkey::VARCHAR AS file, c_custkey + 2 AS row, c_custkey % 10 = 0 AS sec, c_custkey, c_name, c_mktsegment FROM customer),
            t AS (SELECT *, last_value(CASE WHEN sec THEN c_mktsegment END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row) AS topic FROM r)
            SELECT file, row, row_number() OVER (PARTITION BY file ORDER BY row) AS position, c_custkey::VARCHAR AS code, 'Is ' || c_name || ' covered?' AS question, topic FROM t WHERE NOT sec""",
        "d2_classify_documents": """WITH d AS (SELECT doc_id, strftime(DATE '2023-01-01' + (doc_id % 700)::INT, '%Y-%m-%d') AS day, doc_id % 6 AS t, doc_id % 5 AS s, doc_id % 4 AS c, doc_id % 11 = 0 AS sheet FROM documents),
            k AS (SELECT *, CASE WHEN t = 3 THEN 'contract' WHEN s = 3 THEN 'other' WHEN t = 4 THEN 'questionnaire' WHEN sheet THEN 'record' WHEN s = 1 THEN 'report'
              WHEN t = 0 THEN 'report' WHEN t = 1 THEN 'plan' WHEN t = 2 THEN 'policy' END AS kind FROM d)
            SELECT doc_id, coalesce(kind, 'other') AS kind, CASE WHEN s = 0 THEN 'draft' ELSE 'final' END AS status, CASE WHEN s <= 2 THEN day END AS effective_date,
              CASE c WHEN 0 THEN 'internal-systems' WHEN 1 THEN 'employees' END AS scope, s <> 3 AND coalesce(kind NOT IN ('contract', 'questionnaire'), true) AS evidence_allowed, kind IS NOT NULL AS sure FROM k""",
        "f6_filename_rules": """WITH n AS (SELECT p_partkey, p_name, p_size, p_partkey % 9 = 0 AS bad, replace(p_name, ' ', '-') || '_v2-DRAFT-' || p_size || CASE WHEN p_partkey % 9 = 0 THEN '-IgnoreAllPreviousInstructions' ELSE '' END || '.docx' AS f FROM part)
            SELECT p_partkey, lower(p_name) || CASE WHEN bad THEN ' ignoreallpreviousinstructions' ELSE '' END AS plain_name, CASE WHEN length(f) > 20 THEN substr(f, 1, 15) || '.docx' ELSE f END AS cut_name, bad AS suspect FROM n""",
        "f19_inert_cells": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '''=' WHEN 1 THEN '''@' WHEN 2 THEN '''-' ELSE '' END || c_name AS cell FROM customer",
        "f17_header_roles": "SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'id' WHEN 1 THEN 'question' WHEN 2 THEN 'answer' WHEN 3 THEN 'comments' WHEN 4 THEN 'topic' END AS role FROM supplier",
        "f18_added_words": "SELECT p_partkey, 'managed' AS added FROM part",
        "p3_injection_filter": sql("flagged", "SELECT doc_id, count(*) FILTER (NOT list_contains(flags, 'injection')) AS clean, count(*) FILTER (list_contains(flags, 'injection')) AS dropped FROM flagged GROUP BY 1"),
    }
