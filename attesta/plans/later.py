"""Queries on what later rounds need: drafts, evidence in detail, request keys, dated sheets, tenants, and two more streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import canonical
from attesta.operators import decisions as D
from attesta.operators import retrieval as R
from attesta.operators import scoring as G
from attesta.operators.detail import evidence_detail
from attesta.operators.interview import clean_statement_chunks
from attesta.operators.tenants import in_tenants, of_tenants
from attesta.plans import base, evidence, rounds
from attesta.plans.base import shared_folder, sql, table
from attesta.sources.lines import decoded, sheet_lines
from attesta.streaming import cleanup, jobs, reopening

# Drafts: orders are answered items, their customers' terms the documents, in three workspaces


def _drafted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions, drafts of six kinds, and the documents."""
    workspace = lambda k: F.concat(F.lit("w"), (F.col(k) % 3).cast("string")).alias("workspace_id")
    filename = lambda name: F.concat(F.lit("Terms-of_"), F.col(name), F.lit("_v1.md"))
    customers = table(spark, sf_dir, "customer")
    rows = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    said = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" is kept in order"))
    cite = F.struct(F.lit(1).alias("idx"), said.alias("chunk_id"), F.col("c_custkey").alias("doc_id"), filename("c_name").alias("filename"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), said.alias("quote"), F.lit("yes").alias("stance"), F.lit("").alias("note"))
    sides = "struct<rule:string,sides:array<struct<stance:string,citations:array<struct<doc_id:bigint,filename:string,quote:string>>,date:date>>>"
    decisions = rows.select(F.col("o_orderkey").alias("item_id"), F.lit("verified").alias("label"), F.lit("Yes").alias("value"), F.array(cite).alias("citations"), F.lit(None).cast(sides).alias("conflict"), F.lit(None).cast("string").alias("scope_note"))
    k = F.col("o_orderkey")
    other = lambda n: F.concat(F.lit("As the terms of Customer#"), F.lpad((F.col("o_custkey") + n).cast("string"), 9, "0"), F.lit(" say."))
    text = (
        F.when(k % 6 == 0, F.concat(F.lit('Yes. The terms say: "'), said, F.lit(',"'))).when(k % 6 == 1, 'They say "words that nobody wrote here"').when(k % 6 == 2, other(3)).when(k % 6 == 3, other(1)).when(k % 6 == 4, " ")
        .otherwise("It costs $12.50.")
    )
    return decisions, rows.select(k.alias("item_id"), workspace("o_custkey"), text.alias("text")), customers.select(workspace("c_custkey"), filename("c_name").alias("filename"))


def draft_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each draft, and with how many."""
    return D.drafts_checked(*_drafted(spark, sf_dir)).select("item_id", F.array_join("problems", "; ").alias("problems"))


def drafted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their drafts where these are sound, else by the template."""
    return D.answers(*_drafted(spark, sf_dir)).select("item_id", "source", "text")


_DRAFTS = """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, c_name, 'order ' || o_orderkey || ' is kept in order' AS said FROM orders JOIN customer ON c_custkey = o_custkey),
b AS (
  SELECT k, c_name, said, CASE k % 6 WHEN 0 THEN 'Yes. The terms say: "' || said || ',"' ELSE '' END AS draft,
    CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'quote not in the evidence: "words that nobody wrote here"' WHEN 4 THEN 'the answer is empty' WHEN 5 THEN 'number not in the evidence: 12.5'
      WHEN 2 THEN concat_ws('; ', CASE WHEN c + 3 IN (SELECT c_custkey FROM customer) THEN 'names a document it does not cite: terms of customer#' || lpad((c + 3)::VARCHAR, 9, '0') END, 'number not in the evidence: ' || (c + 3))
      ELSE 'number not in the evidence: ' || (c + 1) END AS problems FROM r)
"""

# Evidence in detail


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision's citations with their lines, its drops, and the sides of its conflict, written in a line each."""
    rows = evidence.passages(spark, sf_dir)
    decided = base.written(D.decide(rows.select("item_id").distinct(), rows, evidence.stances(rows)), "decided")
    got = evidence_detail(decided, base.meta(spark, sf_dir), rows, base.corpus_lines(spark, sf_dir))
    text = lambda c: c.cast("string")
    context = lambda c: F.array_join(F.transform(c["context"], lambda x: F.concat(text(x["n"]), F.when(x["cited"], "*").otherwise(""))), ",")
    cite = lambda c: F.concat_ws("|", text(c["line"]), text(c["date"]), c["status"], text(c["found_in_source"]), context(c))
    side = lambda s: F.concat(s["stance"], F.lit(":"), F.coalesce(text(s["date"]), F.lit("")), F.lit(":"), F.array_join(F.transform(s["citations"], lambda p: text(p)), ","))
    return got.select(
        "item_id", F.array_join(F.transform("citations", cite), " ").alias("citations"),
        F.array_join(F.transform("dropped", lambda d: F.concat(d["reason"], F.lit("@"), text(d["line"]), F.when(d["sentence"].isNull(), "?").otherwise(""))), " ").alias("dropped"),
        F.coalesce(F.array_join(F.transform("conflict.sides", side), " "), F.lit("")).alias("sides"),
    )


_DETAIL = evidence._PASSAGES + """, kc AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY idx) - 1 AS spot FROM k WHERE kept),
cx AS (SELECT kc.item_id, kc.spot, coalesce(string_agg(l.n || CASE WHEN l.n = line THEN '*' ELSE '' END, ',' ORDER BY l.n), '') AS ctx, coalesce(bool_or(l.n = line AND NOT record AND contains(' ' || l.text || ' ', ' ' || quote || ' ')), false) AS found
  FROM kc LEFT JOIN lines l ON l.doc_id = kc.doc_id AND l.n BETWEEN line - 2 AND line + 2 GROUP BY 1, 2),
cs AS (SELECT item_id, string_agg(line || '|' || day || '|' || status || '|' || found || '|' || ctx, ' ' ORDER BY spot) AS c FROM kc JOIN cx USING (item_id, spot) GROUP BY 1),
ds AS (SELECT item_id, string_agg(reason || '@' || line_start, ' ' ORDER BY idx) AS d FROM k WHERE NOT kept GROUP BY 1),
si AS (SELECT item_id, stance, string_agg(spot, ',' ORDER BY spot) AS places FROM kc GROUP BY 1, 2),
sd AS (SELECT item_id, 'yes' AS stance, CASE WHEN newer = 'no' THEN older ELSE yd END AS day, CASE WHEN newer = 'no' THEN 1 ELSE 0 END AS side FROM f WHERE rule IS NOT NULL
  UNION ALL SELECT item_id, 'no', CASE WHEN newer = 'yes' THEN older ELSE nd END, CASE WHEN newer = 'no' THEN 0 ELSE 1 END FROM f WHERE rule IS NOT NULL),
ss AS (SELECT item_id, string_agg(sd.stance || ':' || coalesce(sd.day::VARCHAR, '') || ':' || coalesce(places, ''), ' ' ORDER BY side) AS s FROM sd LEFT JOIN si USING (item_id, stance) GROUP BY 1)
SELECT i.item_id, coalesce(c, '') AS citations, coalesce(d, '') AS dropped, coalesce(s, '') AS sides FROM (SELECT DISTINCT item_id FROM pas) i LEFT JOIN cs USING (item_id) LEFT JOIN ds USING (item_id) LEFT JOIN ss USING (item_id)"""

#: The template's sentences, from the same steps: every document is called "doc".
_TEMPLATES = _DETAIL[: _DETAIL.rindex("SELECT i.item_id")] + """, dq AS (SELECT item_id, min(idx) AS m FROM kc GROUP BY item_id, doc_id),
dr AS (SELECT item_id, m AS idx, row_number() OVER (PARTITION BY item_id ORDER BY m) AS r FROM dq),
qs AS (SELECT item_id, string_agg('The doc says: "' || trim(quote) || '"', ' ' ORDER BY idx) AS quotes FROM kc JOIN dr USING (item_id, idx) WHERE r <= 2 GROUP BY 1),
sq AS (SELECT item_id, stance, count(DISTINCT doc_id) AS docs, min_by(trim(quote), idx) AS quote FROM kc GROUP BY 1, 2),
st2 AS (SELECT item_id, string_agg(CASE WHEN docs = 1 OR sd.day IS NULL THEN 'The doc' || coalesce(' (dated ' || sd.day::VARCHAR || ')', '') || ' says: "' || quote || '"' ELSE 'One side, dated ' || sd.day::VARCHAR || ': The doc says: "' || quote || '"' END, ' ' ORDER BY side) AS sides
  FROM sd JOIN sq USING (item_id, stance) GROUP BY 1)
SELECT item_id, label, CASE label WHEN 'unknown' THEN '' WHEN 'conflict' THEN 'The documents disagree. ' || sides || ' Which is current?'
  ELSE concat_ws(' ', CASE value WHEN 'Yes' THEN 'Yes.' WHEN 'No' THEN 'No.' ELSE 'Partly.' END, scope_note, quotes) END AS text
FROM f LEFT JOIN qs USING (item_id) LEFT JOIN st2 USING (item_id)"""

# Request keys


def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a request about each document."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("family/"), (i % 5).cast("string")).alias("model"), F.concat(F.lit("v-"), "lang").alias("prompt_version"), F.lit('Answer "yes" or "no".\n').alias("system"), F.concat("text", F.lit('\t\\"')).alias("user"),
        F.col("source").alias("schema_name"), F.create_map(F.lit("type"), F.lit("object"), F.lit("required"), F.col("source")).alias("schema"), F.col("n_chars").alias("max_tokens"),
        F.when(i % 3 > 0, F.create_map(F.lit("enabled"), i % 2 == 0)).alias("reasoning"),
    )
    return rows.select("doc_id", canonical.request_key(rows.schema).alias("key"))


_JSON = r"""'"' || replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t') || '"'"""
_KEYS = "SELECT doc_id, sha256('[' || concat_ws(', ', " + ", ".join(
    [_JSON.format("'family/' || (doc_id % 5)"), _JSON.format("'v-' || lang"), _JSON.format("""'Answer "yes" or "no".' || chr(10)"""), _JSON.format("""text || chr(9) || '\\"'"""), _JSON.format("source"),
     "'{\"required\": ' || " + _JSON.format("source") + " || ', \"type\": \"object\"}'", "n_chars::VARCHAR", """CASE WHEN doc_id % 3 > 0 THEN '{"enabled": ' || (doc_id % 2 = 0) || '}' ELSE 'null' END"""]
) + ") || ']') AS key FROM documents"

# Sheets: a customer's orders, in some with a line above that dates them all


def sheet_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = F.col("c_custkey")
    line = lambda n, *cells: F.struct(F.lit(n).cast("long").alias("row"), F.array(*[F.lit(x) if isinstance(x, str) else x for x in cells]).alias("cells"))
    stated = F.concat(F.lit("List as of: 2024-0"), (c % 9 + 1).cast("string"), F.lit("-15"))
    rows_ = F.array_compact(F.array(
        line(-9, "Orders", F.lit(None).cast("string")), F.when(c % 3 == 0, line(-8, "", stated)), F.when(c % 5 == 0, line(-7, "Last updated 2024-13-45", " ")), line(-6, "", "", "   "), line(-1, "Order", "Date", "", "Next review"),
    ))
    titles = table(spark, sf_dir, "customer").select(c.alias("sheet_id"), F.explode(rows_).alias("x")).select("sheet_id", "x.row", "x.cells")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = o.select(F.col("o_custkey").alias("sheet_id"), F.col("o_orderkey").alias("row"), F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 4 > 0, day), F.col("o_orderpriority"), F.lit("2030-01-01")).alias("cells"))
    return sheet_lines(titles.unionByName(rows)).select("sheet_id", F.col("n").cast("long").alias("n"), "text", "kind", F.col("as_of").cast("string").alias("as_of"))


_SHEETS = """WITH s AS (
  SELECT c_custkey AS sheet_id, -9 AS row, 'Orders' AS text, 'text' AS kind, NULL AS as_of FROM customer
  UNION ALL SELECT c_custkey, -8, 'List as of: 2024-0' || (c_custkey % 9 + 1) || '-15', 'text', NULL FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, -7, 'Last updated 2024-13-45', 'text', NULL FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT o_custkey, o_orderkey, 'Order: ' || o_orderkey || CASE WHEN o_orderkey % 4 > 0 THEN '; Date: ' || strftime(o_orderdate, '%Y-%m-%d') ELSE '' END || '; Column 3: ' || o_orderpriority || '; Next review: 2030-01-01', 'record',
    CASE WHEN o_custkey % 3 = 0 THEN '2024-0' || (o_custkey % 9 + 1) || '-15' WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END FROM orders)
SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY row) AS n, text, kind, as_of FROM s"""

# What runs observed of the corpus


def observed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the corpus: what each says of documents, keeps of their lines, finds, judges, writes and leaks."""
    runs = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("run_id")
    specs = base.meta(spark, sf_dir).select("doc_id", "status", "scope", "effective_date", "evidence_allowed")
    d, run = F.col("doc_id"), F.col("run_id")
    metadata = specs.select(runs, "*").filter(d % 31 != run).withColumn("status", F.when(d % 11 == run, "other").otherwise(F.col("status")))
    lines = base.corpus_lines(spark, sf_dir).select("doc_id", "n", "text")
    stored = base.written(lines.select(runs, "*").filter((F.col("n") > 1) | (d % 13 != run)), "stored")
    chunks = base.chunks(spark, sf_dir).select("doc_id", "line_start", "text")
    line = F.substring_index("text", "\n", 1)
    evidence_ = chunks.filter("line_start < 4").select(d.alias("code"), "doc_id", F.array_join(F.slice(F.split(line, " "), 1, 9), " ").alias("quote"), F.when(d % 3 == 0, "no").otherwise("yes").alias("stance"))
    passages = chunks.select(runs, d.alias("code"), F.col("line_start").alias("idx"), "doc_id", "text").filter((d + F.col("idx")) % 7 != run)
    stances = passages.filter((d + F.col("idx")) % 10 > 0).select("run_id", "code", F.col("idx").alias("ord"), F.col("idx").alias("passage_idx"), F.when((d + run) % 4 == 0, "no").otherwise("yes").alias("stance"))
    results = specs.select(runs, d.alias("code"), F.when(d % 6 == 0, "unknown").when(d % 5 == run, "partial").otherwise("verified").alias("label"), F.when(d % 6 == 0, None).when(d % 5 == run, "Partial").otherwise("Yes").alias("value"))
    c = F.col("code")
    judged = results.filter(c % 17 > 0).select("run_id", "code", (c % 8 > run).alias("faithful"))
    problems = F.when(c % 9 == run, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")).alias("problems")
    checks = results.filter(c % 19 > 0).select("run_id", "code", problems)
    drafts = results.select("run_id", "code", F.when(c % 3 == run, "template").otherwise("model").alias("source"), problems)
    keys = specs.select(d.alias("code"), F.when(d % 6 == 0, "unknown").otherwise("verified").alias("expected_label"), F.when(d % 6 > 0, "Yes").alias("expected_value"))
    cites = results.select("run_id", "code", (c % 21 > run).alias("valid"))
    private = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("private_id"), F.substring_index("text", " ", 3).alias("private")).filter(F.col("private").rlike("^[A-Za-z ]+$"))
    leaked = G.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), private).select(F.lit(0).cast("long").alias("run_id"), "private_id", "n")
    sides = [G.document_scores(specs, metadata, lines, stored), G.evidence_scores(evidence_, stored, passages, stances), G.answer_scores(results, judged, checks, drafts), G.redaction_scores(keys, results, cites, leaked)]
    out = sides[0]
    for side in sides[1:]:
        out = out.unionByName(side)
    return G.rounded(out, 4)


_OBSERVED = """, runs AS (SELECT unnest([0, 1])::BIGINT AS run_id), sp AS (SELECT run_id, doc_id AS d FROM documents, runs),
li AS (SELECT run_id, doc_id, n, text FROM lines, runs WHERE n > 1 OR doc_id % 13 <> run_id),
ev AS (SELECT DISTINCT doc_id AS d, array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:9], ' ') AS quote, CASE WHEN doc_id % 3 = 0 THEN 'no' ELSE 'yes' END AS want FROM chunks WHERE line_start < 4),
pa AS (SELECT run_id, doc_id AS d, line_start AS idx, text FROM chunks, runs WHERE (doc_id + line_start) % 7 <> run_id),
hl AS (SELECT run_id, d, quote, count(*) AS n FROM ev JOIN li ON li.doc_id = d AND contains(' ' || text || ' ', ' ' || quote || ' ') GROUP BY 1, 2, 3),
mt AS (SELECT run_id, d, quote, min(idx) AS idx FROM ev JOIN pa USING (d) WHERE contains(' ' || replace(text, chr(10), ' ') || ' ', ' ' || quote || ' ') GROUP BY 1, 2, 3),
ef AS (SELECT * FROM ev CROSS JOIN runs LEFT JOIN mt USING (run_id, d, quote)),
w AS (SELECT * FROM sp WHERE d % 6 > 0), n6 AS (SELECT run_id, d, d % 6 = 0 AS unk, d % 5 = run_id AS part FROM sp),
pv AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS private FROM benchmark),
m AS (
  SELECT run_id, 'classification_correct' AS metric, avg((d % 31 <> run_id AND d % 11 <> run_id)::INT) AS value FROM sp GROUP BY 1
  UNION ALL SELECT run_id, 'parsing_documents_match', avg((doc_id % 13 <> run_id)::INT) FROM (SELECT DISTINCT doc_id FROM lines), runs GROUP BY 1
  UNION ALL SELECT run_id, 'parsing_key_quotes_in_one_line', avg((coalesce(n, 0) = 1)::INT) FROM ev CROSS JOIN runs LEFT JOIN hl USING (run_id, d, quote) GROUP BY 1
  UNION ALL SELECT run_id, 'retrieval_recall_at_8', round(avg(x), 4) FROM (SELECT run_id, d, count(idx) / count(*) AS x FROM ef GROUP BY 1, 2) GROUP BY 1
  UNION ALL SELECT run_id, 'stance_accuracy', avg((CASE WHEN (d + idx) % 10 = 0 THEN 'irrelevant' WHEN (d + run_id) % 4 = 0 THEN 'no' ELSE 'yes' END = want)::INT) FROM ef WHERE idx IS NOT NULL GROUP BY 1
  UNION ALL SELECT run_id, 'judge_faithfulness', avg((d % 17 > 0 AND d % 8 > run_id)::INT) FROM w GROUP BY 1
  UNION ALL SELECT run_id, 'answer_checks_pass', avg((d % 19 > 0 AND d % 9 <> run_id)::INT) FROM w GROUP BY 1
  UNION ALL SELECT run_id, 'first_drafts_pass', avg((d % 3 <> run_id AND d % 9 <> run_id)::INT) FROM w GROUP BY 1
  UNION ALL SELECT run_id, 'redaction_citations_valid', avg((d % 21 > run_id)::INT) FROM sp GROUP BY 1
  UNION ALL SELECT run_id, 'redaction_label_accuracy', avg((unk OR NOT part)::INT) FROM n6 GROUP BY 1
  UNION ALL SELECT 0, 'redaction_private_leaks', (SELECT count(*) FROM pv JOIN documents ON contains(text, private) WHERE regexp_matches(private, '^[A-Za-z ]+$'))::DOUBLE)
SELECT run_id, metric, round(value, 4) AS value FROM m"""

# Small steps on the corpus and its bytes


def statement_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clean passages of each document, as a statement's are judged."""
    return clean_statement_chunks(base.chunks(spark, sf_dir), 3).select("doc_id", "chunk_id", F.col("idx").cast("long").alias("idx"))


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as bytes, every second in UTF-8 with a mark and the others in the Western code where that has all their
    characters, and read back."""
    text = F.col("text")
    western = F.encode(text, "ISO-8859-1")
    marked = F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(text, "UTF-8"))
    plain = (F.col("doc_id") % 2 == 0) | (F.decode(western, "ISO-8859-1") != text)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(decoded(F.when(plain, marked).otherwise(western))).alias("digest"))


# Tenants: the same questions, under the same ids, in two of three workspaces


def tenant_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of two tenants finds in its own passages, which are stored by tenant."""
    asked = base.questions(spark, sf_dir).withColumn("workspace_id", F.explode(F.array(F.lit("w0"), F.lit("w1"))))
    chunks = base.stored(spark, sf_dir, "tenant-chunks", ("documents", "labels"), lambda: base.chunks(spark, sf_dir), by="workspace_id")
    index = base.stored(spark, sf_dir, "tenant-postings", ("documents", "labels"), lambda: base.index(spark, sf_dir), by="workspace_id")
    own = [of_tenants(t, asked, "workspace_id") for t in (chunks, index)]
    run = lambda items, c, i: R.retrieve(items, c, i, hop=False, tenant="workspace_id")
    got = in_tenants(run, "workspace_id", ("item_id", "chunk_id", "doc_id"), asked, *own, inside=True)
    return got.select("workspace_id", "item_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("idx").cast("long").alias("idx"), "score")


_TENANTS = """, tp AS (SELECT workspace_id AS ws, post.* FROM post JOIN chunks USING (chunk_id) WHERE workspace_id IN ('w0', 'w1')), nn AS (SELECT workspace_id AS ws, count(*) AS n FROM chunks GROUP BY 1),
df AS (SELECT ws, term, count(*) AS df FROM tp GROUP BY 1, 2), sz AS (SELECT chunk_id, count(*) AS size FROM tp GROUP BY 1),
hit AS (SELECT ws, item_id, chunk_id, sum(tf) AS tf, sum(ln(n / df)::DECIMAL(18, 9)) AS weight FROM asked JOIN tp USING (term) JOIN df USING (ws, term) JOIN nn USING (ws) GROUP BY 1, 2, 3),
sc AS (SELECT ws, item_id, chunk_id, round(tf * 0.1 / (1 + ln(1 + size)), 6) AS density, round(weight::DOUBLE / (1 + ln(1 + size)), 9) AS idf FROM hit JOIN sz USING (chunk_id)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY ws, item_id ORDER BY density DESC, filename, line_start, chunk_id) AS a FROM sc JOIN chunks USING (chunk_id)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY ws, item_id ORDER BY idf DESC, filename, line_start, chunk_id) AS b FROM r1 WHERE a <= 200),
fu AS (SELECT *, row_number() OVER (PARTITION BY ws, item_id ORDER BY score DESC, filename, line_start, chunk_id) AS rank FROM (SELECT *, round(1 / (60 + a) + 1 / (60 + b), 9) AS score FROM r2)),
cl AS (SELECT *, row_number() OVER (PARTITION BY ws, item_id, doc_id ORDER BY rank) AS c FROM fu WHERE NOT list_contains(flags, 'injection')),
top AS (SELECT *, row_number() OVER (PARTITION BY ws, item_id ORDER BY rank) AS idx FROM cl WHERE c <= 2)
SELECT ws AS workspace_id, item_id, chunk_id, rank, idx, score FROM top WHERE idx <= 8"""

# Two streams


def stream_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces expire ten days after their last call, their orders with them, and hourly counters after two days; the calls
    are the ticks of the clean-up. What was dropped, and what is still there at the end."""
    out = shared_folder(spark, "cleanup")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    paths = {n: f"{out}/{n}" for n in ("workspaces", "counters", "orders")}
    used = events.groupBy(F.col("user_id").alias("workspace_id")).agg(F.max("ts").alias("used"))
    cleanup.stored_by_expiry(used, paths["workspaces"], F.col("used") + F.expr("INTERVAL 10 DAYS"))
    counters = events.groupBy("event_type", F.date_trunc("hour", "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    cleanup.stored_by_expiry(counters, paths["counters"], F.col("window_start") + F.expr("INTERVAL 2 DAYS"))
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "workspace_id")
    cleanup.stored_with_parent(orders, paths["orders"], "workspace_id", spark.read.parquet(paths["workspaces"]))
    ticks = jobs.folder_stream(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events")).select(F.col("ts").cast("timestamp").alias("at"))
    jobs.run_batches(ticks, cleanup.cleanup_pass(paths, f"{out}/counts"), f"{out}/state")
    now = str(events.agg(F.max("ts")).first()[0])
    gone = spark.read.parquet(f"{out}/counts").groupBy("table").agg(F.sum("deleted").alias("deleted"))
    left = None
    for name, path in paths.items():
        n = cleanup.alive(spark, path, now).agg(F.count(F.lit(1)).alias("left")).select(F.lit(name).alias("table"), "left")
        left = n if left is None else left.unionByName(n)
    return gone.join(left, "table")


_CLEANUP = """WITH now AS (SELECT max(ts) AS now FROM events), w AS (SELECT user_id, max(ts) + INTERVAL 10 DAY AS x FROM events GROUP BY 1),
r AS (SELECT 'workspaces' AS "table", x FROM w UNION ALL SELECT 'counters', h + INTERVAL 2 DAY FROM (SELECT DISTINCT event_type, date_trunc('hour', ts) AS h FROM events) UNION ALL SELECT 'orders', x FROM orders LEFT JOIN w ON user_id = o_custkey),
d AS (SELECT *, CASE WHEN date_trunc('hour', x) < x THEN date_trunc('hour', x) + INTERVAL 1 HOUR ELSE date_trunc('hour', x) END AS hour FROM r)
SELECT "table", count(*) FILTER (hour IS NULL OR hour <= date_trunc('hour', now)) AS deleted, count(*) FILTER (x > now) AS "left" FROM d, now GROUP BY 1"""


def stream_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that must be judged again, as order lines of later days bring new passages."""
    outcomes, stored, _, deployed = rounds._parts(spark, sf_dir)
    out = shared_folder(spark, "reopened")
    reopening.start(out, outcomes, stored, deployed, "p1", "m")
    part = rounds._numbered_parts(spark, sf_dir)
    write = reopening.reopening_pass(out, "p1", "m")
    lines = jobs.folder_stream(spark, f"{sf_dir}/lineitem*.parquet", table(spark, sf_dir, "lineitem")).filter("l_shipdate >= '1998-03-01' and l_shipdate < '1998-06-01'")
    changes = lambda batch: batch.join(part, batch.l_partkey == part.p_partkey).select(F.col("l_suppkey").cast("string").alias("chunk_id"), "outcome_id", "part_n", F.lit(False).alias("gone"))
    jobs.run_batches(lines, lambda batch, n: write(changes(batch), n), f"{out}/state")
    return reopening.open_outcomes(spark, out).select("outcome_id", F.array_join("reasons", ", ").alias("reasons"))


def queries() -> dict:
    return {
        "d6_draft_problems": draft_problems, "d7_drafted_answers": drafted_answers, "d26_evidence_detail": detail, "f22_request_keys": request_keys, "s3_sheet_dates": sheet_dates, "p1_tenant_retrieval": tenant_retrieval, "d23_observed_scores": observed_scores, "l3_statement_chunks": statement_chunks, "s4_decoded_texts": decoded_texts,
        "t8_stream_cleanup": stream_cleanup, "t6_stream_reopened": stream_reopened,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "d6_draft_problems": _DRAFTS + "SELECT k AS item_id, problems FROM b",
        "d7_drafted_answers": _DRAFTS + """SELECT k AS item_id, CASE WHEN problems = '' THEN 'draft' ELSE 'template' END AS source, CASE WHEN problems = '' THEN draft ELSE 'Yes. The terms of ' || lower(c_name) || ' says: "' || said || '"' END AS text FROM b""",
        "d7_template_answers": sql("chunks", _TEMPLATES),
        "d26_evidence_detail": sql("chunks", _DETAIL), "f22_request_keys": _KEYS, "s3_sheet_dates": _SHEETS, "t8_stream_cleanup": _CLEANUP,
        "l3_statement_chunks": sql("flagged", "SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) AS idx FROM flagged WHERE NOT list_contains(flags, 'injection') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_start) <= 3"),
        "s4_decoded_texts": "SELECT doc_id, md5(text) AS digest FROM documents",
        "d23_observed_scores": sql("chunks", _OBSERVED),
        "p1_tenant_retrieval": sql("post asked", _TENANTS),
        "t6_stream_reopened": rounds.oracle_sql()["d11_reopened"],
    }
