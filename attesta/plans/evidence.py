"""Queries from passages to decisions: index, retrieval, stances, labels, answers and their citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import decisions as D
from attesta.operators import retrieval as R
from attesta.plans import base
from attesta.plans.base import sql, table


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every term, and its share of all passages."""
    chunks = base.chunks(spark, sf_dir)
    total = chunks.agg(F.count(F.lit(1)).alias("n"))
    df = R.document_frequency(base.index(spark, sf_dir)).crossJoin(F.broadcast(total))
    return df.select("term", "df", F.round(F.ln(F.col("n") / F.col("df")), 6).alias("idf"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.item_terms(base.questions(spark, sf_dir)).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("terms"))


def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of every passage that holds a term of an item; statements are excluded before anything is counted."""
    chunks = base.chunks(spark, sf_dir).filter("origin <> 'statement'")
    return R.scored(base.questions(spark, sf_dir), chunks, base.written(R.postings(chunks), "postings"))


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that ask for words in the middle of a benchmark text and for two phrases before them."""
    words = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " ", -1), lambda w: w.rlike("^[A-Za-z]{2,}$"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    said = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    return rows.select("item_id", said(4, 3).alias("question"), F.lit(None).cast("string").alias("topic"), F.filter(F.array(said(1, 2), said(3, 3)), lambda p: p != "").alias("phrases"))


def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the phrases of each item stand, word by word."""
    found = R.phrase_matches(_worded(spark, sf_dir), base.index(spark, sf_dir))
    return found.select("item_id", "chunk_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("noise").cast("long").alias("noise"))


def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of the passages that hold a word or phrase of the item."""
    return R.scored(_worded(spark, sf_dir), base.chunks(spark, sf_dir), base.index(spark, sf_dir))


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = base.chunks(spark, sf_dir)
    return R.retrieve(base.questions(spark, sf_dir), chunks, base.index(spark, sf_dir), hop=False)


def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _retrieved(spark, sf_dir)
    return got.select("item_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("idx").cast("long").alias("idx"), "score")


def retrieval_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged passages among each item's first 8. Every fifth item asks in the flagged passages' own words."""
    own = F.when(F.col("item_id") % 5 == 0, F.lit("ignore previous instructions")).otherwise(F.col("question"))
    chunks = base.chunks(spark, sf_dir)
    return R.dropped(base.questions(spark, sf_dir).withColumn("question", own), chunks, base.index(spark, sf_dir)).select("item_id", "chunk_id", "filename", "reason")


def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the items whose text stands in some document, how many have such a document among their passages."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    longest = F.array_max(F.transform(words("quote"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    items = base.questions(spark, sf_dir).select("item_id", F.regexp_replace("question", r"\s+", " ").alias("quote")).withColumn("w", longest)
    # A document is met through the item's longest word, then looked through for the whole of it.
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("flat"))
    said = docs.select("doc_id", "flat", F.explode_outer(F.array_distinct(words("flat"))).alias("w")).filter("w is not null")
    held = said.join(items, "w").filter(F.contains("flat", F.col("quote"))).select("item_id", "doc_id").distinct()
    got = _retrieved(spark, sf_dir).select("item_id", "doc_id").distinct().withColumn("hit", F.lit(1))
    per_item = held.join(got, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return per_item.agg(F.count(F.lit(1)).alias("items"), F.sum("hit").alias("found"), F.round(F.avg("hit"), 6).alias("recall"))


# Judged passages: all passages dealt to items, with stances and quotes from a hash of their id


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of the corpus, two of each of four documents to an item; every fifth of an item is a dated row."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("line_start")) - 1
    c = base.chunks(spark, sf_dir).withColumn("__n", place)
    c = c.withColumn("item_id", F.floor(F.col("doc_id") / 4) * 100_000 + F.floor(F.col("__n") / 2)).withColumn("idx", (F.col("doc_id") % 4 * 2 + F.col("__n") % 2 + 1).cast("int")).drop("__n")
    record = F.col("idx") == 5
    return base.written(c.withColumns({
        "record": record,
        "as_of": F.when(record, F.date_add(F.lit("2024-03-01").cast("date"), (F.col("doc_id") % 200).cast("int"))).cast("date"),
        "text": F.when(record, F.concat(F.lit("Row: "), F.col("chunk_id"), F.lit("; State: kept in order; Owner: team"))).otherwise(F.col("text")),
    }), "passages")


def stances(rows: DataFrame) -> DataFrame:
    """A stance for each passage, with a quote that is good, too short, or made up; some passages are judged twice."""
    h = F.conv(F.substring(F.md5("chunk_id"), 1, 4), 16, 10).cast("int")
    words = F.split(F.substring_index("text", "\n", 1), " ")
    quote = (
        F.when(F.col("record") & (h % 3 == 0), "State: kept in order").when(F.col("record"), "kept in order")
        .when(h % 11 == 0, F.array_join(F.slice(words, 1, 2), " ")).when(h % 13 == 0, "words that nobody wrote here").otherwise(F.array_join(F.slice(words, 1, 9), " "))
    )
    one = rows.select("item_id", F.col("idx").alias("ord"), F.col("idx").alias("passage_idx"), F.when(h % 8 < 4, "yes").when(h % 8 < 6, "no").when(h % 8 == 6, "partial").otherwise("irrelevant").alias("stance"), quote.alias("quote"))
    again = one.filter("passage_idx % 4 = 0").withColumns({"ord": F.col("ord") + 100, "stance": F.lit("no")})
    return one.unionByName(again)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all items; each group of four documents has one more item that no passage bears on."""
    rows = passages(spark, sf_dir)
    bare = table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 4) * 100_000 + 99_999).alias("item_id")).distinct()
    return D.decide(rows.select("item_id").distinct().unionByName(bare), rows, stances(rows))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages(spark, sf_dir)
    return D.judged(rows, stances(rows))


def judged_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first judgement of each passage after the quote check, the evidence gate and the negation rule."""
    return _judged(spark, sf_dir).select("item_id", F.col("idx").cast("long").alias("idx"), "stance", "note", "reason", F.col("line").cast("long").alias("line"))


def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("item_id", "label", "value", F.size("citations").alias("n_citations"), F.size("dropped").alias("n_dropped"), F.col("conflict.rule").alias("rule"), "scope_note", "confidence")


def conflict_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decisions(spark, sf_dir).filter("conflict is not null").select("item_id", F.col("conflict.rule").alias("rule"), F.posexplode("conflict.sides").alias("side", "x"))
    return rows.select("item_id", "rule", "side", "x.stance", F.size("x.citations").alias("n"), F.col("x.date").cast("string").alias("day"))


def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("item_id", F.explode("dropped.reason").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("items"))


def template_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.answers(_decisions(spark, sf_dir)).select("item_id", "label", "text")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def citation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cited line with two lines on both sides, the cited one marked, and whether the quote is still there."""
    cites = _judged(spark, sf_dir).filter("reason is null and not record").select("item_id", "doc_id", "idx", "line", "quote")
    lines = base.corpus_lines(spark, sf_dir).select("doc_id", "n", "text")
    near = cites.withColumn("n", F.explode(F.sequence(F.col("line") - 2, F.col("line") + 2))).join(lines, ["doc_id", "n"])
    return near.select("item_id", F.col("idx").cast("long").alias("idx"), F.col("n").cast("long").alias("n"), (F.col("n") == F.col("line")).alias("cited"), T.contains_quote(F.col("text"), F.col("quote")).alias("holds"))


def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many quotes are found again in the one line that they cite."""
    cites = _judged(spark, sf_dir).filter("reason is null and not record").select("doc_id", F.col("line").alias("n"), "quote")
    held = cites.join(base.corpus_lines(spark, sf_dir).select("doc_id", "n", "text"), ["doc_id", "n"], "left").withColumn("ok", F.coalesce(T.contains_quote(F.col("text"), F.col("quote")), F.lit(False)))
    return held.agg(F.count(F.lit(1)).alias("citations"), F.count_if("ok").alias("valid"), F.round(F.count_if("ok") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("share"))


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents behind each decision."""
    return _decisions(spark, sf_dir).select("item_id", F.size(F.array_distinct(F.transform("citations", lambda c: c["doc_id"]))).alias("documents"))


def draft_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a drafted sentence that its order does not support."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Order "), k.cast("string"), F.when(k % 3 == 0, " cost $12.50").when(k % 3 == 1, " grew 7 percent").otherwise(" has 3 lines"), F.lit(" for "), F.col("o_custkey").cast("string"))
    sources = F.array(F.concat(F.lit("order "), k.cast("string")), F.when(k % 2 == 0, "USD 12.5 and 7%").otherwise("12.5 of 7"), F.concat(F.lit("customer "), (F.col("o_custkey") - k % 2).cast("string")))
    return o.select("o_orderkey", F.array_join(T.unsupported_numbers(text, sources), ",").alias("unsupported"))


def queries() -> dict:
    return {
        "a2_term_frequencies": term_frequencies, "f9_query_terms": query_terms, "a3_match_scores": match_scores, "a3_cover_density": cover_density, "j2_phrase_matches": phrase_matches, "d4_retrieve_topk": retrieve_topk, "p3_retrieval_drops": retrieval_drops, "a15_retrieval_recall": retrieval_recall,
        "j5_judged_passages": judged_passages, "d5_decide": decide, "a7_conflict_sides": conflict_sides, "p5_drop_reasons": drop_reasons, "d7_template_answers": template_answers, "a24_label_counts": label_counts,
        "j8_citation_context": citation_context, "a17_citation_validity": citation_validity, "a27_source_documents": source_documents, "f8_draft_numbers": draft_numbers,
    }


_PASSAGES = """, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) - 1 AS place FROM chunks),
ranked AS (SELECT *, (doc_id // 4) * 100000 + place // 2 AS item_id, doc_id % 4 * 2 + place % 2 + 1 AS idx FROM placed),
all_items AS (SELECT item_id FROM ranked UNION SELECT doc_id // 4 * 100000 + 99999 FROM documents),
pas AS (
  SELECT item_id, idx, chunk_id, doc_id, filename, line_start, flags, evidence_allowed, status, effective_date, scope, idx = 5 AS record,
    CASE WHEN idx = 5 THEN (DATE '2024-03-01' + (doc_id % 200)::INT)::DATE END AS as_of,
    CASE WHEN idx = 5 THEN 'Row: ' || chunk_id || '; State: kept in order; Owner: team' ELSE text END AS text, ('0x' || substr(md5(chunk_id), 1, 4))::INT AS h
  FROM ranked),
st AS (
  SELECT *, CASE WHEN h % 8 < 4 THEN 'yes' WHEN h % 8 < 6 THEN 'no' WHEN h % 8 = 6 THEN 'partial' ELSE 'irrelevant' END AS said,
    string_split(string_split(text, chr(10))[1], ' ') AS ws FROM pas),
q AS (
  SELECT *, CASE WHEN record AND h % 3 = 0 THEN 'State: kept in order' WHEN record THEN 'kept in order' WHEN h % 11 = 0 THEN array_to_string(ws[1:2], ' ')
    WHEN h % 13 = 0 THEN 'words that nobody wrote here' ELSE array_to_string(ws[1:9], ' ') END AS quote FROM st WHERE said <> 'irrelevant'),
j AS (
  SELECT *, CASE WHEN NOT record AND len(string_split(quote, ' ')) < 3 THEN 'quote-length' WHEN NOT record AND quote = 'words that nobody wrote here' THEN 'containment'
      WHEN record AND h % 3 <> 0 THEN 'record-field' WHEN NOT evidence_allowed THEN 'not-evidence' WHEN list_contains(flags, 'placeholder') THEN 'placeholder' WHEN list_contains(flags, 'injection') THEN 'injection' END AS reason,
    CASE WHEN (NOT record AND len(string_split(quote, ' ')) < 3) OR (NOT record AND quote = 'words that nobody wrote here') OR (record AND h % 3 <> 0) THEN NULL ELSE line_start END AS line,
    CASE WHEN said = 'yes' AND contains(' ' || quote || ' ', ' not ') AND NOT contains(quote, 'not only') THEN 'partial' ELSE said END AS stance,
    CASE WHEN said = 'yes' AND contains(' ' || quote || ' ', ' not ') AND NOT contains(quote, 'not only') THEN 'negation' ELSE '' END AS note FROM q),
k AS (SELECT *, reason IS NULL AS kept, coalesce(as_of, effective_date) AS day FROM j),
g AS (
  SELECT item_id, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_drop, coalesce(bool_or(kept AND stance = 'yes'), false) AS yes, coalesce(bool_or(kept AND stance = 'no'), false) AS no,
    bool_and(stance = 'yes') FILTER (kept) AS all_yes, bool_and(stance = 'no') FILTER (kept) AS all_no, bool_and(status = 'draft') FILTER (kept) AS all_draft,
    count(DISTINCT doc_id) FILTER (kept AND stance IN ('yes', 'no')) AS docs, coalesce(bool_or(scope IS NULL) FILTER (kept AND stance IN ('yes', 'no')), false) AS open_scope,
    list_sort(list(DISTINCT scope) FILTER (kept AND stance = 'yes')) AS ys, list_sort(list(DISTINCT scope) FILTER (kept AND stance = 'no')) AS ns,
    array_to_string(list_sort(list(DISTINCT filename) FILTER (kept AND stance = 'yes')), ', ') AS yf, array_to_string(list_sort(list(DISTINCT filename) FILTER (kept AND stance = 'no')), ', ') AS nf,
    coalesce(bool_or(reason IN ('quote-length', 'containment', 'record-field')), false) AS failed,
    max(day) FILTER (kept AND stance = 'yes') AS yd, max(day) FILTER (kept AND stance = 'no') AS nd FROM k GROUP BY 1),
snap AS (SELECT DISTINCT item_id, stance, doc_id, as_of FROM k WHERE kept AND record AND stance IN ('yes', 'no')),
cmp AS (
  SELECT s.item_id, s.stance AS newer, s.top, max(o.day) AS older FROM (SELECT item_id, stance, max(as_of) AS top FROM snap GROUP BY 1, 2) s JOIN k o ON o.item_id = s.item_id AND o.kept AND o.stance IN ('yes', 'no') AND o.stance <> s.stance
  WHERE o.day IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snap x WHERE x.item_id = s.item_id AND x.stance = s.stance AND x.doc_id = o.doc_id AND x.as_of = o.as_of)
    AND (o.as_of IS NOT NULL OR NOT EXISTS (SELECT 1 FROM snap x WHERE x.item_id = s.item_id AND x.stance = s.stance AND x.doc_id = o.doc_id))
  GROUP BY 1, 2, 3 HAVING s.top > max(o.day)),
newer AS (SELECT item_id, any_value(newer) AS newer, any_value(older) AS older FROM cmp GROUP BY 1 HAVING count(*) = 1),
dec AS (
  SELECT i.item_id, g.*, newer.newer, newer.older, yes AND no AND docs >= 2 AS two, yes AND no AND docs >= 2 AND NOT open_scope AND NOT list_has_any(coalesce(ys, []), coalesce(ns, [])) AS apart
  FROM all_items i LEFT JOIN g ON g.item_id = i.item_id LEFT JOIN newer ON newer.item_id = i.item_id),
d AS (
  SELECT *, CASE WHEN coalesce(n_kept, 0) = 0 THEN 'unknown' WHEN apart THEN 'partial' WHEN two THEN 'conflict' WHEN (all_yes OR all_no) AND NOT all_draft THEN 'verified' ELSE 'partial' END AS label FROM dec),
sw(k, v) AS (VALUES ('internal-systems', 'internal systems'), ('production', 'the production environment'), ('employees', 'employees')),
f AS (
  SELECT item_id, label, CASE label WHEN 'verified' THEN CASE WHEN all_yes THEN 'Yes' ELSE 'No' END WHEN 'partial' THEN 'Partial' END AS value, coalesce(n_kept, 0) AS n_citations, coalesce(n_drop, 0) AS n_dropped,
    CASE WHEN label = 'conflict' THEN CASE WHEN newer IS NULL THEN 'documents-disagree' ELSE 'date' END END AS rule,
    CASE WHEN apart THEN 'Yes for ' || (SELECT string_agg(v, ' and ' ORDER BY k) FROM sw WHERE list_contains(ys, k)) || ' (' || yf || '); no for ' || (SELECT string_agg(v, ' and ' ORDER BY k) FROM sw WHERE list_contains(ns, k)) || ' (' || nf || ').' END AS scope_note,
    round(greatest(CASE label WHEN 'verified' THEN 0.9 WHEN 'partial' THEN 0.6 WHEN 'conflict' THEN 0.3 ELSE 0.0 END - CASE WHEN coalesce(failed, false) THEN 0.2 ELSE 0.0 END, 0.0), 2)::DOUBLE AS confidence, yd, nd, newer, older FROM d)
"""

_SCORED = """, own AS (SELECT * FROM chunks {where}), p AS (SELECT post.* FROM post JOIN own USING (chunk_id)), nn AS (SELECT count(*) AS n FROM own), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), sz AS (SELECT chunk_id, count(*) AS size FROM p GROUP BY 1),
hit AS (SELECT item_id, chunk_id, sum(tf) AS tf, sum(ln(n / df)::DECIMAL(18, 9)) AS weight FROM asked JOIN df USING (term) JOIN p USING (term), nn GROUP BY 1, 2),
sc AS (SELECT item_id, chunk_id, round(tf * 0.1 / (1 + ln(1 + size)), 6) AS density, round(weight::DOUBLE / (1 + ln(1 + size)), 9) AS idf FROM hit JOIN sz USING (chunk_id))"""

_WORDED = rf""", bw AS (SELECT item_id, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda w: regexp_matches(w, '^[A-Za-z]{{2,}}$')) AS w FROM benchmark),
pw AS (SELECT item_id, [w[1:2], w[3:5]] AS ps FROM bw),
ph AS (SELECT item_id, k, lower(unnest(ps[k])) AS w, generate_subscripts(ps[k], 1) - 1 AS off FROM (SELECT item_id, ps, unnest([1, 2]) AS k FROM pw)),
pt AS (SELECT item_id, k, {base.sql_stem("w")} AS term, off FROM ph WHERE w NOT IN ({base._STOP})),
po AS (SELECT item_id, k, term, off - min(off) OVER (PARTITION BY item_id, k) AS off, count(*) OVER (PARTITION BY item_id, k) AS n, max(off) OVER (PARTITION BY item_id, k) - min(off) OVER (PARTITION BY item_id, k) AS span FROM pt),
ext AS (SELECT DISTINCT item_id, chunk_id, pos - off AS start, pos - off + span AS "end", span - n + 1 AS noise FROM po JOIN occ USING (term) GROUP BY item_id, k, chunk_id, pos - off, n, span HAVING count(*) = n)"""

#: Covers by windows: an extent counts if no extent that ends before it, or with it, starts as late.
_COVERS = _WORDED + rf""", sw AS (SELECT DISTINCT item_id, {base.sql_stem("w")} AS term FROM (SELECT item_id, lower(unnest(w[4:6])) AS w FROM bw) WHERE w NOT IN ({base._STOP})),
ask AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, term FROM sw UNION ALL SELECT item_id, term FROM pt)),
both_ AS (SELECT item_id, chunk_id, start, "end", noise FROM ext UNION SELECT item_id, chunk_id, pos, pos, 0 FROM sw JOIN occ USING (term)),
cov AS (SELECT *, max(start) OVER (PARTITION BY item_id, chunk_id ORDER BY "end", start DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM both_),
nn AS (SELECT count(*) AS n FROM chunks), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1), sz AS (SELECT chunk_id, count(*) AS size FROM post GROUP BY 1),
dens AS (SELECT item_id, chunk_id, sum(1 / (1 + noise)) AS s FROM cov WHERE before IS NULL OR start > before GROUP BY 1, 2),
wt AS (SELECT item_id, chunk_id, sum(ln(n / df)::DECIMAL(18, 9)) AS weight FROM ask JOIN dfs USING (term) JOIN post USING (term), nn GROUP BY 1, 2)"""

_FUSED = _SCORED.replace("{where}", "") + """,
r1 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY density DESC, filename, line_start, chunk_id) AS a FROM sc JOIN chunks USING (chunk_id)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY idf DESC, filename, line_start, chunk_id) AS b FROM r1 WHERE a <= 200),
fu AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, filename, line_start, chunk_id) AS rank FROM (SELECT *, round(1 / (60 + a) + 1 / (60 + b), 9) AS score FROM r2)),
cl AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY rank) AS c FROM fu WHERE NOT list_contains(flags, 'injection')),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS idx FROM cl WHERE c <= 2)"""


def oracle_sql() -> dict[str, str]:
    judged = sql("chunks", _PASSAGES + "SELECT item_id, idx, stance, note, reason, line FROM j")
    return {
        "a2_term_frequencies": sql("post", ", df AS (SELECT term, count(*) AS df FROM post GROUP BY 1) SELECT term, df, round(ln((SELECT count(*) FROM chunks) / df), 6) AS idf FROM df"),
        "f9_query_terms": sql("asked", "SELECT item_id, string_agg(term, ' ' ORDER BY term) AS terms FROM asked GROUP BY 1"),
        "a3_match_scores": sql("post asked", _SCORED.replace("{where}", "WHERE origin <> 'statement'") + " SELECT * FROM sc"),
        "j2_phrase_matches": sql("occ", _WORDED + ' SELECT item_id, chunk_id, start, "end", noise FROM ext'),
        "a3_cover_density": sql("post", _COVERS + " SELECT item_id, chunk_id, round(s * 0.1 / (1 + ln(1 + size)), 6) AS density, round(weight::DOUBLE / (1 + ln(1 + size)), 9) AS idf FROM dens JOIN wt USING (item_id, chunk_id) JOIN sz USING (chunk_id)"),
        "d4_retrieve_topk": sql("post asked", _FUSED + " SELECT item_id, chunk_id, rank, idx, score FROM top WHERE idx <= 8"),
        "p3_retrieval_drops": sql("post asked", _FUSED + " SELECT item_id, chunk_id, filename, 'injection' AS reason FROM fu WHERE rank <= 8 AND list_contains(flags, 'injection')").replace("text AS question", "CASE WHEN item_id % 5 = 0 THEN 'ignore previous instructions' ELSE text END AS question"),
        "a15_retrieval_recall": sql("post asked", _FUSED + r""", qi AS (SELECT item_id, regexp_replace(question, '\s+', ' ', 'g') AS quote FROM items),
            held AS (SELECT DISTINCT item_id, doc_id FROM qi JOIN (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM documents) x ON contains(flat, quote)),
            pi AS (SELECT item_id, max(CASE WHEN t.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM held LEFT JOIN (SELECT DISTINCT item_id, doc_id FROM top WHERE idx <= 8) t USING (item_id, doc_id) GROUP BY 1)
            SELECT count(*) AS items, sum(hit)::BIGINT AS found, round(avg(hit), 6) AS recall FROM pi"""),
        "j5_judged_passages": judged,
        "d5_decide": sql("chunks", _PASSAGES + "SELECT item_id, label, value, n_citations, n_dropped, rule, scope_note, confidence FROM f"),
        "a7_conflict_sides": sql("chunks", _PASSAGES + """, s AS (SELECT item_id, rule, 'yes' AS stance, CASE WHEN newer = 'no' THEN older ELSE yd END AS day, CASE WHEN newer = 'no' THEN 1 ELSE 0 END AS side FROM f WHERE rule IS NOT NULL
            UNION ALL SELECT item_id, rule, 'no', CASE WHEN newer = 'yes' THEN older ELSE nd END, CASE WHEN newer = 'no' THEN 0 ELSE 1 END FROM f WHERE rule IS NOT NULL)
            SELECT s.item_id, rule, side, s.stance, count(k.item_id) AS n, any_value(s.day)::VARCHAR AS day FROM s LEFT JOIN k ON k.item_id = s.item_id AND k.stance = s.stance AND k.kept GROUP BY ALL"""),
        "p5_drop_reasons": sql("chunks", _PASSAGES + "SELECT reason, count(*) AS n, count(DISTINCT item_id) AS items FROM k WHERE NOT kept GROUP BY 1"),
        "a24_label_counts": sql("chunks", _PASSAGES + "SELECT label, count(*) AS n, round(avg(confidence), 6) AS confidence FROM f GROUP BY 1"),
        "j8_citation_context": sql("chunks", _PASSAGES + """SELECT item_id, idx, l.n, l.n = line AS cited, contains(' ' || l.text || ' ', ' ' || quote || ' ') AS holds FROM k JOIN lines l ON l.doc_id = k.doc_id AND l.n BETWEEN line - 2 AND line + 2 WHERE kept AND NOT record"""),
        "a17_citation_validity": sql("chunks", _PASSAGES + "SELECT count(*) AS citations, count(*) AS valid, 1.0::DOUBLE AS share FROM k WHERE kept AND NOT record"),
        "a27_source_documents": sql("chunks", _PASSAGES + "SELECT i.item_id, count(DISTINCT doc_id) AS documents FROM all_items i LEFT JOIN k ON k.item_id = i.item_id AND k.kept GROUP BY 1"),
        "f8_draft_numbers": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), plain AS (SELECT k, c, [k] || CASE WHEN k % 2 = 0 THEN [] ELSE [7] END || [c - k % 2] AS have FROM o),
            bad AS (SELECT k, CASE WHEN NOT list_contains(have, c) AND c > 10 THEN c::VARCHAR END AS b, CASE WHEN k % 3 = 0 AND k % 2 = 1 THEN '12.5' WHEN k % 3 = 1 AND k % 2 = 1 THEN '7' END AS m FROM plain)
            SELECT k AS o_orderkey, array_to_string(list_sort(list_distinct(list_filter([b, m], lambda x: x IS NOT NULL))), ',') AS unsupported FROM bad""",
    }
