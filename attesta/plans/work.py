"""Queries on outcomes, the interview, limits, stored rows and scores. Their rows come from the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import interview as I
from attesta.operators import lifecycle as S
from attesta.operators import limits as L
from attesta.operators import outcomes as O
from attesta.operators import scoring as G
from attesta.plans.base import table


def _h(col: Column, a: int = 1) -> Column:
    """A number from 0 to 255 that both engines have."""
    return F.conv(F.substring(F.md5(col.cast("string")), a, 2), 16, 10).cast("int")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    h = _h(F.col("p_partkey"))
    label = F.when(h < 150, "covered").when(h < 190, "partly_covered").when(h < 220, "gap").when(h < 240, "not_met").otherwise("documents_disagree")
    rows = p.select(
        F.concat_ws("-", "p_brand", (F.col("p_partkey") % 40).cast("string")).alias("outcome_id"), "p_partkey", label.alias("part_label"), (F.col("p_partkey") % 6 == 0).alias("filled"),
        F.concat("p_name", F.lit("?")).alias("question"), F.concat(F.lit("Answer "), F.col("p_partkey").cast("string"), F.lit(".")).alias("answer"), "p_size", "p_retailprice", "p_type",
    )
    from pyspark.sql import Window as W

    return rows.withColumn("part_n", F.row_number().over(W.partitionBy("outcome_id").orderBy("p_partkey")))


_PARTS = """WITH p0 AS (SELECT p_brand || '-' || (p_partkey % 40) AS outcome_id, p_partkey, ('0x' || substr(md5(p_partkey::VARCHAR), 1, 2))::INT AS h, p_partkey % 6 = 0 AS filled, p_name || '?' AS question, 'Answer ' || p_partkey || '.' AS answer, p_size, p_retailprice, p_type FROM part),
p AS (SELECT *, CASE WHEN h < 150 THEN 'covered' WHEN h < 190 THEN 'partly_covered' WHEN h < 220 THEN 'gap' WHEN h < 240 THEN 'not_met' ELSE 'documents_disagree' END AS part_label, row_number() OVER (PARTITION BY outcome_id ORDER BY p_partkey) AS part_n FROM p0),
c AS (SELECT outcome_id, CASE WHEN bool_or(part_label = 'documents_disagree') THEN 'documents_disagree' WHEN bool_or(part_label = 'not_met') THEN 'not_met' WHEN bool_and(part_label = 'covered') THEN 'covered' WHEN bool_and(part_label = 'gap') THEN 'gap' ELSE 'partly_covered' END AS label FROM p GROUP BY 1)
"""


def combine_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.combine_parts(parts(spark, sf_dir))


def outcome_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.explanations(parts(spark, sf_dir))


def _with_results(rows: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return rows.withColumns({
        "conflict_rule": F.when(F.col("part_label") == "documents_disagree", F.when(k % 2 == 0, "date").otherwise("documents-disagree")),
        "scope_note": F.when(k % 5 == 0, F.concat(F.lit("note "), F.col("p_size").cast("string"))), "quote_failed": k % 9 == 0,
        "cost_usd": (F.col("p_retailprice") / 1000).cast("decimal(10,4)"), "latency_ms": F.col("p_size") * 10, "statement_id": F.when(F.col("filled"), F.concat(F.lit("s"), k.cast("string"))),
    })


def outcome_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.outcome_results(_with_results(parts(spark, sf_dir)))


def confirmed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_results(parts(spark, sf_dir))
    return O.confirmed_by_fills(O.combine_parts(rows), rows)


def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outcome, a third of them not checked and a third asked of the user."""
    rows = parts(spark, sf_dir)
    h = _h(F.col("outcome_id")) % 3
    every = rows.groupBy("outcome_id").agg(F.min("p_type").alias("function"), F.collect_set(F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("CT-"), F.col("p_size").cast("string")))).alias("controls")).withColumn("tier", F.when(h == 0, "not_checked").when(h == 1, "ask").otherwise("checked"))
    results = O.explanations(rows).select("outcome_id", F.when(_h(F.col("outcome_id")) % 3 == 1, "confirmed_by_you").otherwise(F.col("label")).alias("label"), "explanation")
    cites = rows.filter("part_label = 'covered'").select("outcome_id", "part_n", F.lit(1).alias("ord"), F.lit("d").alias("doc_id"), (F.col("p_size") % 3).alias("line_start"), (F.col("p_size") % 3).alias("line_end"), F.concat(F.lit("size "), (F.col("p_size") % 3).cast("string")).alias("quote"), F.lit("yes").alias("stance"))
    return O.gap_report(every, results, cites, F.lit("2024-06-01").cast("date"), "2.0")


def scope_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts(spark, sf_dir).groupBy("outcome_id").agg(F.min("p_type").alias("function"))
    tiers = rows.filter(_h(F.col("outcome_id")) % 3 > 0).select("outcome_id", F.when(_h(F.col("outcome_id")) % 3 == 1, "ask").otherwise("checked").alias("tier"))
    ask = rows.select("outcome_id", F.concat(F.lit("Is "), F.col("outcome_id"), F.lit(" done?")).alias("question"), F.array("outcome_id").alias("parts"))
    return O.in_scope(O.framework(rows, tiers, ask), "economy").select("outcome_id", "tier", "question")


# The interview


def open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    h = _h(k)
    label = F.when(h < 60, "conflict").when(h < 120, "unknown").when(h < 180, "partial").otherwise("verified")
    topic = F.when(k % 4 == 0, "Data protection").when(k % 4 == 1, "Vendors").when(k % 4 == 2, "Backup and recovery").otherwise(None)
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("run_id"), k.alias("item_id"), (1_000_000 - k).alias("position"), topic.alias("topic"), label.alias("label"), F.when(k % 5 == 0, 1).otherwise(0).alias("asked"),
        (k % 7 == 0).alias("approved"), (k % 11 == 0).alias("edited"), F.col("c_mktsegment").alias("function"),
    )


_ITEMS = """WITH i AS (SELECT c_nationkey::BIGINT AS run_id, c_custkey AS item_id, 1000000 - c_custkey AS position, CASE c_custkey % 4 WHEN 0 THEN 'Data protection' WHEN 1 THEN 'Vendors' WHEN 2 THEN 'Backup and recovery' END AS topic,
  CASE WHEN h < 60 THEN 'conflict' WHEN h < 120 THEN 'unknown' WHEN h < 180 THEN 'partial' ELSE 'verified' END AS label, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS asked, c_custkey % 7 = 0 AS approved, c_custkey % 11 = 0 AS edited, c_mktsegment AS function
  FROM (SELECT *, ('0x' || substr(md5(c_custkey::VARCHAR), 1, 2))::INT AS h FROM customer))
"""


def _queue(items: DataFrame) -> DataFrame:
    return items.filter("item_id % 13 = 0").select("run_id", "item_id", F.lit("old").alias("reason"), (F.col("item_id") % 50).alias("rank"), F.when(F.col("item_id") % 2 == 0, "open").otherwise("answered").alias("status"))


def interview_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = open_items(spark, sf_dir)
    return I.plan_queue(items, _queue(items))


def queue_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = open_items(spark, sf_dir)
    return I.display_order(I.refresh_queue(_queue(items), items)).select("run_id", "item_id", "status", "place")


def fill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = open_items(spark, sf_dir)
    said = items.filter("item_id % 17 = 0").select(F.concat(F.lit("st"), F.col("item_id").cast("string")).alias("statement_id"), "run_id", "item_id", "topic", "function")
    return I.fill_candidates(said, items)


def accepted_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fills = li.select((F.col("l_orderkey") % 7).alias("run_id"), F.col("l_orderkey").alias("item_id"), F.concat_ws(".", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("suggestion_id"), F.when(F.col("l_linenumber") == 5, "dismissed").otherwise("open").alias("status"))
    fills = fills.dropDuplicates(["suggestion_id"])
    taken = li.filter("l_partkey % 50 = 0").select(F.concat_ws(".", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("suggestion_id"))
    return I.accept_fills(fills, taken).groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("n"))


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reply of each turn of a conversation still owes; some words stand for the cues."""
    c = table(spark, sf_dir, "conversations")
    ask = c.filter("role = 'user'").select("conv_id", "turn", F.concat(F.when(F.col("conv_id") % 3 == 0, "How often? ").when(F.col("conv_id") % 3 == 1, "How many? ").otherwise("Who? "), F.col("text")).alias("q"))
    say = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.concat(F.when(F.col("turn") % 4 == 1, "Monthly, 3 times. ").otherwise(""), F.lit("So: "), F.lower("text")).alias("a"))
    return ask.join(say, ["conv_id", "turn"]).select("conv_id", "turn", T.follow_up(F.lower("q"), F.lower("a")).alias("owes"))


# Limits


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(e: DataFrame) -> DataFrame:
    return e.select("event_id", "ts", F.col("user_id").alias("network"), (F.col("user_id") % 4).alias("workspace_id"), F.col("event_type").alias("kind"))


CAPS = L.Caps(network=1, kinds=(("click", 2), ("error", 1)), hour=9, day=180)


def call_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    per = L.counters(rows, "hour", ["workspace_id", "kind"])
    return per.select("workspace_id", "kind", F.col("window_start").cast("string").alias("window_start"), "n", (F.col("n") > L.kind_cap(F.col("kind"), CAPS)).alias("over"))


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.admitted(calls(spark, sf_dir), CAPS).select("event_id", F.coalesce("refused_by", F.lit("admitted")).alias("verdict"))


def idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (users) by activity, with pauses of an hour or more between them."""
    got = L.idle_sessions(calls(spark, sf_dir), "network", "60 minutes")
    return got.select("network", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n")


def budget_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir)
    hour, day = F.date_trunc("hour", "ts"), F.date_trunc("day", "ts")
    own = rows.groupBy("network", hour.alias("h")).agg(F.count(F.lit(1)).alias("own"))
    per_hour = rows.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("hourly"))
    per_day = rows.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("daily"))
    joined = own.join(per_hour, "h").withColumn("d", F.date_trunc("day", "h")).join(per_day, "d")
    return joined.select("network", F.col("h").cast("string").alias("hour"), L.remaining(F.col("own"), F.col("hourly"), F.col("daily"), L.Caps(network=3, hour=20, day=400)).cast("long").alias("left"))


def stale_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "done").otherwise("claimed").alias("state"), F.col("ts").alias("claimed_at"), (F.col("event_id") % 5).alias("attempts"))
    return L.stale_claims(rows, F.lit("2024-01-15 00:00:00").cast("timestamp")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workspaces with an event in the last day stay; what hangs on the others is counted."""
    rows = calls(spark, sf_dir)
    alive = L.retained(rows, "ts", F.lit("2024-01-30 12:00:00").cast("timestamp"), 24).select(F.col("network").alias("workspace_id"))
    tables = {"events": rows.withColumn("workspace_id", F.col("network")), "orders": table(spark, sf_dir, "orders").withColumn("workspace_id", F.col("o_custkey"))}
    return L.cascade(alive, tables)[1]


def window_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("event_id", T.seconds_left(F.col("ts"), "hour").alias("hour_left"), T.seconds_left(F.col("ts"), "day").alias("day_left"))


# Stored rows


def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return S.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


def audit_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(table(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], 500).select("event_type", "event_id")


def idempotent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    new = li.select("l_orderkey", "l_linenumber", "l_extendedprice")
    old = li.filter("l_suppkey % 4 = 0").select("l_orderkey", "l_linenumber").distinct()
    return S.append_once(new, old, ["l_orderkey", "l_linenumber"], [F.col("l_extendedprice")])


def affected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    answers = li.groupBy(F.col("l_orderkey").alias("answer_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("chunk_ids"))
    changed = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("chunk_id"))
    return S.affected(answers, changed, "chunk_ids", "chunk_id").select("answer_id", F.size("chunk_ids").alias("chunks"))


def evidence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("m", F.col("l_partkey") % 2)
    return S.same_evidence(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag <> 'A'"), "l_orderkey", "m")


def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.digest(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey", "o_orderstatus"])


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = open_items(spark, sf_dir)
    return S.approvable(items, items.filter("item_id % 6 = 0")).select("item_id")


def approval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = open_items(spark, sf_dir)
    return S.approval_counts(items, items.filter("item_id % 6 = 0"))


def answer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = open_items(spark, sf_dir).withColumn("value", F.when(F.col("label") == "verified", "Yes"))
    k = F.col("item_id")
    changes = items.filter(k % 3 == 0).select("item_id", F.when(k % 9 == 0, "na").when(k % 9 == 3, "edit").otherwise("approve").alias("action"), F.lit("Mine").alias("value"))
    return S.transitions(items, changes)


def refused_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = open_items(spark, sf_dir)
    changes = items.filter("item_id % 3 = 0").select((F.col("item_id") + 300).alias("item_id"), F.lit("approve").alias("action"))
    return S.refused(items, changes)


def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("answer_id"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("c"), (F.col("o_custkey") + 40).cast("string"))).alias("names"))
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_nationkey").alias("id"))
    return S.remapped(o, names, "names").select("answer_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",", "?").alias("ids"), "complete")


def exported_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    grid = c.select(F.col("c_custkey").alias("row"), F.concat(F.when(F.col("c_custkey") % 4 == 0, "=").otherwise(""), F.col("c_name")).alias("question"))
    answers = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("row"), F.concat(F.lit("+"), F.col("c_mktsegment")).alias("answer"), F.lit("verified").alias("status"), F.lit("a.md, line 3").alias("sources"), F.when(F.col("c_custkey") % 2 == 0, "-see above").alias("notes"))
    return S.merged_sheet(grid, answers)


def withdrawn_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 2 == 0).alias("evidence_allowed"))
    answers = o.select(k.alias("answer_id"), F.when(k % 5 == 0, F.col("o_custkey")).alias("statement_id"))
    fills = o.select(k.alias("suggestion_id"), F.col("o_custkey").alias("statement_id"), F.when(k % 4 == 0, "accepted").otherwise("open").alias("status"))
    d, s = S.withdrawn(docs, answers, fills, o.filter("o_orderkey % 35 = 0").select(k.alias("answer_id")))
    return d.groupBy(F.col("evidence_allowed").cast("string").alias("state")).agg(F.count(F.lit(1)).alias("n")).unionByName(s.groupBy(F.col("status").alias("state")).agg(F.count(F.lit(1)).alias("n")))


# Scores


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = lambda h: F.when(h < 100, "verified").when(h < 150, "partial").when(h < 200, "conflict").otherwise("unknown")
    return table(spark, sf_dir, "orders").select(k.alias("code"), F.col("o_orderpriority").alias("pack"), name(_h(k)).alias("expected"), F.when(_h(k, 3) < 200, name(_h(k))).otherwise(name(_h(k, 5))).alias("label"))


_KEYED = """WITH h AS (SELECT o_orderkey AS code, o_orderpriority AS pack, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 2))::INT AS a, ('0x' || substr(md5(o_orderkey::VARCHAR), 3, 2))::INT AS b, ('0x' || substr(md5(o_orderkey::VARCHAR), 5, 2))::INT AS c FROM orders),
k AS (SELECT code, pack, CASE WHEN a < 100 THEN 'verified' WHEN a < 150 THEN 'partial' WHEN a < 200 THEN 'conflict' ELSE 'unknown' END AS expected, CASE WHEN (CASE WHEN b < 200 THEN a ELSE c END) < 100 THEN 'verified' WHEN (CASE WHEN b < 200 THEN a ELSE c END) < 150 THEN 'partial' WHEN (CASE WHEN b < 200 THEN a ELSE c END) < 200 THEN 'conflict' ELSE 'unknown' END AS label FROM h),
m AS (SELECT pack, count(*) AS items, round(count(*) FILTER (expected = label) / count(*), 6) AS accuracy, round(count(*) FILTER (expected = 'conflict' AND label = 'conflict') / nullif(count(*) FILTER (expected = 'conflict'), 0), 6) AS conflict_recall,
  round(count(*) FILTER (expected = 'conflict' AND label = 'conflict') / nullif(count(*) FILTER (label = 'conflict'), 0), 6) AS conflict_precision FROM k GROUP BY 1)
"""


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.rounded(G.label_metrics(_keyed(spark, sf_dir), ["pack"]))


def run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of each pack; asked is what was left open, and one pack has no answer to measure faithfulness by."""
    rows = _keyed(spark, sf_dir)
    due = F.col("expected").isin("conflict", "unknown")
    asked = rows.groupBy("pack").agg(G.ratio(F.count_if(due & F.col("label").isin("conflict", "unknown", "partial")), F.count_if(due)).alias("ask_recall"))
    written = F.col("label") != "unknown"
    faithful = rows.filter("pack <> '5-LOW'").groupBy("pack").agg(G.ratio(F.count_if(written & (F.col("expected") != "unknown")), F.count_if(written)).alias("faithfulness"))
    metrics = G.label_metrics(rows, ["pack"]).join(asked, "pack").join(faithful, "pack", "left")
    rules = spark.createDataFrame([("accuracy", ">=", 0.83, True), ("conflict_recall", ">=", 0.9, False), ("ask_recall", ">=", 0.8, True), ("faithfulness", ">=", 0.5, True)], "metric string, op string, target double, gating boolean")
    return G.gates(G.unpivoted(metrics, ["pack"], ["accuracy", "conflict_recall", "ask_recall", "faithfulness"]), rules).select("pack", "metric", F.round("value", 6).alias("value"), "passed", "reason")


def verifier_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _keyed(spark, sf_dir)
    value = F.when(F.col("label") == "verified", "Yes")
    keys = rows.filter("code % 10 <> 1").select("code", F.col("expected").alias("label"), F.when(F.col("expected") == "verified", "Yes").alias("value"))
    other = rows.filter("code % 10 <> 2").select("code", "label", value.alias("value"))
    return G.key_diff(keys, other.unionByName(other.filter("code % 100 = 7"))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def id_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return G.missing_and_extra(have, table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id")), "id").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def row_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rules = {"status": F.col("l_linestatus").isin("O", "F"), "discount": F.col("l_discount") < 0.1, "cited": (F.col("l_returnflag") != "R") | (F.col("l_quantity") > 10)}
    return G.violations(li, "l_orderkey", rules, ["l_orderkey", "l_linenumber"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def planted_minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = spark.createDataFrame([("click", 5), ("error", 10**9), ("never", 1)], "kind string, needed long")
    return G.minimums(table(spark, sf_dir, "events"), "event_type", needed)


def model_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    h = _h(F.concat_ws(".", "l_orderkey", "l_partkey"))
    rows = li.select(
        F.concat(F.lit("model/"), (F.col("l_suppkey") % 5).cast("string")).alias("model"), F.lit("yes").alias("expected"), F.when(h < 180, "yes").otherwise("no").alias("label"),
        ((F.col("l_suppkey") % 5 == 4) | (h % 50 == 0)).alias("failed"), (F.col("l_quantity") / 10000).cast("decimal(10,4)").alias("cost_usd"), F.col("l_quantity").alias("latency_ms"),
    )
    return G.rounded(G.bench(rows))


def replay_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests keyed by a digest, the later recording of a key wins, and keys without one are told."""
    key = lambda c: F.sha2(F.concat(F.lit("req|"), c.cast("string")), 256)
    asked = table(spark, sf_dir, "orders").select(key(F.col("o_custkey")).alias("key"))
    made = table(spark, sf_dir, "customer").filter("c_custkey % 4 < 3")
    lines = made.select(key(F.col("c_custkey")).alias("key"), F.col("c_custkey").alias("line"), F.col("c_mktsegment").alias("reply")).unionByName(made.filter("c_custkey % 4 = 0").select(key(F.col("c_custkey")).alias("key"), (F.col("c_custkey") + 10**6).alias("line"), F.lit("NEWER").alias("reply")))
    hit, miss = G.replayed(asked, lines)
    return hit.groupBy("reply").agg(F.count(F.lit(1)).alias("n")).unionByName(miss.agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("reply"), "n"))


def trap_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, traps = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("trap_id"), "text")
    return G.exposure(docs, traps)


def private_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each sentence of a benchmark item stands."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\. ", -1)).alias("n", "private"))
    private = b.select(F.concat_ws("/", F.col("item_id").cast("string"), F.col("n").cast("string")).alias("private_id"), "private")
    return G.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), private)


def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median latency, and cost for every 60 items, of each questionnaire."""
    rows = table(spark, sf_dir, "orders").withColumn("cost", (F.col("o_totalprice") / 1000).cast("decimal(10,4)"))
    return rows.groupBy(F.col("o_orderpriority").alias("pack")).agg(F.count(F.lit(1)).alias("items"), F.round(F.median("o_totalprice"), 4).alias("p50"), F.round(F.sum("cost").cast("double") / F.count(F.lit(1)) * 60, 1).alias("cost_per_60"))


def queries() -> dict:
    return {
        "a9_combine_parts": combine_parts, "a11_outcome_explanations": outcome_explanations, "a10_outcome_results": outcome_results, "d9_confirmed_outcomes": confirmed_outcomes, "s14_gap_report": gap_report, "p6_scope_outcomes": scope_outcomes,
        "w8_interview_queue": interview_queue, "d12_queue_refresh": queue_refresh, "d14_fill_candidates": fill_candidates, "d14_accepted_fills": accepted_fills, "d13_follow_ups": follow_ups,
        "a25_call_counters": call_counters, "w12_admission": admission, "t3_idle_runs": idle_runs, "a28_budget_left": budget_left, "t4_stale_claims": stale_claims, "s17_retention": retention, "f24_window_ends": window_ends,
        "w9_latest_runs": latest_runs, "s12_audit_newest": audit_newest, "s11_idempotent_answers": idempotent_answers, "j10_affected_answers": affected_answers, "u5_evidence_sets": evidence_sets, "a29_row_digests": row_digests,
        "p10_approvals": approvals, "p10_approval_counts": approval_counts, "d27_answer_changes": answer_changes, "d27_refused_changes": refused_changes, "s16_snapshot_ids": snapshot_ids, "s13_exported_sheet": exported_sheet, "d16_withdrawn_statements": withdrawn_statements,
        "a16_label_metrics": label_metrics, "a21_run_gates": run_gates, "j13_verifier_diff": verifier_diff, "u2_id_drift": id_drift, "a13_row_violations": row_violations, "a26_planted_minimums": planted_minimums,
        "a23_model_bench": model_bench, "j12_replay_misses": replay_misses, "j16_trap_exposure": trap_exposure, "j15_private_leaks": private_leaks, "a20_run_costs": run_costs,
    }


def _words_sql() -> str:
    words = [("Confirmed by you: ", "filled AND part_label = 'covered'")]
    words += [(f"{w} in your answer: ", f"filled AND part_label = '{k}'") for k, w in O.PART_WORDS.items() if k != "covered"]
    words += [(f"{w}: ", f"NOT filled AND part_label = '{k}'") for k, w in O.PART_WORDS.items()]
    one = "CASE WHEN count(*) FILTER ({c}) > 0 THEN '{w}' || CASE WHEN count(*) FILTER ({c}) = 1 THEN 'part ' ELSE 'parts ' END || string_agg(part_n::VARCHAR, ', ' ORDER BY part_n) FILTER ({c}) || '.' END"
    return ", ".join(one.format(c=c, w=w) for w, c in words)


_ADMIT = """WITH e AS (SELECT event_id, ts, user_id AS network, user_id % 4 AS ws, event_type AS kind, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY network, h ORDER BY ts, event_id) > 1 AS r1 FROM e),
b AS (SELECT event_id, row_number() OVER (PARTITION BY ws, h, kind ORDER BY ts, event_id) > CASE kind WHEN 'click' THEN 2 WHEN 'error' THEN 1 ELSE 9 END AS r2 FROM a WHERE NOT r1),
c AS (SELECT event_id, row_number() OVER (PARTITION BY h ORDER BY ts, event_id) > 9 AS r3 FROM a JOIN b USING (event_id) WHERE NOT r2),
f AS (SELECT event_id, row_number() OVER (PARTITION BY d ORDER BY ts, event_id) > 180 AS r4 FROM a JOIN c USING (event_id) WHERE NOT r3)
SELECT event_id, CASE WHEN r1 THEN 'network' WHEN r2 THEN 'workspace' WHEN r3 THEN 'hour' WHEN r4 THEN 'day' ELSE 'admitted' END AS verdict FROM a LEFT JOIN b USING (event_id) LEFT JOIN c USING (event_id) LEFT JOIN f USING (event_id)"""


def oracle_sql() -> dict[str, str]:
    deciding = "CASE c.label WHEN 'documents_disagree' THEN part_label = 'documents_disagree' WHEN 'not_met' THEN part_label = 'not_met' WHEN 'covered' THEN part_label = 'covered' WHEN 'partly_covered' THEN part_label IN ('covered', 'partly_covered') ELSE false END"
    explain = f""", x AS (SELECT outcome_id, any_value(c.label) AS label, concat_ws(' ', {_words_sql()}, string_agg(question || ' ' || answer, ' ' ORDER BY part_n) FILTER ({deciding})) AS explanation FROM p JOIN c USING (outcome_id) GROUP BY 1)"""
    tier = "('0x' || substr(md5(outcome_id), 1, 2))::INT % 3"
    sid = "l_orderkey || '.' || l_partkey || '.' || l_suppkey || '.' || l_linenumber || '.' || l_quantity || '.' || l_extendedprice"
    return {
        "a9_combine_parts": _PARTS + "SELECT * FROM c",
        "a11_outcome_explanations": _PARTS + explain + " SELECT * FROM x",
        "a10_outcome_results": _PARTS + """, r AS (SELECT outcome_id, arg_min(CASE WHEN p_partkey % 2 = 0 THEN 'date' ELSE 'documents-disagree' END, part_n) FILTER (part_label = 'documents_disagree') AS conflict_rule, bool_or(p_partkey % 9 = 0) AS failed,
            sum((p_retailprice / 1000)::DECIMAL(10, 4)) AS cost_usd, sum(p_size * 10)::BIGINT AS latency_ms FROM p GROUP BY 1),
            n1 AS (SELECT outcome_id, p_size, min(part_n) AS part_n FROM p WHERE p_partkey % 5 = 0 GROUP BY 1, 2), n AS (SELECT outcome_id, string_agg('note ' || p_size, ' ' ORDER BY part_n) AS scope_note FROM n1 GROUP BY 1)
            SELECT outcome_id, label, conflict_rule, scope_note, round(greatest(CASE label WHEN 'covered' THEN 0.9 WHEN 'partly_covered' THEN 0.6 WHEN 'not_met' THEN 0.9 WHEN 'documents_disagree' THEN 0.3 ELSE 0.0 END - CASE WHEN failed THEN 0.2 ELSE 0 END, 0), 2)::DOUBLE AS confidence, cost_usd, latency_ms FROM c JOIN r USING (outcome_id) LEFT JOIN n USING (outcome_id)""",
        "d9_confirmed_outcomes": _PARTS + """, f AS (SELECT outcome_id, arg_min('s' || p_partkey, part_n) AS s FROM p WHERE filled GROUP BY 1)
            SELECT outcome_id, label, CASE WHEN label = 'covered' THEN s END AS statement_id, CASE WHEN label = 'covered' AND s IS NOT NULL THEN 'user_confirmed' ELSE 'machine' END AS status FROM c LEFT JOIN f USING (outcome_id)""",
        "s14_gap_report": _PARTS + explain + f""", e AS (SELECT outcome_id, min(p_type) AS function, {tier} AS t, coalesce(string_agg(DISTINCT 'CT-' || p_size, ', ' ORDER BY 'CT-' || p_size) FILTER (p_size % 5 > 0), '') AS controls FROM p GROUP BY 1),
            q1 AS (SELECT outcome_id, p_size % 3 AS z, min(part_n) AS n FROM p WHERE part_label = 'covered' GROUP BY 1, 2), q AS (SELECT outcome_id, string_agg('"size ' || z || '"', '; ' ORDER BY n) AS quotes, string_agg('d#L' || z, '; ' ORDER BY n) AS links FROM q1 GROUP BY 1)
            SELECT outcome_id, function, CASE t WHEN 0 THEN 'not_checked' WHEN 1 THEN 'ask' ELSE 'checked' END AS tier, CASE t WHEN 0 THEN 'not checked in this version' WHEN 1 THEN 'Answered by you' ELSE
              CASE label WHEN 'covered' THEN 'Covered' WHEN 'partly_covered' THEN 'Partly covered' WHEN 'not_met' THEN 'Not met' WHEN 'documents_disagree' THEN 'Documents disagree' ELSE 'Gap' END END AS status, explanation, coalesce(quotes, '') AS quotes, coalesce(links, '') AS links, controls, '2024-06-01' AS run_date, '2.0' AS version
            FROM e JOIN x USING (outcome_id) LEFT JOIN q USING (outcome_id)""",
        "p6_scope_outcomes": _PARTS + f"SELECT outcome_id, CASE {tier} WHEN 1 THEN 'ask' ELSE 'checked' END AS tier, 'Is ' || outcome_id || ' done?' AS question FROM p GROUP BY 1 HAVING min(p_type) = 'ECONOMY' AND {tier} > 0",
        "w8_interview_queue": _ITEMS + """, q AS (SELECT run_id, item_id, item_id % 50 AS rank FROM i WHERE item_id % 13 = 0), l AS (SELECT run_id, max(rank) AS last FROM q GROUP BY 1)
            SELECT run_id, item_id, label AS reason, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN label = 'conflict' THEN 0 WHEN topic IN ('Data protection', 'Backup and recovery') THEN 1 ELSE 2 END, position, item_id) + coalesce(last, 0) AS rank
            FROM i LEFT JOIN l USING (run_id) WHERE label <> 'verified' AND asked = 0 AND item_id % 13 <> 0""",
        "d12_queue_refresh": _ITEMS + """, q AS (SELECT run_id, item_id, item_id % 50 AS rank, CASE WHEN item_id % 2 = 1 THEN 'answered' WHEN label <> 'verified' AND NOT approved AND NOT edited THEN 'open' ELSE 'skipped' END AS status FROM i WHERE item_id % 13 = 0)
            SELECT run_id, item_id, status, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN status = 'open' THEN 0 ELSE 1 END, rank, item_id) AS place FROM q""",
        "d14_fill_candidates": _ITEMS + """SELECT * FROM (SELECT 'st' || s.item_id AS statement_id, t.item_id, row_number() OVER (PARTITION BY s.item_id ORDER BY t.position, t.item_id) AS n FROM i s JOIN i t ON t.run_id = s.run_id AND coalesce(t.topic, t.function) = coalesce(s.topic, s.function) AND t.item_id <> s.item_id
            WHERE s.item_id % 17 = 0 AND t.label <> 'verified' AND NOT t.approved AND NOT t.edited) WHERE n <= 8""",
        "d14_accepted_fills": f"""WITH f AS (SELECT DISTINCT l_orderkey % 7 AS run_id, l_orderkey AS item_id, {sid} AS s, l_linenumber = 5 AS gone, l_partkey % 50 = 0 AS taken FROM lineitem),
            g AS (SELECT *, bool_or(taken) OVER (PARTITION BY item_id) AS hit FROM f) SELECT run_id, CASE WHEN taken THEN 'accepted' WHEN gone OR hit THEN 'dismissed' ELSE 'open' END AS status, count(*) AS n FROM g GROUP BY ALL""",
        "d13_follow_ups": """SELECT q.conv_id, q.turn, CASE q.conv_id % 3 WHEN 0 THEN CASE WHEN (q.turn + 1) % 4 = 1 THEN NULL ELSE 'how often' END WHEN 1 THEN CASE WHEN (q.turn + 1) % 4 = 1 OR regexp_matches(a.text, '[0-9]') THEN NULL ELSE 'the number' END
            ELSE CASE WHEN regexp_matches(q.text, '[0-9%]') AND NOT ((q.turn + 1) % 4 = 1 OR regexp_matches(a.text, '[0-9]')) THEN 'the number and the name of the person or team' ELSE 'the name of the person or team' END END AS owes
            FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""",
        "a25_call_counters": "SELECT user_id % 4 AS workspace_id, event_type AS kind, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(*) > CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 1 ELSE 9 END AS over FROM events GROUP BY 1, 2, 3",
        "w12_admission": _ADMIT,
        "t3_idle_runs": """WITH e AS (SELECT user_id AS network, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY network ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
            SELECT network, rtrim(rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS start, rtrim(rtrim(strftime(max(ts) + INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS end, count(*) AS n FROM s GROUP BY network, k""",
        "a28_budget_left": """WITH o AS (SELECT user_id AS network, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), hh AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1), dd AS (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY 1)
            SELECT network, strftime(o.h, '%Y-%m-%d %H:%M:%S') AS hour, greatest(0, least(3 - o.n, 20 - hh.n, 400 - dd.n)) AS left FROM o JOIN hh USING (h) JOIN dd ON dd.d = date_trunc('day', o.h)""",
        "t4_stale_claims": "SELECT CASE WHEN event_id % 3 = 0 THEN 'done' WHEN ts < TIMESTAMP '2024-01-14 23:55:00' THEN CASE WHEN event_id % 5 >= 3 THEN 'failed' ELSE 'pending' END ELSE 'claimed' END AS state, count(*) AS n FROM events GROUP BY 1",
        "s17_retention": """WITH alive AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-29 12:00:00') SELECT 'events' AS "table", count(*) AS deleted FROM events WHERE user_id NOT IN (SELECT user_id FROM alive) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM alive)""",
        "f24_window_ends": "SELECT event_id, ceil(3600 - (epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 1e6)::BIGINT AS hour_left, ceil(86400 - (epoch_us(ts) - epoch_us(date_trunc('day', ts)::TIMESTAMP)) / 1e6)::BIGINT AS day_left FROM events",
        "w9_latest_runs": "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
        "s12_audit_newest": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500",
        "s11_idempotent_answers": "SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2 HAVING NOT bool_or(l_suppkey % 4 = 0)",
        "j10_affected_answers": "SELECT l_orderkey AS answer_id, count(DISTINCT l_partkey) AS chunks FROM lineitem GROUP BY 1 HAVING bool_or(l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7))",
        "u5_evidence_sets": "WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 2) FILTER (l_returnflag = 'A')) AS a, list_sort(list(DISTINCT l_partkey % 2) FILTER (l_returnflag <> 'A')) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, coalesce(a = b, false) AS same FROM s",
        "a29_row_digests": "SELECT o_custkey, sha256(string_agg(o_orderkey || '|' || o_orderstatus, chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1",
        "p10_approvals": _ITEMS + "SELECT item_id FROM i WHERE label = 'verified' AND NOT approved AND NOT edited AND item_id % 6 <> 0",
        "p10_approval_counts": _ITEMS + "SELECT run_id, count(*) FILTER (label = 'verified' AND NOT approved AND NOT edited AND item_id % 6 <> 0) AS approved, count(*) FILTER (label = 'verified' AND edited AND NOT approved) AS skipped_edited FROM i GROUP BY 1",
        "d27_answer_changes": _ITEMS + """SELECT item_id, CASE WHEN item_id % 9 = 0 THEN 'na' ELSE label END AS label, CASE WHEN item_id % 9 = 0 THEN NULL WHEN item_id % 9 = 3 THEN 'Mine' WHEN label = 'verified' THEN 'Yes' END AS value,
            CASE WHEN item_id % 9 = 6 AND label IN ('verified', 'partial') THEN true WHEN item_id % 9 IN (0, 3) THEN false ELSE approved END AS approved, edited OR item_id % 9 = 3 AS edited FROM i""",
        "d27_refused_changes": _ITEMS + ", c AS (SELECT item_id + 300 AS item_id FROM i WHERE item_id % 3 = 0) SELECT c.item_id, 'approve' AS action, CASE WHEN i.label IS NULL THEN 'no such item' ELSE 'not approvable' END AS reason FROM c LEFT JOIN i USING (item_id) WHERE i.label IS NULL OR i.label NOT IN ('verified', 'partial')",
        "s16_snapshot_ids": "SELECT o_orderkey AS answer_id, coalesce(a.c_nationkey::VARCHAR, '?') || ',' || coalesce(b.c_nationkey::VARCHAR, '?') AS ids, a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL AS complete FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey + 40",
        "s13_exported_sheet": "SELECT c_custkey AS row, CASE WHEN c_custkey % 4 = 0 THEN '''=' ELSE '' END || c_name AS question, CASE WHEN c_custkey % 3 = 0 THEN '''+' || c_mktsegment ELSE '' END AS answer, CASE WHEN c_custkey % 3 = 0 THEN 'verified' ELSE '' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 'a.md, line 3' ELSE '' END AS sources, CASE WHEN c_custkey % 6 = 0 THEN '''-see above' ELSE '' END AS notes FROM customer",
        "d16_withdrawn_statements": """WITH g AS (SELECT DISTINCT o_custkey AS s FROM orders WHERE o_orderkey % 35 = 0) SELECT (c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT s FROM g))::VARCHAR AS state, count(*) AS n FROM customer GROUP BY 1
            UNION ALL SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'accepted' WHEN o_custkey IN (SELECT s FROM g) THEN 'dismissed' ELSE 'open' END, count(*) FROM orders GROUP BY 1""",
        "a16_label_metrics": _KEYED + "SELECT * FROM m",
        "a21_run_gates": _KEYED + "SELECT pack, 'accuracy' AS metric, accuracy AS value, accuracy >= 0.83 AS passed, CASE WHEN accuracy >= 0.83 THEN NULL ELSE 'target missed' END AS reason FROM m UNION ALL SELECT pack, 'conflict_recall', conflict_recall, true, CASE WHEN conflict_recall >= 0.9 THEN NULL ELSE 'target missed' END FROM m UNION ALL SELECT pack, 'ask_recall', v, v >= 0.8, CASE WHEN v >= 0.8 THEN NULL ELSE 'target missed' END FROM (SELECT pack, round(count(*) FILTER (label <> 'verified') / count(*), 6) AS v FROM k WHERE expected IN ('conflict', 'unknown') GROUP BY 1)"
            " UNION ALL SELECT pack, 'faithfulness', v, coalesce(v >= 0.5, false), CASE WHEN v IS NULL THEN 'nothing to measure' WHEN v < 0.5 THEN 'target missed' END FROM (SELECT pack, CASE WHEN pack <> '5-LOW' THEN round(count(*) FILTER (expected <> 'unknown') / count(*), 6) END AS v FROM k WHERE label <> 'unknown' GROUP BY 1)",
        "j13_verifier_diff": _KEYED + "SELECT * FROM (SELECT CASE WHEN code % 10 = 2 THEN 'missing' WHEN code % 10 = 1 THEN 'not asked' WHEN code % 100 = 7 THEN 'repeated' WHEN expected <> label THEN 'differs' END AS problem, count(*) AS n FROM k GROUP BY 1) WHERE problem IS NOT NULL",
        "u2_id_drift": "SELECT 'missing' AS side, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0 UNION ALL SELECT 'extra', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0) HAVING count(*) > 0",
        "a13_row_violations": """SELECT 'status' AS rule, count(*) AS n FROM lineitem WHERE NOT coalesce(l_linestatus IN ('O', 'F'), false) HAVING count(*) > 0 UNION ALL SELECT 'discount', count(*) FROM lineitem WHERE NOT coalesce(l_discount < 0.1, false) HAVING count(*) > 0
            UNION ALL SELECT 'cited', count(*) FROM lineitem WHERE NOT (l_returnflag <> 'R' OR l_quantity > 10) HAVING count(*) > 0 UNION ALL SELECT 'unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0""",
        "a26_planted_minimums": "WITH n(kind, needed) AS (VALUES ('click', 5), ('error', 1000000000), ('never', 1)) SELECT kind, needed::BIGINT AS needed, (SELECT count(*) FROM events WHERE event_type = kind) AS found, (SELECT count(*) FROM events WHERE event_type = kind) >= needed AS ok FROM n",
        "a23_model_bench": """WITH l AS (SELECT 'model/' || (l_suppkey % 5) AS model, ('0x' || substr(md5(l_orderkey || '.' || l_partkey), 1, 2))::INT AS h, l_suppkey % 5 = 4 AS dead, l_quantity FROM lineitem), f AS (SELECT *, dead OR h % 50 = 0 AS failed FROM l)
            SELECT model, count(*) AS calls, count(*) FILTER (failed) AS failures, round(count(*) FILTER (NOT failed AND h < 180) / nullif(count(*) FILTER (NOT failed), 0), 6) AS accuracy, sum((l_quantity / 10000)::DECIMAL(10, 4)) FILTER (NOT failed) AS cost_usd, median(l_quantity) FILTER (NOT failed) AS p50_ms FROM f GROUP BY 1""",
        "j12_replay_misses": "SELECT CASE WHEN c_custkey IS NULL OR c_custkey % 4 = 3 THEN 'missing' WHEN c_custkey % 4 = 0 THEN 'NEWER' ELSE c_mktsegment END AS reply, CASE WHEN reply = 'missing' THEN count(DISTINCT o_custkey) ELSE count(*) END AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY 1",
        "j16_trap_exposure": r"""WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda y: y <> '') AS ws FROM documents), t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda y: y <> '') AS ws FROM benchmark),
            a AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(ws) - 4)) AS i FROM s)), b AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(ws) - 4)) AS i FROM t))
            SELECT item_id AS trap_id, doc_id, count(*) AS n FROM a JOIN b USING (g) GROUP BY 1, 2""",
        "j15_private_leaks": r"""WITH b AS (SELECT item_id, unnest(string_split(text, '. ')) AS s, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM benchmark)
            SELECT item_id || '/' || i AS private_id, (SELECT count(*) FROM documents d WHERE contains(d.text, b.s) AND regexp_matches(b.s, '[\pL\pN]')) AS n FROM b""",
        "a20_run_costs": "SELECT o_orderpriority AS pack, count(*) AS items, round(median(o_totalprice), 4) AS p50, round(sum((o_totalprice / 1000)::DECIMAL(10, 4))::DOUBLE / count(*) * 60, 1) AS cost_per_60 FROM orders GROUP BY 1",
    }
