"""Framework outcomes: from the labels of an outcome's parts to its own label, evidence and explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.operators.decisions import CONFIDENCE, QUOTE_FAILURES

# The labels of a part by decision, their words in an explanation, and which parts explain a label.
PART_LABELS = {("verified", "Yes"): "covered", ("partial", "Partial"): "partly_covered", ("verified", "No"): "not_met", ("conflict", None): "documents_disagree", ("unknown", None): "gap"}
PART_WORDS = {"covered": "Evidenced", "partly_covered": "Partly evidenced", "not_met": "Stated as not done", "documents_disagree": "Documents disagree", "gap": "No evidence"}
DECIDING = {"documents_disagree": ["documents_disagree"], "not_met": ["not_met"], "covered": ["covered"], "partly_covered": ["covered", "partly_covered"], "gap": []}
GAP_WORDS = {
    "covered": "Covered", "partly_covered": "Partly covered", "not_met": "Not met", "documents_disagree": "Documents disagree",
    "gap": "Gap", "confirmed_by_you": "Confirmed by you", "not_answered": "Not answered",
}
ANSWERED, NOT_CHECKED = "Answered by you", "not checked in this version"


def part_label(label: Column, value: Column) -> Column:
    out = F.lit(None).cast("string")
    for (k, v), name in PART_LABELS.items():
        out = F.when((label == k) & value.eqNullSafe(F.lit(v)), name).otherwise(out)
    return out


def combined(part: Column) -> Column:
    """The label of a group of parts, as an aggregate; the first rule that applies wins."""
    any_ = lambda x: F.bool_or(part == x)
    every = lambda x: F.bool_and(part == x)
    return (
        F.when(any_("documents_disagree"), "documents_disagree").when(any_("not_met"), "not_met")
        .when(every("covered"), "covered").when(every("gap"), "gap").otherwise("partly_covered")
    )


def combine_parts(parts: DataFrame) -> DataFrame:
    """(outcome_id, label) from (outcome_id, part_n, part_label)."""
    return parts.groupBy("outcome_id").agg(combined(F.col("part_label")).alias("label"))


def gap_label(tier: Column, label: Column, value: Column, has_statement: Column) -> Column:
    """The label that a report shows for an outcome; none if its tier is not checked."""
    return (
        F.when(tier == "not_checked", None).when((label == "user_confirmed") & has_statement, "confirmed_by_you")
        .when(tier == "ask", "not_answered").otherwise(part_label(label, value))
    )


def gap_word(tier: Column, label: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in GAP_WORDS.items() for x in kv])
    return F.when((label == "confirmed_by_you") & (tier == "ask"), ANSWERED).otherwise(F.try_element_at(words, label))


def first_of_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def part_numbers(numbers: Column) -> Column:
    return F.concat(F.when(F.size(numbers) == 1, "part ").otherwise("parts "), F.array_join(F.transform(numbers, lambda n: n.cast("string")), ", "))


def explanations(parts: DataFrame) -> DataFrame:
    """(outcome_id, label, explanation) from (outcome_id, part_n, part_label, filled, question, answer).

    Part numbers by label, the parts filled by the user first and under their own words; then the question and answer of
    each part that decided the label.
    """
    numbers = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("part_n"))))
    groups = {"mine": numbers(F.col("filled") & (F.col("part_label") == "covered"))}
    for k in PART_WORDS:
        groups[f"own_{k}"] = numbers(F.col("filled") & (F.col("part_label") == k))
        groups[f"doc_{k}"] = numbers(~F.col("filled") & (F.col("part_label") == k))
    said = F.array_sort(F.collect_list(F.struct("part_n", "part_label", F.concat_ws(" ", "question", "answer").alias("text"))))
    rows = parts.groupBy("outcome_id").agg(combined(F.col("part_label")).alias("label"), *[v.alias(k) for k, v in groups.items()], said.alias("said"))
    phrase = lambda word, col: F.when(F.size(col) > 0, F.concat(F.lit(word), part_numbers(F.col(col)), F.lit(".")))
    deciding = F.create_map(*[x for k, v in DECIDING.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    answers = F.transform(F.filter("said", lambda s: F.array_contains(F.element_at(deciding, F.col("label")), s["part_label"])), lambda s: s["text"])
    texts = [phrase("Confirmed by you: ", "mine")]
    texts += [phrase(f"{w} in your answer: ", f"own_{k}") for k, w in PART_WORDS.items() if k != "covered"]
    texts += [phrase(f"{w}: ", f"doc_{k}") for k, w in PART_WORDS.items()]
    return rows.select("outcome_id", "label", F.array_join(F.concat(F.array_compact(F.array(*texts)), answers), " ").alias("explanation"))


def merge_evidence(citations: DataFrame) -> DataFrame:
    """(outcome_id, citations): every part's citations without repeats, in order of part and place.

    ``citations``: outcome_id, part_n, ord, doc_id, line_start, line_end, quote, stance.
    """
    key = ["outcome_id", "doc_id", "line_start", "line_end", "quote", "stance"]
    one = first_of_key(citations, key, [F.col("part_n"), F.col("ord")])
    row = F.struct("part_n", "ord", "doc_id", "line_start", "line_end", "quote", "stance")
    return one.groupBy("outcome_id").agg(F.array_sort(F.collect_list(row)).alias("citations"))


def outcome_results(parts: DataFrame) -> DataFrame:
    """Label, confidence, first conflict, notes, cost and latency of each outcome.

    ``parts``: outcome_id, part_n, part_label, scope_note, conflict_rule, quote_failed, cost_usd decimal, latency_ms.
    """
    out = parts.groupBy("outcome_id").agg(
        combined(F.col("part_label")).alias("label"),
        F.min_by("conflict_rule", F.when(F.col("conflict_rule").isNotNull(), F.col("part_n"))).alias("conflict_rule"),
        F.array_sort(F.collect_list(F.when(F.col("scope_note").isNotNull(), F.struct("part_n", "scope_note")))).alias("notes"),
        F.bool_or("quote_failed").alias("failed"), F.sum("cost_usd").alias("cost_usd"), F.sum("latency_ms").alias("latency_ms"),
    )
    back = {name: k for (k, _), name in PART_LABELS.items()}
    low = F.create_map(*[x for name, k in back.items() for x in (F.lit(name), F.lit(CONFIDENCE[k]))])
    note = F.array_join(F.array_distinct(F.transform("notes", lambda n: n["scope_note"])), " ")
    confidence = F.round(F.greatest(F.element_at(low, F.col("label")) - F.when(F.col("failed"), 0.2).otherwise(0.0), F.lit(0.0)), 2)
    return out.select("outcome_id", "label", "conflict_rule", F.when(note != "", note).alias("scope_note"), confidence.alias("confidence"), "cost_usd", "latency_ms")


def confirmed_by_fills(outcomes: DataFrame, parts: DataFrame) -> DataFrame:
    """``outcomes`` (outcome_id, label) with ``status`` user_confirmed and ``statement_id`` where a covered outcome has a
    part that the user filled; the first such part is cited."""
    filled = parts.filter("filled").groupBy("outcome_id").agg(F.min_by("statement_id", "part_n").alias("statement_id"))
    out = outcomes.join(filled, "outcome_id", "left")
    mine = (F.col("label") == "covered") & F.col("statement_id").isNotNull()
    return out.withColumn("status", F.when(mine, "user_confirmed").otherwise("machine")).withColumn("statement_id", F.when(mine, F.col("statement_id")))


def framework(reference: DataFrame, tiers: DataFrame, questions: DataFrame) -> DataFrame:
    """Reference outcomes (outcome_id, ...) with tier, question and parts; what has no tier is not checked."""
    out = reference.join(tiers.select("outcome_id", "tier"), "outcome_id", "left").join(questions.select("outcome_id", "question", "parts"), "outcome_id", "left")
    return out.withColumn("tier", F.coalesce("tier", F.lit("not_checked"))).withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))


def in_scope(outcomes: DataFrame, scope: str) -> DataFrame:
    """The checked and asked outcomes of the core, or of one function."""
    rows = outcomes.filter("tier <> 'not_checked'")
    return rows if scope == "core" else rows.filter(F.lower("function") == scope)


def gap_check(decisions: DataFrame, parts: DataFrame) -> DataFrame:
    """(outcome_id, label, status, explanation, citations): from the decisions on an outcome's parts to its row of a report.

    ``decisions`` as :func:`attesta.operators.decisions.decide` gives them; ``parts``: item_id, outcome_id, part_n, question.
    """
    from attesta.operators.decisions import answers

    told = answers(decisions).join(parts, "item_id").withColumn("part_label", part_label(F.col("label"), F.col("value")))
    said = explanations(told.select("outcome_id", "part_n", "part_label", F.lit(False).alias("filled"), "question", F.col("text").alias("answer")))
    cites = told.select("outcome_id", "part_n", F.posexplode("citations").alias("ord", "c")).select("outcome_id", "part_n", "ord", "c.doc_id", "c.line_start", "c.line_end", "c.quote", "c.stance")
    return said.join(merge_evidence(cites), "outcome_id", "left").select("outcome_id", "label", gap_word(F.lit("checked"), F.col("label")).alias("status"), "explanation", F.coalesce(F.size("citations"), F.lit(0)).alias("citations"))


def gap_report(outcomes: DataFrame, results: DataFrame, citations: DataFrame, run_date: Column, version: str) -> DataFrame:
    """Every outcome with the words of its label, its explanation, quotes and links to their lines, and its related controls
    (an array column ``controls`` of ``outcomes``); also those that were not checked. Each row has the run's day and the
    version of the framework's data."""
    quotes = F.transform("citations", lambda c: F.concat(F.lit('"'), c["quote"], F.lit('"')))
    links = F.transform("citations", lambda c: F.concat(c["doc_id"].cast("string"), F.lit("#L"), c["line_start"].cast("string")))
    rows = outcomes.join(results, "outcome_id", "left").join(merge_evidence(citations), "outcome_id", "left")
    word = F.when(F.col("tier") == "not_checked", NOT_CHECKED).otherwise(F.coalesce(gap_word(F.col("tier"), F.col("label")), F.lit("")))
    return rows.select(
        "outcome_id", "function", "tier", word.alias("status"), F.coalesce("explanation", F.lit("")).alias("explanation"), F.coalesce(F.array_join(quotes, "; "), F.lit("")).alias("quotes"), F.coalesce(F.array_join(links, "; "), F.lit("")).alias("links"),
        F.coalesce(F.array_join(F.array_sort("controls"), ", "), F.lit("")).alias("controls"), F.date_format(run_date, "yyyy-MM-dd").alias("run_date"), F.lit(version).alias("version"))
