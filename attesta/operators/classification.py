"""Classification of documents by rules on their first lines: kind, status, date, scope, and whether they are evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import PLACEHOLDER

# How many lines are looked at, and what is looked for in them.
OPENING, HEAD = 3, 6
DAY = r"(\d{4}-\d{2}-\d{2})"
EFFECTIVE = r"(?i)\beffective(?: date)?\b\W*" + DAY
PERIOD = r"(?i)\b(?:examination|audit|review|reporting) period\b|\bperiod of review\b"
RANGE = rf"(?i){DAY}\s*(?:to|through|until|-)\s*{DAY}"
REPORT_DATE, AS_OF = rf"(?i)\breport date\b\W*{DAY}", rf"(?i)\bas (?:of|at)\b\W*{DAY}"
CONTRACT = (
    r"(?i)\b(?:master services agreement|services agreement|subscription agreement|terms of service"
    r"|data processing (?:agreement|addendum)|non-disclosure agreement|order form)\b"
)
TEMPLATE, DRAFT = r"(?i)\btemplate\b", r"\bDRAFT\b|\bdraft\b[^.]{0,40}\bnot (?:yet )?approved\b"
VERSIONED, QUESTIONNAIRE = r"(?i)\bversion\b.{0,30}?\b(?:effective|draft)\b", r"(?i)\bquestionnaire\b"
TITLES = {
    "report": r"(?i)\breport\b",
    "plan": r"(?i)\bplan\b",
    "policy": r"(?i)\b(?:polic(?:y|ies)|standard|procedures?|handbook|program)\b",
    "other": r"(?i)\b(?:faq|wiki|notes?|readme|guide|glossary|export)\b",
}
QUESTION_CELL, ANSWER_CELL, QUESTION_FIELD = r"(?i)^questions?$", r"(?i)^(?:answers?|responses?)$", r"(?i)(?:^|; )question:"
SCOPE_LINE = r"(?i)^(?:scope:|this (?:policy|standard|procedure|report|plan|document) (?:applies to|covers)\b)"
SCOPES = {
    "internal-systems": r"(?i)\b(?:internal|corporate) systems?\b",
    "customer-product": r"(?i)\bcustomer(?:[- ]facing)? product\b",
    "production": r"(?i)\bproduction\b",
    "vendors-and-contractors": r"(?i)\b(?:vendors?|contractors?|suppliers?|third[- ]part(?:y|ies))\b",
    "employees": r"(?i)\b(?:employees?|staff|workforce|personnel)\b",
}


def _any(lines: Column, *patterns: str) -> Column:
    return F.exists(lines, lambda t: F.greatest(*[t.rlike(p) for p in patterns]) if len(patterns) > 1 else t.rlike(patterns[0]))


def effective_date(head: Column) -> Column:
    """The first line's date that has one: its effective day, the end of its period, its report or as-of day."""

    def of(t: Column) -> Column:
        pick = lambda p, i: F.when(t.rlike(p), F.regexp_extract(t, p, i))
        day = F.coalesce(pick(EFFECTIVE, 1), F.when(t.rlike(PERIOD), pick(RANGE, 2)), pick(REPORT_DATE, 1), pick(AS_OF, 1))
        return F.try_to_date(day, "yyyy-MM-dd")

    return F.get(F.filter(F.transform(head, of), lambda d: d.isNotNull()), F.lit(0))


def scope(head: Column) -> Column:
    """The scope that the first scope line names; the first that matches."""
    line = F.get(F.filter(head, lambda t: t.rlike(SCOPE_LINE)), F.lit(0))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SCOPES.items()):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


def is_questionnaire(fmt: Column, opening: Column, head: Column) -> Column:
    def header(t: Column) -> Column:
        cells = F.split(F.trim(t), r"\s*[|\t,;]\s*")
        return F.exists(cells, lambda c: c.rlike(QUESTION_CELL)) & F.exists(cells, lambda c: c.rlike(ANSWER_CELL))

    return _any(opening, QUESTIONNAIRE) | F.exists(head, header) | (fmt.isin("xlsx", "csv") & _any(head, QUESTION_FIELD))


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, status, effective_date, scope, evidence_allowed, sure) from (doc_id, format, head).

    ``head`` has a document's first lines. A document that no rule knows is 'other' and not sure.
    """
    rows = docs.withColumn("opening", F.slice("head", 1, OPENING)).withColumn("head", F.slice("head", 1, HEAD))
    opening, head, title = F.col("opening"), F.col("head"), F.get("head", F.lit(0))
    template = _any(opening, PLACEHOLDER, TEMPLATE)
    by_title = F.when(_any(opening, VERSIONED), "policy")
    for kind, pattern in reversed(TITLES.items()):
        by_title = F.when(title.rlike(pattern), kind).otherwise(by_title)
    kind = (
        F.when(F.array_join(opening, " ").rlike(CONTRACT), "contract").when(template, "other").when(is_questionnaire(F.col("format"), opening, head), "questionnaire")
        .when(F.col("format").isin("xlsx", "csv"), "record").when(_any(head, PERIOD, REPORT_DATE), "report").otherwise(by_title)
    )
    out = rows.withColumn("__kind", kind).withColumn("__template", template)
    evidence = ~F.col("__template") & ~F.coalesce(F.col("__kind").isin("contract", "questionnaire"), F.lit(False))
    return out.select(
        "doc_id", F.coalesce("__kind", F.lit("other")).alias("kind"), F.when(_any(opening, DRAFT), "draft").otherwise("final").alias("status"),
        effective_date(head).alias("effective_date"), scope(head).alias("scope"), evidence.alias("evidence_allowed"), F.col("__kind").isNotNull().alias("sure"),
    )
