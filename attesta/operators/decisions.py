"""Decisions: from what passages say about an item to its label, citations and confidence. Rules only, no model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import NEGATION, contains_quote, holds_quote, normal_words, normalize_text, once, plain_name

# Lengths of quotes, confidence of labels, names of scopes and reasons that weigh on confidence.
MIN_WORDS, MAX_WORDS = 3, 30
CONFIDENCE = {"verified": 0.9, "partial": 0.6, "conflict": 0.3, "unknown": 0.0}
QUOTE_FAILURES = ("containment", "quote-length", "record-field")
SCOPE_WORDS = {
    "internal-systems": "internal systems",
    "customer-product": "the customer product",
    "production": "the production environment",
    "employees": "employees",
    "vendors-and-contractors": "vendors and contractors",
}


def whole_fields(line: Column, quote: Column) -> Column:
    """Whether the quote is one or more complete 'Header: value' fields of a record line."""
    text = normalize_text(line)
    needle = F.regexp_replace(normalize_text(quote), r"[;\s]+$", "")
    padded = lambda c: F.concat(F.lit("; "), c, F.lit("; "))
    return F.contains(needle, F.lit(": ")) & F.contains(padded(text), padded(needle))


def quote_line(text: Column, record: Column, line_start: Column, quote: Column) -> Column:
    """struct<line, reason>: the line of a passage that holds the quote, or why it fails."""

    def lines(q: Column) -> Column:
        holding = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(holds_quote(normalize_text(x), q).alias("ok"), i.alias("i"), x.alias("x"))), lambda r: r["ok"])

        def reason(first: Column) -> Column:
            return (
                F.when((words > MAX_WORDS) | (~record & (words < MIN_WORDS)), "quote-length")
                .when(first.isNull(), "containment")
                .when(record & ~whole_fields(first["x"], quote), "record-field")
            )

        def told(r: Column) -> Column:
            return F.struct(F.when(r["reason"].isNull(), line_start + r["i"]).cast("int").alias("line"), r["reason"].alias("reason"))

        words = normal_words(q)
        # The lines are looked through once, whatever is asked of the one that is found.
        return once(F.get(holding, F.lit(0)), lambda first: once(F.struct(first["i"].alias("i"), reason(first).alias("reason")), told))

    return once(normalize_text(quote), lines)


def evidence_gate(evidence_allowed: Column, flags: Column) -> Column:
    """Why a passage is never evidence; the first reason that applies."""
    return F.when(~evidence_allowed, "not-evidence").when(F.array_contains(flags, "placeholder"), "placeholder").when(F.array_contains(flags, "injection"), "injection")


def judged(passages: DataFrame, stances: DataFrame, by: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """The first stance of each passage, with the passage, ``line``, ``reason`` of a drop, and ``note``.

    ``passages``: item_id, idx and the passage's columns. ``stances``: item_id, ord, passage_idx, stance, quote. ``by`` names
    the columns that tell items apart; passages that items share may lack some of them.
    """
    first = F.row_number().over(W.partitionBy(*by, "passage_idx").orderBy("ord"))
    one = stances.withColumn("__n", first).filter("__n = 1").drop("__n").withColumnRenamed("passage_idx", "idx")
    one = one.filter("stance <> 'irrelevant'")
    shared = [c for c in by if c in passages.columns]
    if len(shared) < len(by):
        # The few passages that items share meet them as one array, by that key alone: tables dealt by it do not travel.
        held = passages.groupBy(*shared).agg(F.collect_list(F.struct(*[c for c in passages.columns if c not in shared])).alias("__p"))
        rows = one.withColumnRenamed("idx", "__idx").join(held, shared).select("*", F.inline(F.filter("__p", lambda x: x["idx"] == F.col("__idx")))).drop("__p", "__idx")
    else:
        rows = one.join(passages, [*by, "idx"])
    rows = rows.withColumn("__q", quote_line(F.col("text"), F.col("record"), F.col("line_start"), F.col("quote")))
    reason = F.coalesce(F.col("__q.reason"), evidence_gate(F.col("evidence_allowed"), F.col("flags")))
    negated = (F.col("stance") == "yes") & normalize_text(F.col("quote")).rlike(NEGATION)
    return rows.select(
        *[c for c in rows.columns if c not in ("__q", "stance", "quote")],
        F.trim("quote").alias("quote"), F.when(negated, "partial").otherwise(F.col("stance")).alias("stance"),
        F.when(negated, "negation").otherwise("").alias("note"), F.col("__q.line").alias("line"), reason.alias("reason"),
    )


def _side(stance: str) -> Column:
    return F.col("stance") == stance


def conflict_dates(sides: Column) -> Column:
    """struct<newer, newer_day, compared_day>, null unless exactly one side has records newer than all the other has.

    ``sides``: an item's kept yes and no rows as (stance, doc_id, as_of, record, day). Rows of a record's own sheet snapshot
    (document and day) on the other side are not another document, nor are the undated passages of that sheet.
    """

    def one(stance: str) -> Column:
        def compared(snaps: Column) -> Column:
            def counts(x: Column) -> Column:
                same = F.exists(snaps, lambda s: (s["doc_id"] == x["doc_id"]) & (s["as_of"] == x["as_of"]))
                sheet = x["as_of"].isNull() & F.exists(snaps, lambda s: s["doc_id"] == x["doc_id"])
                return (x["stance"] != stance) & x["day"].isNotNull() & ~F.coalesce(same, F.lit(False)) & ~F.coalesce(sheet, F.lit(False))

            newest = F.array_max(F.transform(snaps, lambda s: s["as_of"]))
            other = F.array_max(F.transform(F.filter(sides, counts), lambda x: x["day"]))
            return F.when(newest > other, F.struct(F.lit(stance).alias("newer"), newest.alias("newer_day"), other.alias("compared_day")))

        return once(F.filter(sides, lambda x: (x["stance"] == stance) & x["record"] & x["as_of"].isNotNull()), compared)

    both = F.struct(one("yes").alias("yes"), one("no").alias("no"))
    return once(both, lambda b: F.when(b["yes"].isNull(), b["no"]).when(b["no"].isNull(), b["yes"]))


def decide(items: DataFrame | None, passages: DataFrame, stances: DataFrame, dropped: DataFrame | None = None, by: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """One decision for each of ``items`` (item_id): item_id, label, value, citations, dropped, conflict, scope_note, confidence.

    ``dropped`` (item_id, chunk_id, doc_id, filename, reason) are carried first. Items without evidence are unknown. An item
    has as many passages as retrieval gives it, so its rows fit in one array; everything is one aggregation by item. ``by`` names
    the columns that tell items apart, which are told in place of item_id. With ``items`` None only those with evidence are told.
    """
    rows = judged(passages, stances, by)
    cite = F.struct("idx", "chunk_id", "doc_id", "filename", F.col("line").alias("line_start"), F.col("line").alias("line_end"), "quote", "stance", "note")
    drop = F.struct("ord", "chunk_id", "doc_id", "filename", "reason", "quote")
    kept = F.col("reason").isNull()
    yes, no = kept & _side("yes"), kept & _side("no")
    scopes = lambda side: F.collect_set(F.when(side, F.col("scope")))
    names = lambda side: F.array_join(F.array_sort(F.collect_set(F.when(side, F.col("filename")))), ", ")
    agg = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(kept, F.struct("ord", cite.alias("c"))))).alias("__cites"),
        F.array_sort(F.collect_list(F.when(~kept, drop))).alias("__drops"),
        F.collect_list(F.when(yes | no, F.struct("stance", "doc_id", "as_of", "record", F.coalesce("as_of", "effective_date").alias("day")))).alias("__sides"),
        F.count_if(kept).alias("kept"), F.coalesce(F.bool_or(yes), F.lit(False)).alias("yes"), F.coalesce(F.bool_or(no), F.lit(False)).alias("no"),
        F.bool_and(F.when(kept, _side("yes"))).alias("all_yes"), F.bool_and(F.when(kept, _side("no"))).alias("all_no"),
        F.bool_and(F.when(kept, F.col("status") == "draft")).alias("all_draft"), F.size(F.collect_set(F.when(yes | no, F.col("doc_id")))).alias("docs"),
        F.coalesce(F.bool_or((yes | no) & F.col("scope").isNull()), F.lit(False)).alias("open_scope"),
        scopes(yes).alias("yes_scopes"), scopes(no).alias("no_scopes"), names(yes).alias("yes_names"), names(no).alias("no_names"),
        F.coalesce(F.bool_or(F.col("reason").isin(*QUOTE_FAILURES)), F.lit(False)).alias("failed"),
        F.max(F.when(yes, F.coalesce("as_of", "effective_date"))).alias("yes_day"), F.max(F.when(no, F.coalesce("as_of", "effective_date"))).alias("no_day"),
    )
    dated = conflict_dates(F.coalesce("__sides", F.array().cast(agg.schema["__sides"].dataType)))
    all_ = (agg if items is None else items.select(*by).join(agg, list(by), "left")).withColumn("__dated", dated)
    all_ = all_.withColumns({c: F.col(f"__dated.{c}") for c in ("newer", "compared_day")})
    if dropped is not None:
        early = dropped.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "doc_id", "filename", "reason"))).alias("__early"))
        all_ = all_.join(early, list(by), "left")
    two = F.col("yes") & F.col("no") & (F.col("docs") >= 2)
    apart = two & ~F.col("open_scope") & ~F.arrays_overlap("yes_scopes", "no_scopes")
    label = (
        F.when(F.coalesce("kept", F.lit(0)) == 0, "unknown").when(apart, "partial").when(two, "conflict")
        .when((F.col("all_yes") | F.col("all_no")) & ~F.col("all_draft"), "verified").otherwise("partial")
    )
    value = F.when(F.col("label") == "verified", F.when(F.col("all_yes"), "Yes").otherwise("No")).when(F.col("label") == "partial", "Partial")
    words = F.create_map(*[F.lit(x) for kv in SCOPE_WORDS.items() for x in kv])
    said = lambda arr: F.array_join(F.transform(F.array_sort(arr), lambda s: F.coalesce(F.try_element_at(words, s), s)), " and ")
    note = F.concat(F.lit("Yes for "), said("yes_scopes"), F.lit(" ("), F.col("yes_names"), F.lit("); no for "), said("no_scopes"), F.lit(" ("), F.col("no_names"), F.lit(")."))
    low = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    confidence = F.round(F.greatest(F.element_at(low, F.col("label")) - F.when(F.coalesce("failed", F.lit(False)), 0.2).otherwise(0.0), F.lit(0.0)), 2)
    bare = lambda c: F.transform(F.coalesce(c, F.array().cast(agg.schema["__cites"].dataType)), lambda x: x["c"])
    side = lambda s, day: F.struct(F.lit(s).alias("stance"), F.filter("citations", lambda c: c["stance"] == s).alias("citations"), day.alias("date"))
    both = [side("yes", F.when(F.col("newer") == "no", F.col("compared_day")).otherwise(F.col("yes_day"))), side("no", F.when(F.col("newer") == "yes", F.col("compared_day")).otherwise(F.col("no_day")))]
    conflict = F.when(
        F.col("label") == "conflict",
        F.struct(F.when(F.col("newer").isNull(), "documents-disagree").otherwise("date").alias("rule"), F.when(F.col("newer") == "no", F.array(both[1], both[0])).otherwise(F.array(*both)).alias("sides")),
    )
    late = F.coalesce("__drops", F.array().cast(agg.schema["__drops"].dataType))
    late = F.transform(late, lambda d: F.struct(d["chunk_id"].alias("chunk_id"), d["doc_id"].alias("doc_id"), d["filename"].alias("filename"), d["reason"].alias("reason"), d["quote"].alias("quote")))
    if dropped is not None:
        none = F.array().cast(all_.schema["__early"].dataType)
        early_rows = F.transform(F.coalesce("__early", none), lambda d: F.struct(d["chunk_id"].alias("chunk_id"), d["doc_id"].alias("doc_id"), d["filename"].alias("filename"), d["reason"].alias("reason"), F.lit("").alias("quote")))
        late = F.concat(early_rows, late)
    out = all_.withColumn("label", label).withColumn("value", value).withColumn("citations", bare("__cites")).withColumn("dropped", late)
    return out.select(*by, "label", "value", "citations", "dropped", conflict.alias("conflict"), F.when(apart, note).alias("scope_note"), confidence.alias("confidence"))


def template_answer(label: Column, value: Column, citations: Column, conflict: Column, scope_note: Column) -> Column:
    """The answer that a decision gives without a writer; empty for an unknown one.

    It quotes one citation of each of the first two documents, or of each side of a conflict.
    """
    says = lambda c, day: F.concat(F.lit("The "), plain_name(c["filename"]), day, F.lit(' says: "'), c["quote"], F.lit('"'))
    docs = F.array_distinct(F.transform(citations, lambda c: c["doc_id"]))
    quotes = F.transform(F.slice(docs, 1, 2), lambda d: says(F.get(F.filter(citations, lambda c: c["doc_id"] == d), F.lit(0)), F.lit("")))

    def side(s: Column) -> Column:
        one = F.size(F.array_distinct(F.transform(s["citations"], lambda c: c["doc_id"]))) == 1
        day = s["date"].cast("string")
        alone = F.coalesce(F.concat(F.lit(" (dated "), day, F.lit(")")), F.lit(""))
        return F.when(one | s["date"].isNull(), says(F.get(s["citations"], F.lit(0)), alone)).otherwise(F.concat(F.lit("One side, dated "), day, F.lit(": "), says(F.get(s["citations"], F.lit(0)), F.lit(""))))

    disagree = F.concat(F.lit("The documents disagree. "), F.array_join(F.transform(conflict["sides"], side), " "), F.lit(" Which is current?"))
    plain = F.array_join(F.concat(F.array(F.when(value == "Yes", "Yes.").when(value == "No", "No.").otherwise("Partly.")), F.array_compact(F.array(scope_note)), quotes), " ")
    return F.when(label == "unknown", "").when(conflict.isNotNull(), disagree).otherwise(plain)


def draft_problems(text: Column, citations: Column, conflict: Column, known_names: Column) -> Column:
    """What is wrong with a drafted answer, an empty array if nothing: quotes, document names and numbers must come from
    its evidence. ``known_names``: plain names of documents of the workspace, those that the text may hold among them."""
    from attesta.functions.text import unsupported_numbers

    flat = normalize_text(text)
    quoted = F.transform(F.regexp_extract_all(flat, F.lit('"([^"]+)"'), F.lit(1)), lambda q: F.struct(q.alias("q"), F.regexp_replace(q, "[,;:]+$", "").alias("w")))
    missing = F.filter(quoted, lambda q: ~F.exists(citations, lambda c: contains_quote(c["quote"], q["w"])))
    cited = F.transform(citations, lambda c: plain_name(c["filename"]))
    named = F.filter(
        F.array_sort(F.array_except(known_names, cited)),
        lambda n: F.contains(n, F.lit(" ")) & ~F.exists(cited, lambda c: F.contains(c, n)) & F.rlike(F.lower(flat), F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b"))),
    )
    sources = F.concat(F.transform(citations, lambda c: c["quote"]), F.transform(citations, lambda c: c["filename"]), F.coalesce(F.transform(conflict["sides"], lambda s: F.coalesce(s["date"].cast("string"), F.lit(""))), F.array().cast("array<string>")))
    problems = F.concat(
        F.transform(missing, lambda q: F.concat(F.lit('quote not in the evidence: "'), q["q"], F.lit('"'))),
        F.transform(named, lambda n: F.concat(F.lit("names a document it does not cite: "), n)),
        F.transform(unsupported_numbers(text, sources), lambda n: F.concat(F.lit("number not in the evidence: "), n)),
    )
    return F.when(F.trim(text) == "", F.array(F.lit("the answer is empty"))).otherwise(problems)


def mentioned(drafts: DataFrame, documents: DataFrame, tenant: str) -> DataFrame:
    """(item_id, names): the plain names of the tenant's documents that a draft (item_id, tenant, text) may hold.

    Names of several words are looked up by the word that the fewest names of the tenant share, so a draft meets few of them
    however many documents there are; whether a name stands there as a whole is left to the caller.
    """
    words = lambda text: F.array_distinct(F.regexp_extract_all(F.lower(normalize_text(text)), F.lit(r"(?U)\w+"), F.lit(0)))
    names = documents.select(tenant, plain_name(F.col("filename")).alias("name")).distinct().filter(F.contains("name", F.lit(" ")))
    said = names.select(tenant, "name", F.explode(words(F.col("name"))).alias("word"))
    shared = said.groupBy(tenant, "word").agg(F.count(F.lit(1)).alias("names"))
    keys = said.join(shared, [tenant, "word"]).groupBy(tenant, "name").agg(F.min_by("word", F.struct("names", "word")).alias("word"))
    asked = drafts.select("item_id", tenant, F.explode(words(F.col("text"))).alias("word"))
    return asked.join(keys, [tenant, "word"]).groupBy("item_id").agg(F.collect_set("name").alias("names"))


def drafts_checked(decisions: DataFrame, drafts: DataFrame, documents: DataFrame | None = None, tenant: str = "workspace_id") -> DataFrame:
    """``decisions`` that have a draft, with ``draft`` and its ``problems``.

    ``drafts``: item_id, text, and the tenant if ``documents`` (tenant, filename) are given, of which it may name only those
    that it cites.
    """
    rows = decisions.join(drafts.select("item_id", F.col("text").alias("draft")), "item_id")
    names = F.array().cast("array<string>")
    if documents is not None:
        rows = rows.join(mentioned(drafts, documents, tenant), "item_id", "left")
        names = F.coalesce("names", names)
    return rows.withColumn("problems", draft_problems(F.col("draft"), F.col("citations"), F.col("conflict"), names)).drop("names")


def answers(decisions: DataFrame, drafts: DataFrame | None = None, documents: DataFrame | None = None, tenant: str = "workspace_id") -> DataFrame:
    """The decisions with ``text`` and its ``source``: a draft without problems (see :func:`drafts_checked`), else the template."""
    made = template_answer(*[F.col(c) for c in ("label", "value", "citations", "conflict", "scope_note")])
    if drafts is None:
        return decisions.withColumn("text", made).withColumn("source", F.lit("template"))
    fit = drafts_checked(decisions, drafts, documents, tenant).filter((F.size("problems") == 0) & (F.col("label") != "unknown")).select("item_id", "draft")
    joined = decisions.join(fit, "item_id", "left")
    return joined.withColumn("text", F.coalesce("draft", made)).withColumn("source", F.when(F.col("draft").isNotNull(), "draft").otherwise("template")).drop("draft")
