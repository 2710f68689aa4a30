"""The evidence behind an answer, in one row: citations with their surroundings, drops, sides of a conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import contains_quote

CONTEXT = 2
# What a reader is told about each reason of a drop.
WHY = {
    "containment": "The quoted words are not in this line, so the quote was not used.",
    "quote-length": "The quote was shorter than 3 or longer than 30 words.",
    "record-field": "The quote did not copy whole fields of this spreadsheet row.",
    "not-evidence": "This document does not count as evidence (a contract, template or questionnaire).",
    "placeholder": "This passage is unfilled template text.",
    "injection": "This passage contains instructions aimed at a model, so it was never sent to one.",
    "statement": "This is your own answer; a CSF outcome is judged on documents only.",
}


def evidence_detail(decisions: DataFrame, documents: DataFrame, chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each of ``decisions``: item_id, citations, dropped, conflict, scope_note.

    A citation has its document's data, its day, the quote, whether the quote still stands in a cited line, and the lines from
    two before to two after it. A drop has its line and a sentence. The sides of a conflict name citations by their place.
    ``documents``: doc_id, status, scope, effective_date. ``chunks``: chunk_id, line_start, as_of. ``lines``: doc_id, n, text.

    Lines, documents and passages are met by their own keys; what they give comes together in one shuffle by item.
    """
    cites = decisions.select("item_id", F.posexplode("citations").alias("at", "c"))
    drops = decisions.select("item_id", F.posexplode("dropped").alias("at", "d"))
    day = chunks.select("chunk_id", "line_start", "as_of")
    about = cites.select("item_id", "at", F.col("c.doc_id").alias("doc_id"), F.col("c.chunk_id").alias("chunk_id")).join(documents.select("doc_id", "status", "scope", "effective_date"), "doc_id", "left").join(day, "chunk_id", "left")
    about = about.select("item_id", F.struct("at", "status", "scope", F.coalesce("as_of", "effective_date").alias("date")).alias("about"))
    near = cites.select("item_id", "at", F.col("c.doc_id").alias("doc_id"), F.col("c.line_start").alias("first"), F.col("c.line_end").alias("last"), F.col("c.quote").alias("quote"))
    near = near.withColumn("n", F.explode(F.sequence(F.greatest(F.col("first") - CONTEXT, F.lit(1)), F.col("last") + CONTEXT))).join(lines.select("doc_id", "n", "text"), ["doc_id", "n"])
    cited = F.col("n").between(F.col("first"), F.col("last"))
    line = near.select("item_id", F.struct("at", "n", "text", cited.alias("cited"), (cited & contains_quote(F.col("text"), F.col("quote"))).alias("holds")).alias("line"))
    lost = drops.select("item_id", "at", F.col("d.chunk_id").alias("chunk_id")).join(day, "chunk_id").select("item_id", F.struct("at", "line_start").alias("lost"))
    rows = about.unionByName(line, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)
    got = rows.groupBy("item_id").agg(F.collect_list("about").alias("abouts"), F.array_sort(F.collect_list("line")).alias("lines"), F.collect_list("lost").alias("losts"))
    why = F.create_map(*[F.lit(x) for kv in WHY.items() for x in kv])

    def of(found: str, at: Column) -> Column:
        """The rows that belong to the citation or drop at a place."""
        return F.filter(F.coalesce(found, F.array().cast(got.schema[found].dataType)), lambda x: x["at"] == at)

    def citation(c: Column, at: Column) -> Column:
        own = F.get(of("abouts", at), F.lit(0))
        here = of("lines", at)
        return F.struct(
            c["doc_id"].alias("doc_id"), c["filename"].alias("filename"), own["status"].alias("status"), own["date"].alias("date"), own["scope"].alias("scope"), c["line_start"].alias("line"), c["quote"].alias("quote"),
            c["stance"].alias("stance"), F.exists(here, lambda x: x["holds"]).alias("found_in_source"), F.transform(here, lambda x: F.struct(x["n"].alias("n"), x["text"].alias("text"), x["cited"].alias("cited"))).alias("context"),
        )

    def drop(d: Column, at: Column) -> Column:
        return F.struct(d["reason"].alias("reason"), d["doc_id"].alias("doc_id"), d["filename"].alias("filename"), F.get(of("losts", at), F.lit(0))["line_start"].alias("line"), F.try_element_at(why, d["reason"]).alias("sentence"))

    def side(s: Column) -> Column:
        known = F.transform("kept", lambda c: F.struct(c["chunk_id"], c["quote"]))
        places = F.transform(s["citations"], lambda c: F.array_position(known, F.struct(c["chunk_id"], c["quote"])) - 1)
        return F.struct(s["stance"].alias("stance"), s["date"].alias("date"), F.filter(places, lambda p: p >= 0).alias("citations"))

    conflict = F.when(F.col("both").isNotNull(), F.struct(F.col("both.rule").alias("rule"), F.transform("both.sides", side).alias("sides")))
    joined = decisions.select("item_id", F.col("citations").alias("kept"), F.col("dropped").alias("gone"), F.col("conflict").alias("both"), "scope_note").join(got, "item_id", "left")
    return joined.select("item_id", F.transform("kept", citation).alias("citations"), F.transform("gone", drop).alias("dropped"), conflict.alias("conflict"), "scope_note")
