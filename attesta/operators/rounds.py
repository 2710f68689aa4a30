"""What a later round does to earlier answers: decide again after a change of documents, re-open outcomes, fill and ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import normalize_text
from attesta.operators.decisions import answers as answer_table
from attesta.operators.decisions import decide
from attesta.operators.redaction import applied, spans

MACHINE = ("verified", "partial", "conflict", "unknown")
#: About how many fills one task decides.
TASK_FILLS = 200_000


def machine_judged(answers: DataFrame, parts: DataFrame) -> DataFrame:
    """Answers with a machine's label, or confirmed ones that have stored parts, whose others are still judged on documents.

    ``answers``: run_id, item_id, label. ``parts``: run_id, item_id.
    """
    some = parts.select("run_id", "item_id").distinct().withColumn("__parts", F.lit(True))
    rows = answers.join(some, ["run_id", "item_id"], "left")
    return rows.filter(F.col("label").isin(*MACHINE) | ((F.col("label") == "user_confirmed") & F.coalesce("__parts", F.lit(False)))).drop("__parts")


def current_parts(stored: DataFrame, deployed: DataFrame, prompt: str, model: str) -> DataFrame:
    """``stored`` (outcome_id, part_n, question, stance_prompt, model, statement_id) with ``current``: the wording is that
    of ``deployed`` (outcome_id, part_n, question) and so is the judge, which a part filled by the user does not have."""
    wording = deployed.select("outcome_id", "part_n", F.col("question").alias("__now"))
    judge = F.col("stance_prompt").eqNullSafe(F.lit(prompt)) & F.col("model").eqNullSafe(F.lit(model))
    same = F.col("question").eqNullSafe(F.col("__now")) & F.col("__now").isNotNull() & (judge | F.col("statement_id").isNotNull())
    return stored.join(wording, ["outcome_id", "part_n"], "left").withColumn("current", same).drop("__now")


def affected_answers(answers: DataFrame, chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """The unedited machine answers (item_id, label, edited, chunk_ids) that hold a passage of a changed document (doc_id)."""
    own = chunks.join(changed.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id")
    rows = answers.filter(F.col("label").isin(*MACHINE) & ~F.col("edited"))
    hit = rows.select("item_id", F.explode("chunk_ids").alias("chunk_id")).join(own, "chunk_id", "left_semi").select("item_id").distinct()
    return rows.join(hit, "item_id", "left_semi")


def rebuilt_passages(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, idx, passage columns) in the stored order of ``chunk_ids``, with today's metadata; an answer of which a
    passage is gone has no rows."""
    said = answers.select("item_id", F.posexplode("chunk_ids").alias("i", "chunk_id"))
    rows = said.join(chunks.withColumn("__there", F.lit(True)), "chunk_id", "left")
    gone = rows.filter("__there is null").select("item_id").distinct()
    return rows.join(gone, "item_id", "left_anti").withColumn("idx", F.col("i") + 1).drop("i", "__there")


def redecide(answers: DataFrame, stances: DataFrame, chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """The answers that a change of documents changes: item_id, label, value, citations, text, approved.

    ``answers``: item_id, label, value, citations, edited, approved, chunk_ids. ``chunks``: the passages as they are now.
    A changed answer has the template's text and no approval; the others have no row.
    """
    todo = affected_answers(answers, chunks, changed)
    passages = rebuilt_passages(todo, chunks)
    whole = passages.select("item_id").distinct()
    new = answer_table(decide(whole, passages, stances.join(whole, "item_id", "left_semi")))
    old = answers.select("item_id", F.col("label").alias("__label"), F.col("value").alias("__value"), F.col("citations").alias("__citations"))
    plain = lambda c: F.to_json(F.col(c))
    same = F.col("label").eqNullSafe(F.col("__label")) & F.col("value").eqNullSafe(F.col("__value")) & plain("citations").eqNullSafe(plain("__citations"))
    return new.join(old, "item_id").filter(~same).select("item_id", "label", "value", "citations", "conflict", "scope_note", "confidence", "text", F.lit(False).alias("approved"))


def reopened(outcomes: DataFrame, stored: DataFrame, found: DataFrame, deployed: DataFrame, prompt: str, model: str) -> DataFrame:
    """(outcome_id, reasons): checked outcomes that must be judged again.

    ``outcomes``: outcome_id, label, edited, approved, failed. ``stored``: parts with chunk_ids. ``found`` (outcome_id,
    part_n, chunk_id): what retrieval gives today, compared as a set. Parts that the user filled need no evidence.
    """
    rows = current_parts(stored, deployed, prompt, model)
    now = found.groupBy("outcome_id", "part_n").agg(F.array_sort(F.collect_set("chunk_id")).alias("__now"))
    rows = rows.join(now, ["outcome_id", "part_n"], "left")
    none = F.array().cast(now.schema["__now"].dataType)
    moved = F.array_sort(F.array_distinct("chunk_ids")) != F.coalesce("__now", none)
    judged = F.col("statement_id").isNull()
    per = rows.groupBy("outcome_id").agg(F.bool_or(judged & ~F.col("current")).alias("stale"), F.bool_or(judged & F.col("current") & moved).alias("moved"))
    lacking = deployed.join(stored, ["outcome_id", "part_n"], "left_anti").select("outcome_id").distinct().withColumn("lacking", F.lit(True))
    some = stored.select("outcome_id").distinct().withColumn("run_id", F.lit(0)).withColumnRenamed("outcome_id", "item_id")
    judged_ = machine_judged(outcomes.withColumn("run_id", F.lit(0)).withColumnRenamed("outcome_id", "item_id"), some).withColumnRenamed("item_id", "outcome_id")
    todo = judged_.filter("not edited and not approved").join(deployed.select("outcome_id").distinct(), "outcome_id", "left_semi")
    todo = todo.join(per, "outcome_id", "left").join(lacking, "outcome_id", "left")
    yes = lambda c, name: F.when(F.coalesce(c, F.lit(False)), name)
    reasons = F.array_compact(F.array(yes(F.col("failed"), "failed"), yes(F.col("lacking"), "part missing"), yes(F.col("stale"), "not current"), yes(F.col("moved"), "evidence changed")))
    return todo.select("outcome_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def after_reopening(opened: DataFrame, stored: DataFrame, fills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored parts that stay (all of other outcomes, the user's of re-opened ones), and the fills (outcome_id, part_n,
    status), of which open whole-outcome ones (part 0) of re-opened outcomes are dismissed."""
    mark = opened.select("outcome_id").withColumn("__open", F.lit(True))
    kept = stored.join(mark, "outcome_id", "left").filter("__open is null or statement_id is not null").drop("__open")
    rows = fills.join(mark, "outcome_id", "left")
    gone = F.col("__open").isNotNull() & (F.col("part_n") == 0) & (F.col("status") == "open")
    return kept, rows.withColumn("status", F.when(gone, "dismissed").otherwise(F.col("status"))).drop("__open")


def statement_lines(statements: DataFrame) -> DataFrame:
    """(statement_id, said_on, n, text): accepted answers as dated documents, a redacted line for each line with text."""
    line = F.filter(F.transform(F.split("answer", "\n"), normalize_text), lambda x: x != "")
    rows = statements.select("statement_id", F.col("accepted_at").cast("date").alias("said_on"), F.posexplode(line).alias("i", "text"))
    kept = rows.withColumn("__spans", spans(F.col("text")))
    return kept.select("statement_id", "said_on", (F.col("i") + 1).alias("n"), applied(F.col("text"), F.col("__spans")).alias("text"))


def dealt_by_statement(candidates: DataFrame) -> Callable[..., DataFrame]:
    """A function that deals a table by its statements (named if not statement_id), over tasks that follow the number of fills.

    What is dealt before passages meet the items that they may fill need not travel after that.
    """
    tasks = max(candidates.sparkSession.sparkContext.defaultParallelism, -(-candidates.count() // TASK_FILLS))
    return lambda df, statement="statement_id": df.repartition(tasks, statement)


def decided_fills(candidates: DataFrame, passages: DataFrame, stances: DataFrame) -> DataFrame:
    """(statement_id, item_id, label, value, text): fills of ``candidates`` (statement_id, item_id, n) that their statement's
    passages decide; only verified and partial ones. ``stances`` are keyed by statement and item, ``passages`` by statement, or
    by both. Tables that are dealt alike (see :func:`dealt_by_statement`) do not travel."""
    # By statement alone: a join by statement and item would deal everything again.
    own = candidates.groupBy("statement_id").agg(F.collect_set("item_id").alias("__own"))
    stances = stances.join(own, "statement_id").filter(F.array_contains("__own", F.col("item_id"))).drop("__own")
    got = decide(None, passages, stances, by=("statement_id", "item_id"))
    return answer_table(got).filter("label in ('verified', 'partial')").select("statement_id", "item_id", "label", "value", "text")


def document_uses(documents: DataFrame, chunks: DataFrame, answers: DataFrame, suggestions: DataFrame, questions: DataFrame) -> DataFrame:
    """``documents`` with ``used``: whether an answer (statement_id, chunk_ids), suggestion or question (statement_id) uses it."""
    by_chunk = answers.select(F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("doc_id")
    named = [df.select(F.col("statement_id").alias("doc_id")).filter("doc_id is not null") for df in (answers, suggestions, questions)]
    used = by_chunk
    for df in named:
        used = used.unionByName(df)
    mark = used.distinct().withColumn("__used", F.lit(True))
    return documents.join(mark, "doc_id", "left").withColumn("used", F.coalesce("__used", F.lit(False))).drop("__used")


def side_citations(decisions: DataFrame) -> DataFrame:
    """(item_id, side, place, citation): for each citation of a conflict's side its number, from 0, among the item's citations."""
    cites = decisions.select("item_id", F.posexplode("citations").alias("citation", "c")).select("item_id", "citation", "c.chunk_id", "c.quote")
    cites = cites.groupBy("item_id", "chunk_id", "quote").agg(F.min("citation").alias("citation"))
    sides = decisions.filter("conflict is not null").select("item_id", F.posexplode("conflict.sides").alias("side", "s"))
    said = sides.select("item_id", "side", F.posexplode("s.citations").alias("place", "c")).select("item_id", "side", "place", "c.chunk_id", "c.quote")
    return said.join(cites, ["item_id", "chunk_id", "quote"], "left").select("item_id", "side", "place", "citation")


def worded(rows: DataFrame, items: DataFrame, deployed: DataFrame) -> DataFrame:
    """Suggestions or questions (item_id, part_n) with the item's question, or the wording of the part that they concern."""
    own = deployed.select(F.col("outcome_id").alias("item_id"), "part_n", F.col("question").alias("__part"))
    out = rows.join(items.select("item_id", F.col("question").alias("__whole")), "item_id", "left").join(own, ["item_id", "part_n"], "left")
    return out.withColumn("wording", F.when(F.col("part_n") > 0, F.col("__part")).otherwise(F.col("__whole"))).drop("__part", "__whole")


def searched(answers: DataFrame, text: str, labels: list[str]) -> DataFrame:
    """Answers whose question or code holds ``text`` in any case, with one of the labels (all if none is named)."""
    needle = F.lower(F.lit(text))
    hit = F.contains(F.lower("question"), needle) | F.contains(F.lower("code"), needle)
    return answers.filter(hit & F.col("label").isin(*labels)) if labels else answers.filter(hit)


def compacted(recordings: DataFrame, used: DataFrame, dropped_steps: list[str]) -> DataFrame:
    """The last recording of each used key, less those of the dropped steps, in order of key."""
    from attesta.operators.lifecycle import latest

    rows = recordings.join(used.select("key").distinct(), "key", "left_semi").filter(~F.col("step").isin(*dropped_steps))
    return latest(rows, ["key"], [F.desc("line")]).orderBy("key")


def verifier_bundle(lines: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(file, row, content): numbered lines for each document, a row of metadata for each, and the questions without answers."""
    numbered = lines.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.col("n").cast("long").alias("row"), F.concat_ws("\t", F.col("n").cast("string"), "text").alias("content"))
    about = documents.select(F.lit("documents.csv").alias("file"), F.col("doc_id").cast("long").alias("row"), F.to_csv(F.struct("doc_id", "filename", "status", "scope")).alias("content"))
    asked = items.select(F.lit("questions.csv").alias("file"), F.col("position").cast("long").alias("row"), F.to_csv(F.struct("item_id", "topic")).alias("content"))
    return numbered.unionByName(about).unionByName(asked)


def ingest_tables(docs: DataFrame, path: str) -> None:
    """Writes documents, lines and chunks of ``docs`` (workspace_id, doc_id, text) below ``path``, by workspace."""
    from attesta.operators.chunks import chunk_documents
    from attesta.sources.lines import text_lines

    keep = ("doc_id", "workspace_id")
    for name, rows in (("documents", docs.drop("text")), ("lines", text_lines(docs, keep)), ("chunks", chunk_documents(docs, keep))):
        rows.write.mode("append").partitionBy("workspace_id").parquet(f"{path}/{name}")


def cell_text(value: Column, kind: str) -> Column:
    """How one cell reads in a record line: booleans in capitals, days alone where there is no time, whole floats without
    a point, texts normalised; nothing for null. ``kind`` is the column's simple type."""
    if kind == "boolean":
        out = F.upper(value.cast("string"))
    elif kind == "date":
        out = value.cast("string")
    elif kind.startswith("timestamp"):
        out = F.when(value.cast("timestamp") == F.date_trunc("day", value), F.date_format(value, "yyyy-MM-dd")).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm"))
    elif kind in ("float", "double"):
        out = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))
    else:
        out = normalize_text(value.cast("string"))
    return F.coalesce(out, F.lit(""))


def scrubbed(text: Column) -> Column:
    """Without NUL, which stores refuse. A Spark string is UTF-8 and so holds no lone surrogate."""
    return F.replace(text, F.lit("\0"), F.lit(""))


def column_letter(index: Column) -> Column:
    """The sheet letters of a column, counted from 1; up to three letters."""
    i = index - 1
    digit = lambda v: F.char(F.lit(65) + F.pmod(v, F.lit(26)))
    two, three = F.floor(i / 26) - 1, F.floor((F.floor(i / 26) - 1) / 26) - 1
    return F.concat(F.when(i >= 702, digit(three)).otherwise(""), F.when(i >= 26, digit(two)).otherwise(""), digit(i))


def column_index(letters: Column) -> Column:
    """The inverse of :func:`column_letter`."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)
