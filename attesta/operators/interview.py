"""The interview: which open items to ask about, in which order, and what an answer may fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import high_weight

#: Labels that leave an item open, and how many items one answer is checked against.
OPEN = ("conflict", "unknown", "partial")
MAX_RECHECKS = 8


def is_open(label: Column) -> Column:
    return label.isin(*OPEN)


def askable(label: Column, approved: Column, edited: Column) -> Column:
    """Open, and nobody has settled it by hand."""
    return is_open(label) & ~approved & ~edited


def plan_queue(items: DataFrame, queue: DataFrame | None = None) -> DataFrame:
    """(run_id, item_id, reason, rank) of items to ask about: conflicts, then weighty topics, then the rest.

    ``items``: run_id, item_id, position, topic, label, asked. Entries of ``queue`` (run_id, item_id, rank) stay; new ones
    rank after them.
    """
    todo = items.filter(is_open(F.col("label")) & (F.col("asked") == 0))
    if queue is not None:
        todo = todo.join(queue.select("run_id", "item_id"), ["run_id", "item_id"], "left_anti")
    group = F.when(F.col("label") == "conflict", 0).when(high_weight(F.col("topic")), 1).otherwise(2)
    ranked = todo.withColumn("rank", F.row_number().over(W.partitionBy("run_id").orderBy(group, "position", "item_id")))
    if queue is not None:
        last = queue.groupBy("run_id").agg(F.max("rank").alias("__last"))
        ranked = ranked.join(last, "run_id", "left").withColumn("rank", F.col("rank") + F.coalesce("__last", F.lit(0))).drop("__last")
    return ranked.select("run_id", "item_id", F.col("label").alias("reason"), "rank")


def refresh_queue(queue: DataFrame, items: DataFrame) -> DataFrame:
    """The queue with ``status``: an open question whose item needs no answer any more is skipped."""
    now = items.select("run_id", "item_id", askable(F.col("label"), F.col("approved"), F.col("edited")).alias("still"))
    rows = queue.join(now, ["run_id", "item_id"], "left")
    moot = (F.col("status") == "open") & ~F.coalesce("still", F.lit(False))
    return rows.withColumn("status", F.when(moot, "skipped").otherwise(F.col("status"))).drop("still")


def display_order(queue: DataFrame) -> DataFrame:
    """With ``place``: open questions before closed ones, then by rank."""
    order = W.partitionBy("run_id").orderBy(F.when(F.col("status") == "open", 0).otherwise(1), "rank", "item_id")
    return queue.withColumn("place", F.row_number().over(order))


def fill_candidates(statements: DataFrame, items: DataFrame, most: int = MAX_RECHECKS) -> DataFrame:
    """(statement_id, item_id, n): open items in a statement's own area that its answer may fill, at most so many.

    The area is the topic; an item without one has its framework function for it. A statement is one row.
    """
    area = F.coalesce("topic", "function")
    said = statements.select("statement_id", "run_id", area.alias("area"), F.col("item_id").alias("own"))
    todo = items.filter(askable(F.col("label"), F.col("approved"), F.col("edited"))).select("run_id", "item_id", "position", area.alias("area"))
    # No answer needs more of an area than its first open items, its own among them: the rest meets no statement.
    first = W.partitionBy("run_id", "area").orderBy("position", "item_id")
    todo = todo.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= most + 1)
    # An area's items travel as one array, and a statement takes its own out of it where it is.
    todo = todo.groupBy("run_id", "area").agg(F.array_sort(F.collect_list(F.struct("__n", "item_id"))).alias("__todo"))
    fits = F.slice(F.filter("__todo", lambda x: x["item_id"] != F.col("own")), 1, most)
    fills = said.join(todo, ["run_id", "area"]).select("statement_id", F.posexplode(fits["item_id"]).alias("n", "item_id"))
    return fills.select("statement_id", "item_id", (F.col("n") + 1).alias("n"))


def accept_fills(suggestions: DataFrame, accepted: DataFrame) -> DataFrame:
    """Suggestions (run_id, item_id, suggestion_id, status) after the ids of ``accepted``: taking one dismisses the item's others."""
    mark = accepted.select("suggestion_id").distinct().withColumn("__hit", F.lit(True))
    rows = suggestions.join(mark, "suggestion_id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    some = F.max(F.col("__hit").cast("int")).over(W.partitionBy("run_id", "item_id")) == 1
    status = F.when(F.col("__hit"), "accepted").when(some & (F.col("status") == "open"), "dismissed").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("__hit")


def clean_statement_chunks(chunks: DataFrame, most: int = 8) -> DataFrame:
    """A statement's first passages in line order, flagged ones left out."""
    clean = chunks.filter(~F.array_contains("flags", "injection"))
    return clean.withColumn("idx", F.row_number().over(W.partitionBy("doc_id").orderBy("line_start"))).filter(F.col("idx") <= most)
