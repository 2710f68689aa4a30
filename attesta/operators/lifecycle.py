"""What happens to stored rows: latest runs, idempotent appends, re-decisions, approvals, snapshots and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in that order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def append_once(new: DataFrame, existing: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of ``new`` to append: the first of each key, unless the key is there already."""
    return latest(new, keys, order).join(existing.select(*keys), keys, "left_anti")


def affected(answers: DataFrame, changed: DataFrame, array: str, key: str) -> DataFrame:
    """The answers whose ``array`` holds a changed key."""
    hit = answers.select("answer_id", F.explode(array).alias(key)).join(changed.select(key).distinct(), key, "left_semi").select("answer_id").distinct()
    return answers.join(hit, "answer_id", "left_semi")


def changed_only(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of ``new`` that differ from ``old`` in one of the columns; nulls are compared like values."""
    before = old.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    return new.join(before, key, "left").filter(~same).select(*new.columns)


def same_evidence(stored: DataFrame, found: DataFrame, key: str, member: str) -> DataFrame:
    """(key, same): whether two sets of members per key are equal; a key of only one side is not the same."""
    of = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias(name))
    both = of(stored, "a").join(of(found, "b"), key, "full")
    return both.select(key, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same"))


def approvable(answers: DataFrame, framework_items: DataFrame) -> DataFrame:
    """Verified answers that nobody has edited or approved, less the items of the framework."""
    rows = answers.filter((F.col("label") == "verified") & ~F.col("edited") & ~F.col("approved"))
    return rows.join(framework_items.select("item_id"), "item_id", "left_anti")


def approval_counts(answers: DataFrame, framework_items: DataFrame) -> DataFrame:
    """(run_id, approved, skipped_edited): what a bulk approval of each run takes, and the edited verified answers, still
    unapproved, that it leaves for a look."""
    taken = approvable(answers, framework_items).groupBy("run_id").agg(F.count(F.lit(1)).alias("approved"))
    rows = answers.groupBy("run_id").agg(F.count_if((F.col("label") == "verified") & F.col("edited") & ~F.col("approved")).alias("skipped_edited"))
    return rows.join(taken, "run_id", "left").select("run_id", F.coalesce("approved", F.lit(0)).alias("approved"), "skipped_edited")


def transitions(answers: DataFrame, changes: DataFrame) -> DataFrame:
    """``answers`` (item_id, label, value, approved, edited) after ``changes`` (item_id, action, value).

    approve: only what is verified or partial. edit: the value is the user's and the approval is gone. na: neither label
    nor value is left. Refused changes leave the answer as it is; see :func:`refused`.
    """
    rows = answers.join(changes.select("item_id", "action", F.col("value").alias("__new")), "item_id", "left")
    ok = (F.col("action") == "approve") & F.col("label").isin("verified", "partial")
    edit, na = F.coalesce(F.col("action") == "edit", F.lit(False)), F.coalesce(F.col("action") == "na", F.lit(False))
    return rows.select(
        "item_id", F.when(na, "na").otherwise(F.col("label")).alias("label"), F.when(na, None).when(edit, F.col("__new")).otherwise(F.col("value")).alias("value"),
        F.when(F.coalesce(ok, F.lit(False)), True).when(edit | na, False).otherwise(F.col("approved")).alias("approved"), (F.col("edited") | edit).alias("edited"),
    )


def refused(answers: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that a rule forbids, with the reason."""
    rows = changes.join(answers.select("item_id", "label"), "item_id", "left")
    reason = F.when(F.col("label").isNull(), "no such item").when((F.col("action") == "approve") & ~F.col("label").isin("verified", "partial"), "not approvable")
    return rows.withColumn("reason", reason).filter("reason is not null").select("item_id", "action", "reason")


def remapped(answers: DataFrame, names: DataFrame, array: str) -> DataFrame:
    """(answer_id, ids, complete): the names in ``array`` replaced by ids, in order; not complete if one has no id."""
    rows = answers.select("answer_id", F.posexplode(array).alias("i", "name")).join(names.select("name", "id"), "name", "left")
    out = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("x"), F.bool_and(F.col("id").isNotNull()).alias("complete"))
    return out.select("answer_id", F.transform("x", lambda v: v["id"]).alias("ids"), "complete")


def digest(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(keys..., digest): SHA-256 of a key's rows in order, fields parted by bars and rows by line ends."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
    packed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(packed, lambda r: r["line"]), "\n"), 256).alias("digest"))


def merged_sheet(grid: DataFrame, answers: DataFrame) -> DataFrame:
    """The original rows (row, any cells) with what ``answers`` (row, answer, status, sources, notes...) adds to each, as
    inert text; rows without an answer keep empty cells. Columns of one name may not stand on both sides."""
    from attesta.functions.text import inert

    cells = [c for c in [*grid.columns, *answers.columns] if c != "row"]
    return grid.join(answers, "row", "left").select("row", *[inert(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in cells])


def withdrawn(documents: DataFrame, answers: DataFrame, suggestions: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After edits of confirmed answers: their statements are no evidence, and open fills that cite them are dismissed."""
    gone = answers.join(edited.select("answer_id"), "answer_id", "left_semi").filter("statement_id is not null").select("statement_id").distinct()
    mark = gone.withColumn("__gone", F.lit(True))
    docs = documents.join(mark.withColumnRenamed("statement_id", "doc_id"), "doc_id", "left")
    docs = docs.withColumn("evidence_allowed", F.col("evidence_allowed") & F.col("__gone").isNull()).drop("__gone")
    fills = suggestions.join(mark, "statement_id", "left")
    return docs, fills.withColumn("status", F.when((F.col("status") == "open") & F.col("__gone").isNotNull(), "dismissed").otherwise(F.col("status"))).drop("__gone")
