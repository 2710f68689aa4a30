"""Which columns of a questionnaire's sheets hold ids, questions, answers, comments and topics, found for many files at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import HEADER_ROLES, header_role
from attesta.operators.rounds import column_letter

# Rows that may be a header, and how many questions tell a column without one.
SCAN, LEAST_QUESTIONS = 30, 3
ROLES = tuple(HEADER_ROLES)


def header_candidates(cells: DataFrame) -> DataFrame:
    """(file, sheet_no, row, roles): for each row that has a question header, the first column of each role.

    A row below that has headers alone is part of the header, unless it holds something under the question's.
    """
    place = ["file", "sheet_no", "row"]
    some = cells.filter(F.col("row") <= SCAN)
    head = some.filter(F.col("row") < SCAN).select(*place, "col", F.col("value").alias("v"))
    below = some.withColumn("row", F.col("row") - 1).select(*place, "col", F.col("value").alias("b"))
    both = head.join(below, [*place, "col"], "full")
    alone, under = header_role(F.col("v")), header_role(F.col("b"))
    rows = both.withColumn("alone", alone).withColumn("under", under)
    two = rows.filter("b is not null").groupBy(*place).agg(F.bool_and(F.col("under").isNotNull()).alias("two"))
    rows = rows.join(two, place, "left").withColumn("two", F.coalesce("two", F.lit(False)))
    joined = header_role(F.trim(F.concat_ws(" ", "v", "b")))
    rows = rows.withColumn("role", F.when(F.col("two"), F.coalesce("alone", "under", joined)).otherwise(F.col("alone")))
    first = lambda role, name: F.min(F.when(F.col(name) == role, F.col("col")))
    under_question = F.max(F.when(F.col("role") == "question", F.struct(-F.col("col"), F.col("b").isNotNull())))
    per = rows.groupBy(*place, "two").agg(
        under_question.alias("q"), *[first(r, "role").alias(f"{r}_2") for r in ROLES], *[first(r, "alone").alias(f"{r}_1") for r in ROLES], F.collect_set(F.when(F.col("v").isNotNull(), F.col("col"))).alias("filled")
    )
    wide = F.col("two") & ~F.coalesce(F.col("q.col2"), F.lit(False))
    chosen = [F.when(wide, F.col(f"{r}_2")).otherwise(F.col(f"{r}_1")).alias(r) for r in ROLES]
    return per.select(*place, "filled", *chosen).filter("question is not null")


def by_shape(cells: DataFrame) -> DataFrame:
    """(file, sheet_no, header_row, question): the column with the most cells that end in a question mark, in the first
    sheet that has enough of them."""
    asks = cells.filter(F.col("value").endswith("?"))
    n = F.count_if(F.col("row") > 0).alias("n")
    per = asks.groupBy("file", "sheet_no", "col").agg(n, F.min("row").alias("first")).filter(F.col("n") >= LEAST_QUESTIONS)
    order = W.partitionBy("file").orderBy("sheet_no", F.desc("n"), "col")
    best = per.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return best.select("file", "sheet_no", F.greatest(F.lit(1), F.col("first")).alias("header_row"), F.col("col").alias("question"))


def detect(cells: DataFrame) -> DataFrame:
    """(file, sheet_no, header_row, id_col, question_col, answer_col, comments_col, topic_col) of each file that has one.

    ``cells``: file, sheet_no, row, col (all from 0), value; empty cells may be left out. Rows of the mapping count from 1,
    its columns are letters. The header with the most roles wins, then the first sheet and row. A mapping without an answer
    column takes the first one without a header to the right of the question.
    """
    width = cells.groupBy("file", "sheet_no").agg((F.max("col") + 1).alias("width"))
    cells = cells.withColumn("value", F.trim("value")).filter("value <> ''")
    order = W.partitionBy("file").orderBy(F.desc("n"), "sheet_no", "row")
    count = sum((F.col(r).isNotNull().cast("int") for r in ROLES), F.lit(0))
    best = header_candidates(cells).withColumn("n", count).withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    best = best.join(width, ["file", "sheet_no"])
    right = F.when(F.col("question") + 1 < F.col("width"), F.sequence(F.col("question") + 1, F.col("width") - 1)).otherwise(F.array().cast("array<int>"))
    free = F.get(F.filter(right, lambda c: ~F.array_contains("filled", c)), F.lit(0))
    named = best.select("file", "sheet_no", (F.col("row") + 1).alias("header_row"), "id", "question", F.coalesce("answer", free, F.col("question") + 1).alias("answer"), "comments", "topic")
    none = lambda c: F.lit(None).cast("int").alias(c)
    rest = by_shape(cells).join(named.select("file"), "file", "left_anti").select("file", "sheet_no", "header_row", none("id"), "question", (F.col("question") + 1).alias("answer"), none("comments"), none("topic"))
    letter = lambda c: F.when(F.col(c).isNotNull(), column_letter(F.col(c) + 1)).alias(f"{c}_col")
    return named.unionByName(rest).select("file", "sheet_no", "header_row", *[letter(c) for c in ("id", "question", "answer", "comments", "topic")])


def mapping_table(found: DataFrame) -> DataFrame:
    """The mapping with columns counted from 0, as :func:`attesta.sources.lines.sheet_items` takes it."""
    from attesta.operators.rounds import column_index

    index: Column = lambda c: (column_index(F.col(c)) - 1).alias(c)
    return found.select("file", (F.col("header_row") - 1).alias("header_row"), *[index(f"{c}_col") for c in ("id", "question", "topic")])
