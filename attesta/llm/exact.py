"""Exact copies by a content sort.

Texts are normalised (each run of white space is one space) and stored once with a row number. Spark samples splitters and
deals the rows to ranges of content; in a range they are sorted, on disk where memory is short, so that equal texts stand
side by side. Neighbours are compared in full, and of each run of equal ones the row with the smallest id stays.

Splitters see the first characters of a text and a hash of it all, so what is sampled has a bounded size and texts with a
long common beginning are still told apart. A text that very many rows share is cut into fragments by row number, each
sorted like any other group; the first rows of its fragments, a few for each such text, are then compared in full.

Null texts count as empty, and empty texts equal each other. Null ids come after all others. Rows with equal id and text are
copies of each other: one of them stays, whichever it is. An empty table gives an empty result. Texts are read whole, whatever
their length. Other columns are carried along by :func:`keep_first`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.llm.shared import discard, hot_limit, written

SPACE = r"[\x20\x09-\x0D]+"
#: Characters of a text that splitters see.
HEAD = 32
#: A text of more rows than this (or than a hundred-thousandth of all rows) is cut into fragments of about so many.
FRAGMENT = 1_000


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keyed(docs: DataFrame, carry: bool) -> DataFrame:
    """(doc_id, norm, row, carried, head, hash, sha) of each row, as a table."""
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried")] if carry else []
    rows = docs.select(F.col("doc_id"), normal(F.col("text")).alias("norm"), F.monotonically_increasing_id().alias("row"), *carried)
    return written(rows.select("*", F.substring("norm", 1, HEAD).alias("head"), F.xxhash64("norm").alias("hash"), F.sha2("norm", 256).alias("sha")), "keyed")


def _marked(docs: DataFrame, carry: bool, fragment: int) -> DataFrame:
    """The rows with ``first`` and ``size`` of their group, and whether they stay."""
    keyed = _keyed(docs, carry)
    limit = hot_limit(keyed.count(), fragment)
    counts = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") > limit).select("hash", F.ceil(F.col("n") / limit).alias("parts"))
    rows = keyed.join(F.broadcast(hot), "hash", "left").withColumn("part", F.coalesce(F.pmod("row", "parts"), F.lit(0)))
    # Ranges of (head, hash, part) hold whole groups, so the window sorts them where they are.
    equal = W.partitionBy("head", "hash", "part", "norm")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = F.first("place").over(equal.orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    size = F.count(F.lit(1)).over(equal.orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    sorted_ = rows.withColumn("place", place).repartitionByRange("head", "hash", "part").withColumns({"first": first, "size": size})
    leads = F.col("first.row") == F.col("row")
    kept_text = F.when(F.col("parts").isNotNull() & leads, F.col("norm")).alias("norm")
    kept = ["doc_id", "row", "hash", "sha", "parts", "first", "size", *(["carried"] if carry else [])]
    marked = written(sorted_.select(*kept, kept_text), "marked")
    whole = marked.filter("norm is not null").groupBy("hash", "sha", "norm").agg(F.min("first").alias("all_first"), F.sum("size").alias("all_size")).drop("norm")
    discard(keyed)
    out = marked.drop("norm").join(F.broadcast(whole), ["hash", "sha"], "left")
    return out.withColumns({"first": F.coalesce("all_first", "first"), "size": F.coalesce("all_size", "size")}).withColumn("kept", F.col("first.row") == F.col("row"))


def assign(docs: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs`` (doc_id, text)."""
    rows = _marked(docs, False, fragment)
    return rows.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """``docs`` with all its columns, one row for each distinct normalised text."""
    return _marked(docs, True, fragment).filter("kept").select("carried.*")
