"""Quality rules: base counts of a text, and lines that a host repeats across its documents.

Lines are normalised (lower case, digits to ``0``, white space to one space) and hashed. Per host, a line counts the
distinct documents that hold it. Exact copies of a document are one document here, for the line and for the host: what
is counted is the hash of the whole text, which nothing but copies share. A line above the limits is boilerplate and is
removed; a document that loses more than a given part of its words with them is depleted and rejected.

Null texts have no words and fail the base rule. A null host is a host of its own. Rows with equal id and text share a
verdict; the same id with another text is another document. An empty table gives an empty result. Texts are read whole,
whatever their length; helper columns give way to names that the input has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import fresh, let, row_key, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate if more than ``min_docs`` documents of its host hold it, and more than ``share`` of them."""

    min_docs: int = 5
    share: float = 0.01
    depleted: float = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of three words that the text holds twice or more."""

    def positions(keyed: Column) -> Column:
        same = lambda x, i: (F.get(keyed, i - 1)["h"] == x["h"]) | (F.get(keyed, i + 1)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(keyed, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def keyed(w: Column) -> Column:
        window = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        return F.array_sort(window)

    return let(words, lambda w: let(keyed(w), lambda k: let(positions(k), covered)))


def base_stats(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """word_chars, n_words, n_symbols, n_dup_lines, n_repeat_words and base_failed for each row, beside ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = words_of(F.col("text"))
    out = docs.select(
        *keep,
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("__w"),
    )
    out = out.select("*", F.col("__w.n").alias("n_words"), F.col("__w.r").alias("n_repeat_words")).drop("__w")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " "))


def document_lines(docs: DataFrame) -> DataFrame:
    """(__id, __text, host, copy, line, place, n_words): a row for each line of a document with a word, with its place among all
    lines from 0; copies share ``copy``."""
    placed = F.transform(F.split(F.col("text"), "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    hashed = F.transform(
        F.filter(placed, lambda p: p["x"].rlike(r"[^\x20\x09-\x0D]")),
        lambda p: F.struct(F.md5(normal_line(p["x"])).alias("h"), F.size(words_of(p["x"])).alias("n"), p["i"].alias("i")),
    )
    rows = docs.select(*row_key(), F.col("source").alias("host"), F.xxhash64("text").alias("copy"), F.explode(hashed).alias("x"))
    return rows.select("__id", "__text", "host", "copy", F.col("x.h").alias("line"), F.col("x.i").alias("place"), F.col("x.n").cast("long").alias("n_words"))


def frequent_lines(lines: DataFrame, docs: DataFrame, limits: LineLimits) -> DataFrame:
    """(host, line, n_docs) above the limits. Counts are gathered in two steps, so that a hot line meets no single task."""
    counted = lines.groupBy("host", "line", "copy").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    texts = docs.groupBy(F.col("source").alias("__host"), F.xxhash64("text").alias("__copy")).agg(F.lit(1).alias("one"))
    hosts = texts.groupBy("__host").agg(F.count(F.lit(1)).alias("host_docs"))
    above = counted.filter(F.col("n_docs") > limits.min_docs).join(hosts, F.col("host").eqNullSafe(F.col("__host")))
    return above.filter(F.col("n_docs") > F.lit(limits.share) * F.col("host_docs")).select("host", "line", "n_docs")


def removed_lines(docs: DataFrame, limits: LineLimits) -> DataFrame:
    """(__id, __text, removed): the lines (place, n_words) of each document that are above the limits, in order; documents
    without such a line have no row."""
    lines = written(document_lines(docs), "lines")  # read twice, so made once
    frequent = frequent_lines(lines, docs, limits).select(F.col("host").alias("__host"), F.col("line").alias("__line"))
    hit = lines.join(frequent, (F.col("line") == F.col("__line")) & F.col("host").eqNullSafe(F.col("__host")), "left_semi")
    # Repeated rows have their lines in the same places.
    return hit.groupBy("__id", "__text").agg(F.array_sort(F.collect_set(F.struct("place", "n_words"))).alias("removed"))


def judge(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): the base counts, n_removed_words, the places of the lines that are
    removed (``removed_lines``) and ``kept``, beside the row's key (__id, __text)."""
    rows = docs.select("doc_id", "text", "source")
    # Written, or the counts would be made once more for each condition on them that Spark pushes down.
    stats = written(base_stats(rows, [F.col("doc_id"), *row_key()]), "stats")
    removed = removed_lines(rows, limits).select(
        "__id", "__text", F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["n_words"]).alias("n_removed_words"), F.transform("removed", lambda x: x["place"]).alias("removed_lines")
    )
    out = stats.join(removed, ["__id", "__text"], "left").withColumns({"n_removed_words": F.coalesce("n_removed_words", F.lit(0).cast("long")), "removed_lines": F.coalesce("removed_lines", F.array().cast("array<int>"))})
    depleted = F.col("n_removed_words") > F.lit(limits.depleted) * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_lines(text: Column, places: Column) -> Column:
    """``text`` less the lines at some places; the others stay as they are."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(places, i)), "\n")


def keep_good(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """``docs`` with all its columns, less the rows that :func:`judge` rejects and the lines above the limits.

    A row that loses lines has its text without them, and its n_chars counts what is left.
    """
    names = {x: fresh([*docs.columns, "__id", "__text"], x) for x in ("__row_id", "__row_text", "__places")}
    verdicts = judge(docs, limits).filter("kept").groupBy("__id", "__text").agg(F.first("removed_lines").alias(names["__places"]))
    verdicts = verdicts.select(F.col("__id").alias(names["__row_id"]), F.col("__text").alias(names["__row_text"]), names["__places"])
    keys = {x: fresh([*docs.columns, *names.values()], x) for x in ("__key_id", "__key_text")}
    rows = docs.withColumns(dict(zip(keys.values(), row_key(), strict=True)))
    kept = rows.join(verdicts, (F.col(keys["__key_id"]) == F.col(names["__row_id"])) & (F.col(keys["__key_text"]) == F.col(names["__row_text"])))
    loses = F.size(names["__places"]) > 0
    text = F.when(loses, without_lines(F.col("text"), F.col(names["__places"]))).otherwise(F.col("text"))
    shorter = kept.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], loses.alias(names["__places"]))
    if "n_chars" not in docs.columns:
        return shorter.select(*docs.columns)
    n_chars = F.when(F.col(names["__places"]), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return shorter.select(*[n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
