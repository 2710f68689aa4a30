"""Passages: runs of lines under one heading, of at most so many words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import flags, is_injection, once
from attesta.sources.lines import line_array

#: Fixed value: most words of a passage of more than one line.
MAX_WORDS = 120


def chunk_array(lines: Column, max_words: int = MAX_WORDS) -> Column:
    """The passages of a document's lines, by one greedy fold over their kinds and sizes.

    A heading closes the running passage and labels the next ones; a record row is a passage of its own; a line that
    would make the passage too long starts the next. Before the first heading the label is the first line. Lines have
    single blanks between their words.
    """
    mark = "array<struct<begin:int,end:int,label:int,record:boolean>>"

    def marks(ls: Column) -> Column:
        def one(begin: Column, end: Column, label: Column, record: bool) -> Column:
            return F.array(F.struct(begin.alias("begin"), end.alias("end"), label.alias("label"), F.lit(record).alias("record")))

        def step(acc: Column, x: Column) -> Column:
            n, text = acc["n"] + 1, x["kind"] == "text"
            size = F.length(x["text"]) - F.length(F.replace(x["text"], F.lit(" "), F.lit(""))) + 1
            close = (acc["begin"] > 0) & (~text | (acc["words"] + size > max_words))
            out = F.when(close, F.concat(acc["out"], one(acc["begin"], acc["n"], acc["label"], False))).otherwise(acc["out"])
            label = F.when(x["kind"] == "heading", n).otherwise(acc["label"])
            out = F.when(x["kind"] == "record", F.concat(out, one(n, n, label, True))).otherwise(out)
            fresh = close | (acc["begin"] == 0)
            return F.struct(
                n.alias("n"), label.alias("label"), F.when(~text, 0).when(fresh, n).otherwise(acc["begin"]).alias("begin"),
                F.when(~text, 0).when(fresh, size).otherwise(acc["words"] + size).alias("words"), out.alias("out"),
            )

        def finish(acc: Column) -> Column:
            return F.when(acc["begin"] > 0, F.concat(acc["out"], one(acc["begin"], acc["n"], acc["label"], False))).otherwise(acc["out"])

        zero = F.lit(0)
        start = F.struct(zero.alias("n"), zero.alias("label"), zero.alias("begin"), zero.alias("words"), F.array().cast(mark).alias("out"))
        return F.aggregate(ls, start, step, finish)

    def passage(ls: Column, m: Column) -> Column:
        own = F.slice(ls, m["begin"], m["end"] - m["begin"] + 1)
        return F.struct(
            m["begin"].alias("line_start"), m["end"].alias("line_end"), F.array_join(F.transform(own, lambda x: x["text"]), "\n").alias("text"),
            F.get(ls, F.greatest(m["label"] - 1, F.lit(0)))["text"].alias("label"), F.when(m["record"], F.get(ls, m["begin"] - 1)["as_of"]).alias("as_of"), m["record"].alias("record"),
        )

    return once(lines, lambda ls: F.transform(marks(ls), lambda m: passage(ls, m)))


def passage_flags(text: Column, label: Column) -> Column:
    """The flags of a passage; an injection in its heading flags each passage beneath it."""
    own = flags(text)
    return F.when(F.coalesce(is_injection(label), F.lit(False)), F.array_union(own, F.array(F.lit("injection")))).otherwise(own)


def chunk_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), max_words: int = MAX_WORDS) -> DataFrame:
    """(keep..., chunk_id, line_start, line_end, text, heading, flags, as_of, record) for ``docs`` (doc_id, text).

    Everything happens inside a document's row. An injection in the heading flags each passage beneath it.
    """
    return _passages(docs.select(*keep, line_array(F.col("text")).alias("__lines")), keep, max_words)


def chunk_lines(lines: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The same for stored lines (doc_id, n, text, kind, as_of); a document's lines are gathered into one row."""
    row = F.struct("n", "text", "kind", "as_of")
    own = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), x["as_of"].alias("as_of")))
    return _passages(lines.groupBy("doc_id").agg(own.alias("__lines")), ("doc_id",), max_words)


def _passages(lined: DataFrame, keep: tuple[str, ...], max_words: int) -> DataFrame:
    # The outer form: for the plain one Spark infers a filter that cuts each document once more.
    found = lined.select(*keep, F.explode_outer(chunk_array(F.col("__lines"), max_words)).alias("x")).filter("x is not null")
    return found.select(
        *keep,
        F.concat_ws("#", F.col(keep[0]).cast("string"), F.col("x.line_start").cast("string")).alias("chunk_id"),
        *[F.col(f"x.{c}").alias(c) for c in ("line_start", "line_end", "text")],
        F.col("x.label").alias("heading"), passage_flags(F.col("x.text"), F.col("x.label")).alias("flags"), F.col("x.as_of").alias("as_of"), F.col("x.record").alias("record"),
    )
