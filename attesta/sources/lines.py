"""Texts and tables as numbered lines.

A text is parsed inside its row, by array functions: no shuffle, and no rows of a text that could end up apart. Blocks
are parted by blank lines; in a block the lines of a paragraph are joined, headings and bullets stand alone, and a pipe
table's first row names the cells of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import normalize_text, once

LINE = "struct<text:string,kind:string,as_of:date>"

# Limits of what is taken in.
MAX_LINES, MAX_LINE_CHARS, MAX_CHARS = 20_000, 20_000, 2_000_000

#: A block with such a line is more than one paragraph.
SPECIAL = r"(?m)^(?:#|[ \t]*\||[ \t]*[-*] )"
TABLE_RULE = r"^\|?[\s:|-]+\|?$"
#: A header that names a day still to come.
TO_COME = r"(?i)\b(?:next|due|expir\w*|until|planned|target)\b"
_PARA, _END = "\x02", "\x04"


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c))


def record_line(headers: Column, values: Column) -> Column:
    """One row as 'Header: value; Header: value'; empty cells are left out, a blank header is 'Column N'."""

    def field(v: Column, i: Column) -> Column:
        name = normalize_text(F.coalesce(F.get(headers, i), F.lit("")))
        name = F.when(name == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(name)
        value = normalize_text(F.coalesce(v, F.lit("")))
        return F.when(value != "", F.concat(name, F.lit(": "), value))

    return F.array_join(F.array_compact(F.transform(values, field)), "; ")


def latest_date(headers: Column, values: Column) -> Column:
    """The latest ISO date of a row, less cells under a header that names a day to come; no date is no date."""

    def day(v: Column, i: Column) -> Column:
        own = F.trim(v)
        ahead = F.coalesce(F.get(headers, i), F.lit("")).rlike(TO_COME)
        return F.when(own.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~ahead, F.try_to_date(own, "yyyy-MM-dd"))

    return F.array_max(F.transform(values, day))


def _block_lines(block: Column) -> Column:
    """The lines of a block, as an array of LINE."""
    line = lambda text, kind: F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(None).cast("date").alias("as_of"))
    table = lambda x: F.ltrim(x).startswith("|")
    head = lambda x: x.startswith("#")
    bullet = lambda x: F.ltrim(x).startswith("- ") | F.ltrim(x).startswith("* ")
    heading = lambda x: line(normalize_text(F.regexp_replace(x, "^#+", "")), "heading")
    item = lambda x: line(normalize_text(F.regexp_replace(F.substring(F.ltrim(x), F.lit(3), F.length(x)), r"^\[[xX]\] ", "")), "text")

    def of(raw: Column) -> Column:
        marked = F.transform(raw, lambda x: F.when(table(x) | head(x) | bullet(x), x).otherwise(F.concat(F.lit(_PARA), x, F.lit(_END))))
        joined = F.replace(F.array_join(marked, "\n"), F.lit(f"{_END}\n{_PARA}"), F.lit(" "))
        return F.split(joined, "\n", -1)

    def typed(x: Column, header: Column) -> Column:
        record = lambda own: F.struct(record_line(header, own).alias("text"), F.lit("record").alias("kind"), latest_date(header, own).alias("as_of"))
        text = line(normalize_text(F.regexp_replace(x, f"[{_PARA}{_END}]", "")), "text")
        return F.when(table(x), once(cells(x), record)).when(head(x), heading(x)).when(bullet(x), item(x)).otherwise(text)

    def whole(ls: Column) -> Column:
        def rows(x: Column) -> Column:
            def row(v: Column, i: Column) -> Column:
                skip = table(v) & ((i == x["at"]) | F.trim(v).rlike(TABLE_RULE))
                return F.when(~skip, typed(v, x["names"]))

            return F.array_compact(F.transform(ls, row))

        first = F.get(F.filter(ls, table), F.lit(0))  # the header's own row
        return once(first, lambda h: once(F.struct(cells(h).alias("names"), (F.array_position(ls, h) - 1).alias("at")), rows))

    def mixed(b: Column) -> Column:
        return once(of(F.transform(F.split(b, "\n", -1), lambda x: F.rtrim(x))), whole)

    alone = ~F.contains(block, F.lit("\n"))
    return (
        F.when(~block.rlike(SPECIAL), F.array(line(normalize_text(F.replace(block, F.lit("\n"), F.lit(" "))), "text")))
        .when(alone & head(block), F.array(heading(block))).when(alone & bullet(block), F.array(item(block))).otherwise(mixed(block))
    )


def line_array(text: Column) -> Column:
    """A text's lines in order, empty ones left out."""
    plain = once(F.coalesce(text, F.lit("")), lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, "\r\n?", "\n")).otherwise(t))
    blocks = F.split(plain, r"\n(?:[ \t\f\x0B]*\n)+", -1)
    return F.filter(F.flatten(F.transform(blocks, _block_lines)), lambda x: x["text"] != "")


def text_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n, text, kind, as_of): the numbered lines of ``docs`` (doc_id, text)."""
    # The outer form: for the plain one Spark infers a filter that parses each text once more.
    found = docs.select(*keep, F.posexplode_outer(line_array(F.col("text"))).alias("i", "x")).filter("i is not null")
    return found.select(*keep, (F.col("i") + 1).alias("n"), F.col("x.text").alias("text"), F.col("x.kind").alias("kind"), F.col("x.as_of").alias("as_of"))


def record_rows(rows: DataFrame, columns: dict[str, str], as_of: Column | None = None) -> DataFrame:
    """``rows`` with ``text`` (the row as a record line, by a map from column to header) and ``as_of``.

    A sheet's stated day, if given, dates every row; else the row's latest date does.
    """
    headers = F.array(*[F.lit(h) for h in columns.values()])
    values = F.array(*[F.col(c).cast("string") for c in columns])
    own = latest_date(headers, values)
    return rows.withColumns({"text": record_line(headers, values), "as_of": own if as_of is None else F.coalesce(as_of, own)})


#: A day that a sheet states for all its rows.
STATED = r"(?i)\b(?:as of|as at|last updated)\b\W*([0-9]{4}-[0-9]{2}-[0-9]{2})"


def sheet_lines(grid: DataFrame) -> DataFrame:
    """(sheet_id, n, text, kind, as_of): the lines of sheets given by their rows (sheet_id, row, cells array<string>).

    The first row with two filled cells or more names the columns. Rows above it are plain lines; the last valid day that one
    of them states as the sheet's own dates all rows below, else a row's latest date does. Empty rows have no line.
    """
    filled = F.filter(F.transform("cells", lambda c: normalize_text(F.coalesce(c, F.lit("")))), lambda c: c != "")
    rows = grid.select("sheet_id", "row", "cells", filled.alias("filled")).filter(F.size("filled") > 0)
    head = rows.filter(F.size("filled") >= 2).groupBy("sheet_id").agg(F.min("row").alias("head"), F.min_by("cells", "row").alias("names"))
    rows = rows.join(head, "sheet_id", "left").withColumn("title", F.array_join("filled", " "))
    above = F.coalesce(F.col("row") < F.col("head"), F.lit(True))
    day = F.try_to_date(F.regexp_extract("title", STATED, 1), "yyyy-MM-dd")
    titles = rows.filter(above & F.contains(F.col("title"), F.lit("-"))).withColumn("day", day).filter("day is not null")
    stated = titles.groupBy("sheet_id").agg(F.max_by("day", "row").alias("stated"))
    rows = rows.filter(F.col("head").isNull() | (F.col("row") != F.col("head"))).join(stated, "sheet_id", "left")
    text = F.when(above, F.col("title")).otherwise(record_line(F.col("names"), F.col("cells")))
    dated = F.when(~above, F.coalesce("stated", latest_date(F.col("names"), F.col("cells"))))
    out = rows.select("sheet_id", "row", text.alias("text"), F.when(above, "text").otherwise("record").alias("kind"), dated.alias("as_of")).filter("text <> ''")
    return out.withColumn("n", F.row_number().over(W.partitionBy("sheet_id").orderBy("row"))).select("sheet_id", "n", "text", "kind", "as_of")


#: The characters of the Western code page at bytes that Latin-1 has controls for.
WESTERN = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark, else the Western single-byte code."""
    single = F.translate(F.decode(content, "ISO-8859-1"), "".join(WESTERN), "".join(WESTERN.values()))
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(F.decode(content, "UTF-8"), r"^\x{feff}", "")).otherwise(single)


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(filename, text) of the files under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), decoded(F.col("content")).alias("text"))


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(key, reply, line) of JSON lines with a key and a reply; ``line`` orders them by file and place, so the last wins.

    Lines that are not such records are left out.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(path).select(F.from_json("value", "key string, reply string").alias("x"), place.alias("line"))
    return rows.select("x.key", "x.reply", "line").filter("key is not null")


def ingest_gate(docs: DataFrame, max_lines: int = MAX_LINES, max_line: int = MAX_LINE_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """``docs`` with ``reason``: why a text is not taken in, null if it is."""
    lines = line_array(F.col("text"))
    longest = F.array_max(F.transform(F.col("__lines"), lambda x: F.length(x["text"])))
    reason = (
        F.when(F.length("text") > max_chars, "too-many-characters")
        .when(F.size("__lines") == 0, "no-text")
        .when(F.size("__lines") > max_lines, "too-many-lines")
        .when(longest > max_line, "line-too-long")
    )
    return docs.withColumn("__lines", lines).withColumn("reason", reason).drop("__lines")


def separator(text: Column) -> Column:
    """Which of comma, semicolon, tab and bar the first line has most of; the earlier one in a tie."""
    first = F.substring_index(text, "\n", 1)
    count = lambda c: F.length(first) - F.length(F.replace(first, F.lit(c), F.lit("")))
    best = F.greatest(*[count(c) for c in ",;\t|"])
    out = F.lit("|")
    for c in reversed(",;\t"):
        out = F.when(count(c) == best, c).otherwise(out)
    return out


def sheet_items(cells_: DataFrame, mapping: DataFrame) -> DataFrame:
    """Questionnaire items from a cell grid (file, row, col, value) under a column mapping
    (file, header_row, id_col, question_col, topic_col; a column may be null).

    A row with an empty question and some other filled cell is a section: its first filled cell is the topic of the rows
    after it, where they have none of their own.
    """
    from pyspark.sql import Window as W

    pick = lambda c: F.max(F.when((F.col("col") == F.col(c)) & (F.trim("value") != ""), F.trim("value")))
    rows = cells_.join(mapping, "file").filter("row > header_row")
    rows = rows.groupBy("file", "row").agg(
        pick("question_col").alias("question"), pick("id_col").alias("code"), pick("topic_col").alias("own_topic"),
        F.min_by(F.trim("value"), F.when(F.trim("value") != "", F.col("col"))).alias("first_cell"),
    )
    running = W.partitionBy("file").orderBy("row")
    section = F.last(F.when(F.col("question").isNull(), F.col("first_cell")), ignorenulls=True).over(running)
    named = rows.withColumn("topic", F.coalesce("own_topic", section)).filter("question is not null")
    return named.select("file", "row", F.row_number().over(running).alias("position"), "code", "question", "topic")
