"""The library's functions for SQL users.

Each is a temporary SQL function whose body is the text of the library's own column expression, so SQL and DataFrames share one
rule, nothing of it runs in Python, and Spark inlines the body into the query: text normal forms, quotes, numbers and
redaction. ``line_list`` and ``chunk_list`` are a text's lines and passages as arrays, which a subquery selects and ``LATERAL VIEW
posexplode`` spreads within the row; the table functions ``doc_lines`` and ``doc_chunks`` are the same for LATERAL, which Spark turns into a join by
text: handy for some texts, while a whole corpus should go through the arrays.

Null is kept by functions of a value; a null text has no lines and no passages.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import contains_quote, inert, normalize_text, number_tokens, once

#: A string literal, which stays; or the name of an operator that is called as a function, which SQL wants in backquotes.
_PIECE = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])((?:or|and|not|[=!<>+*/%&|^~-]+)(?=\())", re.S)


def sql_text(column: Column) -> str:
    """An expression over named columns as SQL text."""
    shown = re.fullmatch(r"Column<'(.*)'>", str(column), re.S)
    if shown is None:
        raise ValueError("the expression has no SQL text")
    return _PIECE.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], shown[1])


LINE_LIST = "ARRAY<STRUCT<text: STRING, kind: STRING, as_of: DATE>>"
CHUNK_LIST = "ARRAY<STRUCT<line_start: INT, line_end: INT, text: STRING, heading: STRING, flags: ARRAY<STRING>, as_of: DATE, record: BOOLEAN>>"


def _scalars() -> dict[str, tuple[str, str, str]]:
    """name: (parameters, result, body)."""
    from attesta.operators.chunks import chunk_array, passage_flags
    from attesta.operators.redaction import applied, spans
    from attesta.sources.lines import line_array

    def flagged(c: Column) -> Column:
        plain = [c[n].alias(n) for n in ("line_start", "line_end", "text")]
        return F.struct(*plain, c["label"].alias("heading"), passage_flags(c["text"], c["label"]).alias("flags"), c["as_of"].alias("as_of"), c["record"].alias("record"))

    x, haystack, quote = F.col("x"), F.col("haystack"), F.col("quote")
    space = r"(?U)\s+"
    return {
        "plain_spaces": ("x STRING", "STRING", sql_text(F.trim(F.regexp_replace(x, space, " ")))),
        "word_total": ("x STRING", "INT", sql_text(F.size(F.filter(F.split(x, space), lambda w: w != "")))),
        "inert_cell": ("x STRING", "STRING", sql_text(inert(x))),
        "normalize_text": ("x STRING", "STRING", sql_text(normalize_text(x))),
        "number_tokens": ("x STRING", "ARRAY<STRUCT<raw: STRING, value: STRING, kind: STRING>>", sql_text(number_tokens(x))),
        "redact_text": ("x STRING", "STRING", sql_text(once(x, lambda t: once(spans(t), lambda kept: applied(t, kept))))),
        "holds_quote": ("haystack STRING, quote STRING", "BOOLEAN", sql_text(contains_quote(haystack, quote))),
        "line_list": ("x STRING", LINE_LIST, sql_text(line_array(x))),
        "chunk_list": ("x STRING", CHUNK_LIST, sql_text(F.transform(chunk_array(line_array(x)), flagged))),
    }


#: name: (result, body) of table functions of a text ``x``. The outer form: for the plain one Spark infers a filter that parses each text once more.
TABLES = {
    "doc_lines": (
        "n INT, text STRING, kind STRING, as_of DATE",
        "SELECT f.i + 1, f.v.text, f.v.kind, f.v.as_of FROM (SELECT line_list(x) AS vs) LATERAL VIEW OUTER posexplode(vs) f AS i, v WHERE f.i IS NOT NULL",
    ),
    "doc_chunks": (
        "line_start INT, line_end INT, text STRING, heading STRING, flags ARRAY<STRING>, as_of DATE, record BOOLEAN",
        "SELECT f.v.* FROM (SELECT chunk_list(x) AS vs) LATERAL VIEW OUTER explode(vs) f AS v WHERE f.v IS NOT NULL",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions callable from SQL; returns their names."""
    scalars = _scalars()
    for name, (params, result, body) in scalars.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    for name, (result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS TABLE({result}) RETURN {body}")
    return [*scalars, *TABLES]
