"""NFKC as column expressions, from tables that the Unicode data gives by rule.

Characters whose form is one character go through ``translate``; the few with longer forms, and marks that compose with
the character right before them, are looked up only in values that hold such. Conjoining Hangul jamo, and marks that
another mark parts from their letter, stay apart.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_class(chars: list[str]) -> str:
    """The inside of a regular expression's class for the sorted characters."""
    spans: list[list[int]] = []
    for c in map(ord, chars):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" if b > a else rf"\x{{{a:x}}}" for a, b in spans)


@cache
def forms() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Characters with a form of one character, those with a longer one, and pairs that compose."""
    one, more, pairs = {}, {}, {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x110000))):
        form = unicodedata.normalize("NFKC", c)
        if form != c:
            (one if len(form) == 1 else more)[c] = form
        parts = unicodedata.decomposition(c).split()
        if form == c and len(parts) == 2:
            pairs["".join(chr(int(p, 16)) for p in parts)] = c
    return one, more, pairs


def _map(table: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in table.items())), F.lit("\n"), F.lit("\t"))


def nfkc(text: Column) -> Column:
    """The NFKC form of a text."""
    one, more, pairs = forms()
    marks = char_class(sorted({p[-1] for p in pairs}))

    def longer(x: Column) -> Column:
        table = _map(more)
        spelled = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        return F.when(x.rlike(f"[^\\x00-\\x7f](?<=[{char_class(sorted(more))}])"), spelled).otherwise(x)

    def composed(x: Column) -> Column:
        table = _map(pairs)

        def step(acc: Column, c: Column) -> Column:
            both = F.try_element_at(table, F.concat(acc["last"], c))
            return F.struct(F.when(both.isNull(), F.concat(acc["out"], acc["last"])).otherwise(acc["out"]).alias("out"), F.coalesce(both, c).alias("last"))

        none = F.struct(F.lit("").alias("out"), F.lit("").alias("last"))
        return F.when(x.rlike(f"[^\\x00-\\x7f](?<=[{marks}])"), F.aggregate(F.split(x, ""), none, step, lambda acc: F.concat(acc["out"], acc["last"]))).otherwise(x)

    own = lambda value, body: F.transform(F.array(value), body)[0]
    return own(own(F.translate(text, "".join(one), "".join(one.values())), longer), composed)
