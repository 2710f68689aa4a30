"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their check (card numbers by their check digit, addresses by their octets, dates by the
calendar, telephone numbers and mail names by shape) are replaced by a keyed permutation of themselves: a Feistel network
over the symbols of the value. Separators, length, check digit and date format stay, so a pseudonym is valid wherever
its value was; equal values get equal pseudonyms in every document, and the key holder can go back.

All of it is column expressions. Null texts stay null; texts without such values stay as they are. Rows are treated one by
one, so repeated rows stay alike and an empty table stays empty; texts are read whole, and other columns are not looked at.
Dates before 1800 or after 2199 stay in clear, as do kinds of numbers that are not named here. The key stands in the
query's plan: whoever sees plans or event logs sees it, so rotate it as they are kept.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import let

ROUNDS = 10
DIGITS, HEX, ALNUM = string.digits, "0123456789abcdef", string.digits + string.ascii_letters

# The shapes, tried in this order at each place of a text.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(SHAPES.values())
KINDS = tuple(SHAPES)
DATE_FORMATS = {"-": "yyyy-MM-dd", ".": "dd.MM.yyyy", "/": "MM/dd/yyyy"}
#: Days of the 400 years from here are permuted; they are FEW times MANY.
FIRST_DAY, FEW, MANY = "1800-01-01", 189, 773


def prf(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(value: Column, alphabet: str, key: str, tweak: str, back: bool = False) -> Column:
    """Permutes the strings of one length over ``alphabet``; ``back`` inverts it. The halves change places each round."""
    radix = len(alphabet)

    def shifted(half: Column, by: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            step = F.conv(F.substring(by, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            place = F.instr(F.lit(alphabet), c) - 1 + (-step if back else step)
            return F.substring(F.lit(alphabet), F.pmod(place, F.lit(radix)) + 1, F.lit(1))

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.split(half, ""), one), "")).otherwise("")

    def step(acc: Column, r: Column) -> Column:
        if back:  # (a, b) was (b before, a before + f(b before))
            r = F.lit(ROUNDS - 1) - r
            return F.struct(shifted(acc["b"], prf(key, F.lit(tweak), r, acc["a"])).alias("a"), acc["a"].alias("b"))
        return F.struct(acc["b"].alias("a"), shifted(acc["a"], prf(key, F.lit(tweak), r, acc["b"])).alias("b"))

    def run(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substring(v, F.lit(1), half).alias("a"), F.substring(v, half + 1, F.length(v)).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    return let(value, run)


def shifted_day(day: Column, key: str, back: bool = False) -> Column:
    """Permutes the days from 0 to FEW * MANY - 1."""

    def step(acc: Column, r: Column) -> Column:
        r = F.lit(ROUNDS - 1) - r if back else r
        few = F.conv(F.substring(prf(key, F.lit("few"), r, acc["b"]), 1, 8), 16, 10).cast("long") * (-1 if back else 1)
        many = F.conv(F.substring(prf(key, F.lit("many"), r, acc["a"]), 1, 8), 16, 10).cast("long") * (-1 if back else 1)
        even = r % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["a"] + few, F.lit(FEW))).otherwise(acc["a"]).cast("long").alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + many, F.lit(MANY))).cast("long").alias("b"),
        )

    start = lambda d: F.struct(F.floor(d / MANY).cast("long").alias("a"), (d % MANY).cast("long").alias("b"))
    return let(day.cast("long"), lambda d: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start(d), step, lambda acc: (acc["a"] * MANY + acc["b"]).cast("int")))


def check_digit(number: Column) -> Column:
    """The last digit that makes ``number`` and it pass the Luhn check."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v, lambda a: F.pmod(-a, F.lit(10)).cast("string"))


def refilled(shape: Column, symbols: Column, pattern: str) -> Column:
    """``shape`` with its characters that match ``pattern`` replaced, in turn, by those of ``symbols``."""

    def step(acc: Column, c: Column) -> Column:
        hit = c.rlike(pattern)
        out = F.concat(acc["out"], F.when(hit, F.substring(symbols, acc["i"], F.lit(1))).otherwise(c))
        return F.struct((acc["i"] + F.when(hit, 1).otherwise(0)).alias("i"), out.alias("out"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _email(m: Column, key: str, back: bool) -> Column:
    name = F.regexp_extract(m, "^[^@]*", 0)
    plain = F.regexp_replace(name, "[^A-Za-z0-9]", "")
    return F.when(F.length(plain) > 0, F.concat(refilled(name, feistel(plain, ALNUM, key, "email", back), "[A-Za-z0-9]"), F.substring(m, F.length(name) + 1, F.length(m))))


def _ip(m: Column, key: str, back: bool) -> Column:
    octets = F.split(m, r"\.")
    plain = F.forall(octets, lambda o: (o.cast("int") < 256) & (o.cast("int").cast("string") == o))
    code = F.array_join(F.transform(octets, lambda o: F.lpad(F.lower(F.conv(o, 10, 16)), 2, "0")), "")
    new = let(feistel(code, HEX, key, "ip", back), lambda c: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.conv(F.substring(c, i, F.lit(2)), 16, 10)), "."))
    return F.when(plain, new)


def _date(m: Column, key: str, back: bool) -> Column:
    out = F.lit(None).cast("string")
    for sign, shape in DATE_FORMATS.items():
        day = F.datediff(F.try_to_timestamp(m, F.lit(shape)).cast("date"), F.lit(FIRST_DAY).cast("date"))
        new = let(day, lambda d: F.when(d.between(0, FEW * MANY - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), shifted_day(d, key, back)), shape)))  # noqa: B023
        out = F.when(F.contains(m, F.lit(sign)), new).otherwise(out)
    return out


def _phone(m: Column, key: str, back: bool) -> Column:
    return refilled(m, feistel(digits_of(m), DIGITS, key, "phone", back), "[0-9]")


def _card(m: Column, key: str, back: bool) -> Column:
    def replaced(d: Column) -> Column:
        front = F.substring(d, F.lit(1), F.length(d) - 1)
        new = let(feistel(front, DIGITS, key, "card", back), lambda n: F.concat(n, check_digit(n)))
        return F.when(check_digit(front) == F.substring(d, -1, 1), refilled(m, new, "[0-9]"))

    return let(digits_of(m), replaced)


def pseudonym(found: Column, key: str, back: bool = False) -> Column:
    """(kind, new): ``new`` is the value as it was, and ``kind`` null, if it fails the check of every kind it may be."""
    by = {"email": _email, "ip": _ip, "date": _date, "phone": _phone, "card": _card}
    which = F.lit(None).cast("string")
    new = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        is_it = found.rlike(f"^(?:{SHAPES[kind]})$")
        which, new = F.when(is_it, kind).otherwise(which), F.when(is_it, by[kind](found, key, back)).otherwise(new)
    return let(F.struct(which.alias("kind"), new.alias("new")), lambda x: F.struct(F.when(x["new"].isNotNull(), x["kind"]).alias("kind"), F.coalesce(x["new"], found).alias("new")))


def pseudonymise(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """doc_id, text with the pseudonyms in it, and how many values of each kind were replaced: n_email, n_ip, ..."""
    text = F.col("text")
    none = F.array().cast("array<struct<kind:string,new:string>>")

    def rebuilt(x: Column) -> Column:
        pieces = F.transform(x["p"], lambda piece, i: F.concat(piece, F.coalesce(F.get(x["new"], i)["new"], F.lit(""))))
        return F.struct(F.array_join(pieces, "").alias("text"), x["new"].alias("new"))

    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key, back))
    changed = let(F.struct(F.split(text, ANY, -1).alias("p"), found.alias("new")), rebuilt)
    out = docs.select("doc_id", F.when(text.rlike("[0-9@]"), changed).otherwise(F.struct(text.alias("text"), none.alias("new"))).alias("x"))
    count = lambda k: F.size(F.filter("x.new", lambda v: F.coalesce(v["kind"] == k, F.lit(False)))).cast("long")
    counts = [F.when(F.col("x.text").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", F.col("x.text").alias("text"), *counts)
