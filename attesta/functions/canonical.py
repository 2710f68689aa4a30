"""Canonical JSON as a column: keys in order, one spacing, one way to write each value, so that equal requests have one key.

The form is that of a JSON writer with sorted keys, ``, `` and ``: `` between, and characters beyond ASCII as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import once

# Characters with a short escape.
ESCAPES = {'"': '\\"', "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_SHORT = [ord(c) for c in ESCAPES]
CONTROLS = {chr(c): f"\\u{c:04x}" for c in range(32) if c not in _SHORT}


def json_string(text: Column) -> Column:
    """A string in quotes, with what must be escaped escaped."""

    def escaped(x: Column) -> Column:
        out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        for c, e in ESCAPES.items():
            out = F.replace(out, F.lit(c), F.lit(e))
        rare = out
        for c, e in CONTROLS.items():
            rare = F.replace(rare, F.lit(c), F.lit(e))
        return F.when(x.rlike(r"[\x00-\x1f]"), rare).otherwise(out)

    plain = ~text.rlike(r'["\\\x00-\x1f]')
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped(text)), F.lit('"'))


def json_double(number: Column) -> Column:
    """A double by its shortest digits: plain from 0.0001 up to 1e16, else with an exponent of two digits or more."""

    def written(x: Column) -> Column:
        sign = F.when(x["s"].startswith("-"), "-").otherwise("")
        body = F.regexp_replace(x["s"], "^-", "")
        tail = F.regexp_extract(body, "E.*$", 0)
        exact = F.substring_index(body, "E", 1).cast("decimal(38,28)")
        # Java may tell more digits than needed: the fewest that still give this number are told.
        shorter = [F.round(exact, k).cast("string") for k in range(22)]
        mantissa = F.coalesce(*[F.when(F.concat(m, tail).cast("double") == F.abs(x["x"]), m) for m in shorter], F.substring_index(body, "E", 1))
        mantissa = F.when(F.contains(mantissa, F.lit(".")), mantissa).otherwise(F.concat(mantissa, F.lit(".0")))
        shift = F.when(F.contains(body, F.lit("E")), F.substring_index(body, "E", -1).cast("int")).otherwise(0)

        def digits_of(m: Column) -> Column:
            whole, part = F.substring_index(m["m"], ".", 1), F.regexp_replace(F.substring_index(m["m"], ".", -1), "0+$", "")
            digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
            # The power of ten of the first digit.
            lead = F.length(F.regexp_extract(F.concat(whole, part), "^0*", 0))
            power = F.length(whole) - 1 - lead + m["shift"]
            short = F.when(power >= 0, F.regexp_replace(digits, "0+$", "")).otherwise(digits)
            told = once(F.struct(F.when(short == "", "0").otherwise(short).alias("digits"), power.alias("power")), form)
            return F.concat(sign, F.when(digits == "", "0.0").otherwise(told))

        def form(d: Column) -> Column:
            n, p = F.length(d["digits"]), d["power"]
            before = F.when(n > p + 1, F.concat(F.substring(d["digits"], F.lit(1), p + 1), F.lit("."), F.substring(d["digits"], p + 2, n))).otherwise(F.concat(F.rpad(d["digits"], p + 1, "0"), F.lit(".0")))
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), d["digits"])
            rest = F.when(n > 1, F.concat(F.lit("."), F.substring(d["digits"], F.lit(2), n))).otherwise("")
            power_ = F.concat(F.when(p < 0, "e-").otherwise("e+"), F.lpad(F.abs(p).cast("string"), F.greatest(F.lit(2), F.length(F.abs(p).cast("string"))), F.lit("0")))
            return F.when((p >= 0) & (p < 16), before).when((p < 0) & (p >= -4), small).otherwise(F.concat(F.substring(d["digits"], 1, 1), rest, power_))

        return once(F.struct(mantissa.alias("m"), shift.alias("shift")), digits_of)

    odd = F.when(F.isnan(number), "NaN").when(number == float("inf"), "Infinity").when(number == float("-inf"), "-Infinity")
    return F.coalesce(odd, once(F.struct(number.alias("x"), number.cast("string").alias("s")), written))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """``value``, a column of type ``kind``, as canonical JSON; null is ``null``, also inside of arrays, maps and structs.

    Structs and maps with string keys are objects; a struct's null fields are kept. Dates and timestamps have to be made
    strings by the caller.
    """
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        out = json_string(value)
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = json_double(value.cast("double"))
    elif isinstance(kind, T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda e: F.concat(json_string(e["key"]), F.lit(": "), canonical_json(e["value"], kind.valueType))
        keys = F.array_sort(F.map_keys(value))
        pairs = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(value, k).alias("value")))
        out = F.concat(F.lit("{"), F.array_join(F.transform(pairs, entry), ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        pairs = [F.concat(json_string(F.lit(f.name)), F.lit(": "), canonical_json(value[f.name], f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


#: What tells one request from another, in order.
REQUEST = ("model", "prompt_version", "system", "user", "schema_name", "schema", "max_tokens", "reasoning")


def request_key(requests_schema: T.StructType) -> Column:
    """SHA-256 of a request's canonical JSON: an array of the columns ``REQUEST`` of a table with this schema.

    ``schema`` and ``reasoning`` may be structs, maps, or null.
    """
    parts = [canonical_json(F.col(c), requests_schema[c].dataType) for c in REQUEST]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256)
