"""Secret scans: fixed shapes, and tokens that look random to character Markov models.

Three fixed shapes are searched first (an assignment to a secret's name, an access key id, a long hexadecimal run). Then
two first-order Markov models over characters, one of random strings and one of ordinary identifiers, score each long
token by its mean log-likelihood ratio per step; tokens above the threshold are spans of kind ``random``. Of another token
those runs of parts between ``= / _ -`` are, that are long enough and above it: names and paths before a value do not hide
it. What spans of fixed shapes cover is cut out of tokens first. Both models are trained from labelled samples. All of it is column expressions.

Null and empty texts have no spans. Spans are half open and count code points. Rows are scanned one by one, so repeated
rows have the same spans; an empty table gives an empty result and an untrained model. Texts are read whole. The sample's
ties are ordered by id and text.
"""

from __future__ import annotations

import json
import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.shared import let, sample_rows

# The shapes, with the least length of what must be long.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
QUICK = {"assign": r"(?i:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"  # LEAST and more
SPAN = "struct<start:int,end:int,kind:int>"
#: Mean log-likelihood ratio per step above which a token counts as random.
THRESHOLD = 0.8
LEAST = 16
#: Letters of ``ALPHABET`` from here on part a token; "+" does not.
FIRST_JOINER = ALPHABET.index("/")
#: A run of parts ends where its sum (less the threshold for each step) has fallen so far below its highest.
DROP = 8.0
#: At most so many labelled samples of a class train a model.
MAX_SAMPLES = 4000


def spans_of(text: Column, pattern: str, kind: int, accept) -> Column:
    """The accepted ones of a pattern's leftmost non-overlapping matches, as an array of ``SPAN``."""

    def fold(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            found = F.get(x["m"], i)
            begin = acc["at"] + F.length(F.get(x["p"], i))
            end = begin + F.length(found)
            span = F.array(F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
            return F.struct(end.alias("at"), F.when(accept(found), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        order = F.transform(x["m"], lambda _, i: i)
        return F.aggregate(order, start, step, lambda acc: acc["out"])

    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return let(both, fold)


def fixed_spans(text: Column) -> Column:
    """Spans of the three fixed shapes, sorted by start, then kind."""
    rules = (
        ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        ("access", ACCESS, lambda m: F.length(m) >= 20),
        ("hex", HEX, lambda m: F.length(m) >= 24),
    )
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.when(text.rlike(QUICK[k]), spans_of(text, rx, KINDS.index(k), ok)).otherwise(none) for k, rx, ok in rules]
    return F.array_sort(F.concat(*found), _by_place)


def _by_place(a: Column, b: Column) -> Column:
    key = lambda x: x["start"].cast("long") * 8 + x["kind"]
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def default_samples(docs: DataFrame, n_docs: int = 500) -> DataFrame:
    """Labelled samples (text, random): keys made by a hash as random ones, words and names built of them as ordinary.

    The words are letters only, from the ``n_docs`` documents with the smallest id hashes, with at most ``MAX_SAMPLES``
    words; a name joins two of them by an underscore, or has a capital in the middle. Plain
    decimal numbers are ordinary too.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    packed = F.translate(F.base64(F.unhex(digest)), "\r\n", "")
    shape = F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).otherwise(packed.substr(F.lit(1), (F.lit(20) + F.col("id") % 40).cast("int")))
    random = spark.range(MAX_SAMPLES).select(shape.alias("text"), F.lit(True).alias("random"))
    some = sample_rows(docs.filter("text is not null").select("doc_id", "text"), n_docs, "doc_id", "text")
    word = some.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)))).alias("w")).distinct()
    word = word.orderBy(F.xxhash64("w")).limit(MAX_SAMPLES)
    named = F.array(F.col("w"), F.concat(F.lower("w"), F.lit("_"), F.lower(F.reverse("w"))), F.concat(F.lower("w"), F.initcap("w")), F.concat(F.lower("w"), F.lit("-"), F.lower("w"), F.lit("/"), F.lower("w")))
    ordinary = word.select(F.explode(named).alias("text"), F.lit(False).alias("random"))
    number = F.substring(F.conv(F.substring(F.sha2(F.concat(F.lit("number"), F.col("id").cast("string")), 256), 1, 15), 16, 10), 1, 16)
    numbers = spark.range(MAX_SAMPLES).select(number.alias("text"), F.lit(False).alias("random"))
    return random.unionByName(ordinary).unionByName(numbers)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character steps, with one added to each count; row by row of ``ALPHABET``.

    Only the counts of character pairs come to the driver, at most two for each pair of the alphabet.
    """
    size = len(ALPHABET)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(2))))
    counts = samples.filter(F.length("text") > 1).select("random", pair.alias("pair")).groupBy("random", "pair").count()
    counts = counts.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$"))
    seen = {True: [1.0] * size * size, False: [1.0] * size * size}
    for x in counts.collect():
        a, b = (ALPHABET.index(c) for c in x["pair"])
        seen[x["random"]][a * size + b] += x["count"]
    logs = {}
    for label, table in seen.items():
        total = [sum(table[a * size : (a + 1) * size]) for a in range(size)]
        logs[label] = [math.log(v / total[i // size]) for i, v in enumerate(table)]
    return [round(r - o, 4) for r, o in zip(logs[True], logs[False], strict=True)]


def random_score(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio per step of a token over ``ALPHABET``."""
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def total(x: Column) -> Column:
        steps = F.transform(F.slice(x, 2, F.size(x)), lambda b, i: F.get(ratios, F.get(x, i) * len(ALPHABET) + b))
        return F.aggregate(steps, F.lit(0.0), lambda a, v: a + v) / (F.size(x) - 1)

    return let(at, total)


def ratio_literal(ratios: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(ratios)), "array<double>")


def token_runs(token: Column, begin: Column, ratios: Column, threshold: float) -> Column:
    """Random spans of one token that begins at ``begin``: all of it, or runs of its parts.

    What follows a run's best end, up to where the run was given up, is searched again until nothing is left of it: a second
    key behind a higher one is told as well.
    """
    none = F.array().cast(f"array<{SPAN}>")
    places = "array<struct<a:int,b:int>>"
    random = F.lit(KINDS.index("random")).alias("kind")

    def runs(x: Column, stretch: Column) -> Column:
        """(out, rest): the runs of a stretch that ends before place b, and the stretches to be searched again."""
        # total: what the steps since ``start`` exceed the threshold by; top: its highest at the end of a part, at ``stop``.
        zero = F.lit(0.0)
        first = F.struct(stretch["a"].alias("start"), zero.alias("total"), zero.alias("top"), stretch["a"].alias("stop"), none.alias("out"), F.array().cast(places).alias("rest"))

        def step(acc: Column, i: Column) -> Column:
            end = i == stretch["b"]
            joint = end | (F.get(x, i) >= FIRST_JOINER)
            higher = joint & (acc["total"] > acc["top"])
            top, stop = F.when(higher, acc["total"]).otherwise(acc["top"]), F.when(higher, i).otherwise(acc["stop"])
            over = joint & ((acc["total"] <= 0) | (acc["total"] < top - DROP) | end)
            ruled = (F.get(x, i - 1) >= FIRST_JOINER) & (F.get(x, i) >= FIRST_JOINER)  # a step within a rule says nothing
            value = F.when(ruled, zero).otherwise(F.get(ratios, F.get(x, i - 1) * len(ALPHABET) + F.get(x, i)))
            ratio = F.when(i > acc["start"], F.coalesce(value - threshold, zero)).otherwise(zero)
            tell = over & (top > 0) & (stop - acc["start"] >= LEAST)
            again = over & (top > 0) & (i - stop > LEAST)
            span = F.array(F.struct((begin + acc["start"]).cast("int").alias("start"), (begin + stop).cast("int").alias("end"), random))
            return F.struct(
                F.when(over, i + 1).otherwise(acc["start"]).alias("start"),
                F.when(over, zero).otherwise(acc["total"] + ratio).alias("total"),
                F.when(over, zero).otherwise(top).alias("top"),
                F.when(over, i + 1).otherwise(stop).alias("stop"),
                F.when(tell, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"),
                F.when(again, F.concat(acc["rest"], F.array(F.struct((stop + 1).alias("a"), i.alias("b"))))).otherwise(acc["rest"]).alias("rest"),
            )

        return F.aggregate(F.sequence(stretch["a"], stretch["b"]), first, step, lambda acc: F.struct(acc["out"].alias("out"), acc["rest"].alias("rest")))

    def passes(x: Column) -> Column:
        """Passes over what is left; each stretch has a part less than the one it is of, so there are no more than parts."""

        def one(acc: Column, _: Column) -> Column:
            found = lambda r: F.struct(F.concat(acc["out"], F.flatten(F.transform(r, lambda y: y["out"]))).alias("out"), F.flatten(F.transform(r, lambda y: y["rest"])).alias("rest"))
            return F.when(F.size(acc["rest"]) > 0, let(F.transform(acc["rest"], lambda s: runs(x, s)), found)).otherwise(acc)

        start = F.struct(none.alias("out"), F.array(F.struct(F.lit(0).alias("a"), F.size(x).alias("b"))).cast(places).alias("rest"))
        most = F.sequence(F.lit(0), F.size(F.filter(x, lambda c: c >= FIRST_JOINER)))
        return F.aggregate(most, start, one, lambda acc: F.array_sort(acc["out"], _by_place))

    whole = F.array(F.struct(begin.cast("int").alias("start"), (begin + F.length(token)).cast("int").alias("end"), random))
    parts = let(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), passes)
    return F.when(random_score(token, ratios) > threshold, whole).when(token.rlike("[/_=-]"), parts).otherwise(none)


def random_spans(text: Column, ratios: list[float], threshold: float = THRESHOLD) -> Column:
    """Tokens, or runs of their parts, that the models take for random strings."""
    table = ratio_literal(ratios)
    none = F.array().cast(f"array<{SPAN}>")
    inside = lambda s: let(F.substring(text, s["start"] + 1, s["end"] - s["start"]), lambda t: token_runs(t, s["start"], table, threshold))
    found = F.flatten(F.transform(spans_of(text, TOKEN, KINDS.index("random"), lambda m: F.lit(True)), inside))
    return F.when(text.rlike(TOKEN), found).otherwise(none)


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of the spans, which are sorted by start."""

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"], acc["at"])
        end = F.greatest(s["end"], acc["at"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), end - begin))
        return F.struct(end.alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def scan(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with column ``spans``: an array of (start, end, kind), sorted by start, then kind.

    ``keep`` names the columns to carry, all by default; one called ``spans`` is replaced.
    """
    ratios = train(default_samples(docs) if samples is None else samples)
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [c for c in (keep or docs.columns) if c.lower() != "spans"]

    def joined(fixed: Column) -> Column:
        rest = let(blanked(text, fixed), lambda t: random_spans(t, ratios, threshold))
        return F.array_sort(F.concat(fixed, rest), _by_place)

    found = let(fixed_spans(text), joined)
    return docs.select(*names, found.alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """``text`` with each run of touching spans replaced by ``mark``."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        between = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, between).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the secrets of its texts replaced, and ``n_chars`` brought up to date where there is one."""
    found = scan(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), samples, threshold)
    text = redacted(F.col("text"), F.col("spans"))
    cols = [text.alias(c) if c.lower() == "text" else F.length(text).cast("long").alias(c) if c.lower() == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.select(*cols)
