"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    names = ["".join(rng.choice(["th", "an", "er", "é", "on", "st", "Ä", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    out = []
    for i in range(words):
        out.append(rng.choice(names))
        if i % 17 == 16:
            out[-1] += rng.choice([".", ",", ".\n", "!"])
    return " ".join(out)


def awkward() -> list[tuple]:
    base = prose(1, 120)
    return [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", None),
        (2, base, "en", "a", None),
        (3, base.replace(" ", "  ", 3).upper(), None, None, 5),
        (4, "", "en", "b", 0),
        (5, None, None, None, None),
        (None, None, None, None, None),
        (None, base + " zz", "en", "b", 7),
        (6, prose(2, 30_000), "fr", "b", 9),
        (7, "\n\n \t\n", "de", "a", 4),
        (8, "x", "de", "a", 1),
        (9, "no space " * 40, "de", "a", 1),
        (9, "another text with the same id", "de", "a", 1),
        (10, "tab\tcr\rnbsp\u00a0em\u2003 x \u0301y <|endoftext|> x<|startoftext|>\n<|endoftext|>. 'll it's  two\n\nthree \n four", "de", "a", 1),
    ]


def frame(spark, rows, extra: bool = False):
    df = spark.createDataFrame(rows, COLUMNS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("kept", "spans", "n_words", "__id", "__text", "shard", "h", "piece", "component_id", "vslot", "n_shingles", "__kept_id", "__kept_no", "__kept_text", "__dirty_id", "__dirty_text", "__row_id", "__key_id", "__own_id", "__first_no", "__alone", "class", "second"):
            df = df.withColumn(name, F.lit("clash"))
    return df
