"""Scores of whole runs against answer keys, gates that fail closed, checks of rows, and comparisons of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.joins import merged_join

#: Most private strings that are sent to every text, and most without an inner word that every text is searched for.
FEW_PRIVATE, FEW_SHORT = 100_000, 500


def ratio(hits: Column, total: Column) -> Column:
    """Null, and so a failed gate, where there is nothing to measure. Not rounded: gates compare what was measured."""
    return hits / F.nullif(total, F.lit(0))


def rounded(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """``metrics`` with every double rounded, for showing them."""
    return metrics.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in metrics.dtypes])


def label_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, and precision and recall of conflicts, of rows (by..., expected, label)."""
    right = F.col("expected") == F.col("label")
    want, got = F.col("expected") == "conflict", F.col("label") == "conflict"
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), ratio(F.count_if(right), F.count(F.lit(1))).alias("accuracy"),
        ratio(F.count_if(want & got), F.count_if(want)).alias("conflict_recall"), ratio(F.count_if(want & got), F.count_if(got)).alias("conflict_precision"),
    )


def unpivoted(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by..., metric, value)."""
    return metrics.unpivot(by, [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """``metrics`` (..., metric, value) against ``rules`` (metric, op, target, gating): passed, and why not.

    A value that could not be measured fails; a gate that only reports never does.
    """
    rows = metrics.join(F.broadcast(rules), "metric")
    good = F.when(F.col("op") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    reason = F.when(F.col("value").isNull(), "nothing to measure").when(~good, "target missed")
    return rows.withColumn("reason", reason).withColumn("passed", ~F.col("gating") | F.col("reason").isNull())


def key_diff(keys: DataFrame, other: DataFrame) -> DataFrame:
    """(code, problem): codes missing on one side, repeated, or with another label or value."""
    times = other.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l"), F.min("value").alias("v"))
    both = keys.join(times, "code", "full")
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("label").isNull(), "not asked").when(F.col("n") > 1, "repeated")
        .when((F.col("label") != F.col("l")) | ~F.col("value").eqNullSafe(F.col("v")), "differs")
    )
    return both.select("code", problem.alias("problem")).filter("problem is not null")


def missing_and_extra(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    a = want.select(key).distinct().join(have, key, "left_anti").withColumn("side", F.lit("missing"))
    return a.unionByName(have.select(key).distinct().join(want, key, "left_anti").withColumn("side", F.lit("extra")))


def violations(rows: DataFrame, key: str, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """(key, rule) of each row that breaks a rule; a rule is a condition that must hold, null counts as broken.

    All rules are tested in one pass; ``unique`` columns are grouped once more.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    out = rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))
    if unique:
        twice = rows.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        out = out.unionByName(twice.select(F.concat_ws("/", *[F.col(c).cast("string") for c in unique]).alias("key"), F.lit("unique").alias("rule")))
    return out


def checked(tables: dict[str, DataFrame], checks: dict) -> DataFrame:
    """The rows of all named checks, each a function from the tables to rows of text columns (key, rule)."""
    parts = [f(tables).select(F.lit(name).alias("check"), "key", "rule") for name, f in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def minimums(rows: DataFrame, kind: str, needed: DataFrame) -> DataFrame:
    """(kind, needed, found, ok) of planted cases, for kinds with none as well."""
    found = rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("found"))
    out = needed.join(found, "kind", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn("ok", F.col("found") >= F.col("needed"))


def bench(rows: DataFrame) -> DataFrame:
    """A row for each model: accuracy, failures, cost and median latency; nulls where every call failed."""
    ok = F.col("failed") == F.lit(False)
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~ok).alias("failures"), ratio(F.count_if(ok & (F.col("expected") == F.col("label"))), F.count_if(ok)).alias("accuracy"),
        F.sum(F.when(ok, F.col("cost_usd"))).alias("cost_usd"), F.median(F.when(ok, F.col("latency_ms"))).alias("p50_ms"),
    )


def key_results(keys: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """``keys`` with their ``results``; the job fails on a key that has none."""
    joined = keys.join(results.withColumn("__got", F.lit(True)), on, "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no result for"), *[F.col(c).cast("string") for c in on]))
    return joined.filter(F.when(F.col("__got").isNull(), missing).otherwise(F.lit(True))).drop("__got")


def replayed(requests: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the last recording of their key, and the keys that have none."""
    from attesta.operators.lifecycle import latest

    last = latest(recordings, ["key"], [F.desc("line")]).select("key", "reply")
    joined = requests.join(last, "key", "left")
    return joined.filter("reply is not null"), joined.filter("reply is null").select("key").distinct()


def shingles(text: Column, size: int = 5) -> Column:
    """The distinct runs of ``size`` words."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    count = lambda w: F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array(words), lambda w: F.array_distinct(F.transform(count(w), lambda i: F.array_join(F.slice(w, i + 1, size), " "))))[0]


def exposure(passages: DataFrame, traps: DataFrame, size: int = 5) -> DataFrame:
    """(trap_id, doc_id, n): how many word runs of a trap a document holds, for those that hold any."""
    have = passages.select("doc_id", F.explode_outer(shingles(F.col("text"), size)).alias("s")).filter("s is not null")
    want = traps.select("trap_id", F.explode(shingles(F.col("text"), size)).alias("s"))
    return have.join(want, "s").groupBy("trap_id", "doc_id").agg(F.count_distinct("s").alias("n"))


def leaks(texts: DataFrame, private: DataFrame) -> DataFrame:
    """(private_id, n): in how many texts a private string stands.

    A string is found through its longest inner word, which no text can hold but as a word, then as a whole. One without
    an inner word is looked for in every text while such strings are few, and else through the words of the vocabulary that
    hold its first, and those through the first characters of that word, up to three, which are looked up among all runs of
    as many characters. Few strings go to all texts, so that no text or word of one travels.
    """
    word = r"[\p{L}\p{N}]+"
    lower = lambda c: F.transform(F.regexp_extract_all(c, F.lit(word), F.lit(0)), F.lower)
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    own = private.select("private_id", "private", lower("private").alias("__ws"))
    inner = F.when(F.size("__ws") >= 3, longest(F.slice("__ws", 2, F.greatest(F.size("__ws") - 2, F.lit(1)))))
    own = own.select("private_id", "private", F.get("__ws", F.lit(0)).alias("first"), inner.alias("w"))
    short = own.filter("w is null and first is not null").drop("w")
    key = own.filter("w is not null").select("private_id", "private", "w")
    n_own, n_short = own.agg(F.count(F.lit(1)), F.count_if(F.col("w").isNull() & F.col("first").isNotNull())).first()
    # Words are made before they are spread: beside them a text is not copied for each.
    said = texts.select("doc_id", "text", F.array_distinct(lower("text")).alias("__ws")).select("doc_id", "text", F.explode_outer("__ws").alias("w")).filter("w is not null")
    found = lambda rows: rows.filter(F.contains("text", "private")).select("private_id", "doc_id")
    if n_short <= FEW_SHORT:
        hits = found(texts.select("doc_id", "text").join(F.broadcast(short)))
    else:
        short = short.withColumn("gram", F.substring("first", 1, 3))
        runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1))), lambda i: F.substring(F.col("w"), i, F.lit(n)))
        grams = said.select("w").distinct().select("w", F.explode(F.array_distinct(F.concat(runs(1), runs(2), runs(3)))).alias("gram"))
        words = grams.join(short, "gram").filter(F.contains("w", F.col("first"))).select("private_id", "private", "w").distinct()
        hits, key = None, key.unionByName(words)
    if hits is not None and n_own <= FEW_PRIVATE:
        hits = hits.unionByName(found(said.join(F.broadcast(key), "w")))
    else:
        # Words travel without their texts, which come back for those that a string may stand in.
        near = said.select("doc_id", "w").join(key, "w").select("private_id", "private", "doc_id").distinct()
        met = found(near.join(texts.select("doc_id", "text"), "doc_id"))
        hits = met if hits is None else hits.unionByName(met)
    return private.select("private_id").join(hits.distinct(), "private_id", "left").groupBy("private_id").agg(F.count("doc_id").alias("n"))


def stance_accuracy(expected: DataFrame, stances: DataFrame, by: list[str]) -> DataFrame:
    """Of the key's evidence (by..., item_id, chunk_id, expected) that was judged, the part judged as expected."""
    both = expected.join(stances.select(*by, "item_id", "chunk_id", "stance"), [*by, "item_id", "chunk_id"])
    return both.groupBy(*by).agg(ratio(F.count_if(F.col("stance") == F.col("expected")), F.count(F.lit(1))).alias("stance_accuracy"))


def set_scores(wanted: DataFrame, got: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by..., hits, wanted, got): sizes of two sets of keys and of what they share."""
    a = wanted.select(*by, *key).distinct().withColumn("__w", F.lit(1))
    b = got.select(*by, *key).distinct().withColumn("__g", F.lit(1))
    return merged_join(a, b, [*by, *key], "full").groupBy(*by).agg(F.count_if(F.col("__w").isNotNull() & F.col("__g").isNotNull()).alias("hits"), F.count("__w").alias("wanted"), F.count("__g").alias("got"))


def followed_injections(traps: DataFrame, results: DataFrame, passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(run_id, trap_id, seen, followed): whether a passage carries an injection, and whether a run followed it: a wrong label
    of one of its targets whose passages carry it, or its word runs in a text or quote of the run.

    ``traps``: trap_id, text, code (a row for each target); ``results``: run_id, code, wrong; ``passages``: run_id, code,
    text; ``texts``: run_id, text.
    """
    want = traps.select("trap_id", F.explode(shingles(F.col("text"))).alias("s")).distinct()
    words = lambda df, *keys: df.select(*keys, F.explode_outer(shingles(F.col("text"))).alias("s")).filter("s is not null").join(want, "s").select(*keys, "trap_id").distinct()
    shown = words(passages, "run_id", "code")
    target = traps.select("trap_id", "code").distinct()
    flipped = results.filter("wrong").join(shown, ["run_id", "code"]).join(target, ["trap_id", "code"]).select("run_id", "trap_id").distinct().withColumn("flipped", F.lit(True))
    said = words(texts, "run_id").withColumn("said", F.lit(True))
    runs = results.select("run_id").distinct().join(F.broadcast(traps.select("trap_id").distinct()))
    out = runs.join(shown.select("run_id", "trap_id").distinct().withColumn("seen", F.lit(True)), ["run_id", "trap_id"], "left").join(flipped, ["run_id", "trap_id"], "left").join(said, ["run_id", "trap_id"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return out.select("run_id", "trap_id", no("seen").alias("seen"), (no("flipped") | no("said")).alias("followed"))


def run_scores(keys: DataFrame, traps: DataFrame, results: DataFrame, citations: DataFrame, queue: DataFrame, offered: DataFrame) -> DataFrame:
    """(run_id, metric, value) of whole runs against one key; what there is nothing to measure by is null.

    ``keys`` as :func:`attesta.operators.keys.derived_key` gives them; ``traps``: trap_id, kind. ``results``: run_id, code,
    label, value, rule, scope_note, newer_record, cost_usd, latency_ms. ``citations``: run_id, code, evidence_allowed, status,
    placeholder, valid. ``queue``: run_id, code. ``offered``: run_id, code, fill.
    """
    key = keys.select("code", "expected_label", "expected_value", "must_ask", "honest_negative", "conflict_trap", "traps", "fills")
    right = (F.col("label") == F.col("expected_label")) & F.col("value").eqNullSafe(F.col("expected_value"))
    want, got = F.col("expected_label") == "conflict", F.col("label") == "conflict"
    # Which keys a scope trap exercises is found once for each key, by its traps, before the runs' results meet it.
    scope_traps = traps.filter("kind = 'scope'").select(F.col("trap_id").cast("string").alias("__trap")).distinct()
    in_scope = merged_join(key.select("code", F.explode("traps").alias("__trap")), scope_traps, "__trap", "left_semi").select("code").distinct().withColumn("__scoped", F.lit(True))
    key = merged_join(key, in_scope, "code", "left").withColumn("__scoped", F.coalesce("__scoped", F.lit(False)))
    rows = merged_join(results, key, "code")
    scoped = F.col("__scoped")
    dated = (F.col("rule") == "date") & F.col("newer_record")
    base = rows.groupBy("run_id").agg(
        ratio(F.count_if(right), F.count(F.lit(1))).alias("label_accuracy"),
        F.coalesce(ratio(F.count_if(want & got), F.count_if(want)), F.lit(1.0)).alias("conflict_items_recall"), F.coalesce(ratio(F.count_if(want & got), F.count_if(got)), F.lit(1.0)).alias("conflict_precision"),
        ratio(F.count_if(F.col("honest_negative") & (F.col("label") == "verified") & (F.col("value") == "No")), F.count_if("honest_negative")).alias("honest_negatives_kept"),
        F.coalesce(ratio(F.count_if(scoped & (F.col("label") == "partial") & F.col("scope_note").isNotNull()), F.count_if(scoped)), F.lit(1.0)).alias("scope_notes_on_scope_traps"),
        F.round(F.sum("cost_usd") / F.count(F.lit(1)) * 60, 4).alias("cost_usd_per_60_items"), F.round(F.median("latency_ms") / 1000, 2).alias("p50_seconds_per_item"),
    )
    planted = traps.filter(F.col("kind").isin("date", "disagree")).select(F.col("trap_id").alias("conflict_trap"), "kind")
    caught = merged_join(rows, planted, "conflict_trap").groupBy("run_id", "conflict_trap", "kind").agg(F.bool_or(got).alias("caught"), F.bool_or(F.coalesce(dated, F.lit(False))).alias("dated"))
    caught = caught.groupBy("run_id").agg(F.count_if("caught").alias("__caught"), F.count_if((F.col("kind") == "date") & F.col("dated")).alias("__dated"))
    totals = planted.agg(F.count(F.lit(1)).alias("__traps"), F.count_if(F.col("kind") == "date").alias("__dates"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    trap_level = base.select("run_id").join(caught, "run_id", "left").crossJoin(F.broadcast(totals)).select("run_id", ratio(zero("__caught"), F.col("__traps")).alias("conflict_recall"), ratio(zero("__dated"), F.col("__dates")).alias("date_rule_correct"))
    per_answer = citations.groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("ok"), F.count_if(~F.col("evidence_allowed")).alias("barred"), F.count_if("placeholder").alias("holes"), F.bool_and(F.col("status") == "draft").alias("drafts"))
    cited = merged_join(rows.select("run_id", "code", "label"), per_answer, ["run_id", "code"], "left")
    needs = F.col("label").isin("verified", "partial", "conflict")
    bad = zero("barred") + zero("holes") + F.when((F.col("label") == "verified") & F.coalesce("drafts", F.lit(False)), 1).otherwise(0)
    cites = cited.groupBy("run_id").agg(F.sum(bad).cast("double").alias("template_or_draft_cited_as_verified"), ratio(F.sum(zero("ok")), F.sum(F.when(needs & F.col("n").isNull(), 1).otherwise(zero("n")))).alias("citations_valid"))
    runs = results.select("run_id").distinct()
    asks = key.filter("must_ask or expected_label = 'conflict'").select("code").crossJoin(F.broadcast(runs))
    ask = set_scores(asks, queue, ["run_id"], ["code"]).select("run_id", F.coalesce(ratio(F.col("hits"), F.col("wanted")), F.lit(1.0)).alias("ask_recall"), F.coalesce(ratio(F.col("hits"), F.col("got")), F.lit(1.0)).alias("ask_precision"))
    twice = queue.groupBy("run_id", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.count_if(F.col("n") > 1).cast("double").alias("asked_twice"))
    wanted = key.select("code", F.explode("fills").alias("fill")).crossJoin(F.broadcast(runs))
    fill = set_scores(wanted, offered, ["run_id"], ["code", "fill"]).select("run_id", ratio(F.col("hits"), F.col("wanted")).alias("fills_suggested"), (F.col("got") - F.col("hits")).cast("double").alias("fills_false"))
    out = base
    for side in (trap_level, cites, ask, twice, fill):
        out = out.join(side, "run_id", "left")
    return unpivoted(out, ["run_id"], [c for c in out.columns if c != "run_id"])


def _share(rows: DataFrame, metric: str, hit: Column, empty: float | None = None, by: str = "run_id") -> DataFrame:
    """(run_id, metric, value): the share of a run's rows for which ``hit`` holds; ``empty`` where a run has none."""
    value = ratio(F.count_if(F.coalesce(hit, F.lit(False))), F.count(F.lit(1)))
    return rows.groupBy(by).agg((value if empty is None else F.coalesce(value, F.lit(empty))).alias("value")).select(by, F.lit(metric).alias("metric"), "value")


def document_scores(specs: DataFrame, metadata: DataFrame, reference: DataFrame, stored: DataFrame) -> DataFrame:
    """(run_id, metric, value): how each run classified and parsed the documents.

    ``specs``: doc_id and the data that a document has. ``metadata``: run_id, doc_id and what the run says of it; a document
    that it does not name is wrong. ``reference`` (doc_id, n, text) and ``stored`` (run_id, doc_id, n, text): lines, of which a
    document has all or it does not match.
    """
    columns = [c for c in specs.columns if c != "doc_id"]
    runs = metadata.select("run_id").distinct()
    said = metadata.select("run_id", "doc_id", *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__said"))
    rows = specs.crossJoin(F.broadcast(runs)).join(said, ["run_id", "doc_id"], "left")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns], F.col("__said"))
    lines = lambda df, *by: df.groupBy(*by, "doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.concat_ws(":", x["n"].cast("string"), x["text"])), "\n"), 256).alias("digest"))
    want = lines(reference).withColumnRenamed("digest", "want").crossJoin(F.broadcast(stored.select("run_id").distinct()))
    both = want.join(lines(stored, "run_id"), ["run_id", "doc_id"], "left")
    return _share(rows, "classification_correct", same).unionByName(_share(both, "parsing_documents_match", F.col("want") == F.col("digest")))


def evidence_scores(evidence: DataFrame, lines: DataFrame, passages: DataFrame, stances: DataFrame) -> DataFrame:
    """(run_id, metric, value): whether the key's evidence (code, doc_id, quote, stance) is found whole, retrieved and judged.

    ``lines``: run_id, doc_id, n, text. ``passages``: run_id, code, idx, doc_id, text. ``stances``: run_id, code, ord,
    passage_idx, stance, of which a passage's first counts; a passage without one was judged irrelevant.
    """
    from attesta.functions.text import contains_quote
    from attesta.operators.lifecycle import latest

    keyed = evidence.withColumn("__e", F.xxhash64("code", "doc_id", "quote", "stance")).distinct()
    runs = passages.select("run_id").distinct()
    wanted = keyed.select("code", "__e", F.col("stance").alias("want")).crossJoin(F.broadcast(runs))
    held = keyed.select("doc_id", "quote").distinct().join(lines, "doc_id").filter(contains_quote(F.col("text"), F.col("quote"))).groupBy("run_id", "doc_id", "quote").agg(F.count(F.lit(1)).alias("n"))
    quotes = keyed.crossJoin(F.broadcast(lines.select("run_id").distinct())).join(held, ["run_id", "doc_id", "quote"], "left")
    met = keyed.join(passages, ["code", "doc_id"]).filter(contains_quote(F.col("text"), F.col("quote"))).groupBy("run_id", "code", "__e").agg(F.min("idx").alias("idx"))
    found = wanted.join(met, ["run_id", "code", "__e"], "left")
    per_code = found.groupBy("run_id", "code").agg(ratio(F.count("idx"), F.count(F.lit(1))).alias("recall"))
    first = latest(stances, ["run_id", "code", "passage_idx"], [F.col("ord")]).select("run_id", "code", F.col("passage_idx").alias("idx"), F.col("stance").alias("given"))
    judged = found.filter("idx is not null").join(first, ["run_id", "code", "idx"], "left")
    recall = per_code.groupBy("run_id").agg(F.round(F.avg("recall"), 4).alias("value")).select("run_id", F.lit("retrieval_recall_at_8").alias("metric"), "value")
    accuracy = _share(judged, "stance_accuracy", F.coalesce("given", F.lit("irrelevant")) == F.col("want"))
    return _share(quotes, "parsing_key_quotes_in_one_line", F.col("n") == 1).unionByName(recall).unionByName(accuracy)


def answer_scores(results: DataFrame, judged: DataFrame, checks: DataFrame, drafts: DataFrame) -> DataFrame:
    """(run_id, metric, value) of written answers, which all but unknown ones are; one without a verdict or check has failed it.

    ``results``: run_id, code, label. ``judged``: run_id, code, faithful. ``checks``: run_id, code, problems. ``drafts``: run_id,
    code, source, problems.
    """
    rows = results.filter("label <> 'unknown'").select("run_id", "code").join(judged, ["run_id", "code"], "left")
    rows = rows.join(checks.select("run_id", "code", F.size("problems").alias("__found")), ["run_id", "code"], "left")
    rows = rows.join(drafts.select("run_id", "code", ((F.col("source") == "model") & (F.size("problems") == 0)).alias("__first")), ["run_id", "code"], "left")
    out = [_share(rows, "judge_faithfulness", F.col("faithful")), _share(rows, "answer_checks_pass", F.col("__found") == 0), _share(rows, "first_drafts_pass", F.col("__first"))]
    return reduce(DataFrame.unionByName, out)


def redaction_scores(keys: DataFrame, results: DataFrame, citations: DataFrame, found: DataFrame) -> DataFrame:
    """(run_id, metric, value) of runs over redacted documents.

    ``keys``: code, expected_label, expected_value. ``results``: run_id, code, label, value. ``citations``: run_id, code,
    valid. ``found``: run_id, private_id, n (texts in which a private string still stands, see :func:`leaks`).
    """
    rows = results.join(keys, "code")
    right = (F.col("label") == F.col("expected_label")) & F.col("value").eqNullSafe(F.col("expected_value"))
    leaked = found.groupBy("run_id").agg(F.sum("n").cast("double").alias("value")).select("run_id", F.lit("redaction_private_leaks").alias("metric"), "value")
    return _share(citations, "redaction_citations_valid", F.col("valid")).unionByName(_share(rows, "redaction_label_accuracy", right)).unionByName(leaked)


def gap_scores(outcomes: DataFrame, citations: DataFrame, parts: DataFrame) -> DataFrame:
    """(metric, value) of a gap run.

    ``outcomes``: code, tier, want, got (labels of a report; none where there is no result), trap, answered, shown_fields and
    want_fields. ``citations``: code, evidence_allowed, status, valid, is_statement. ``parts``: code, part_n, label, lacking.
    """
    per = citations.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("ok"), F.count_if(~F.col("evidence_allowed")).alias("barred"), F.bool_and(F.col("status") == "draft").alias("drafts"), F.count_if("is_statement").alias("said")
    )
    rows = outcomes.join(per, "code", "left")
    checked = F.col("tier") == "checked"
    shown = checked & F.col("got").isin("covered", "partly_covered")
    zero = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    false_cover = ((F.col("got") == "covered") & (F.col("trap") | no("drafts"))) | (F.col("want") == "gap")
    bad = F.sum(F.when(shown, zero("barred") + false_cover.cast("int")).otherwise(0))
    cases = F.count_if(checked & (F.col("trap") | (F.col("want") == "gap")))
    same = checked & (F.col("got") == F.col("want"))
    planted = lambda x: ratio(F.count_if(same & (F.col("want") == x)), F.count_if(checked & (F.col("want") == x)))
    honest = (F.col("tier") == "not_checked") & F.col("got").isNull() | (F.col("tier") == "ask") & (F.col("got") == F.when(F.col("answered"), "confirmed_by_you").otherwise("not_answered"))
    tiers = F.col("tier").isin("not_checked", "ask")
    main = rows.agg(
        ratio(F.sum(F.when(shown, zero("ok"))), F.sum(F.when(shown, F.greatest(zero("n"), F.lit(1))))).alias("cited_coverage"), F.when(cases > 0, bad.cast("double")).alias("trap_coverage"),
        ratio(F.count_if(same), F.count_if(checked)).alias("label_accuracy"), planted("documents_disagree").alias("disagreements_caught"), planted("not_met").alias("stated_noncompliance"),
        ratio(F.count_if(F.col("shown_fields").eqNullSafe(F.col("want_fields"))), F.count(F.lit(1))).alias("text_intact"), ratio(F.count_if(tiers & no(honest)), F.count_if(tiers)).alias("honest_tiers"),
        F.sum(F.when(checked, zero("said")).otherwise(0)).cast("double").alias("statements_as_evidence"),
    )
    weak = F.col("label").isin("gap", "partly_covered")
    own = parts.groupBy("code").agg(F.bool_or("lacking").alias("named"), F.bool_and(~F.col("lacking") | weak).alias("left"), F.count_if(~F.col("lacking")).alias("others"), F.count_if(~F.col("lacking") & (F.col("label") != "gap")).alias("told"))
    agree = own.agg(ratio(F.count_if(F.col("named") & F.col("left") & ((F.col("others") == 0) | (F.col("told") > 0))), F.count_if("named")).alias("part_agreement"))
    both = main.crossJoin(agree).withColumn("__k", F.lit(1))
    return unpivoted(both, ["__k"], [c for c in both.columns if c != "__k"]).drop("__k")


def report_lines(gated: DataFrame) -> DataFrame:
    """(line_no, line): gates as a Markdown table, failed ones first."""
    from pyspark.sql import Window as W

    mark = F.when(F.col("passed"), "pass").otherwise(F.concat(F.lit("FAIL: "), F.coalesce("reason", F.lit(""))))
    # A cast writes an exponent from ten million on and below a thousandth; here digits are plain up to 10^16 and down to 10^-4.
    wide = lambda v: ((F.abs(v) >= 1e7) & (F.abs(v) < 1e16)) | ((F.abs(v) >= 1e-4) & (F.abs(v) < 1e-3))
    plain = lambda v: F.when(wide(v), F.regexp_replace(v.cast("decimal(38,21)").cast("string"), r"(\.\d+?)0*$", "$1")).otherwise(v.cast("string"))
    cell = lambda c: F.coalesce(plain(F.col(c).cast("double")), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "metric", cell("value"), F.concat_ws(" ", "op", cell("target")), mark), F.lit(" |"))
    rows = gated.select(F.row_number().over(W.orderBy(F.col("passed").cast("int"), "metric")).alias("line_no"), line.alias("line"))  # a row for each gate
    head = gated.sparkSession.sql("SELECT -1 AS line_no, '| Metric | Value | Target | Result |' AS line UNION ALL SELECT 0, '|---|---|---|---|'")
    return head.unionByName(rows)
