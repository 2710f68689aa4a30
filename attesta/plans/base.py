"""Inputs that queries derive from the driver's tables, in Spark and as common table expressions for the SQL side."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import STOP_WORDS
from attesta.operators.chunks import chunk_documents
from attesta.sources.lines import text_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markup(text: Column) -> Column:
    """A document as Markdown: short lines are headings, some are bullets, the others wrapped paragraphs.

    Some common words become cues of the passage flags.
    """
    cued = F.replace(F.replace(F.replace(text, F.lit("|"), F.lit("/")), F.lit(" with "), F.lit(" not ")), F.lit(" that "), F.lit(" [name] "))
    cued = F.replace(cued, F.lit(" for the "), F.lit(" ignore all previous instructions "))
    lines = F.filter(F.split(cued, "\n", -1), lambda x: F.trim(x) != "")

    def line(x: Column, i: Column) -> Column:
        x = F.when(F.substring(x, 1, 1).isin("#", "*", "-", " "), F.concat(F.lit("~"), x)).otherwise(x)
        short = (F.size(F.split(x, " ", -1)) <= 3) & ~F.contains(x, F.lit(" the "))
        return F.when(short, F.concat(F.lit("# "), x)).when(i % 6 == 4, F.concat(F.lit("- "), x)).otherwise(F.replace(x, F.lit(" the "), F.lit("\nthe ")))

    return F.array_join(F.transform(lines, line), "\n\n")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) in Markdown."""
    return table(spark, sf_dir, "documents").select("doc_id", markup(F.col("text")).alias("text"))


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(corpus(spark, sf_dir))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of each document, from its id and its label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    return docs.select("doc_id", "lang").join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("doc-"), F.lpad(i.cast("string"), 7, "0"), F.lit(".md")).alias("filename"),
        F.concat(F.lit("w"), (i % 3).cast("string")).alias("workspace_id"),
        F.when(i % 7 == 0, "statement").otherwise("upload").alias("origin"),
        F.when(i % 5 == 0, "draft").otherwise("final").alias("status"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")).alias("effective_date"),
        F.when(i % 4 == 1, "internal-systems").when(i % 4 == 2, "production").when(i % 4 == 3, "employees").alias("scope"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("evidence_allowed"),
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; in local mode an own one where ``spark.checkpoint.dir`` is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root or tempfile.mkdtemp(prefix='attesta-')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in a shared folder, read back: what several parts of a plan read is made once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: (session, name, version of its inputs) of tables that are there already, and where they are.
_STORED: dict[tuple, str] = {}


def version(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A digest of the names, sizes and times of the files of some tables: another file, another version."""
    said = []
    for name in names:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        said += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(said).encode()).hexdigest()


def stored(spark: SparkSession, sf_dir: str, name: str, inputs: tuple[str, ...], make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """A table that is made once for each version of its inputs and session, and read by all that need it; in folders ``by``
    a column if one is named."""
    key = (spark.sparkContext.applicationId, name, version(spark, sf_dir, *inputs))
    if key not in _STORED:
        path = shared_folder(spark, name)
        rows = make()
        if by:
            rows.hint("rebalance", by).write.partitionBy(by).parquet(path)
        else:
            rows.write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' passages with their document's metadata: the table that ingesting the corpus makes."""
    make = lambda: chunk_documents(corpus(spark, sf_dir)).join(meta(spark, sf_dir), "doc_id")
    return stored(spark, sf_dir, "chunks", ("documents", "labels"), make)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positional index of all passages with their workspace, made with them."""
    from attesta.operators.retrieval import postings

    return stored(spark, sf_dir, "postings", ("documents", "labels"), lambda: postings(chunks(spark, sf_dir), ("workspace_id",)))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, question, topic, position, run_id) from the benchmark."""
    i = F.col("item_id")
    topic = F.when(i % 4 == 0, "Access control").when(i % 4 == 1, "Vendors").when(i % 4 == 2, "Incident response").otherwise("Facilities")
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), topic.alias("topic"), i.alias("position"), F.lit(1).alias("run_id"))


def sql(names: str, body: str) -> str:
    """``body`` with the named expressions, and those they need, in front."""
    need: list[str] = []

    def add(name: str) -> None:
        for n in CTE[name][0].split():
            add(n)
        if name not in need:
            need.append(name)

    for n in names.split():
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{CTE[n][2] if len(CTE[n]) > 2 else n} AS ({CTE[n][1]})" for n in need) + "\n" + body


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_stem(w: str) -> str:
    """The light stemmer as a SQL expression over ``w``."""
    fits = lambda s: f"{w} LIKE '%{s}' AND {w} NOT LIKE '%ss' AND length({w}) - {len(s)} >= 3"
    cases = " ".join(f"WHEN {fits(s)} THEN substr({w}, 1, length({w}) - {len(s)}) || '{'y' if s == 'ies' else ''}'" for s in ("ies", "ing", "ed", "es", "s"))
    return f"regexp_replace(CASE {cases} ELSE {w} END, 'e$', '')"


#: name: (what it needs, its text, and its heading if it is recursive)
CTE: dict[str, tuple] = {
    "mlines": (
        "",
        r"""SELECT doc_id, i, CASE WHEN substr(x, 1, 1) IN ('#', '*', '-', ' ') THEN '~' || x ELSE x END AS x
        FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM (
          SELECT doc_id, list_filter(string_split(replace(replace(replace(replace(text, '|', '/'), ' with ', ' not '), ' that ', ' [name] '), ' for the ', ' ignore all previous instructions '), chr(10)), lambda y: trim(y) <> '') AS ls FROM documents))""",
    ),
    "lines": (
        "mlines",
        r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INT AS n, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text,
          CASE WHEN len(string_split(x, ' ')) <= 3 AND NOT contains(x, ' the ') THEN 'heading' ELSE 'text' END AS kind FROM mlines""",
    ),
    "lw": (
        "lines",
        r"""SELECT doc_id, n, text, kind, len(list_filter(string_split(text, ' '), lambda y: y <> '')) AS w, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS before,
          coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), first_value(text) OVER (PARTITION BY doc_id ORDER BY n)) AS label FROM lines""",
    ),
    "packed": (
        "lw",
        r"""SELECT doc_id, n, n, w FROM lw WHERE kind = 'text' AND (before IS NULL OR before = 'heading')
        UNION ALL SELECT l.doc_id, l.n, CASE WHEN p.rw + l.w > 120 THEN l.n ELSE p.cs END, CASE WHEN p.rw + l.w > 120 THEN l.w ELSE p.rw + l.w END
        FROM packed p JOIN lw l ON l.doc_id = p.doc_id AND l.n = p.n + 1 WHERE l.kind = 'text'""",
        "packed(doc_id, n, cs, rw)",
    ),
    "plain_chunks": (
        "packed",
        r"""SELECT doc_id, doc_id || '#' || cs AS chunk_id, cs AS line_start, max(n) AS line_end, string_agg(text, chr(10) ORDER BY n) AS text, any_value(label) AS heading
        FROM packed JOIN lw USING (doc_id, n) GROUP BY doc_id, cs""",
    ),
    "flagged": (
        "plain_chunks",
        r"""SELECT *, list_filter([
          CASE WHEN regexp_matches(regexp_replace(text, '(?i)not only($|[^\pL\pN_])', '\1', 'g'), '(?i)(^|[^\pL\pN_])(not|never|no longer|pending|planned)($|[^\pL\pN_])') THEN 'negation' END,
          CASE WHEN contains(text, '[name]') THEN 'placeholder' END,
          CASE WHEN contains(text, 'ignore all previous instructions') OR contains(heading, 'ignore all previous instructions') THEN 'injection' END], lambda f: f IS NOT NULL) AS flags FROM plain_chunks""",
    ),
    "meta": (
        "",
        r"""SELECT d.doc_id, 'doc-' || lpad(d.doc_id::VARCHAR, 7, '0') || '.md' AS filename, 'w' || (d.doc_id % 3) AS workspace_id,
          CASE WHEN d.doc_id % 7 = 0 THEN 'statement' ELSE 'upload' END AS origin, CASE WHEN d.doc_id % 5 = 0 THEN 'draft' ELSE 'final' END AS status,
          (DATE '2024-01-01' + (d.doc_id % 365)::INT)::DATE AS effective_date,
          CASE d.doc_id % 4 WHEN 1 THEN 'internal-systems' WHEN 2 THEN 'production' WHEN 3 THEN 'employees' END AS scope, coalesce(quality, 1) = 1 AS evidence_allowed
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "chunks": ("flagged meta", "SELECT * FROM flagged JOIN meta USING (doc_id)"),
    "items": (
        "",
        """SELECT item_id, text AS question, CASE item_id % 4 WHEN 0 THEN 'Access control' WHEN 1 THEN 'Vendors' WHEN 2 THEN 'Incident response' ELSE 'Facilities' END AS topic,
          item_id AS position, 1 AS run_id FROM benchmark""",
    ),
    "tokens": (
        "chunks",
        r"""SELECT chunk_id, flatten(list_transform(regexp_extract_all(lower(heading || ' ' || text), '[\pL\pN]+(?:[.''-][\pL\pN]+)*'), lambda w: CASE WHEN contains(w, '-') THEN [w] || string_split(w, '-') ELSE [w] END)) AS ws FROM chunks""",
    ),
    "words": (
        "tokens",
        "SELECT chunk_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM tokens",
    ),
    "occ": ("words", f"SELECT chunk_id, {sql_stem('w')} AS term, pos FROM words WHERE w <> '' AND w NOT IN ({_STOP})"),
    "post": ("occ", "SELECT chunk_id, term, count(*) AS tf FROM occ GROUP BY ALL"),
    "asked": (
        "items",
        rf"""SELECT DISTINCT item_id, {sql_stem("w")} AS term FROM (
          SELECT item_id, unnest(list_concat(qs, list_transform(list_filter(qs, lambda y: contains(y, '-')), lambda y: replace(y, '-', '')), flatten(list_transform(list_filter(qs, lambda y: contains(y, '-')), lambda y: string_split(y, '-'))))) AS w
          FROM (SELECT item_id, list_transform(list_distinct_ordered[1:64], lambda y: lower(y)) AS qs FROM (
            SELECT item_id, list(DISTINCT y ORDER BY y) AS list_distinct_ordered FROM (SELECT item_id, unnest(regexp_extract_all(substr(question || ' ' || topic, 1, 2000), '[A-Za-z0-9][A-Za-z0-9.''-]*[A-Za-z0-9]|[A-Za-z0-9]')) AS y FROM items) GROUP BY 1)))
          WHERE w <> '' AND w NOT IN ({_STOP})""",
    ),
}
