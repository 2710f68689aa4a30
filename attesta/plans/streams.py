"""Streams over the event table, run to their end, against the same windows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.plans.base import shared_folder, table
from attesta.streaming import jobs, state


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return shared_folder(spark, "stream")


def _events(spark: SparkSession, sf_dir: str, per_batch: int = 1000) -> DataFrame:
    like = table(spark, sf_dir, "events")
    rows = jobs.folder_stream(spark, f"{sf_dir}/events*.parquet", like, per_batch)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_counters(spark: SparkSession, sf_dir: str, per_batch: int = 1000) -> DataFrame:
    """Calls per kind and hour; each batch tells the counts that changed, the largest is the last.

    The table is bounded and its files are in no order of time, so no call is too late.
    """
    out = _folder(spark)
    jobs.run_to_folder(jobs.call_counters(_events(spark, sf_dir, per_batch), "1 hour", ["event_type"], 4, late=None), f"{out}/rows", f"{out}/state", "update")
    rows = spark.read.parquet(f"{out}/rows").groupBy("event_type", "window_start").agg(F.max("n").alias("n"), F.max("over").alias("over"))
    return rows.select("event_type", F.col("window_start").cast("string").alias("window_start"), "n", "over")


def stream_once(spark: SparkSession, sf_dir: str, per_batch: int = 1000) -> DataFrame:
    """Every event is delivered twice and counted once, however its table is cut into files."""
    out = _folder(spark)
    rows = _events(spark, sf_dir, per_batch).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    jobs.run_to_folder(jobs.once(rows, ["event_id"], late=None), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark)
    items = _events(spark, sf_dir).select((F.col("user_id") % 20).alias("run_id"), F.when((F.col("user_id") % 20 < 3) | (F.col("value") > 5), "done").otherwise("pending").alias("state"))
    jobs.run_to_folder(jobs.run_progress(items), f"{out}/rows", f"{out}/state", "complete")
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).select("run_id", "done", "total", "finished")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to passages as a stream; passages per document."""
    from attesta.plans.base import markup

    out = _folder(spark)
    docs = jobs.folder_stream(spark, f"{sf_dir}/documents*.parquet", table(spark, sf_dir, "documents")).select("doc_id", markup(F.col("text")).alias("text"))
    jobs.run_to_folder(jobs.ingest_chunks(docs), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("line_end").alias("last_line"))


#: A bounded table is in no order of time, so none of its windows is ever closed.
WHOLE = "36500 days"


def stream_admission(spark: SparkSession, sf_dir: str, per_batch: int = 1000, late: str = WHOLE) -> DataFrame:
    """Calls admitted as they come, each behind those before it."""
    from attesta.plans.work import CAPS, calls_of

    state.use_state_store(spark)
    out = shared_folder(spark, "stream")
    jobs.run_to_folder(state.stream_admitted(calls_of(_events(spark, sf_dir, per_batch)), CAPS, late), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("event_id", F.coalesce("refused_by", F.lit("admitted")).alias("verdict"))


def stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' calls as claims, of which every third is the end of one; what the others become after four hours each."""
    state.use_state_store(spark)
    out = shared_folder(spark, "stream")
    event = F.when(F.col("event_id") % 3 == 0, "done").otherwise("claimed")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("item_id"), "ts", "event_id", event.alias("event"))
    jobs.run_to_folder(state.stream_claims(rows, minutes=240), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("item_id", F.col("at").cast("string").alias("at"), "state", F.col("attempts").cast("long").alias("attempts"))


def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to redacted lines, classes and passages as a stream; what each document then has."""
    from attesta.plans.base import markup

    out = shared_folder(spark, "stream")
    docs = jobs.folder_stream(spark, f"{sf_dir}/documents*.parquet", table(spark, sf_dir, "documents")).select("doc_id", F.lit("md").alias("format"), markup(F.col("text")).alias("text"))
    jobs.run_batches(docs, lambda batch, n: jobs.ingest_batch(batch, f"{out}/rows", n), f"{out}/state")
    lines = spark.read.parquet(f"{out}/rows/lines").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    chunks = spark.read.parquet(f"{out}/rows/chunks").groupBy("doc_id").agg(F.max("line_end").cast("long").alias("last_line"))
    return spark.read.parquet(f"{out}/rows/documents").select("doc_id", "status").join(lines, "doc_id").join(chunks, "doc_id", "left").select("doc_id", "status", "lines", "last_line")


def stream_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses of an hour between a user's calls, told once the watermark has passed them: of all users but the last calls."""
    out = shared_folder(spark, "stream")
    rows = jobs.idle_runs(_events(spark, sf_dir).select("ts", F.col("user_id").alias("network")), "network", "60 minutes", "0 minutes")
    jobs.run_to_folder(rows, f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("network", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "n")


_CLAIMS = """WITH RECURSIVE e AS (
  SELECT user_id AS item_id, epoch_us(ts) // 1000 AS t, event_id % 3 <> 0 AS claim, row_number() OVER w AS i, coalesce(epoch_us(lead(ts) OVER w), (SELECT max(epoch_us(ts)) FROM events)) // 1000 AS until
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
run AS (
  SELECT item_id, i, t, until, CASE WHEN claim THEN 1 ELSE 0 END AS attempts FROM e WHERE i = 1
  UNION ALL
  SELECT e.item_id, e.i, e.t, e.until, CASE WHEN NOT e.claim THEN 0 ELSE 1 + CASE WHEN r.attempts > 0 AND r.attempts + (r.until - r.t) // 14400000 > 3 AND r.until - r.t >= 14400000 THEN 0
      WHEN r.attempts > 0 THEN r.attempts + (r.until - r.t) // 14400000 ELSE 0 END END
  FROM run r JOIN e ON e.item_id = r.item_id AND e.i = r.i + 1),
told AS (SELECT *, unnest(range(1, least((until - t) // 14400000, greatest(4 - attempts, 1)) + 1)) AS j FROM run WHERE attempts > 0)
SELECT item_id, strftime(make_timestamp_ms(t + j * 14400000), '%Y-%m-%d %H:%M:%S') || CASE WHEN (t + j * 14400000) % 1000 > 0 THEN '.' || rtrim(lpad(((t + j * 14400000) % 1000)::VARCHAR, 3, '0'), '0') ELSE '' END AS at,
  CASE WHEN attempts + j - 1 >= 3 THEN 'failed' ELSE 'pending' END AS state, attempts + j - 1 AS attempts FROM told"""


def queries() -> dict:
    return {"t2_stream_admission": stream_admission, "t4_stream_claims": stream_claims, "t3_stream_idle": stream_idle, "t5_stream_documents": stream_documents, "t1_stream_counters": stream_counters, "t7_stream_once": stream_once, "t9_stream_progress": stream_progress, "t5_stream_ingest": stream_ingest}


def oracle_sql() -> dict[str, str]:
    from attesta.plans.base import sql

    from attesta.plans import work

    idle = work.oracle_sql()["t3_idle_runs"]
    assert idle.count("FROM s GROUP BY network, k") == 1
    return {
        "t4_stream_claims": _CLAIMS,
        "t2_stream_admission": work.oracle_sql()["w12_admission"],
        "t3_stream_idle": idle.replace("FROM s GROUP BY network, k", "FROM s GROUP BY network, k HAVING max(ts) + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events)"),
        "t5_stream_documents": sql("flagged", """, l AS (SELECT doc_id, count(*) AS lines FROM lines GROUP BY 1), c AS (SELECT doc_id, max(line_end)::BIGINT AS last_line FROM flagged GROUP BY 1)
            SELECT doc_id, 'final' AS status, lines, last_line FROM l LEFT JOIN c USING (doc_id)"""),
        "t1_stream_counters": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, count(*) > 4 AS over FROM events GROUP BY 1, 2",
        "t7_stream_once": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
        "t9_stream_progress": "SELECT user_id % 20 AS run_id, count(*) FILTER (user_id % 20 < 3 OR value > 5) AS done, count(*) AS total, count(*) FILTER (user_id % 20 < 3 OR value > 5) = count(*) AS finished FROM events GROUP BY 1",
        "t5_stream_ingest": sql("plain_chunks", "SELECT doc_id, count(*) AS chunks, max(line_end) AS last_line FROM plain_chunks GROUP BY 1"),
    }
