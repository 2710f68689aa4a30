"""Structured Streaming forms of the operators: windows with watermarks, sessions, exactly-once sinks, ingest.

Every function takes and returns a streaming (or batch) DataFrame; the ``run_`` functions start a query that takes what is
there and stops. A sink that is fed by ``foreachBatch`` is a folder with one sub-folder for each batch, so a batch that is
repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.chunks import chunk_documents
from attesta.operators.redaction import redact_lines
from attesta.sources.lines import text_lines

WATERMARK = "10 minutes"


def call_counters(events: DataFrame, unit: str, keys: list[str], cap: Column | int, late: str | None = WATERMARK) -> DataFrame:
    """(keys..., window_start, n, over): calls in each tumbling window; calls later than the watermark are dropped.

    Without a watermark (``late`` is None) all calls count and all windows are remembered, as a bounded table needs it.
    """
    known = events.withWatermark("ts", late) if late else events
    rows = known.groupBy(F.window("ts", unit).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(*keys, F.col("w.start").alias("window_start"), "n", (F.col("n") > cap).alias("over"))


def idle_runs(events: DataFrame, key: str, gap: str = "10 minutes", late: str = WATERMARK) -> DataFrame:
    """(key, start, end, n): runs that have paused for ``gap``; in append mode each is told once, when it is over."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str | None = WATERMARK) -> DataFrame:
    """Events without repeated deliveries; the watermark bounds what is remembered, and without one (None) all keys are."""
    if late is None:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_progress(events: DataFrame) -> DataFrame:
    """(run_id, done, total, finished) of items (run_id, state) as they change."""
    rows = events.groupBy("run_id").agg(F.count_if(F.col("state") == "done").alias("done"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("finished", F.col("done") == F.col("total"))


def ingest_chunks(docs: DataFrame) -> DataFrame:
    """New documents to passages, stateless."""
    return chunk_documents(docs)


def ingest_lines(docs: DataFrame) -> DataFrame:
    """New documents to redacted lines, stateless."""
    return redact_lines(text_lines(docs))


def ingest_batch(docs: DataFrame, path: str, n: int, people: DataFrame | None = None) -> None:
    """One batch of documents (doc_id, format, text): redacted lines, classification and passages, each in a folder of the
    batch's own."""
    from attesta.operators.chunks import chunk_lines
    from attesta.operators.classification import HEAD, classify

    lines = redact_lines(text_lines(docs), people)
    lines.write.mode("overwrite").parquet(f"{path}/lines/batch={n}")
    lines = docs.sparkSession.read.schema(lines.schema).parquet(f"{path}/lines/batch={n}")
    head = lines.filter(F.col("n") <= HEAD).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("head"))
    classify(docs.select("doc_id", "format").join(head, "doc_id")).write.mode("overwrite").parquet(f"{path}/documents/batch={n}")
    chunk_lines(lines).write.mode("overwrite").parquet(f"{path}/chunks/batch={n}")


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Takes what is there, writes each batch to its own sub-folder of ``path``, and returns when all is done."""

    def write(batch: DataFrame, n: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def folder_stream(spark: SparkSession, glob: str, like: DataFrame, per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files that a pattern names, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_batch).parquet(glob)


def redecide_pass(tables: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]], target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that decides again what a batch of changed documents (doc_id) concerns.

    ``tables`` gives answers, stances and passages as they are now; the changed answers go to the batch's own folder.
    """
    from attesta.operators.rounds import redecide

    def write(batch: DataFrame, n: int) -> None:
        answers, stances, chunks = tables(batch.sparkSession)
        redecide(answers, stances, chunks, batch.select("doc_id").distinct()).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return write


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Takes what is there, batch by batch, and returns when all is done."""
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def append_answers(existing: str, keys: list[str], order: list[Column]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends the answers whose keys are not in the table at ``existing`` yet.

    The table has a folder for each batch (earlier rows under batch=-1), so a batch that is repeated replaces its own rows.
    """
    from attesta.operators.lifecycle import append_once

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = spark.read.option("basePath", existing).parquet(f"{existing}/batch=*")
        old = rows.filter(F.col("batch") != n).drop("batch")
        append_once(batch, old, keys, order).select(*old.columns).write.mode("overwrite").parquet(f"{existing}/batch={n}")

    return write


def retention_pass(table: str, target: str, at: str, now: Column, hours: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that rewrites ``table`` without its old rows to ``target``, whatever the batch holds."""
    from attesta.operators.limits import retained

    def write(batch: DataFrame, n: int) -> None:
        retained(batch.sparkSession.read.parquet(table), at, now, hours).write.mode("overwrite").parquet(f"{target}/pass={n}")

    return write
