"""Re-opening outcomes as changes come in, at the cost of what changed.

Two tables are kept, each in buckets by a hash: which parts hold a passage (by passage), and what each part was judged on and
would be judged on today (by outcome). A batch of changes looks its passages up in the first, updates the parts that it finds
in the second, and judges their outcomes alone. Only buckets that the batch touches are read and written.

A batch first writes what it will change, with its verdicts, to a folder of its own, and then puts it in place. A batch that is
repeated after a crash finds that folder and only puts it in place again, so no change is lost or counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.rounds import reopened

BUCKETS = 64


def _bucket(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("bucket")


def _done(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def start(path: str, outcomes: DataFrame, stored: DataFrame, deployed: DataFrame, prompt: str, model: str, buckets: int = BUCKETS) -> None:
    """Lays the tables out under ``path`` from stored parts, and gives the first verdicts, for which evidence is unchanged.

    ``outcomes``, ``stored``, ``deployed``: as :func:`attesta.operators.rounds.reopened` takes them.
    """
    spark = stored.sparkSession
    stored.select("*", F.col("chunk_ids").alias("now"), _bucket("outcome_id", buckets)).write.partitionBy("bucket").parquet(f"{path}/parts")
    held = stored.select(F.explode("chunk_ids").alias("chunk_id"), "outcome_id", "part_n").distinct()
    held.select("*", F.lit(True).alias("live"), _bucket("chunk_id", buckets)).write.partitionBy("bucket").parquet(f"{path}/holders")
    for name, df in (("outcomes", outcomes), ("deployed", deployed)):
        df.select("*", _bucket("outcome_id", buckets)).write.partitionBy("bucket").parquet(f"{path}/{name}")
    first = reopened(outcomes, stored, stored.select("outcome_id", "part_n", F.explode("chunk_ids").alias("chunk_id")), deployed, prompt, model)
    first.write.parquet(f"{path}/verdicts/batch=-1")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")


def _pruned(spark: SparkSession, path: str, table: str, buckets: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}").filter(F.col("bucket").isin(buckets))


def _touched(rows: DataFrame) -> list[int]:
    """The buckets of some rows, at most as many as there are."""
    return [r["bucket"] for r in rows.select("bucket").distinct().collect()]


def reopening_pass(path: str, prompt: str, model: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over changes (chunk_id, outcome_id, part_n, gone).

    A passage that is gone concerns all parts that hold it, and its outcome and part are not looked at; else retrieval finds
    the passage for the named part now. Within a batch what is gone is gone, whatever finds it.
    """

    def stage(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
        changes = batch.withColumn("bucket", _bucket("chunk_id", buckets)).persist()
        held = _pruned(spark, path, "holders", _touched(changes))
        gone = changes.filter("gone").select("chunk_id").distinct()
        found = changes.filter("not gone").select("chunk_id", "outcome_id", "part_n", "bucket").distinct().join(gone, "chunk_id", "left_anti")
        lost = held.filter("live").join(gone, "chunk_id").select("chunk_id", "outcome_id", "part_n", "bucket")
        moved = found.withColumn("live", F.lit(True)).unionByName(lost.withColumn("live", F.lit(False))).persist()
        out = f"{path}/staged/batch={n}"
        rest = held.join(moved.select("chunk_id", "outcome_id", "part_n"), ["chunk_id", "outcome_id", "part_n"], "left_anti")
        rest.unionByName(moved).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/holders")

        per_part = moved.groupBy("outcome_id", "part_n").agg(F.collect_set(F.when(F.col("live"), F.col("chunk_id"))).alias("__in"), F.collect_set(F.when(~F.col("live"), F.col("chunk_id"))).alias("__out"))
        at = _touched(moved.select(_bucket("outcome_id", buckets)))
        parts = _pruned(spark, path, "parts", at).join(per_part, ["outcome_id", "part_n"], "left")
        now = F.array_union(F.array_except("now", "__out"), "__in")
        parts = parts.withColumn("now", F.when(F.col("__in").isNotNull(), now).otherwise(F.col("now"))).drop("__in", "__out")
        parts.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/parts")

        own = moved.select("outcome_id").distinct()
        of = lambda df: df.join(own, "outcome_id", "left_semi").drop("bucket")
        parts = of(spark.read.parquet(f"{out}/parts"))
        said = reopened(of(_pruned(spark, path, "outcomes", at)), parts.drop("now"), parts.select("outcome_id", "part_n", F.explode("now").alias("chunk_id")), of(_pruned(spark, path, "deployed", at)), prompt, model)
        verdicts = own.join(said, "outcome_id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
        verdicts.write.mode("overwrite").parquet(f"{out}/verdicts")
        spark.range(1).write.mode("overwrite").parquet(f"{out}/complete")
        changes.unpersist()
        moved.unpersist()

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        if not _done(spark, f"{path}/staged/batch={n}/complete"):
            stage(batch, n)
        for table in ("holders", "parts"):
            rows = spark.read.parquet(f"{path}/staged/batch={n}/{table}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{table}")
        spark.read.parquet(f"{path}/staged/batch={n}/verdicts").write.mode("overwrite").parquet(f"{path}/verdicts/batch={n}")

    return write


def open_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(outcome_id, reasons): each outcome's last verdict, if it is to be judged again."""
    rows = spark.read.option("basePath", f"{path}/verdicts").parquet(f"{path}/verdicts/batch=*")
    last = rows.groupBy("outcome_id").agg(F.max_by("reasons", "batch").alias("reasons"))
    return last.filter(F.size("reasons") > 0)
