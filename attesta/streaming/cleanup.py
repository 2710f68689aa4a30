"""Retention by partition: tables laid out by the hour in which their rows expire, and a pass that drops hours that are over.

A row's hour of expiry is a column of its own (``expires``), so a pass touches the folders of expired hours and no other file.
What hangs on an expired row, such as a workspace's documents, is laid out by its parent's hour and goes with it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = "yyyyMMddHH"


def expiry_hour(at: Column) -> Column:
    """The first full hour by which something that expires at ``at`` is over."""
    hour = F.date_trunc("hour", at)
    return F.date_format(F.when(hour < at, hour + F.expr("INTERVAL 1 HOUR")).otherwise(hour), HOUR)


def stored_by_expiry(rows: DataFrame, path: str, expires_at: Column) -> None:
    """Appends ``rows`` to the table at ``path`` with their moment (``expires_at``) and hour (``expires``) of expiry."""
    dated = rows.withColumn("expires_at", expires_at).withColumn("expires", expiry_hour(F.col("expires_at")))
    # One file for each hour and, where an hour holds much, some more: Spark splits what is large.
    dated.hint("rebalance", "expires").write.mode("append").partitionBy("expires").parquet(path)


def stored_with_parent(rows: DataFrame, path: str, key: str, parents: DataFrame) -> None:
    """Appends rows that expire with their parent (key, expires_at); rows without one expire at once, in hour 0."""
    dated = rows.join(parents.select(key, "expires_at"), key, "left").withColumn("expires", F.coalesce(expiry_hour(F.col("expires_at")), F.lit("0000000000")))
    dated.hint("rebalance", "expires").write.mode("append").partitionBy("expires").parquet(path)


def alive(spark: SparkSession, path: str, now: str) -> DataFrame:
    """The rows that have not expired at ``now``, wherever a pass has left off; expired hours are pruned."""
    moment = F.lit(now).cast("timestamp")
    return spark.read.option("basePath", path).parquet(path).filter((F.col("expires") >= F.date_format(moment, HOUR)) & (F.col("expires_at") > moment))


def _folders(spark: SparkSession, path: str, until: str) -> list[str]:
    """The folders of hours up to ``until``; their number does not grow with the rows."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    hours = [n.removeprefix("expires=") for n in names if n.startswith("expires=")]
    return [f"{path}/expires={h}" for h in sorted(hours) if h <= until]


def expired_counts(spark: SparkSession, paths: dict[str, str], until: str) -> DataFrame:
    """(table, deleted): the rows in hours up to ``until``."""
    kind = "table string, deleted long"
    found = {name: _folders(spark, path, until) for name, path in paths.items()}
    counts = [spark.read.option("basePath", paths[n]).parquet(*f).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(n).alias("table"), "deleted") if f else spark.createDataFrame([(n, 0)], kind) for n, f in found.items()]
    return reduce(DataFrame.unionByName, counts)


def drop_expired(spark: SparkSession, paths: dict[str, str], until: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths.values():
        for folder in _folders(spark, path, until):
            at = hadoop(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cleanup_pass(paths: dict[str, str], target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over ticks (at): drops what has expired by the newest tick and writes the counts.

    Counts are written before anything is dropped. A batch that is repeated finds its counts there and only drops again.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        until = batch.agg(F.date_format(F.max("at"), HOUR)).first()[0]
        if until is None:
            return
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={n}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            expired_counts(spark, paths, until).write.mode("overwrite").parquet(f"{target}/batch={n}")
        drop_expired(spark, paths, until)

    return write
