"""Small helpers that all operators of this package use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, in local mode alone, an own one where it is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = path or tempfile.mkdtemp(prefix="attesta-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it survives lost executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that :func:`written` made and that no later step reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it (Spark compares without case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that stand for a row: its id (null has a place of its own) and a hash of its text.

    Rows with the same id and the same text share a key, and so every verdict.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("__id"),
        F.xxhash64(F.col(doc_id).isNull(), F.col(text)).alias("__text"),
    ]


def matching_rows(docs: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
    """``docs`` with all its columns, less those rows that a "left_semi" or "left_anti" join with the row keys of ``keyed``
    (__id, __text) drops. Helper names give way to columns that ``docs`` has."""
    own = [fresh(docs.columns, x) for x in ("__row_id", "__row_text")]
    other = [fresh([*docs.columns, *own], x) for x in ("__key_id", "__key_text")]
    keys = keyed.select(F.col("__id").alias(other[0]), F.col("__text").alias(other[1])).distinct()
    rows = docs.withColumns(dict(zip(own, row_key(), strict=True)))
    return rows.join(keys, (F.col(own[0]) == F.col(other[0])) & (F.col(own[1]) == F.col(other[1])), how).select(*docs.columns)


#: At most so many keys of a table are split; their list is broadcast.
MOST_HOT = 100_000


def hot_limit(total: int, least: int) -> int:
    """The count of rows above which a key is split. No more than ``MOST_HOT`` keys of ``total`` rows are above it."""
    return max(least, -(-total // MOST_HOT))


def sample_rows(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """At most ``n`` of the rows, those with the smallest hash of ``key``; the same ones each time.

    Rows with larger hashes are left out before the sort, so that only about twice as many reach its one task.
    """
    total = rows.count()
    spread = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    some = rows.filter(spread < int((1 << 40) * 2 * n / total)) if total > 2 * n else rows
    return some.orderBy(spread, *key).limit(n)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 within its group in the given order (nulls first), and ``size``, the group's rows.

    Rows are dealt to ranges of group and order, so that a large group meets many tasks, and numbered within their range; what
    a group has in earlier ranges is added. Only groups that reach over a border of two ranges need that, so the list that is
    broadcast has at most two rows for each range. ``order`` should tell all rows apart: equal ones share a range. ``rows``
    is read twice.
    """
    spark = rows.sparkSession
    ranged = written(rows.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    held = ranged.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__held"))
    of_group = W.partitionBy(*group)
    spans = held.select(
        *[F.col(g).alias(f"__of_{g}") for g in group], F.col("__range").alias("__in"), "__held",
        (F.sum("__held").over(of_group.orderBy("__range")) - F.col("__held")).alias("__before"), F.sum("__held").over(of_group).alias("__all"),
    ).filter(F.col("__held") < F.col("__all")).drop("__held")
    here = W.partitionBy("__range", *group)
    dealt = ranged.repartitionById(int(spark.conf.get("spark.sql.shuffle.partitions")), "__range")
    placed = dealt.withColumns({"__n": F.row_number().over(here.orderBy(*order)) - 1, "__held": F.count(F.lit(1)).over(here)})
    same = F.col("__range") == F.col("__in")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    out = placed.join(F.broadcast(spans), same, "left")
    return out.select(*rows.columns, (F.col("__n") + F.coalesce("__before", F.lit(0))).cast("long").alias("pos"), F.coalesce("__all", "__held").alias("size"))
