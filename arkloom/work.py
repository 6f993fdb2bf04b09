"""The shared work folder, written cuts, checked broadcasts and small batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a table of names or keys is broadcast (about 200 bytes each).
BROADCAST_ROWS = 200_000
#: Bytes of an Arrow batch that goes to a Python worker, where the session has Spark's default.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without a slash at its end.

    It is read from ``spark.checkpoint.dir``. Only a local master may go without that
    setting (tests); on a cluster a missing setting is an error, as a machine's own
    temporary folder would be invisible to the other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts the lineage: what follows survives lost executors without computing ``df``
    again, and several readers don't compute it twice.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, once its session sends whole texts to Python workers in batches of ``BATCH_BYTES``.

    Spark's default of 64 MB a batch is held by the JVM and by each worker several times over.
    A session that has another setting keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key) in ("67108864b", "67108864", "64m"):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; else Spark shuffles as it sees fit.

    ``df`` is counted up to that bound, so it should be a written table.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def asked_of(table: DataFrame, rows: DataFrame, on: list[str], name: str) -> DataFrame:
    """The rows of a large ``table`` whose ``on`` is among those of ``rows``. While these are few the
    table is gone through where it lies, and nothing of it moves but what is asked for."""
    return table.join(broadcast_if_small(keep(rows.select(*on).distinct(), name)), on, "left_semi")


def ranked(rows: DataFrame, keys: list[str], order: list[str], out: str = "_rank") -> DataFrame:
    """``rows`` with their 1-based place among those with equal ``keys`` (which are not null), by
    ``order``; rows equal in all of it get neighbouring places in any order.

    Rows are dealt by ranges of keys and order and written, so that a key that very many rows
    have is counted in several parts; the parts' sizes are added.
    """
    dealt = keep(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    placed = dealt.withColumn("_here", F.row_number().over(inside)).join(offsets, [*keys, "_part"])
    return placed.withColumn(out, F.col("_before") + F.col("_here")).drop("_part", "_here", "_before")
