"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arkloom.work import broadcast_if_small, keep, shared_dir, work_dir

__all__ = ["broadcast_if_small", "fresh", "keep", "shared_dir", "small_batches", "text_or_empty", "work_dir"]

#: Bytes of an Arrow batch that goes to a Python worker, where the session has Spark's default.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, once its session sends whole texts to Python workers in batches of ``BATCH_BYTES``.

    Spark's default of 64 MB a batch is held by the JVM and by each worker several times over.
    A session that has another setting keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) in ("67108864b", "67108864", "64m"):
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores at its end until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
