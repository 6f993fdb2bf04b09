"""Exact duplicates by skew-safe combining: locally, in salted digest groups, globally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, keep, text_or_empty

#: A digest is hot from this share of all rows on, so at most 1,000 digests are hot, and from
#: so many rows.
HOT_SHARE, HOT_ROWS = 1000, 1000
#: Ways to split a hot digest.
SALTS = 16
#: Rows that go are broadcast up to this number (about 100 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 200_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def groups_of_equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, cold groups, hot groups) of ``docs``.

    ``rows`` has ``id``, ``digest`` and ``hot`` for every input row. The groups have
    ``digest``, ``content`` (the text, but null where the digest has one text), ``keep_id``
    (largest id of the rows with that text) and ``n`` (their number).

    Each aggregate groups by the digest and by the whole text, so texts are compared in
    full at every stage: (1) in each task, before the shuffle; (2) in salted groups of the
    digest, with ``SALTS`` salts for hot digests and one for all others, whose groups are
    whole then; (3) over the salts of the hot digests, which get a few rows each. Only (1)
    to (2) moves texts.
    """
    narrow = docs.select(F.col(id_col).alias("id"), digest(text_or_empty(text_col)).alias("digest"))
    rows = keep(narrow, "digests")
    counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    least = F.expr(f"greatest(sum(n) div {HOT_SHARE}, {hot_rows})")
    limit = counts.agg(least.alias("least")).first()["least"] or 0
    hot = keep(counts.filter(F.col("n") > F.lit(limit)).select("digest"), "hot_digests")  # under HOT_SHARE rows by its definition
    flagged = hot.withColumn("hot", F.lit(True))
    is_hot = F.coalesce(F.col("hot"), F.lit(False))

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("content")).withColumn("digest", digest(F.col("content")))
    texts = texts.join(F.broadcast(flagged), "digest", "left").withColumn("hot", is_hot)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salted = texts.groupBy("digest", "content", "hot", salt.alias("salt")).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # The text of a cold group has done its work once its group is whole; a second text of the
    # same digest would show as a second row of the digest.
    winners = keep(salted.select("digest", "hot", "keep_id", "n", F.when(F.col("hot"), F.col("content")).alias("content")), "salt_winners")
    cold = winners.filter(~F.col("hot")).select("digest", F.lit(None).cast("string").alias("content"), "keep_id", "n")
    warm = winners.filter("hot").groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    tagged = rows.join(F.broadcast(flagged), "digest", "left").withColumn("hot", is_hot)
    return tagged, cold, warm


def collided(cold: DataFrame, warm: DataFrame) -> bool:
    """Whether some digest stands for several texts."""
    both = cold.select("digest").unionByName(warm.select("digest"))
    return not both.groupBy("digest").count().filter("count > 1").isEmpty()


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``digest``, ``keep_id``, ``group_size``, ``kept``.

    Of the rows with the same text, the largest id stays. A null text is the empty text.
    Rows with a null id belong to their group but stay only where no id is known
    (``keep_id`` is null then). Rows that repeat an id and its text are all marked as
    staying; :func:`distinct_documents` returns one of them. Two texts with one digest are
    told apart: then rows are matched on the text too. An empty table gives no rows; other
    columns are not looked at.
    """
    rows, cold, warm = groups_of_equal_texts(docs, id_col, text_col, digest, hot_rows)
    if collided(cold, warm):
        return _verdicts_by_text(docs, id_col, text_col, digest)
    cold, warm = (g.select("digest", "keep_id", F.col("n").alias("group_size")) for g in (cold, warm))
    out = rows.filter(~F.col("hot")).join(cold, "digest").unionByName(rows.filter("hot").join(F.broadcast(warm), "digest"))
    return out.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def _verdicts_by_text(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """The same where digests collide: groups and rows meet on the digest and the text."""
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("content")).withColumn("digest", digest(F.col("content")))
    salted = texts.groupBy("digest", "content", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return texts.join(groups, ["digest", "content"]).select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns kept: the row with the largest id.

    Cases as in :func:`verdicts`; of rows that repeat both id and text, one stays. Who goes is
    settled on ids and digests alone, so beyond the comparison of texts only rows that repeat
    an id and text, and those of a text that has them, are shuffled whole; so is the table
    where the rows that go are too many to broadcast.
    """
    found = keep(verdicts(docs, id_col, text_col), "verdicts")
    own, mark = fresh(docs, "_id"), fresh(docs, "_digest")
    named = lambda rows: rows.select(F.col("id").alias(own), F.col("digest").alias(mark)).distinct()
    digest = sha256(text_or_empty(text_col))

    def join(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        return rows.join(broadcast_if_small(others, BROADCAST_ROWS), (digest == others[mark]) & rows[id_col].eqNullSafe(others[own]), how)

    kept = join(docs, keep(named(found.filter("NOT kept")), "going"), "left_anti")
    repeated = keep(named(found.filter("kept").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), "repeated")
    if repeated.isEmpty():
        return kept
    one = F.row_number().over(Window.partitionBy(mark, id_col).orderBy(F.lit(1)))
    place = fresh(docs, "_place")
    several = join(kept, repeated, "left_semi").withColumn(mark, digest).withColumn(place, one).filter(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return join(kept, repeated, "left_anti").unionByName(several)


def op6(docs: DataFrame) -> DataFrame:
    return verdicts(docs).select(F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
