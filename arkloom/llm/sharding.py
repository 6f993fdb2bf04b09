"""Proportional stratified interleaving of documents into shards of equal row counts.

Only DataFrame functions: no Python code runs on the executors.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, text_or_empty
from .ranks import positions

#: Buckets per source and of the whole order. A bucket is the unit that one task sorts:
#: 17 billion rows of one source are 4 million rows a bucket.
BUCKETS = 4096
#: Groups of equal texts above this share of a shard are placed by the driver, so at most so
#: many for each shard.
LARGE = 8


def _steps(place: Column, ends: list[int]) -> Column:
    """How many of the ascending ``ends`` are at or before the place."""
    return F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= place))


def _placed(groups: list[tuple[bytes, int]], rooms: list[int]) -> list[tuple[bytes, int | None]]:
    """Each group whole in the shard with most room, the largest first; None where none has the
    room. ``rooms`` is lowered."""
    out: list[tuple[bytes, int | None]] = []
    for digest, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        s = max(range(len(rooms)), key=lambda i: (rooms[i], -i))
        if fits := n <= rooms[s]:
            rooms[s] -= n
        out.append((digest, s if fits else None))
    return out


def interleave(docs: DataFrame, shards: int = 24, seed: int = 20240, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deal ``docs`` into ``shards`` so that every shard has the corpus's mixture of sources and
    equal texts lie together.

    1. Each source is shuffled: its rows stand in the order of md5(seed, id).
    2. A row at 0-based position r of the n rows of its source gets the fraction
       (r + 1/2) / n; any stretch of the order of fractions holds the sources in proportion.
    3. Groups of equal texts are dealt whole, at the fraction of their first row. Those above
       1 / ``LARGE`` of a shard are placed by size (a bounded list); all others stand in the
       order of fractions, which is cut in proportion to the room that the shards have. The
       last group of a cut may exceed the room: then another shard takes it.
    4. All other rows stand in the order of fractions, which is cut into what each shard still
       lacks. Row counts differ by one at most; within a shard rows stand by fraction.

    Returns one row per input row: the id column, the source column, ``size`` (UTF-8 bytes of
    the text and 8), ``text_crc32`` (of the UTF-8 bytes, unsigned), ``fraction``, ``shard``
    and ``slot`` (0-based place in the shard, without gaps).

    A group that no shard has the room for, as one larger than a shard, is dealt like single
    rows and lies in several shards. A null text has size 8 and checksum 0 and equals an empty
    one. Null sources are a source of their own; rows with a null id are shuffled by text and
    size. Repeated rows are rows like any other and take places of their own; equal ids are
    ordered by checksum and size, and rows equal in all of these are interchangeable. Fewer
    rows than shards leave shards empty; an empty table gives an empty result. Other columns
    of ``docs`` are not looked at, whatever their names.
    """
    spark, text = docs.sparkSession, text_or_empty(text_col)
    digest, size = F.unhex(F.sha2(text, 256)), (F.octet_length(text) + F.lit(8)).cast("long")
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.hex(digest)))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        digest.alias("digest"),
        F.md5(F.concat(F.lit(f"{seed}:"), named)).alias("shuffled"),
    ).withColumn("part", F.conv(F.substring("shuffled", 1, 3), 16, 10).cast("int"))
    in_source = positions(rows, ["source"], "part", ["shuffled", "id", "text_crc32", "size"], "r", "n")
    bucket = lambda fraction: F.least(F.floor(fraction * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    fractions = in_source.withColumn("fraction", (F.col("r") + F.lit(0.5)) / F.col("n")).withColumn("part", bucket(F.col("fraction"))).drop("r", "n")
    fractions = keep(fractions, "fractions")

    total = fractions.count()
    rooms = [total // shards + (s < total % shards) for s in range(shards)]
    groups = keep(fractions.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("fraction").alias("first")).filter("n > 1"), "text_groups")
    large = F.col("n") > total // (shards * LARGE)
    direct = _placed([(bytes(r["digest"]), r["n"]) for r in groups.filter(large).select("digest", "n").collect()], rooms)  # shards * LARGE at most

    small = positions(groups.filter(~large).withColumn("part", bucket(F.col("first"))), [], "part", ["first", "digest"], "start", "all", weight="n")
    small = small.withColumn("cuts", F.array(*[F.lit(c).cast("decimal(38,0)") for c in list(accumulate(rooms))[:-1]]))
    # Of a shard's quota, its share of the room: room before * all // room of all, as whole numbers.
    cut = F.transform("cuts", lambda c: F.floor(c * F.col("all") / F.lit(max(sum(rooms), 1))).cast("long"))
    small = keep(small.withColumn("shard", F.size(F.filter(cut, lambda c: c <= F.col("start")))).select("digest", "n", "start", "shard"), "small_groups")
    last = F.max_by(F.struct("digest", "n"), "start").alias("last")
    over = []
    for r in small.groupBy("shard").agg(F.sum("n").alias("n"), last).collect():  # a row for each shard
        if r["n"] > rooms[r["shard"]]:
            over.append((bytes(r["last"]["digest"]), r["last"]["n"]))
        rooms[r["shard"]] -= r["n"] - (r["last"]["n"] if r["n"] > rooms[r["shard"]] else 0)
    direct += _placed(over, rooms)

    listed = F.array(*[F.struct(F.lit(bytearray(d)).alias("digest"), F.lit(s).cast("int").alias("shard")) for d, s in direct]).cast("array<struct<digest:binary,shard:int>>")
    named = F.broadcast(spark.range(1).select(F.explode(listed).alias("g")).select("g.*"))
    rest = fractions.join(named, "digest", "left_anti").join(small.select("digest", "shard"), "digest", "left")
    dealt = keep(fractions.join(named, "digest").unionByName(rest), "dealt")
    order = ["fraction", "shuffled", "id", "source", "text_crc32", "size"]
    loose = positions(dealt.filter("shard IS NULL"), [], "part", order, "place")
    loose = loose.withColumn("shard", _steps(F.col("place"), list(accumulate(rooms)))).drop("place")
    whole = keep(dealt.filter("shard IS NOT NULL").unionByName(loose), "sharded")
    slots = positions(whole, ["shard"], "part", order, "slot")
    return slots.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "text_crc32", "fraction", "shard", F.col("slot").cast("long"))


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns: the law is ``rows`` (row counts at most one apart)."""
    return interleave(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
