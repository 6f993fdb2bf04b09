"""Near duplicates: circulant MinHash, banding, exact Jaccard verification, components.

Texts that are the same sequence of words are one node from the start. Within a band bucket
pairs are never all written out: members are compared with one centre first, what is linked
becomes one component, and members of other components are compared exactly in blocks, each
of which gives no more rows than it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, keep, small_batches

#: Words of a shingle, and the least similarity as a fraction of whole numbers.
SHINGLE, NEAR, OF = 5, 75, 100
#: Bands and rows of the signature. A pair at a similarity of 0.75 shares no band with a
#: probability of (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
#: Equal bytes of two sketches (one byte per coordinate) below which a pair is not compared:
#: a pair at 0.75 has 96 of 128 on average, and 70 or fewer with a probability of 1e-7.
LEAST_EQUAL = 70
#: Broadcasts stay below so many rows (about 100 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 200_000
#: About how many members, and shingles of members, a block of a cluster has.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
#: Shingles that so many members of two blocks have are counted by matrix products.
OFTEN = 32

U64 = np.uint64
_POWER, _INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEPS = np.asarray([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers (the finalizer of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of a number and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            for name, factor in (("up", _POWER), ("down", _INVERSE)):
                steps = np.full(size, factor, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


_POWERS = _Powers()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased UTF-8 bytes, in order."""
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, U64)
    up, down = _POWERS.upto(len(b) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((b.astype(U64) + U64(1)) * up[: len(b)], dtype=U64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def shingles(text: str | None) -> tuple[np.ndarray, bytes]:
    """(distinct shingle hashes in order of size, digest of the word sequence).

    A-Z is lower-cased, words end at ASCII white space. A text below ``SHINGLE`` words is one
    shingle, a text without words (or null) has none and an empty digest.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    words = word_hashes(data)
    n = len(words)
    if not n:
        return np.empty(0, U64), b""
    digest = hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest()
    size = min(n, SHINGLE)
    total = np.zeros(n - size + 1, U64)
    for k in range(size):
        total = _mix(total + words[k : n - size + 1 + k] * _STEPS[k])
    return np.unique(total), digest


def signature(found: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` coordinates of circulant MinHash.

    sigma, the first permutation, breaks up the order of the shingles; coordinate k is the
    least value of the second permutation, pi, after sigma's value is shifted by k around
    the circle of 2^32 places.
    """
    k = BANDS * ROWS
    placed = (_mix(found ^ U64(0x243F6A8885A308D3)) >> U64(32)).astype(np.uint32)
    shifts = np.arange(1, k + 1, dtype=np.uint32)[:, None]
    least = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(placed), 1024):
        x = placed[None, at : at + 1024] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(1), out=least)
    return least


def bands(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(BANDS, ROWS).astype(U64)
    key = np.arange(BANDS, dtype=U64) + U64(1)
    for r in range(ROWS):
        key = _mix(key * U64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``id``, ``digest`` (of the words), ``n_shingles``, ``sketch`` (a byte per coordinate)
    and ``bands`` (bucket keys; null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for text in part.column(1):
                    found, digest = shingles(text.as_py())
                    if len(found):
                        s = signature(found)
                        rows.append((digest, len(found), (s & np.uint32(255)).astype(np.uint8).tobytes(), bands(s)))
                    else:
                        rows.append((digest, 0, None, None))
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["id", "digest", "n_shingles", "sketch", "bands"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, digest binary, n_shingles long, sketch binary, bands array<long>")


def sketched(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches and sizes allow a similarity of 0.75."""
    a = nodes.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    b = nodes.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    sized = pairs.join(a, "a").join(b, "b").filter((F.col("na") * OF >= F.col("nb") * NEAR) & (F.col("nb") * OF >= F.col("na") * NEAR))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                batch = batch.filter(pa.array((x == y).sum(1) >= LEAST_EQUAL))
            yield batch.select(["a", "b"])

    kind = dict(pairs.dtypes)["a"]
    return sized.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have intersection * 100 >= union * 75."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep_rows = []
            for b_id, ta, tb in zip(batch.column("b"), batch.column("ta"), batch.column("tb")):
                text = tb.as_py()
                if last[0] != text:  # the rows of a centre follow each other
                    last = (text, shingles(text)[0])
                x, y = shingles(ta.as_py())[0], last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep_rows.append(both * OF >= (len(x) + len(y) - both) * NEAR and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep_rows, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of the links; the label is the smallest id of its component.

    Each round a node takes the least label around it and then the label of that label, so
    the rounds grow with the logarithm of the longest chain. Each round is a written table;
    the driver learns only whether labels have changed. No node and no component is
    gathered: minima are combined before the shuffle.
    """
    both = keep(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    labels = keep(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        moved = labels.join(around, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = keep(moved.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("changed")), "labels")
        labels = new.select("id", "label")
        if new.filter("changed").isEmpty():
            return labels


def _only(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that the pairs need; beyond the broadcast's bound all of them."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    if needed.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return texts
    return texts.join(F.broadcast(needed), "id", "left_semi")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two sets, as a square matrix (its diagonal is not filled in)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    counts = np.zeros((n, n), np.float32)

    often = times >= OFTEN
    place, dense = np.cumsum(often) - 1, often[column]
    for at in range(0, int(often.sum()), 4096):
        here = dense & (place[column] >= at) & (place[column] < at + 4096)
        part = np.zeros((n, 4096), np.float32)
        part[owner[here], place[column[here]] - at] = 1
        counts += part @ part.T

    rare = ~dense & (times[column] > 1)
    order = np.argsort(column[rare], kind="stable")
    c, o = column[rare][order], owner[rare][order]
    for step in range(1, OFTEN - 1):
        same = c[step:] == c[:-step]
        if not same.any():
            break
        found = np.bincount(o[:-step][same] * n + o[step:][same], minlength=n * n).reshape(n, n)
        counts += found + found.T
    return counts


def connections(table: pa.Table) -> pa.Table:
    """Of the members of one or two blocks (id, label, text), rows (a, b) that connect by exact
    links what has different labels: each member with the first one that such links lead to."""
    sets = [shingles(t)[0] for t in table.column("text").to_pylist()]
    sizes = np.asarray([len(s) for s in sets])
    both = shared_counts(sets)
    near = both * OF >= (sizes[:, None] + sizes[None, :] - both) * NEAR
    labels = np.unique(np.asarray(table.column("label").to_pylist()), return_inverse=True)[1]
    near &= (labels[:, None] != labels[None, :]) & (both > 0)
    first = np.arange(len(sets))
    while True:
        lower = np.minimum(first, np.where(near, first[None, :], len(sets)).min(1))
        if (lower == first).all():
            break
        first = lower
    ends = np.flatnonzero(first != np.arange(len(sets)))
    ids = table.column("id").combine_chunks()
    return pa.table({"a": ids.take(pa.array(ends)), "b": ids.take(pa.array(first[ends]))})


def blockwise(clusters: DataFrame, texts: DataFrame) -> DataFrame:
    """The connections (a, b) between members of different labels in each cluster.

    ``clusters`` has (centre, id, label, n_shingles). The members of a cluster's most common
    label need no comparison among themselves. They and the others are dealt by hash to
    blocks of a bounded size, and each block of others meets each block of the cluster in a
    task of its own. A member is thus sent as often as there are blocks to meet.
    """
    kind = dict(clusters.dtypes)["id"]
    by_label = clusters.groupBy("centre", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = by_label.groupBy("centre").agg(F.max_by(F.struct("label", "n", "s"), F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK_ROWS, s / BLOCK_SHINGLES))
    sizes = sizes.select("centre", F.col("most.label").alias("most"), blocks(F.col("most.n"), F.col("most.s")).alias("inner"), blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("outer"))
    dealt = clusters.join(broadcast_if_small(keep(sizes, "cluster_sizes"), BROADCAST_ROWS), "centre")
    inside, end = F.col("label") == F.col("most"), F.col("inner") + F.col("outer") - 1
    dealt = dealt.withColumn("block", F.when(inside, F.pmod(F.xxhash64("id"), F.col("inner"))).otherwise(F.col("inner") + F.pmod(F.xxhash64("id"), F.col("outer"))))
    met = dealt.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("inner")).otherwise(F.lit(0)), end)))
    met = met.select("centre", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "label")
    return met.join(texts, "id").select("centre", "lo", "hi", "id", "label", "text").groupBy("centre", "lo", "hi").applyInArrow(connections, f"a {kind}, b {kind}")


def linked(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that span the components of ``nodes`` (id, n_shingles, sketch, bands).

    First every member of a bucket is compared with the bucket's smallest id, which is the
    same in most of a group's buckets. Where members of a bucket are still in different
    components, all members that have this centre are a cluster, and ``blockwise`` compares
    exactly those in different components. So every pair of a bucket is either compared or
    known to be connected, and the rows written for a group grow with its members and the
    blocks that they meet, not with its pairs.
    """
    members = nodes.select("id", F.explode("bands").alias("bucket")).distinct()
    centres = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).filter("n > 1").select("bucket", "centre")
    placed = keep(members.join(centres, "bucket").select("bucket", "id", "centre"), "buckets")
    ids = keep(placed.select("id").distinct(), "bucket_ids")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = keep(texts.join(broadcast_if_small(ids, BROADCAST_ROWS), "id", "left_semi"), "texts")
    narrow = keep(nodes.select("id", "n_shingles", "sketch").join(ids, "id", "left_semi"), "sketches")

    placed = placed.filter("id != centre")
    pairs = keep(placed.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    likely = keep(sketched(pairs, narrow), "likely")
    links = keep(verified(likely, _only(texts, likely)), "links")

    labels = components(links)
    placed = keep(placed.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    several = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
    clusters = placed.join(several, "bucket", "left_semi").select("centre", "id", "label").distinct()
    clusters = keep(clusters.join(narrow.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), "id"), "clusters")
    return links.unionByName(keep(blockwise(clusters, texts), "connections"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest id that links lead to, the row's own included. Equal
    word sequences are linked by definition and stand for each other. A null or empty text,
    or one without words, has no shingles and is linked with nothing. A row without an id
    takes part as no node: its component is that of its words, or null, and it is kept only
    where that is null. Rows that repeat an id are one document, linked with all that any of
    them is linked with. An empty table gives an empty result. Other columns are not looked
    at.
    """
    rows = keep(signatures(docs, id_col, text_col), "signatures")
    with_words = rows.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = keep(with_words.groupBy("digest").agg(F.min("id").alias("first")), "classes")
    nodes = with_words.join(classes, (with_words["digest"] == classes["digest"]) & (with_words["id"] == classes["first"]), "left_semi")
    nodes = nodes.select("id", "n_shingles", "sketch", "bands").dropDuplicates(["id", "n_shingles", "sketch"])
    links = linked(docs, keep(nodes, "nodes"), id_col, text_col)
    labels = components(links)
    named = classes.join(labels.withColumnRenamed("id", "first"), "first", "left").select("digest", F.coalesce("label", "first").alias("component"))
    found = rows.select("id", "digest", "n_shingles").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op3(docs: DataFrame) -> DataFrame:
    return groups(docs)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, all columns kept: that with the smallest id.

    Rows that share an id stay or go together: they stay if :func:`groups` keeps one of them.
    So do rows without an id, which stay if one of them has words that no other text has or
    none at all. Other cases as in :func:`groups`. The rows that go, mostly the fewer, are
    named by their ids and dropped by a join that moves no text while they are few.
    """
    name = fresh(docs, "_gone")
    gone = groups(docs, id_col, text_col).groupBy(F.col(id_col).alias(name)).agg(F.max("kept").alias("_stays")).filter("NOT _stays").select(name)
    gone = keep(gone, "gone")
    return docs.join(broadcast_if_small(gone, BROADCAST_ROWS), docs[id_col].eqNullSafe(gone[name]), "left_anti")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(len(w), 5) - 1], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE common * 100 >= 75 * (na.n + nb.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
