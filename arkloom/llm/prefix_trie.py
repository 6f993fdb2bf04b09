"""The trie of shared beginnings of conversations, in flat tables of nodes behind a minimal
perfect hash.

Conversations are dealt to shards by their hundred, which holds whatever they begin with. In a
shard the distinct digests of all prefixes are enumerated and each gets a slot of its own; all
that is known of a node lies in numpy arrays under its slot, and sums run from children to
parents in the order of depth. What shards say of one node is added up by its digest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Conversations of one hundred begin with turns of its first one, at most MOST_SHARED - 1.
HUNDRED, MOST_SHARED = 100, 6
#: Turns of a shard, about; ids of conversations that are joined to one piece of text.
SHARD_TURNS, AT_ONCE = 50_000, 50_000
#: Places of a level of the hash for each key that it is to place.
ROOM = 2
#: Levels after which keys are not to be told apart; each level leaves less than half of them.
MOST_LEVELS = 100

Digests = tuple[np.ndarray, np.ndarray]  # two lanes of 64 bits


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (shifts and odd factors, modulo 2^64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slots:
    """A minimal perfect hash of distinct digests: numbers 0 to n - 1, one each.

    A level has ``ROOM`` places a key; keys that are alone in theirs are placed and numbered
    by the place's rank, all others go on to the next level. No key is stored.
    """

    def __init__(self, keys: Digests):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        first, second = keys
        placed = 0
        while len(first):
            if len(self.levels) == MOST_LEVELS:
                raise ValueError("digests that no level tells apart, as if two prefixes had one digest")
            at = self._places(first, second, len(self.levels), ROOM * len(first))
            alone = np.bincount(at, minlength=ROOM * len(first)) == 1
            self.levels.append((alone, placed + np.cumsum(alone) - 1))
            placed += int(alone.sum())
            first, second = first[~alone[at]], second[~alone[at]]

    @staticmethod
    def _places(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mixed(first + np.uint64(level)) ^ _mixed(second - np.uint64(level))) % np.uint64(size)

    def of(self, keys: Digests) -> np.ndarray:
        """The slots of keys that are among the distinct ones."""
        out, left = np.full(len(keys[0]), -1), np.arange(len(keys[0]))
        for level, (alone, ranks) in enumerate(self.levels):
            at = self._places(keys[0][left], keys[1][left], level, len(alone))
            out[left[alone[at]]] = ranks[at[alone[at]]]
            left = left[~alone[at]]
        return out


def _upwards(values: np.ndarray, parent: np.ndarray, depth: np.ndarray, how: np.ufunc) -> np.ndarray:
    """``values`` by slot, each combined into its parent's, the deepest nodes first."""
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
    for d in range(len(cuts) - 1, 0, -1):
        at = order[cuts[d - 1] : cuts[d]]
        how.at(values, parent[at], values[at])
    return values


def _rebuilt(conv: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted conversations that have ``sizes`` turns from ``starts`` on: how many turns each has
    when rebuilt, and these turns' places in order."""
    shared = np.fromiter((zlib.crc32(str(c).encode()) % MOST_SHARED for c in conv.tolist()), np.int64, len(conv))
    base = conv - np.fmod(conv, HUNDRED)
    at = np.minimum(np.searchsorted(conv, base), len(conv) - 1)
    borrowed = np.where(conv[at] == base, np.minimum(shared, sizes[at]), 0)
    n = borrowed + np.maximum(sizes - shared, 0)
    whose = np.repeat(np.arange(len(conv)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    own = starts[whose] + shared[whose] + k - borrowed[whose]
    return n, np.where(k < borrowed[whose], starts[at][whose] + k, own)


LOCAL = "kind int, shard long, slot long, parent_slot long, d1 long, d2 long, p1 long, p2 long, depth long, chars long, n_convs long, conv_id long"


def _local_trie(table: pa.Table) -> pa.Table:
    """The nodes of a shard's rebuilt conversations (kind 0), and where each ends (kind 1)."""
    col = lambda c: table.column(c).combine_chunks()
    shard = col("shard")[0].as_py()
    turn = col("turn")
    digests = np.frombuffer(b"".join(col("digest").to_pylist()), "<u8").reshape(-1, 2)
    order = np.lexsort((digests[:, 1], digests[:, 0], np.asarray(turn.fill_null(0)), np.asarray(turn.is_valid()), np.asarray(col("conv_id"))))
    digests, chars = digests[order], np.asarray(col("chars"))[order]
    conv, starts, sizes = np.unique(np.asarray(col("conv_id"))[order], return_index=True, return_counts=True)
    n, source = _rebuilt(conv, sizes, starts)
    ends = np.cumsum(n)
    depth = np.arange(len(source)) - np.repeat(ends - n, n) + 1

    # A prefix's digest is the sum of its turns' digests, each scrambled with its place.
    lanes, parents = [], []
    for k, step in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
        own = _mixed(digests[source, k] + depth.astype(np.uint64) * np.uint64(step))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
        before = np.repeat(total[ends - n], n)
        lanes.append(total[1:] - before)
        parents.append(total[:-1] - before)
    root = np.zeros(1, np.uint64)
    every = tuple(np.concatenate([root, x]) for x in lanes)
    above = tuple(np.concatenate([root, x]) for x in parents)
    depth, source = np.concatenate([[0], depth]), np.concatenate([[-1], source])

    sort = np.lexsort(every[::-1])
    first = sort[np.concatenate([[True], np.any([x[sort][1:] != x[sort][:-1] for x in every], 0)])]
    slots = Slots(tuple(x[first] for x in every))
    slot = slots.of(every)
    node = np.empty(len(first), np.int64)  # an occurrence of each node
    node[slot[first]] = first
    here = node[slot]
    same = [x[here] == x for x in (*every, *above, depth)] + [np.all(digests[source[here[1:]]] == digests[source[1:]], 1)]
    if (slot < 0).any() or len(np.unique(slot[first])) < len(first) or not all(x.all() for x in same):
        raise ValueError("two prefixes have one digest or slot")
    parent = slots.of(tuple(x[node] for x in above))

    end = slot[np.where(n > 0, ends, 0)]  # rows are one later, behind the root's
    counts, least = np.bincount(end, minlength=len(node)), np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, end, conv)
    counts = _upwards(counts, parent, depth[node], np.add)
    least = _upwards(least, parent, depth[node], np.minimum)
    text = np.where(depth[node] > 0, chars[source[node]], 0)
    same_for_all = lambda value, n: np.full(n, value, np.int64)
    nodes = [same_for_all(0, len(node)), same_for_all(shard, len(node)), np.arange(len(node)), parent, *(x[node].view(np.int64) for x in (*every, *above)), depth[node], text, counts, least]
    stops = [same_for_all(1, len(conv)), same_for_all(shard, len(conv)), end, end, *(x[node[end]].view(np.int64) for x in every), *[same_for_all(0, len(conv))] * 5, conv]
    fields = [f.split() for f in LOCAL.split(", ")]
    kinds = {"int": np.int32, "long": np.int64}
    return pa.table({name: pa.array(np.concatenate([a, b]).astype(kinds[kind])) for (name, kind), a, b in zip(fields, nodes, stops)})


SUMS = "d1 long, d2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _summed(table: pa.Table) -> pa.Table:
    """What a shard's own nodes add to theirs and their ancestors' subtrees, and all that is known
    of its own ones (null for others). A node is the own one of its smallest member's shard."""
    slot = np.asarray(table.column("slot"))
    rows = table.take(pa.array(np.argsort(slot)))
    col = {c: np.asarray(rows.column(c)) for c in ("parent_slot", "depth", "conv_id", "n_convs", "chars", "n_children", "own")}
    own = col["own"].astype(bool)
    leaves = _upwards((own & (col["n_children"] == 0)).astype(np.int64), col["parent_slot"], col["depth"], np.add)
    saved = _upwards(np.where(own, (col["n_convs"] - 1) * col["chars"], 0), col["parent_slot"], col["depth"], np.add)
    known = {"depth": col["depth"], "conv_id": col["conv_id"], "parent_conv_id": col["conv_id"][col["parent_slot"]], "n_convs": col["n_convs"], "n_children": col["n_children"]}
    masked = {c: pa.array(v, mask=~own | ((col["depth"] == 0) if c == "parent_conv_id" else False)) for c, v in known.items()}
    return pa.table({"d1": rows.column("d1"), "d2": rows.column("d2"), **masked, "n_leaves": leaves, "saved_tokens": saved})


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (d1, d2, conv_id) in order: the ids of one node joined, some at a time."""
    node, ids = None, []
    done = lambda: pa.RecordBatch.from_pydict({"d1": [node[0]], "d2": [node[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})
    for batch in batches:
        for d1, d2, c in zip(*(x.to_pylist() for x in batch.columns)):
            if node != (d1, d2) or len(ids) >= AT_ONCE:
                if ids:
                    yield done()
                node, ids = (d1, d2), []
            ids.append(c)
    if ids:
        yield done()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces (d1, d2, first, ids) in order: the SHA-256 of each node's pieces."""
    node, state = None, None
    done = lambda: pa.RecordBatch.from_pydict({"d1": [node[0]], "d2": [node[1]], "ends_sha256": [state.hexdigest()]})
    for batch in batches:
        for d1, d2, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
            if node != (d1, d2):
                if node:
                    yield done()
                node, state = (d1, d2), sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node:
        yield done()


def _ends(stops: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of nodes where conversations end. Ids are sorted and joined in ranges,
    so that of a very common end one task only strings a few long pieces together; a digest
    of one text can't be shared out."""
    order = ["d1", "d2", "conv_id"]
    joined = stops.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, "d1 long, d2 long, first long, ids string")
    return joined.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(_digests, "d1 long, d2 long, ends_sha256 string")


def _one(name: str) -> Column:
    """The value that all shards have of a node; digests of different prefixes would differ in it."""
    return F.when(F.min(name) == F.max(name), F.min(name)).otherwise(F.raise_error(F.lit("two prefixes have one digest")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: the contract's columns.

    A conversation's turns are ordered by ``turn``, null first, equal ones by the MD5 of their role
    and text; a null role or text is an empty one. Rows without a conv_id belong to no
    conversation. Repeated rows are turns of their own. Only digests and lengths leave the
    scan, never texts. A shard holds whole hundreds of conversations, some 100 bytes a turn;
    a conversation of very many turns is held as such numbers in one task. An empty table gives
    an empty result; other columns are not looked at.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    n_shards = max(1, -(-conversations.count() // SHARD_TURNS))
    shard = F.pmod(F.xxhash64(F.col("conv_id") - F.col("conv_id") % HUNDRED), F.lit(n_shards))
    local = keep(turns.withColumn("shard", shard).groupBy("shard").applyInArrow(_local_trie, LOCAL), "local_tries")

    key, nodes = ["d1", "d2"], local.filter("kind = 0")
    merged = keep(nodes.groupBy(*key).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[_one(c).alias(c) for c in ("p1", "p2", "depth", "chars")]), "nodes")
    children = merged.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    known = merged.drop("p1", "p2", "depth").join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    placed = nodes.select(*key, "shard", "slot", "parent_slot", "depth").join(known, key).withColumn("own", (shard == F.col("shard")).cast("int"))
    sums = placed.groupBy("shard").applyInArrow(_summed, SUMS)
    facts = [F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")]
    total = sums.groupBy(*key).agg(*facts, F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    out = total.join(_ends(local.filter("kind = 1")), key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"))


def op12(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations)


#: The checksum of an id's digits, bit by bit, as no function gives it.
_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda s, b: list_reduce(list_prepend(xor(s, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda a, z: xor(a >> 1, 3988292384 * (a & 1))))"""

SQL = f"""WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, n, xor({_CRC}, 4294967295) % {MOST_SHARED} AS h, c - c % {HUNDRED} AS base FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
g AS (SELECT k.*, least(h, coalesce(b.m, 0)) AS m FROM k LEFT JOIN (SELECT c AS base, n AS m FROM k) b USING (base)),
r AS (SELECT g.c, i + 1 AS depth, role, text FROM g JOIN t ON t.c = g.base AND i < m
  UNION ALL SELECT g.c, i - h + m + 1, role, text FROM g JOIN t ON t.c = g.c AND i >= h),
p AS (SELECT c, depth, length(text) AS chars, md5(CAST(list(md5(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY depth) AS VARCHAR)) AS d FROM r
  UNION ALL SELECT c, 0, 0, '' FROM g),
q AS (SELECT *, lag(d) OVER (PARTITION BY c ORDER BY depth) AS pd, max(depth) OVER (PARTITION BY c) = depth AS ends FROM p),
n AS (SELECT d, min(c) AS conv_id, any_value(depth) AS depth, any_value(pd) AS pd, any_value(chars) AS chars, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY d),
f AS (SELECT n.*, coalesce(x.n_children, 0) AS n_children FROM n LEFT JOIN (SELECT pd AS d, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY pd) x USING (d)),
s AS (SELECT q.d, sum(CAST(f.n_children = 0 AS BIGINT)) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens FROM f JOIN q ON q.c = f.conv_id AND q.depth <= f.depth GROUP BY q.d)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (d) LEFT JOIN n up ON up.d = f.pd AND f.depth > 0"""
