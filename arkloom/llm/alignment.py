"""Alignment of the tokens of two tokenizers by pointer jumping.

Both tokenizers cover the same bytes, so their tokens are two chains of intervals. A token
points to the farthest-right token that it overlaps; doubling these pointers leads each to the
last token of its component, whose end both chains share.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, keep, small_batches

#: The texts that a worker aligns at a time.
AT_ONCE = 100
# The second tokenizer's mark for a space, its form of a byte that has no piece, and
# the pattern by which the first one cuts texts.
SPACE, BYTE = "▁", re.compile(r"<0x([0-9A-Fa-f]{2})>\Z")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pair of ids is one number: the first id times this, and the second one.
PAIR = 1 << 32


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of two chains over the same bytes the terminal token of its component, as
    the places of second-chain tokens. Tokens have at least one byte.

    Among tokens that end alike, the second chain's is the farther one, so each component has
    one terminal. Pointers are doubled until none changes: as often as the logarithm of the
    longest component.
    """
    n, starts_a, starts_b = len(ends_a), np.roll(ends_a, 1), np.roll(ends_b, 1)
    starts_a[:1] = starts_b[:1] = 0
    last_b = np.searchsorted(starts_b, ends_a) - 1  # the last token that begins before the end
    last_a = np.searchsorted(starts_a, ends_b) - 1
    to = np.concatenate([
        np.where(ends_b[last_b] >= ends_a, n + last_b, np.arange(n)),
        np.where(ends_a[last_a] > ends_b, last_a, n + np.arange(len(ends_b))),
    ])
    while not np.array_equal(further := to[to], to):
        to = further
    return to[:n] - n, to[n:] - n


class Aligner:
    """Aligns texts, some at a time."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        tokenizer.encode_special_tokens = True
        # How the first tokenizer spells bytes: printable ones as they are, the others in order after U+0100.
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in shown]
        spelled = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        assert set(spelled) == set(pre_tokenizers.ByteLevel.alphabet())
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(map(spelled.__getitem__, t)): i for t, i in tokenizer.get_vocab().items() if t not in special}
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.bytes_a[i] = data
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE.match(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        # A vocabulary whose ids are the order of its merges is encoded some four times faster by its ranks.
        fast = Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        whole = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
        sample = " It's   what\n\nthey'll DO, 12345 caf\u00e9s \u4e2d\u6587 <|endoftext|> \U0001f600!? \t"
        self.by_ranks = fast(sample) == whole(sample)
        self.encode_a = fast if self.by_ranks else whole
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64) for x in (self.bytes_a, self.bytes_b))
        # Of each id of either tokenizer its text before another one of its group, and as its last one.
        self.shown = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"] + [f"{i}{mark}" for i in range(len(pieces)) for mark in ",;"]

    def _tokens(self, text: str | None) -> tuple[list[int], list[int]] | None:
        if not text:
            return None
        a, b, data = self.encode_a(" " + text), self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return None
        # Tokens by ranks are stretches of the text's own bytes.
        return (a, b) if self.by_ranks or b"".join(map(self.bytes_a.__getitem__, a)) == data else None

    def aligned(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of texts the numbers of tokens by both tokenizers and of links, the links' pairs of ids
        text by text, and the groups as text.

        The chains of all texts are one behind the other: a text's end is a common one.
        """
        tokens = [self._tokens(x) or ((), ()) for x in texts]
        n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(t[k] for t in tokens), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        of_a, of_b = terminals(np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b]))
        ends = of_b == np.arange(len(b))
        last = np.flatnonzero(ends)  # the terminal of each group, in order
        group_b = np.cumsum(ends) - ends
        group_a = group_b[of_a]
        through_a = np.searchsorted(group_a, np.arange(len(last)), "right")  # first-chain tokens up to each group's end
        before_b = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
        mark = np.zeros(len(a), np.int64)
        mark[through_a - 1] = 1
        merged = np.empty(len(a) + len(b), np.int64)
        merged[np.arange(len(a)) + before_b[group_a]] = 2 * a + mark
        merged[np.arange(len(b)) + through_a[group_b]] = 2 * (len(self.bytes_a) + b) + ends
        until = np.cumsum(n_a + n_b).tolist()
        shown = list(map(self.shown.__getitem__, merged.tolist()))
        groups = ["".join(shown[x:y])[:-1] for x, y in zip([0, *until], until)]
        n_links = np.diff(np.searchsorted(last, np.concatenate([[0], np.cumsum(n_b)])))
        return n_a, n_b, n_links, a[through_a - 1] * PAIR + b[last], groups


def _distinct(pairs: np.ndarray, n_links: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Each text's distinct pairs in order, and how often it has each."""
    text = np.repeat(np.arange(len(n_links)), n_links)
    order = np.lexsort((pairs, text))
    pairs, text = pairs[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])]) if len(pairs) else np.empty(0, bool))
    offsets = pa.array(np.searchsorted(text[first], np.arange(len(n_links) + 1)).astype(np.int32))
    times = np.diff(np.append(first, len(pairs)))
    return pa.ListArray.from_arrays(offsets, pa.array(pairs[first])), pa.ListArray.from_arrays(offsets, pa.array(times))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    """One for each worker process."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Each text's tokens by both tokenizers in groups, the smallest stretches that both cut out.

    Returns a row for each row of ``docs``: ``row`` (a number of its own), ``id``, ``n_a``, ``n_b``,
    ``n_groups``, ``groups_sha256``, the distinct ``pairs`` of ids whose tokens end together and
    how many ``times`` each does so, and, if wanted, ``groups`` as text. Groups end where links
    do, so there are as many of one as of the other.

    A null or empty text and one whose bytes the tokens don't give back has no tokens: zeros,
    no pairs, '' as digest and groups. Texts are taken whole, null and repeated ids each as a
    row of their own; other columns are not looked at. An empty table gives an empty one.
    """

    names = ["row", "id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times", *(["groups"] if with_groups else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = _aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for cut in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(cut, AT_ONCE)
                n_a, n_b, n_links, pairs, groups = aligner.aligned(part.column(1).to_pylist())
                digests = [sha256(x.encode()).hexdigest() if x else "" for x in groups]
                columns = [np.arange(row, row + part.num_rows), part.column(0), n_a, n_b, n_links, digests, *_distinct(pairs, n_links), *([groups] if with_groups else [])]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.string() if isinstance(x, list) else pa.int64()) for x in columns], names=names)

    schema = f"row long, id {dict(docs.dtypes)[id_col]}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * with_groups
    return small_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the whole corpus hold a pair, and whether none with its
    second id is held by more. Counts are combined before the shuffle; there is a row for each
    pair that occurs, whatever the number of texts."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    counts = keep(each.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n")), "pair_counts")
    second = F.col("pair").bitwiseAND(F.lit(PAIR - 1))
    most = counts.groupBy(second.alias("_b")).agg(F.max("n").alias("_most"))
    return counts.join(most, second == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def scored(aligned: DataFrame) -> DataFrame:
    """``aligned`` (a written table of :func:`align`) with ``n_best`` and ``count_sum`` of its links.

    The counts are broadcast while they are few enough, else joined by pairs: a pair that every
    text has is one row of each.
    """
    counts = broadcast_if_small(keep(pair_counts(aligned), "scored_pairs"))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("t"))
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    narrow = aligned.drop("pairs", "times").join(sums, "row", "left")
    return narrow.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}).drop("row")


def op13(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """The contract's columns; see :func:`align` and :func:`scored`."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    out = scored(keep(align(docs, path_a, path_b), "aligned"))
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
