"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Hash buckets of terms.
BUCKETS = 1 << 18
#: At most so many labelled rows are learnt from (those with the smallest md5 of their id).
MAX_TRAIN = 12_000
#: Buckets that the machine has weights for: those that tell the labels apart best, alone
#: (``LEAST_CHI``) or, of the ``PAIRED`` most frequent ones, together with another one
#: (``LEAST_PAIR_CHI`` in at least ``LEAST_BOTH`` texts that have both).
FEATURES, LEAST_CHI = 4096, 30.0
PAIRED, LEAST_PAIR_CHI, LEAST_BOTH = 2048, 100.0, 10
FACTORS, EPOCHS, RATE, L2 = 8, 12, 0.1, 1e-4
#: Labels that only many words together tell apart pass no such test word by word. So a machine that
#: also learns all buckets of at least a share of texts (``OFTEN``, and ``LEAST_BOTH`` texts) is tried on
#: at most ``TRIAL`` of the texts learnt from, a quarter of which it does not see. It has fewer factors,
#: more epochs and a stronger pull to zero.
OFTEN, TRIAL = 0.02, 4000
WIDE = (4, 30, 1e-3)
WORD = re.compile(r"\w+")
#: Texts that a worker holds terms of at a time, words whose buckets it remembers, and the
#: longest of these.
AT_ONCE, KNOWN_WORDS, LONGEST_KNOWN = 500, 50_000, 40


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + sum of w + sum over pairs of <v_i, v_j>) over a text's terms."""

    buckets: np.ndarray  # that it has weights for
    bias: float
    w: np.ndarray
    v: np.ndarray

    @cached_property
    def place(self) -> np.ndarray:
        """Of each bucket among the features, -1 for none."""
        out = np.full(BUCKETS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "place"}

    def score(self, texts: pa.Array, known: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Of each text, ``AT_ONCE`` at a time; ``known`` is as in :func:`terms_of`."""
        out = [np.empty(0)]
        for cut in range(0, len(texts), AT_ONCE):
            lists = [terms_of(x.as_py(), known, self.place) for x in texts[cut : cut + AT_ONCE]]
            rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            at = np.fromiter((t for x in lists for t in x), np.int64, len(rows))
            out.append(1 / (1 + np.exp(-np.clip(_raw(rows, at, len(lists), self.bias, self.w, self.v)[0], -30, 30))))
        return np.concatenate(out)


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], 1)


def _raw(rows: np.ndarray, at: np.ndarray, n: int, bias: float, w: np.ndarray, v: np.ndarray):
    own = v[at]
    total = _sums(rows, own, n)
    pairs = 0.5 * (total**2 - _sums(rows, own**2, n)).sum(1)
    return bias + np.bincount(rows, w[at], n) + pairs, total


def terms_of(text: str | None, known: dict[str, tuple[int, ...]], place: np.ndarray | None = None) -> list[int]:
    """The buckets of a text's terms, each once: its lower-case words and their beginnings of
    4 and 5 letters, which stand for inflected forms; given ``place``, their places among the
    features, without those that have none. Null and empty texts have none."""
    out: set[int] = set()
    for word in set(WORD.findall((text or "").lower())):
        buckets = known.get(word)
        if buckets is None:
            forms = [word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k)]
            buckets = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in forms)
            if place is not None:
                buckets = tuple(int(p) for b in buckets if (p := place[b]) >= 0)
            if len(word) <= LONGEST_KNOWN:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                known[word] = buckets
        out.update(buckets)
    return sorted(out)


def _chi(n: np.ndarray, n1: np.ndarray, seen: np.ndarray, seen1: np.ndarray) -> np.ndarray:
    """Chi-squared of a term, in ``seen`` of ``n`` texts, against the label of ``n1`` of them;
    -1 where it is not defined."""
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (seen1 * n - seen * n1) ** 2 / (seen * (n - seen) * n1 * (n - n1))
    return np.where(np.isfinite(chi), chi, -1)


def _pairs(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The buckets that tell the labels apart by pairs, those of the most telling pairs first.

    A pair does so if among the texts with either bucket the other one still tells the labels
    apart: what the pair says is more than what one of the two says alone.
    """
    seen = np.bincount(terms, minlength=BUCKETS)
    often = np.argsort(-seen, kind="stable")[:PAIRED]
    often = often[seen[often] >= LEAST_BOTH]
    place = np.full(BUCKETS, -1, np.int32)
    place[often] = np.arange(len(often))
    at = place[terms]
    rows, at = rows[at >= 0], at[at >= 0]
    both, both1 = np.zeros((2, len(often), len(often)), np.float32)
    for cut in range(0, len(labels), 1000):
        here = slice(*np.searchsorted(rows, [cut, cut + 1000]))
        x = np.zeros((min(1000, len(labels) - cut), len(often)), np.float32)
        x[rows[here] - cut, at[here]] = 1
        both += x.T @ x
        x = x[labels[cut : cut + 1000] > 0]
        both1 += x.T @ x
    chi = np.full(both.shape, -1, np.float32)
    for cut in range(0, len(often), 256):  # row by row: among the texts with the row's bucket
        part, part1 = (m[cut : cut + 256].astype(float) for m in (both, both1))
        own, own1 = (np.diag(m)[cut : cut + 256, None].astype(float) for m in (both, both1))
        chi[cut : cut + 256] = np.where(part >= LEAST_BOTH, _chi(own, own1, part, part1), -1)
    best = np.minimum(chi, chi.T).max(1, initial=-1)
    order = np.argsort(-best, kind="stable")
    return often[order[best[order] >= LEAST_PAIR_CHI]]


def _chosen(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The buckets with the largest chi-squared against the labels, of those in 3 texts or more
    and of a value that chance hardly gives among so many buckets, and those that tell only
    in pairs."""
    seen = np.bincount(terms, minlength=BUCKETS).astype(float)
    chi = _chi(len(labels), labels.sum(), seen, np.bincount(terms, labels[rows], BUCKETS))
    chi[seen < 3] = -1
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    alone = best[chi[best] >= LEAST_CHI]
    more = _pairs(rows, terms, labels)
    return np.concatenate([alone, more[~np.isin(more, alone)]])[:FEATURES]


def _features(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, wide: bool) -> np.ndarray:
    """The buckets that tell the labels apart and, if so wanted, all that many texts have."""
    told = _chosen(rows, terms, labels)
    seen = np.bincount(terms, minlength=BUCKETS)
    return np.union1d(told, np.flatnonzero(seen >= max(LEAST_BOTH, OFTEN * len(labels)))) if wide else told


def _needs_wide(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, seed: int) -> bool:
    """Whether the wide machine clearly errs less, by a tenth, on texts that it has not seen; errors
    count as in learning."""
    order = np.random.default_rng(seed).permutation(len(labels))[:TRIAL]
    place = np.full(len(labels), -1)
    place[order] = np.arange(len(order))
    at, cut = place[rows], len(order) * 3 // 4
    y, unseen = labels[order[:cut]], labels[order[cut:]]
    if not (0 < y.sum() < len(y) and 0 < unseen.sum() < len(unseen)):
        return False
    known = np.flatnonzero((at >= 0) & (at < cut))
    known = known[np.argsort(at[known], kind="stable")]
    cost = np.where(unseen > 0, np.sqrt((len(y) - y.sum()) / y.sum()), 1.0)
    wrong = []
    for wide in (False, True):
        features = _features(at[known], terms[known], y, wide)
        machine = _learn(at[known], terms[known], y, features, seed, wide)
        k = machine.place[terms]
        use = (at >= cut) & (k >= 0)
        raw, _ = _raw(at[use] - cut, k[use], len(unseen), machine.bias, machine.w, machine.v)
        wrong.append(float((cost * ((raw >= 0) != (unseen > 0))).sum()))
    return wrong[1] < 0.9 * wrong[0]


def fit(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, seed: int = 11) -> Machine:
    """The machine of texts' terms (``rows`` ascending). Without rows, or with one label only, the
    score is a constant."""
    if not 0 < labels.sum() < len(labels):
        return _learn(rows, terms, labels, np.empty(0, int), seed)
    wide = _needs_wide(rows, terms, labels, seed)
    return _learn(rows, terms, labels, _features(rows, terms, labels, wide), seed, wide)


def _learn(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, chosen: np.ndarray, seed: int, wide: bool = False) -> Machine:
    """Adaptive gradient descent on the logistic loss with these features, positives weighted by the
    square root of their rarity."""
    factors, epochs, l2 = WIDE if wide else (FACTORS, EPOCHS, L2)
    rng = np.random.default_rng(seed)
    n, n1 = len(labels), float(labels.sum())
    rate = (n1 + 0.5) / (n + 1)
    bias = float(np.log(rate / (1 - rate)))
    w, v = np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), factors))
    if not len(chosen):
        return Machine(chosen, bias, w, v)
    at = Machine(chosen, bias, w, v).place[terms]
    rows, at = rows[at >= 0], at[at >= 0]
    starts = np.searchsorted(rows, np.arange(n + 1))
    cost = np.where(labels > 0, np.sqrt((n - n1) / n1), 1.0)
    gw, gv, gb = np.full(w.shape, 1e-8), np.full(v.shape, 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(n)
        for cut in range(0, n, 256):
            texts = order[cut : cut + 256]
            sizes = starts[texts + 1] - starts[texts]
            own = np.repeat(np.arange(len(texts)), sizes)
            idx = at[np.repeat(starts[texts], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            raw, total = _raw(own, idx, len(texts), bias, w, v)
            slope = cost[texts] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[texts]) / len(texts)
            db = slope.sum()
            gb += db**2
            bias -= RATE * db / np.sqrt(gb)
            used, back = np.unique(idx, return_inverse=True)
            if not len(used):
                continue
            each = slope[own]
            dw = np.bincount(back, each, len(used)) + l2 * w[used]
            dv = _sums(back, each[:, None] * (total[own] - v[idx]), len(used)) + l2 * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return Machine(chosen, bias, w, v)


def fold(id_col: str):
    """crc32 of the id as text, modulo 5: rows with 0 are held out. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """Fit on at most ``max_train`` labelled rows that are not held out.

    The labels are cut to the bound first, so the broadcast and what the driver gathers
    (bucket lists of that many texts) have it too. A row labelled twice counts with its
    largest label, a repeated id with the smallest of its bucket lists; labels that are null
    or without an id are left out. Rows are learnt in the order of their ids, so the machine
    does not depend on how the tables are dealt out.
    """
    few = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(fold("doc_id") != 0)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id")
        .limit(max_train)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for cut in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(cut, AT_ONCE)
                lists = pa.array([terms_of(x.as_py(), known) for x in part.column(2)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "label", "terms"])

    found = small_batches(docs).select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("_id", "_toxic", "text")
    lists = found.mapInArrow(run, f"id {dict(few.dtypes)['_id']}, label int, terms array<int>")
    got = lists.groupBy("id").agg(F.min("label").alias("label"), F.min("terms").alias("terms")).toArrow().sort_by("id")
    toxic = np.asarray(got.column("label")).astype(float)
    lists = got.column("terms").combine_chunks()
    del got  # the driver holds the lists once
    sizes = np.asarray(lists.value_lengths()) if len(toxic) else np.empty(0, int)
    terms = np.asarray(lists.flatten()) if len(toxic) else np.empty(0, int)
    return fit(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), terms, toxic)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every row, from the whole text. A null text scores as an empty
    one, which has no terms and gets the score of the bias alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.score(batch.column(1), known), pa.float64())], names=["id", "score"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``; see :func:`train` and :func:`score`.

    Repeated rows get equal scores; an empty ``labels`` gives one constant score below 0.5;
    columns other than doc_id and text are not looked at.
    """
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns kept.

    The scores are computed beside the columns, so no join is needed and a null or repeated
    id does no harm.
    """
    machine = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for cut in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(cut, AT_ONCE)
                yield part.filter(pa.array(machine.score(part.column("text"), known) < 0.5))

    return small_batches(docs).mapInArrow(run, docs.schema)
