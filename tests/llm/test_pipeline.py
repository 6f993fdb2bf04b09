"""The whole pipeline against plain Python, on every row of the smallest tables."""

import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from arkloom.llm import toxicity

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairwise_score(machine, text):
    """The machine's definition, pair by pair."""
    at = [machine.place[b] for b in toxicity.terms_of(text, {}) if machine.place[b] >= 0]
    raw = machine.bias + sum(machine.w[i] for i in at) + sum(float(machine.v[i] @ machine.v[j]) for i, j in combinations(at, 2))
    return 1 / (1 + np.exp(-raw))


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_representatives(docs):
    sets, first = {i: shingle_set(t) for i, t in docs.items()}, {i: i for i in docs}

    def root(i):
        while first[i] != i:
            i = first[i]
        return i

    for a, b in combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and both * 100 >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            first[high] = low
    return {i: t for i, t in docs.items() if root(i) == i}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_pipeline_equals_plain_python(spark):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    machine = toxicity.train(tables["documents"], tables["labels"])
    want = {i: t for i, t in docs.items() if pairwise_score(machine, t) < 0.5}

    last = {}
    for i in sorted(want):
        last[want[i] or ""] = i
    want = {i: want[i] for i in last.values()}
    want = near_representatives(want)

    by_length = {}
    for r in tables["benchmark"].collect():
        if words := item_words(r["text"]):
            by_length.setdefault(min(10, len(words)), set()).update(windows(words, min(10, len(words))))
    want = {i: t for i, t in want.items() if not any(windows(item_words(t), n) & found for n, found in by_length.items())}
    assert 0 < len(want) < len(docs)

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, parts in pieces.items():
        ids, at = encoder.encode(want[i] or "", add_special_tokens=False).ids + [1], 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p["start"] : at]))
        assert at == len(ids)
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_take_odd_tables(spark):
    """Nulls, empty texts, repeated rows, clashing columns, and a table without rows."""
    rows = [(1, "a b c", "en", "s", 5, "x"), (1, "a b c", "en", "s", 5, "x"), (None, None, None, None, None, None), (None, "w " * 9, None, None, None, "y"), (2, "", "en", "s", 0, None), (3, None, "en", "s", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _digest string").select("*", *[F.lit(1).alias(c) for c in ("_id", "_kept", "_gone", "_th", "_nb", "id", "th", "_stays")])
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns
        texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
        assert texts == ([] if table is not docs else [(0, "w " * 9), (1, "a b c"), (3, "")])
        assert corpus_pipeline.packed(spark, kept, SF).count() == len(texts)
