"""Lexicon fingerprints, the conversations' trie and the alignment of tokenizers against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from arkloom.llm import alignment, imatch, prefix_trie

DOCS = "doc_id long, text string, id string, row string, words string, n_a string"


# --- fingerprints ---------------------------------------------------------------------


def fingerprint_rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"{rng.choice('abcdef')}{k}" for k in range(400)] + ["Éa", "中文", "the"]
    made = [" ".join(["the", *(rng.choice(words) for _ in range(rng.choice((3, 30, 300))))]) for _ in range(60)]
    made += [made[0], made[0], "", None, "   ", "only-once here", "the", "\U0001f600 x\ty\n", "repeat " * 3000]
    return list(enumerate(made))


def test_fingerprints_equal_their_sql(spark, texts):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    want = {tuple(r) for r in db.execute(imatch.SQL).fetchall()}
    rows = imatch.op11(fingerprint_rows(spark, texts).repartition(3)).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    assert by[60]["fingerprint"] == by[61]["fingerprint"] == by[0]["fingerprint"] and by[61]["near_next"] == 1.0
    assert by[62]["fingerprint"] == "" and by[62]["near_edited"] == 1.0 and by[62]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    last = max(texts)[1]
    first = texts[0][1]
    n = len(first) // 3
    assert by[0]["edited_sha256"] == hashlib.sha256((first[: len(first) - n] + last[:n]).encode()).hexdigest()


def test_fingerprints_without_broadcasts_and_in_many_ranges(spark, texts, monkeypatch):
    docs = fingerprint_rows(spark, texts)
    want = {tuple(r) for r in imatch.op11(docs).collect()}
    monkeypatch.setattr(imatch, "broadcast_if_small", lambda df, most=0: df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {tuple(r) for r in imatch.op11(docs).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_of_odd_tables(spark):
    odd = [(None, "a b c"), (None, "d e f"), (5, "same"), (5, "same"), (5, "other"), (None, None)]
    got = imatch.op11(fingerprint_rows(spark, odd)).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == [(-1, 0), (-1, 5), (-1, 5), (5, 4), (5, 4), (5, 5)]
    one = imatch.op11(fingerprint_rows(spark, [(1, "abc abc")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abc aab").hexdigest()
    assert imatch.op11(fingerprint_rows(spark, [])).count() == 0


def test_edited_texts_are_liker_than_next_ones(spark):
    got = imatch.op11(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.9
    assert np.mean([r["near_edited"] for r in got]) > 0.25 and np.mean([r["near_next"] for r in got]) < 0.05


# --- the trie -------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, shard string, digest string"


def brute_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [(r, t) for *_, r, t in sorted(x, key=lambda y: (y[0], y[1], np.frombuffer(bytes.fromhex(y[2]), "<u8").tolist()))] for c, x in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members, below = {}, {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
            if d:
                below.setdefault(tuple(seq[: d - 1]), set()).add(tuple(seq[:d]))

    def sums(node):
        leaves, saved = [], (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        for kid in below.get(node, ()):
            a, b = sums(kid)
            leaves.append(a)
            saved += b
        return sum(leaves) if leaves else 1, saved

    out = set()
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out.add((min(who), len(node), up, len(who), len(below.get(node, ())), *sums(node), hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-5, 40), *range(95, 130), 400, 401, 502, None]:
        for turn in range(rng.choice((1, 1, 2, 5, 9))):
            rows.append((c, rng.choice((turn, turn, turn, None)), rng.choice(("user", "user", None)), rng.choice(("hi", "hi", "hi", "", None, "é" * 40, "x y"))))
    rows += rows[:30]  # repeated turns
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", rng.choice((7, 60, 10_000)))
    monkeypatch.setattr(prefix_trie, "AT_ONCE", rng.choice((2, 1000)))
    table = spark.createDataFrame([(*r, "a", "b") for r in rows], TURNS).repartition(3)
    got = prefix_trie.op12(table).collect()
    assert {tuple(r) for r in got} == brute_trie(rows) and len({tuple(r) for r in got}) == len(got)


def test_trie_of_odd_tables(spark):
    table = lambda rows: spark.createDataFrame([(*r, "a", "b") for r in rows], TURNS)
    assert prefix_trie.op12(table([])).count() == 0
    assert prefix_trie.op12(table([(None, 1, "u", "x")])).count() == 0
    deep = [(100, i, "u", f"t{i}") for i in range(3000)]  # one very long conversation
    got = prefix_trie.op12(table(deep)).collect()
    assert len(got) == 3001 and max(r["depth"] for r in got) == 3000 and {r["n_leaves"] for r in got} == {1}


def test_slots_are_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = tuple(rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
        slots = prefix_trie.Slots(keys)
        assert sorted(slots.of(keys).tolist()) == list(range(n))
    few = (np.arange(500, dtype=np.uint64), np.zeros(500, np.uint64))  # neighbouring digests as well
    assert sorted(prefix_trie.Slots(few).of(few).tolist()) == list(range(500))


def test_equal_digests_of_other_prefixes_are_an_error(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "_mixed", lambda x: x & np.uint64(1))
    n = 40
    table = pa.table({"shard": [0] * n, "conv_id": list(range(n)), "turn": [0] * n, "digest": [hashlib.md5(bytes([k])).digest() for k in range(n)], "chars": [1] * n})
    monkeypatch.setattr(prefix_trie, "_rebuilt", lambda conv, sizes, starts: (sizes, np.arange(int(sizes.sum()))))
    with pytest.raises(ValueError, match="one digest"):
        prefix_trie._local_trie(table)


# --- alignment ------------------------------------------------------------------------

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def brute_groups(text, a, b):
    """Tokens of whole texts, cut where both end."""
    if not text:
        return []
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(spelled[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return out


def shown_groups(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


@pytest.mark.parametrize("broadcasts", (True, False))
def test_alignment_equals_brute_force(spark, monkeypatch, tokenizers, broadcasts):
    rng = random.Random(9)
    made = ["", None, "a▁b", "<s>x</s> <|endoftext|>", " lead", "trail  ", "a\n\nb\tc", "naïve café 中文 \U0001f600", "word " * 5000, "x" * 3000, "\x00\x01"]
    made += [" ".join(rng.choice(("the", "The", "over", "don't", "1234", "été", "x_y", "...", "\n")) for _ in range(50)) for _ in range(20)] * 2
    rows = [(i if i % 7 else None, t, "a", "b", "c", "d") for i, t in enumerate(made)]
    if not broadcasts:
        monkeypatch.setattr(alignment, "broadcast_if_small", lambda df, most=0: df)
    groups = [brute_groups(t, *tokenizers) for t in made]
    counts = Counter((x[-1], y[-1]) for g in groups for x, y in g)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    want = []
    for (i, *_), g in zip(rows, groups):
        links = [(x[-1], y[-1]) for x, y in g]
        digest = hashlib.sha256(shown_groups(g).encode()).hexdigest() if g else ""
        want.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    got = [tuple(r) for r in alignment.op13(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(not g for g in groups) == 3
    assert alignment.op13(spark.createDataFrame([], DOCS)).count() == 0


def test_alignment_of_fuzzed_texts(tokenizers):
    rng = random.Random(2)
    some = "ab Z.,'\n\t  \r éü中▁́\U0001f600 0 9<s></s>  \x1c\x85﻿|endoftext’s"

    def letter():
        return rng.choice(some) if rng.random() < 0.7 else chr(rng.choice((rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000))))

    texts = ["".join(letter() for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    n_a, n_b, n_links, pairs, groups = alignment.Aligner(A, B).aligned(texts)
    cuts = np.concatenate([[0], np.cumsum(n_links)])
    for k, text in enumerate(texts):
        want = brute_groups(text, *tokenizers)
        assert groups[k] == shown_groups(want), text
        assert (n_a[k], n_b[k], n_links[k]) == (sum(len(x) for x, _ in want), sum(len(y) for _, y in want), len(want))
        assert [divmod(p, alignment.PAIR) for p in pairs[cuts[k] : cuts[k + 1]].tolist()] == [(x[-1], y[-1]) for x, y in want]


def test_pointers_lead_to_the_components_ends():
    rng = np.random.default_rng(5)
    for size in (1, 2, 10, 300):
        for share in (0.1, 0.5, 0.9):
            ends = [np.unique(np.append(np.flatnonzero(rng.random(size) < share) + 1, size)) for _ in range(2)]
            of_a, of_b = alignment.terminals(*ends)
            common = np.intersect1d(*ends)
            for x, to in zip(ends, (of_a, of_b)):
                assert ends[1][to].tolist() == [int(common[common >= e][0]) for e in x]
