"""Packing token sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches
from .ranks import positions

#: Tokens of a sequence, and the id that ends each document.
LENGTH, END_ID = 2048, 1
#: Marks that the tokenizer always cuts from a letter or digit before them.
MARKS = ".,;:!?|*#$%&()\"-"
#: Letters up to here (but for the one below) keep their form in NFC and have one letter as
#: lower case, which U+0130 has not: it becomes an i and a combining dot.
LATIN_END, DOTTED = "\u0250", "\u0130"
#: Words whose ids a worker keeps, in each of two generations, and the longest word kept.
KNOWN_WORDS, LONGEST_KNOWN = 125_000, 40
#: Buckets in which the pieces of one length are numbered.
BUCKETS = 4096


class Words(dict):
    """The ids of words, learnt as they are asked for.

    A word that is letters or digits and marks after them is these two in turn, if its last
    letter stays a letter in NFC and lower case. Words of Latin letters go to the tokenizer's
    model in its own spelling of bytes, all others through the whole tokenizer. Once a
    generation is full it becomes the old one, from which words that are met again return.
    """

    def __init__(self, tokenizer):
        from tokenizers import pre_tokenizers

        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, {}
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {ord(c): spelled(c.lower())[0][0] for c in map(chr, range(ord(LATIN_END))) if c.isalpha() and c != DOTTED}
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.learnt(word)
        if len(word) <= LONGEST_KNOWN:
            if len(self) >= KNOWN_WORDS:
                self.old = dict(self)
                self.clear()
                self[""] = b""
            self[word] = found
        return found

    def learnt(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if len(core) < len(word):
            if core and core[-1] < DOTTED and core.isalnum():
                return self[core] + self[word[len(core) :]]
        elif word.isalpha() and (word.isascii() or max(word) < LATIN_END and DOTTED not in word):
            return array("I", [t.id for t in self.model.tokenize(word.translate(self.spelling))]).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


class Encoder:
    """The ids of whole texts, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins what it separates, so a text's ids are
    those of its space-separated words in turn; see :class:`Words`. A tokenizer that does not
    work so encodes texts as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        apart = ids("Ab.\ncd \u00c9f (g)") == [i for x in ("ab", ".", "CD", "\u00e9F", "(", "g", ")") for i in ids(x)]
        self.words = Words(self.tokenizer)
        spelled = [t.id for t in self.tokenizer.model.tokenize("\u00c9f".translate(self.words.spelling))]
        self.by_words = apart and spelled == ids("\u00c9f")

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.words.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One for each worker process, whose later tasks find its words known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' ids and ``END_ID``, cut after every ``length`` ids.

    Returns ``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if wanted,
    ``ids`` (array of int) per piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []))}
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data, doc_id = encoder.encode(text.as_py() or "") + end, doc_id.as_py()
                for start in range(0, len(data), 4 * length):
                    piece = data[start : start + 4 * length]
                    row = (doc_id, start // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4, *([np.frombuffer(piece, "<u4").astype(np.int32)] if with_ids else []))
                    for k, v in zip(out, row):
                        out[k].append(v)
            kinds = {"id": batch.schema.field(0).type, "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], names=list(out))

    kind = dict(docs.dtypes)[id_col]
    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """Packs as (how many, lengths in them), from how many pieces have each length.

    Lengths are placed longest first. Of the open packs that still have room for one, those
    filled least are filled first; packs that look alike are one entry with a count, so the
    work depends on ``length`` and not on the number of pieces.
    """
    room: dict[int, list[tuple[int, tuple | None]]] = defaultdict(list)  # free tokens -> (how many, chain)
    for size in sorted(histogram, reverse=True):
        left, free = histogram[size], length
        while left:
            while free >= size and not (free < length and room.get(free)):
                free -= 1
            if free < size:  # no open pack takes it: new ones are filled one after the other
                fit, chain = length // size, None
                for n in range(1, fit + 1):
                    chain = (chain, size)
                    if many := left // fit if n == fit else int(n == left % fit):
                        room[length - n * size].append((many, chain))
                break
            many, chain = room[free].pop()
            used = min(many, left)
            if many > used:
                room[free].append((many - used, chain))
            room[free - size].append((used, (chain, size)))
            left -= used
    out = []
    for free in sorted(room):
        for many, chain in room[free]:
            sizes = []
            while chain:
                chain, size = chain
                sizes.append(size)
            out.append((many, sizes[::-1]))
    return out


def ranges(packs: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the pieces of a length from
    that rank on lie in that sequence and the following ones, at that offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for many, sizes in packs:
        offset = 0
        for size in sizes:
            rows.append((size, used[size], sequence, offset))
            used[size] += many
            offset += size
        sequence += many
    return np.asarray(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents as pieces in sequences of at most ``length`` tokens.

    Adds ``sequence_id`` and ``offset`` to :func:`pieces`. The histogram has ``length`` rows
    at most, which the driver packs; the packs come back as ranges of ranks, at most
    ``length`` lengths in at most ``length`` places each, and a piece finds its place from
    its rank among the pieces of its length. Ranks are counted in buckets, so no task holds
    all pieces of a length. The last pack of a kind aside, little is left to pad.

    A null text is empty; an empty text is ``END_ID`` alone. Null and repeated ids are kept:
    each row is a document of its own. Texts of any length are cut, never shortened. An
    empty table gives an empty result. Other columns are not looked at.
    """
    cut = keep(pieces(docs, tokenizer_path, length, with_ids, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(ranges(patterns(histogram, length)))
    spread = cut.withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    ranked = positions(spread, ["length"], "part", ["id", "start", "doc_tokens", "ids_crc32"], "rank").drop("part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] * (1 << 48) + rows[:, 1]
        for batch in batches:
            size, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(keys, size * (1 << 48) + rank, side="right") - 1
            kept = batch.drop_columns(["rank"])
            yield kept.append_column("sequence_id", pa.array(rows[at, 2] + rank - rows[at, 1])).append_column("offset", pa.array(rows[at, 3]))

    fields = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op8(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return pack(docs, tokenizer_path).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
