"""Benchmark decontamination by winnowed fingerprints that are joined and extended.

Only DataFrame functions: no Python code runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh, keep

#: Words of a benchmark window, words of a k-gram, k-grams in a sliding window. Any shared
#: span of K + SPREAD - 1 = WINDOW words holds one whole sliding window, whose smallest hash
#: is a fingerprint on both sides.
WINDOW, K = 10, 5
SPREAD = WINDOW - K + 1
#: Broadcasts stay below so many rows (about 100 bytes each); beyond, Spark shuffles.
BROADCAST_ROWS = 200_000

# What lies between words once A-Z counts as letters: all ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z (and nothing else) in lower case. Null has none."""
    text = F.coalesce(text, F.lit(""))
    # Where all is ASCII, lower() does the same as translate() and much faster.
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, GAP), "")


def grams(w: str, k: int, mark: int) -> Column:
    """Hashes of the k-grams of the word array in column ``w``, in order; ``mark`` tells apart
    the families of hashes."""
    at = lambda i, j: F.get(F.col(w), i + j)
    every = F.transform(F.col(w), lambda _, i: F.xxhash64(F.lit(mark), *[at(i, F.lit(j)) for j in range(k)]))
    return F.slice(every, F.lit(1), F.greatest(F.size(w) - F.lit(k - 1), F.lit(0)))


def winnowed(g: str) -> Column:
    """The smallest hash of each ``SPREAD`` neighbours in column ``g``, each value once."""
    least = F.transform(F.col(g), lambda x, i: F.least(x, *[F.get(F.col(g), i + F.lit(j)) for j in range(1, SPREAD)]))
    return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.size(g) - F.lit(SPREAD - 1), F.lit(0))))


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n, win): every window of every item, ``win`` its words with spaces between.

    An item below ``WINDOW`` words is one window of its ``n`` words; an item without words
    has none.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return items.select("item_id", n.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("win")).distinct()


def fingerprints(rows: DataFrame, short: list[int]) -> Column:
    """Of the word array ``w`` and its ``WINDOW``-family k-grams ``g``: the winnowed hashes, and
    for each length of ``short`` all hashes of that many words."""
    parts = [winnowed("g"), *(grams("w", n, n) for n in short)]
    return F.array_union(parts[0], F.flatten(F.array(*parts[1:]))) if short else parts[0]


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: rows equal in it have the same text, and so the same result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.octet_length(text).alias("nb")]


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th")) & (F.col(f"{a}.nb") == F.col(f"{b}.nb"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct contaminated row of ``docs``: id, th, nb, ``n_hit`` (words that lie in
    an occurrence of a window) and ``items`` (ids of the items whose windows occur, sorted as
    strings).

    1. The fingerprints of all documents, from their whole texts, are joined to those of the
       benchmark: this leaves the documents that may hold a window. No shared window of
       ``WINDOW`` words can be missed.
    2. In these documents, each place of a benchmark fingerprint is extended to the windows
       around it.
    3. The extended windows are compared word by word with the benchmark's, and what they
       cover is summed up.
    Joins with the benchmark broadcast it where it has at most ``BROADCAST_ROWS`` rows.
    """
    windows = keep(item_windows(benchmark, text_col="text"), "item_windows")
    short = sorted(r["n"] for r in windows.filter(F.col("n") < WINDOW).select("n").distinct().collect())  # 9 at most
    of_items = windows.select(F.split("win", " ").alias("w"), "n")
    long_marks = of_items.filter(F.col("n") == WINDOW).withColumn("g", grams("w", K, 0)).select(F.explode(winnowed("g")).alias("mark"))
    marks = long_marks
    for n in short:
        marks = marks.unionByName(of_items.filter(F.col("n") == n).select(F.explode(grams("w", n, n)).alias("mark")))
    marks = broadcast_if_small(keep(marks.distinct(), "marks"), BROADCAST_ROWS)
    unique = broadcast_if_small(keep(windows.select("win").distinct(), "windows"), BROADCAST_ROWS)

    rows = docs.select(*_row_key(id_col, text_col), words(F.col(text_col)).alias("w")).withColumn("g", grams("w", K, 0))
    marked = rows.select("id", "th", "nb", F.explode(fingerprints(rows, short)).alias("mark")).join(marks, "mark", "left_semi")
    candidates = keep(marked.select("id", "th", "nb").distinct(), "candidates")

    texts = docs.select(*_row_key(id_col, text_col), F.col(text_col).alias("text")).alias("t")
    found = texts.join(broadcast_if_small(candidates, BROADCAST_ROWS).alias("c"), _same("t", "c"), "left_semi")
    found = keep(found.dropDuplicates(["id", "th", "nb"]).withColumn("row", F.monotonically_increasing_id()), "found")
    found = found.withColumn("w", words(F.col("text")))

    families = [(K, 0, SPREAD - 1, WINDOW), *((n, n, 0, n) for n in short)]  # words, mark, windows before, window's words
    spans = None
    for family in families:
        part = _extended(found, marks, *family)
        spans = part if spans is None else spans.unionByName(part)
    spans = keep(spans.join(unique, "win", "left_semi"), "spans")

    ends = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "n"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["n"]).alias("end"),
            (a["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a["end"], x["start"]))).cast("long").alias("hit"),
        ),
    )
    covered = spans.groupBy("row").agg(ends.getField("hit").alias("n_hit"))
    by_window = broadcast_if_small(windows.select("win", "item_id"), BROADCAST_ROWS)
    items = spans.select("row", "win").distinct().join(by_window, "win").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return found.select("row", "id", "th", "nb").join(covered, "row").join(items, "row", "left").drop("row")


def _extended(found: DataFrame, marks: DataFrame, k: int, mark: int, before: int, size: int) -> DataFrame:
    """(row, start, n, win): the windows of ``size`` words around each place of a marked k-gram,
    from ``before`` words ahead of it on."""
    anchors = found.select("row", F.posexplode(grams("w", k, mark)).alias("at", "mark")).join(marks, "mark", "left_semi")
    places = anchors.groupBy("row").agg(F.collect_set("at").alias("at"))
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p - F.lit(before), p))))
    inside = F.filter(starts, lambda s: (s >= 0) & (s + F.lit(size) <= F.size("w")))
    out = found.select("row", "w").join(places, "row").select("row", "w", F.explode(inside).alias("start"))
    return out.select("row", "start", F.lit(size).alias("n"), F.array_join(F.slice("w", F.col("start") + 1, F.lit(size)), " ").alias("win"))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``items`` (sorted ids, empty where
    none), ``contaminated``.

    A null text has no words; a document shorter than a window can only hold items that are
    as short. Null ids are kept and told apart by their texts; repeated rows get equal
    results. Items with equal windows are all listed; an item without an id makes its words
    hits but is not listed. An empty benchmark hits nothing; an empty ``docs`` gives no rows.
    Other columns of either table are not looked at.
    """
    found = keep(hits(docs, benchmark, id_col, text_col), "hits").alias("h")
    rows = docs.select(*_row_key(id_col, text_col), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_words")).alias("d")
    joined = rows.join(broadcast_if_small(found, BROADCAST_ROWS).alias("h"), _same("d", "h"), "left")
    return joined.select(
        F.col("d.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all columns kept. Cases as in
    :func:`report`."""
    found = hits(docs, benchmark, id_col, text_col)
    names = [fresh(docs, c) for c in ("_id", "_th", "_nb")]
    bad = broadcast_if_small(keep(found.select(*[F.col(c).alias(n) for c, n in zip(("id", "th", "nb"), names)]), "hits"), BROADCAST_ROWS)
    _, th, nb = _row_key(id_col, text_col)
    same = docs[id_col].eqNullSafe(bad[names[0]]) & (th == bad[names[1]]) & (nb == bad[names[2]])
    return docs.join(bad, same, "left_anti")


def op9(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = report(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
v AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM v),
lengths AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
hit AS (SELECT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win ON win.n = dw.n AND win.win = array_to_string(dw.w[dw.i:dw.i + dw.n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS list FROM hit GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
