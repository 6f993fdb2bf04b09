"""I-Match fingerprints: hashes of a text's terms of middling rarity, under random subsets of
the lexicon.

Only DataFrame functions: no Python code runs on the executors.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arkloom.functions.urls import settled

from .common import broadcast_if_small, keep, text_or_empty
from .decontam import LOWER, UPPER, words

#: The band of inverse document frequency: terms of at least one in ``RARE`` and at most one in
#: ``COMMON`` documents. The lexicon has at most RARE x (mean distinct terms of a text) terms,
#: however many documents there are.
RARE, COMMON = 1000, 20
#: Random subsets of the lexicon, and how often each can be thinned to a quarter.
SUBSETS, DEEPEST = 16, 7
#: A term's lower bits, times a subset's odd factor and modulo this, are its place in the subset.
PLACES = 1 << 31
FACTORS = [int(sha256(f"subset {s}".encode()).hexdigest()[:7], 16) * 2 + 1 for s in range(SUBSETS)]


def lexicon(texts: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """(term, id) of the terms in the band, from the distinct terms (array ``words``) of all texts; ``id``
    is a number from the term's MD5."""
    n = texts.count()
    counts = texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    inside = counts.filter((F.col("df") * rare >= n) & (F.col("df") * common <= n))
    return inside.select("term", F.conv(F.substring(F.md5("term"), 1, 15), 16, 10).cast("long").alias("id"))


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are below an id, by halving."""
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))] or [1]
    further = lambda at, step: (at + step <= len(bounds)) & (F.get(table, at + step - 1) < doc_id)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, place, own, doc_id, text, next_text): each text and the one behind it in descending order
    of doc_id, the first one behind the last.

    Ids are cut into as many ranges as there are shuffle partitions, by quantiles; a range is
    sorted in one task, texts move once, and each range has a copy (not ``own``) of the next
    one's first row at its end. Null ids come last, by their texts' hashes in ranges of these;
    equal ids stand by hash. ``place`` is a row's in its ``bucket``, by which the result is dealt.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = docs.select(F.percentile_approx("doc_id", shares, 20 * parts).alias("q")).first()["q"] if docs.schema["doc_id"].dataType.simpleString() != "void" else None
    bounds = sorted(set(found or []))
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    of_null = F.shiftright("h", 60).cast("int") + (len(bounds) + 9)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), of_null).otherwise(len(bounds) - _bucket(F.col("doc_id"), bounds)))
    first = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("f"))
    behind = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))  # a row for each range
    heads = first.select(F.col("bucket").alias("home"), behind.alias("into"), F.col("f.doc_id").alias("i"), F.bitwise_not("f.h").alias("fh"))
    copies = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("home")) & F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("fh"))).dropDuplicates(["into"])
    every = rows.select("bucket", "doc_id", "h", "text", F.lit(None).cast("int").alias("home")).union(copies.select("into", "doc_id", "h", "text", "home"))
    order = Window.partitionBy("bucket").orderBy(F.col("home").asc_nulls_first(), F.desc_nulls_last("doc_id"), "h")
    placed = every.withColumns({"place": F.row_number().over(order), "next_text": F.coalesce(F.lead("text").over(order), F.lit(""))})
    return placed.select("bucket", "place", F.col("home").isNull().alias("own"), "doc_id", "text", "next_text")


def _signature(terms: Column) -> Column:
    """Of sorted terms the hash of their ids; none of no terms."""
    ids = F.array_join(F.transform(terms, lambda t: t.cast("string")), ",")
    return F.when(F.size(terms) > 0, F.substring(F.md5(ids), 1, 8)).otherwise(F.lit(""))


def _kept(terms: str | Column, factor: int, limit: Column) -> Column:
    """The terms whose places in the subset with this factor are below the limit."""
    return F.filter(terms, lambda t: (t % PLACES * factor) % PLACES < limit)


def fingerprinted(rows: DataFrame, terms: str, whole: Column, out: str) -> DataFrame:
    """``rows`` with the fingerprint ``out`` of their sorted ``terms`` (ids).

    Of each random subset of the lexicon, thinned until one to four of the text's terms are
    to be expected, and thinned once more, the text's terms are hashed:
    ``<times>:<hashes>;<hashes>``. A text without a term in the band has ``whole:`` and the hash
    ``whole`` of all its terms, one without terms nothing.
    """
    times = sum((F.size(terms) >= 4**k).cast("int") for k in range(1, DEEPEST + 1))
    limit = F.call_function("shiftright", F.lit(PLACES), times * 2)
    rows = settled(settled(rows, _times=times), _limit=limit)
    rows = settled(rows, _kept=F.array(*[_kept(terms, f, F.col("_limit")) for f in FACTORS]))
    once = F.array_join(F.transform("_kept", _signature), ",")
    more = F.array_join(F.array(*[_signature(_kept(F.get("_kept", F.lit(s)), f, F.shiftright("_limit", 2))) for s, f in enumerate(FACTORS)]), ",")
    value = F.when(F.size(terms) > 0, F.concat(F.col("_times").cast("string"), F.lit(":"), once, F.lit(";"), more)).otherwise(F.when(whole != "", F.concat(F.lit("whole:"), whole)).otherwise(F.lit("")))
    return settled(rows, **{out: value}).drop("_times", "_limit", "_kept")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1: equal ones 1; else the share of equal hashes among the subsets
    that keep a term of either text, counted as half of all subsets at least, at the thinning
    that both have where it is the greater one."""
    lists = lambda f: F.split(F.substring_index(f, ":", -1), ";")
    at = lambda f, k: F.split(F.get(lists(f), F.lit(k)), ",")

    def share(i: int, j: int) -> Column:
        pairs = F.arrays_zip(at(a, i).alias("x"), at(b, j).alias("y"))
        same = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != "")))
        some = F.size(F.filter(pairs, lambda p: (p["x"] != "") | (p["y"] != "")))
        return same / F.greatest(some, F.lit(SUBSETS // 2))

    times = lambda f: F.substring_index(f, ":", 1).try_cast("int")
    further = times(b) - times(a)
    return (
        F.when(a == b, F.lit(1.0))
        .when(further == 0, F.greatest(share(0, 0), share(1, 1)))
        .when(further == 1, share(1, 0))
        .when(further == -1, share(0, 1))
        .otherwise(F.lit(0.0))
    )


def op11(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """The contract's columns for every row of ``docs``.

    Terms are runs of letters, digits and other characters above ASCII, A-Z in lower case. The
    lexicon comes from all texts and is broadcast while it is small, else joined by terms. A
    text's terms of the band come together again by one aggregate, its facts along with them.

    Null texts are empty; an empty text has no terms and fingerprint '', like to any other such
    (1). Rows with equal or without ids are rows of their own. A single row is its own next one.
    An empty table gives an empty one; other columns are not looked at.
    """
    terms_of = lambda text: F.array_distinct(words(text))
    own_words = docs.select(terms_of(F.col("text")).alias("words"))
    band = broadcast_if_small(keep(lexicon(own_words, rare, common), "lexicon"))

    rows = with_next(docs)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = settled(rows, edited=edited).withColumn("n_chars", n.cast("long"))
    key = ["bucket", "place", "own"]
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    texts = rows.select(*key, "doc_id", "n_chars", F.explode(both).alias("v")).select(*key, "doc_id", "n_chars", "v.kind", "v.t")
    texts = settled(texts, words=terms_of(F.col("t")))
    # No term begins with #: a text's own facts travel behind its terms.
    texts = texts.withColumn("term", F.explode(F.array_append("words", F.concat_ws("#", F.lit(""), "bucket", "place"))))
    whole = F.when(F.size("words") > 0, F.md5(F.array_join(F.sort_array("words"), " "))).otherwise(F.lit(""))
    fact = F.startswith(F.col("term"), F.lit("#"))
    facts = {"doc_id": F.col("doc_id"), "n_chars": F.col("n_chars"), "sha256": F.sha2("t", 256), "whole": whole}
    found = texts.select(*key, "kind", "term", *[F.when(fact, c).alias(name) for name, c in facts.items()]).join(band, "term", "left").filter(fact | F.col("id").isNotNull())

    # Rows are dealt by their buckets, so neither what follows here nor the next row's fingerprint moves them.
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    grouped = found.groupBy(*key).agg(
        *[F.any_value(c, True).alias(c) for c in ("doc_id", "n_chars")],
        F.any_value(of(1, "sha256"), True).alias("edited_sha256"),
        *[F.any_value(of(k, "whole"), True).alias(f"whole{k}") for k in (0, 1)],
        *[F.array_sort(F.collect_list(of(k, "id"))).alias(f"terms{k}") for k in (0, 1)],
    )
    marked = fingerprinted(grouped, "terms0", F.col("whole0"), "fingerprint").drop("terms0")
    marked = fingerprinted(marked, "terms1", F.col("whole1"), "edited_fingerprint").drop("terms1")
    after = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    own = F.col("fingerprint")
    out = settled(marked.withColumn("_next", after).filter("own"), near_edited=likeness(own, F.col("edited_fingerprint")), near_next=likeness(own, F.col("_next")))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _sql_fingerprint(kind: int) -> str:
    sign = lambda k: f"CASE WHEN len({k}) > 0 THEN substr(md5(array_to_string({k}, ',')), 1, 8) ELSE '' END"
    times = "(" + " + ".join(f"CAST(len(terms{kind}) >= {4**k} AS INT)" for k in range(1, DEEPEST + 1)) + ")"
    stays = lambda f, t: f"list_filter(terms{kind}, lambda t: (t % {PLACES} * {f}) % {PLACES} < ({PLACES} >> (2 * {t})))"
    hashed = lambda t: " || ',' || ".join(sign(stays(f, t)) for f in FACTORS)
    return f"CASE WHEN len(terms{kind}) > 0 THEN {times} || ':' || {hashed(times)} || ';' || {hashed(f'({times} + 1)')} WHEN whole{kind} <> '' THEN 'whole:' || whole{kind} ELSE '' END"


def _sql_likeness(a: str, b: str) -> str:
    at = lambda f, k: f"string_split(split_part(split_part({f}, ':', -1), ';', {k + 1}), ',')"

    def share(i: int, j: int) -> str:
        x, y = at(a, i), at(b, j)
        zipped = f"list_zip({x}, {y})"
        return f"len(list_filter({zipped}, lambda p: p[1] = p[2] AND p[1] <> '')) / greatest(len(list_filter({zipped}, lambda p: p[1] <> '' OR p[2] <> '')), {SUBSETS // 2})"

    times = lambda f: f"TRY_CAST(split_part({f}, ':', 1) AS INT)"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {times(b)} = {times(a)} THEN greatest({share(0, 0)}, {share(1, 1)}) WHEN {times(b)} = {times(a)} + 1 THEN {share(1, 0)} WHEN {times(b)} = {times(a)} - 1 THEN {share(0, 1)} ELSE 0.0::DOUBLE END"


_SQL_WORDS = rf"list_distinct(list_filter(regexp_split_to_array(translate(%s, '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''))"
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r FROM documents),
n AS (SELECT count(*) AS n FROM d),
e AS (SELECT d.*, CAST(length(d.text) AS BIGINT) AS n_chars, substr(d.text, 1, length(d.text) - length(d.text) // 3) || substr(x.text, 1, length(d.text) // 3) AS edited, x.r AS next_r
  FROM d CROSS JOIN n JOIN d x ON x.r = d.r % n.n + 1),
v AS (SELECT r, 0 AS kind, {_SQL_WORDS % "text"} AS words FROM e UNION ALL SELECT r, 1, {_SQL_WORDS % "edited"} FROM e),
t AS (SELECT r, kind, unnest(words) AS term FROM v),
l AS (SELECT term, CAST('0x' || substr(md5(term), 1, 15) AS BIGINT) AS id FROM (SELECT term, count(*) AS df FROM t WHERE kind = 0 GROUP BY term) CROSS JOIN n WHERE df * {RARE} >= n AND df * {COMMON} <= n),
g AS (SELECT r, kind, list(id ORDER BY id) AS terms FROM t JOIN l USING (term) GROUP BY r, kind),
w AS (SELECT e.*, coalesce(g0.terms, []) AS terms0, coalesce(g1.terms, []) AS terms1,
    CASE WHEN len(v0.words) > 0 THEN md5(array_to_string(list_sort(v0.words), ' ')) ELSE '' END AS whole0, CASE WHEN len(v1.words) > 0 THEN md5(array_to_string(list_sort(v1.words), ' ')) ELSE '' END AS whole1
  FROM e JOIN v v0 ON v0.r = e.r AND v0.kind = 0 JOIN v v1 ON v1.r = e.r AND v1.kind = 1 LEFT JOIN g g0 ON g0.r = e.r AND g0.kind = 0 LEFT JOIN g g1 ON g1.r = e.r AND g1.kind = 1),
f AS (SELECT r, next_r, doc_id, n_chars, sha256(edited) AS edited_sha256, {_sql_fingerprint(0)} AS fingerprint, {_sql_fingerprint(1)} AS edited_fingerprint FROM w)
SELECT f.doc_id, f.n_chars, f.edited_sha256, f.fingerprint, f.edited_fingerprint, {_sql_likeness("f.fingerprint", "f.edited_fingerprint")} AS near_edited, {_sql_likeness("f.fingerprint", "x.fingerprint")} AS near_next
FROM f JOIN f x ON x.r = f.next_r"""
