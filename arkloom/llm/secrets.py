"""Secrets in text: fixed forms, and a battery of randomness tests with false-discovery control.

A token is reported if its randomness is not refuted and it is found to be unlike the text of the
corpus: what the battery has no power to refute, such as short words, is no discovery by itself.

Only DataFrame functions: no Python code runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, text_or_empty

# The forms that are always found.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the same matches as AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # the same matches as [0-9a-f]+ of 24 characters or more
#: What the battery tests: the longest runs of characters of one alphabet, from this length on
#: (below, four tests cannot refute an ordinary word). An inner = or a character of the other
#: alphabet ends a run; where both alphabets meet, a run of each is tested.
LEAST = 12
PADDING = r"(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
CANDIDATE = rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{{LEAST},}}{PADDING}"
CANDIDATE64 = rf"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{{{LEAST}}})[A-Za-z0-9]*+[+/][A-Za-z0-9+/]*{PADDING}"
KINDS = ("assign", "access", "hex", "random")

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Encodings by inference, narrowest first: what all characters must be, and the alphabet in the order of its values.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", LETTERS.upper() + "234567"),
    ("BASE36", r"^[A-Z0-9]+$", "0123456789" + LETTERS.upper()),
    ("base36", r"^[a-z0-9]+$", "0123456789" + LETTERS),
    ("base62", r"^[A-Za-z0-9]+$", "0123456789" + LETTERS.upper() + LETTERS),
    ("base64", r"^[A-Za-z0-9+/]+$", LETTERS.upper() + LETTERS + "0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", LETTERS.upper() + LETTERS + "0123456789-_"),
)
#: The letters of which prose in Latin script has most.
COMMON = "aehilnorst"
#: The characters of tokens, and the words that tell how characters follow each other in the
#: corpus: whole runs of these characters that are too short to be tested themselves.
SIGNS = "0123456789" + LETTERS.upper() + LETTERS + "+/_-"
WORD = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{2,{LEAST - 1}}}+(?![A-Za-z0-9+/_-])"
#: Of the probability of a character behind another: the weight of the characters' own shares,
#: in occurrences, and the part that is given to all characters alike, so that a rare pair
#: alone is no proof of randomness.
PRIOR, EVEN = 66, 0.05
#: Share of false discoveries among the runs that are found not to be random, and among those
#: that are found not to be text.
FDR = 0.05
#: p-values are binned by their logarithm, in this many levels a decade down to 1e-20, each
#: taken for its largest value, so the counts that set the thresholds are few.
LEVELS, DECADES = 20, 20


def _spans(text: Column, pattern: str, kind: int, ok=None) -> Column:
    """All matches of the pattern as (start, kind, end) in code points.

    The texts between the matches and the matches themselves, laid end to end, give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if ok else found
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), second.alias("part"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,part:string>>")
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["gap"]) + F.char_length(x["hit"])).alias("at"),
            F.array_append(
                a["out"],
                F.struct(
                    (a["at"] + F.char_length(x["gap"])).alias("start"),
                    F.lit(kind).alias("kind"),
                    (a["at"] + F.char_length(x["gap"]) + F.char_length(x["hit"])).alias("end"),
                    x["part"].alias("part"),
                ),
            ).alias("out"),
        ),
    )["out"]
    return F.filter(walked, ok) if ok else walked


def _where(may: Column, spans: Column) -> Column:
    """The spans, looked for only where the text may hold any."""
    return F.when(may, spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,part:string>>"))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by the bounds of Borjesson and Sundberg (relative
    error of the smaller tail below 0.003, so that it holds for tiny p-values)."""

    def tail(z: Column) -> Column:
        a = F.abs(z)
        small = F.exp(F.lit(-0.5) * z * z) / F.lit(2.5066282746310002) / (F.lit(0.661) * a + F.lit(0.339) * F.sqrt(z * z + F.lit(5.51)))
        return F.when(z >= 0, small).otherwise(F.lit(1.0) - small)

    return _let(F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z)), tail)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _battery(token: Column, alphabet: Column, common: Column) -> Column:
    """The smallest p-value of the tests of the hypothesis that the token is random over the
    alphabet, times their number: chi-squared uniformity, runs above and below the middle,
    serial correlation with the next character, and the number of letters that are common in
    prose, where the alphabet has such. The token has no padding.

    Values are the characters' places in the alphabet. Uniformity and common letters are
    one-sided (natural text repeats characters), the others are two-sided.
    """
    t, n, size = token, F.char_length(token).cast("double"), F.char_length(alphabet).cast("double")
    characters = F.slice(F.split(t, ""), F.lit(1), F.char_length(t))
    squares = F.aggregate(F.array_distinct(characters), F.lit(0.0), lambda a, c: a + F.pow((n - F.char_length(F.replace(t, c, F.lit("")))).cast("double"), F.lit(2.0)))
    # Wilson and Hilferty: the cube root of chi-squared is nearly normal.
    spread = F.lit(2.0) / (F.lit(9.0) * (size - 1))
    cube = F.pow(F.greatest(squares * size / n - n, F.lit(0.0)) / (size - 1), F.lit(1 / 3))
    uniform = _upper_tail((cube - (F.lit(1.0) - spread)) / F.sqrt(spread))

    def of_runs(high: Column, runs: Column) -> Column:
        return _let(F.lit(2.0) * high * (n - high) / n, lambda e: F.when(e * (e - 1) > 0, F.abs(runs - e - 1) / F.sqrt(e * (e - 1) / (n - 1))).otherwise(F.lit(8.0)))

    def of_order(values: Column, mean: Column) -> Column:
        # Sums over the values v less their mean d: squares, products with the one before, those
        # above the middle, and runs of them.
        start = F.struct(F.lit(0.0).alias("power"), F.lit(0.0).alias("lagged"), F.lit(0.0).alias("high"), F.lit(1.0).alias("runs"), F.lit(None).cast("double").alias("last"))

        def step(a: Column, v: Column) -> Column:
            other = a["last"].isNotNull() & ((a["last"] > 0) != (v > 0))
            lag = F.coalesce((a["last"] - mean) * (v - mean), F.lit(0.0))
            return F.struct((a["power"] + (v - mean) * (v - mean)).alias("power"), (a["lagged"] + lag).alias("lagged"), (a["high"] + (v > 0).cast("double")).alias("high"), (a["runs"] + other.cast("double")).alias("runs"), v.alias("last"))

        def tails(a: Column) -> Column:
            z = F.when(a["power"] > 0, F.abs(a["lagged"] / a["power"] + F.lit(1.0) / n) * F.sqrt(n)).otherwise(F.lit(8.0))
            return F.lit(2.0) * F.least(_let(of_runs(a["high"], a["runs"]), _upper_tail), _let(z, _upper_tail))

        return _let(F.aggregate(values, start, step), tails)

    places = F.transform(characters, lambda c: F.instr(alphabet, c).cast("double") - (size + 1) / 2)
    ordered = _let(places, lambda v: _let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n, lambda mean: of_order(v, mean)))
    share, k = F.char_length(common) / size, n - F.char_length(F.call_function("translate", t, common, F.lit("")))
    of_letters = F.when(common != "", _upper_tail((k - F.lit(0.5) - n * share) / F.sqrt(n * share * (F.lit(1.0) - share))))
    tests = F.when(common == "", F.lit(3.0)).otherwise(F.lit(4.0))
    return F.least(F.lit(1.0), tests * F.least(uniform, ordered, of_letters))


def level_of(p: Column) -> Column:
    """The level of a p-value: the higher, the smaller it is."""
    return F.floor(F.lit(float(-LEVELS)) * F.log10(F.greatest(p, F.lit(10.0**-DECADES)))).cast("int")


def successions(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The logarithm of each character's probability behind each other one, in the short words
    of all documents: that of ``SIGNS[j]`` behind ``SIGNS[i]`` at ``i * len(SIGNS) + j``.

    Only the counts of pairs leave the executors, at most len(SIGNS) squared rows. Without any
    word all characters are alike.
    """
    words = docs.select(F.explode_outer(F.regexp_extract_all(text_or_empty(text_col), F.lit(WORD), F.lit(0))).alias("word"))
    pairs = words.select(F.explode(F.array(*[F.substring("word", i, 2) for i in range(1, LEAST - 1)])).alias("pair")).filter(F.char_length("pair") == 2)
    counts = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, behind = dict.fromkeys(SIGNS, 0), dict.fromkeys(SIGNS, 1)
    for (a, b), n in counts.items():
        before[a] += n
        behind[b] += n
    total = sum(behind.values())

    def of(a: str, b: str) -> float:
        known = (counts.get(a + b, 0) + PRIOR * behind[b] / total) / (before[a] + PRIOR)
        return math.log((1 - EVEN) * known + EVEN / len(SIGNS))

    return [of(a, b) for a in SIGNS for b in SIGNS]


def _strangeness(token: Column, size: Column, model: Column) -> Column:
    """How much likelier the token is as random characters of an alphabet of ``size`` than as
    characters that follow each other as in the corpus, as a logarithm, less that of the number
    of encodings of which one was inferred.

    The expectation of this ratio over tokens that do follow each other so is at most 1, so its
    inverse is a p-value of that hypothesis at any length (Markov's inequality).
    """
    places = F.transform(F.slice(F.split(token, ""), F.lit(1), F.char_length(token)), lambda c: F.instr(F.lit(SIGNS), c) - 1)

    def walk(even: Column) -> Column:
        start = F.struct(F.lit(-math.log(len(ENCODINGS))).alias("sum"), F.lit(None).cast("int").alias("last"))

        def step(a: Column, v: Column) -> Column:
            gain = F.coalesce(even - F.get(model, a["last"] * len(SIGNS) + v), F.lit(0.0))
            return F.struct((a["sum"] + gain).alias("sum"), v.alias("last"))

        return F.aggregate(places, start, step)["sum"]

    return _let(-F.log(size.cast("double")), walk)


def level_of_ratio(ratio: Column) -> Column:
    """The level of the p-value ``exp(-ratio)``, see :func:`level_of`."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(LEVELS * DECADES)), ratio * (LEVELS / math.log(10))))).cast("int")


def _tested(spans: Column, model: Column) -> Column:
    """(start, end, stratum, level, strange) of the candidates of an inferred encoding, whatever
    their mix of characters. The stratum is the encoding and the length, in quarters of its power
    of two; ``level`` is that of the battery, ``strange`` that of the test against text."""

    def one(s: Column) -> Column:
        return _let(F.regexp_replace(s["part"], "=+$", ""), lambda core: of(s, core))

    def of(s: Column, core: Column) -> Column:
        encoding = F.lit(None)
        for label, form, alphabet in reversed(ENCODINGS):
            common = "".join(c for c in COMMON if c in alphabet) or "".join(c for c in COMMON.upper() if c in alphabet)
            fitting = F.struct(F.lit(label).alias("name"), F.lit(alphabet).alias("alphabet"), F.lit(common).alias("common"))
            encoding = F.when(core.rlike(form), fitting).otherwise(encoding)
        return _let(encoding, lambda e: tested(s, core, e))

    def tested(s: Column, core: Column, e: Column) -> Column:
        band = F.floor(F.lit(4.0) * F.log2(F.char_length(core).cast("double"))).cast("string")
        p = F.when(e["name"].isNotNull(), _battery(core, e["alphabet"], e["common"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(e["name"], F.lit("/"), band).alias("stratum"), level_of(p).alias("level"), level_of_ratio(_strangeness(core, F.char_length(e["alphabet"]), model)).alias("strange"))

    return F.filter(F.transform(spans, one), lambda t: t["stratum"].isNotNull())


def thresholds(tested: DataFrame) -> dict[str, int]:
    """Of each stratum, the level from which on the hypothesis is refuted: of the battery's levels,
    that the token is random, of those of strangeness, that it is text.

    ``tested`` has one row per candidate (stratum, level) of all documents. Within a stratum,
    which holds tokens of one encoding and like length, the step-up rule of Benjamini and
    Hochberg takes the smallest level L whose largest p-value, 10 ** (-L / LEVELS), is at most
    FDR * (tokens from L on) / (all tokens): short tokens, whose tests have little power, do
    not share the threshold of long ones. The counts are at most LEVELS * DECADES + 1 rows
    for each of a few dozen strata.
    """
    counts = tested.groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"))
    beyond = F.sum("n").over(Window.partitionBy("stratum").orderBy(F.desc("level")))
    total = F.sum("n").over(Window.partitionBy("stratum"))
    passed = counts.select("stratum", "level", beyond.alias("beyond"), total.alias("total")).filter(F.pow(F.lit(10.0), F.col("level") / F.lit(float(-LEVELS))) <= F.lit(FDR) * F.col("beyond") / F.col("total"))
    return {r["stratum"]: r["level"] for r in passed.groupBy("stratum").agg(F.min("level").alias("level")).collect()}


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _item(start: Column, token: int, end: Column) -> Column:
    """In the order of these: by start, base spans first, then the longer first."""
    return F.struct(start.alias("start"), F.lit(token).alias("token"), (-end).alias("before"), end.alias("end"))


def _apart(items: Column) -> Column:
    """The tokens among the sorted ``items`` (see :func:`_item`) that meet no base span and lie in
    no longer such token, as spans of kind 3.

    Three walks, each linear in the items: tokens that a base span before them reaches go, then
    those that reach a base span behind them, then those that end where a token before does or
    sooner.
    """

    def walk(items: Column, first: int, keeps, moved) -> Column:
        start = F.struct(F.lit(first).alias("at"), F.array().cast("array<struct<start:int,token:int,before:int,end:int>>").alias("out"))
        return F.aggregate(items, start, lambda a, x: F.struct(moved(a["at"], x).alias("at"), F.when(keeps(a["at"], x), F.array_append(a["out"], x)).otherwise(a["out"]).alias("out")))["out"]

    base = lambda x: x["token"] == 0
    ahead = walk(items, 0, lambda at, x: base(x) | (at <= x["start"]), lambda at, x: F.when(base(x), F.greatest(at, x["end"])).otherwise(at))
    back = walk(F.reverse(ahead), (1 << 31) - 1, lambda at, x: base(x) | (x["end"] <= at), lambda at, x: F.when(base(x), F.least(at, x["start"])).otherwise(at))
    tokens = F.filter(F.reverse(back), lambda x: x["token"] == 1)
    outer = walk(tokens, 0, lambda at, x: x["end"] > at, lambda at, x: F.greatest(at, x["end"]))
    return F.transform(outer, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``spans``, arrays of (start, kind, end) sorted.

    ``base`` has the fixed forms (kinds 0 to 2 of ``KINDS``): the whole match is the span,
    places are code points, ends exclusive. ``spans`` has these and, as kind 3, the tokens of
    other forms that pass the battery: those whose randomness is not refuted and that are
    found not to be text, each at a false-discovery rate of ``FDR`` over all documents, and that
    lie in no base span and no longer such token. Where characters follow each other in the
    corpus as in a random token, as digits mostly do, nothing tells them apart and none is
    reported.

    A null text is an empty one, which has no spans. Null and repeated ids are kept, one
    result per row. An empty table gives no rows. Other columns are not looked at. One
    scan counts the successions of characters, a second one reads the whole texts again and
    leaves a narrow table, whose counts set the thresholds.
    """
    text = text_or_empty(text_col)
    low = F.lower(text)
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | low.rlike("api_?key")
    assign = _where(named, _spans(text, ASSIGN, 0, lambda s: F.char_length(s["part"]) >= 6))
    access = _where(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1))
    hexes = _where(text.rlike("[0-9a-f]{24}"), _spans(text, HEX, 2))
    runs = _where(text.rlike(f"[A-Za-z0-9_-]{{{LEAST}}}"), _spans(text, CANDIDATE, 3))
    runs64 = _where(text.rlike(f"[A-Za-z0-9+/]{{{LEAST}}}") & text.rlike("[+/]"), _spans(text, CANDIDATE64, 3))
    model = F.split(F.lit(",".join(map(repr, successions(docs, text_col)))), ",").cast("array<double>")
    found = docs.select(F.col(id_col).alias("id"), F.concat(assign, access, hexes).alias("base"), _tested(F.concat(runs, runs64), model).alias("tested"))
    found = keep(found.withColumn("base", F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))), "secrets")

    each = found.select(F.explode("tested").alias("t"))

    def refuted(t: Column, name: str, limits: dict[str, int]) -> Column:
        limit = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair]) if limits else F.create_map().cast("map<string,int>")
        return t[name] >= F.coalesce(F.try_element_at(limit, t["stratum"]), F.lit(LEVELS * DECADES + 1))

    ordered, strange = (thresholds(each.select("t.stratum", F.col("t")[name].alias("level"))) for name in ("level", "strange"))
    random = F.filter("tested", lambda t: ~refuted(t, "level", ordered) & refuted(t, "strange", strange))
    tagged = F.transform("base", lambda b: _item(b["start"], 0, b["end"]))
    items = F.array_sort(F.concat(tagged, F.transform(random, lambda t: _item(t["start"], 1, t["end"]))))
    more = F.when(F.size(random) > 0, _apart(items)).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return found.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", more)).alias("spans"))


def op5(docs: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
