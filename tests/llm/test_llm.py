import gzip
import hashlib
import json
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arkloom.llm import decontam, exact_dedup, html_text, near_dedup, packing, secrets, sharding, toxicity, url_lists, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, id string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, and columns with names that clash."""
    a = " ".join(f"w{i}" for i in range(60))
    texts = [a, a, a.replace("w59", "v"), a.replace("w1 ", "x "), None, "", "one two", "one two", "ü " * 30_000, "password = abcdef123 AKIA" + "A1" * 8 + " " + "0a1b" * 6]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", 0, "d", "x") for i, t in enumerate(texts)]
    rows += [rows[0], (None, "null id", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


def test_sharding(docs):
    rows = sharding.op1(docs).collect()
    assert len(rows) == 12 and {r["law"] for r in rows} == {"rows"}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min([*map(len, by.values()), 0]) <= 1
    assert sharding.op1(docs.limit(0)).count() == 0
    one = next(r for r in rows if r["doc_id"] == 6)
    assert (one["size"], one["text_crc32"]) == (15, zlib.crc32(b"one two"))


def test_shards_hold_whole_groups_and_the_mixture(spark):
    rng = random.Random(2)
    texts, groups = [], [1] * 3000 + [2] * 300 + [5] * 60 + [40] * 8 + [150, 130, 700]
    for g, n in enumerate(groups):
        texts += [f"text {g}"] * n
    rows = [(i, t, None if i % 17 == 0 else rng.choice(["a", "a", "a", "b", "c"])) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(table, 24).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) <= 1
    lying = {}
    for r in got:
        lying.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    split = [t for t, shards in lying.items() if len(shards) > 1]
    assert split == [f"text {len(groups) - 1}"]  # 700 rows exceed a shard of 223
    shares = {s: sum(r["source"] == s for r in got) / len(got) for s in ("a", "b", "c", None)}
    for v in by.values():
        v.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in v] == list(range(len(v))) and [r["fraction"] for r in v] == sorted(r["fraction"] for r in v)
        assert all(abs(sum(r["source"] == s for r in v) / len(v) - share) < 0.12 for s, share in shares.items())
    again = sharding.interleave(table.repartition(5, "text"), 24).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    # Without copies the order of fractions is cut as it is, so that the mixture is met closely.
    single = [(i, f"t{i}", "ab"[i % 5 == 0]) for i in range(2400)]
    for shard in range(24):
        rows = [r for r in sharding.interleave(spark.createDataFrame(single, "doc_id long, text string, source string"), 24).collect() if r["shard"] == shard] if shard < 2 else []
        assert not rows or (len(rows), sum(r["source"] == "b" for r in rows)) == (100, 20)


def test_groups_in_tight_room(spark):
    """Nearly nothing but groups: what does not fit is split, and row counts still agree."""
    texts = [f"g{g}" for g in range(40) for _ in range(7)]
    got = sharding.interleave(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"), 24).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(24)]
    assert len(got) == 280 and max(sizes) - min(sizes) <= 1
    assert sum(len({r["shard"] for r in got if texts[r["doc_id"]] == f"g{g}"}) == 1 for g in range(40)) >= 24


def test_page_text():
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use</div><article><h1>T &amp; U</h1><p>A  b<br>c</p><div class="ad">Buy</div><p>Short.</p></article><aside>x</aside><div id="comments">hi</div><form>f</form><footer>&copy;</footer>'
    assert html_text.main_text(page) == "T & U\nA b\nc\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    plain = "<div><a href=a>one</a></div>" * 5 + "<p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p>" + "<div><a href=b>two</a></div>" * 5
    assert html_text.main_text(plain) == ("word " * 40).strip() + "\n" + ("more " * 30).strip()


def test_page_text_beside_marks():
    body = ["word " * 30 + "end", "more " * 25 + "end", "Short.", "last " * 20 + "end"]
    divs = "".join(f"<div>{x}</div>" for x in body)
    want = "\n".join(body)
    for mark in ("<article><p>A teaser.</p></article>", "<article></article>", "<article><a href=x>Read on and on and on</a></article>"):
        assert html_text.main_text(f"{mark}{divs}") == html_text.main_text(f"{divs}{mark}") == want
    comment = "I think that " * 10 + "end"
    assert html_text.main_text(f"{divs}<article><p>{comment}</p></article>") == f"{want}\n{comment}"
    chrome = "<div>Today</div>"
    assert html_text.main_text(f"{chrome}<article>{divs}<nav>x</nav><nav>x</nav><nav>x</nav><p>Bye.</p></article>{chrome}") == f"{want}\nBye."
    assert html_text.main_text(f"<main><h1><a href=x>Title</a></h1>{divs}" + "<div><a href=y>Link</a></div>" * 5 + "</main>") == f"Title\n{want}"


def test_page_text_with_shorter_blocks_beside_the_article():
    """Blocks of names that no list has, beside a marked article that is longer."""
    article = "\n".join("word " * 40 + "end" for _ in range(5))
    marked = "<article>" + "".join(f"<p>{x}</p>" for x in article.split("\n")) + "</article>"
    block = '<div class="user-feedback"><p>' + "I liked it much " * 25 + "</p></div>"
    assert html_text.main_text(f"{marked}{block}") == html_text.main_text(f"{block}{marked}") == article
    assert html_text.main_text(f"{marked}<div>{marked}{block}</div>") == f"{article}\n{article}"
    # Together as long as the article: the mark may be wrong, and all stays.
    feedback = ("I liked it much " * 25).strip()
    assert html_text.main_text(f"{block}{marked}{block * 2}") == "\n".join([feedback, article, feedback, feedback])
    assert html_text.main_text(block) == feedback
    # Each of many teasers is shorter than what lies beside them.
    teasers = [f"Teaser {i} " + "and more " * 15 + "end" for i in range(9)]
    assert html_text.main_text(block + "".join(f"<article>{x}</article>" for x in teasers)) == "\n".join([feedback, *teasers])


def test_page_text_in_wrappers():
    body = ["word " * 30 + "end", "more " * 25 + "end", "Short."]
    inside = "".join(f"<p>{x}</p>" for x in body)
    want = "\n".join(body)
    for name, classes in [("article", "post category-advertising"), ("article", "post comments-open"), ("main", "has-sidebar"), ("main", "search"), ("div", "layout with-sidebar"), ("div", "post comments-open")]:
        assert html_text.main_text(f'<{name} class="{classes}">{inside}</{name}>') == want
    assert html_text.main_text(f'<main class="search"><article class="post notice">{inside}</article></main>') == want
    assert html_text.main_text(f'<div class="sidebar">{inside}<article class="post">{inside}</article>{inside}</div>') == "\n".join([want] * 3)
    assert html_text.main_text(f'<form id="page"><article>{inside}</article></form>') == want
    # What is foreign stays so, by a whole name or a compound of such names.
    ad = "Buy this now, " * 20
    for classes in ("ad", "x ads", "cookie-notice", "related-posts", "site-footer", "comment-list", "page-header"):
        assert html_text.main_text(f'<div class="{classes}">{ad}</div>{inside}') == want
    assert html_text.main_text(f'<article>{inside}</article><div id="comments"><article class="comment">{ad}</article></div>') == want
    assert html_text.main_text(f'<article>{inside}<article class="comment">{ad}</article></article>') == want
    # End tags that are left out, and elements that end themselves.
    for page in (
        f'<p class="notice">{ad}{inside}',
        f'<div><section class="related">{ad}</div>{inside}',
        f'<ul><li class="related">{ad}<ul><li>{ad}</ul>{ad}</ul>{inside}',
        f'<ul><li class="related">{ad}<li>{body[0]}<li>{body[1]}<li>{body[2]}</ul>',
        f'<dl><dt class="ad">{ad}<dd>{body[0]}<dd>{body[1]}<dd>{body[2]}</dl>',
        f'<table><tr class="ad"><td>{ad}<td>{ad}<tr><td>{body[0]}<tr><td>{body[1]}<tr><td>{body[2]}</table>',
        f'<table><tr><td class="ad">{ad}<table><tr><td>{ad}</table><td>{inside}</table>',
        f'<svg width="1" />{inside}',
        f'<svg/>{inside}<svg><path d="M0"/></svg>',
        f'<iframe src="x" />{inside}<iframe src=/a/></iframe>',
        f'<span class="ad">{ad}</span>{inside}</b></div>',
    ):
        assert html_text.main_text(page) == want, page


def brute_main_text(lines):
    """The definition, line by line: [(text, weight)] without marks."""
    sums = [sum(w for _, w in lines[i : i + html_text.WINDOW]) for i in range(len(lines))]
    out = []
    for i, (text, weight) in enumerate(lines):
        left = i
        while left > 0 and sums[left - 1] > 0:
            left -= 1
        right = i
        while right + 1 < len(lines) and sums[right + 1] > 0:
            right += 1
        inside = sums[i] > 0 and max(sums[left : right + 1]) > html_text.SURGE
        if inside and any(w for _, w in lines[left : i + 1]) and any(w for _, w in lines[i : right + 1]):
            out.append(text)
    return "\n".join(out)


def test_windows_surge_and_dive():
    rng, seen = random.Random(4), set()
    for _ in range(300):
        lines = []
        for _ in range(rng.randrange(1, 40)):
            n = rng.choice([0, 0, 0, 5, 20, 30, 60, 100])
            lines.append(("x" * n, n) if rng.random() < 0.6 else ("y" * (n + 1), 0))
        lines = [x for x in lines if x[0]]
        html = "".join(f"<div>{t}</div>" if w else f"<div><a href=u>{t}</a></div>" for t, w in lines)
        sums = [sum(w for _, w in lines[i : i + html_text.WINDOW]) for i in range(len(lines))]
        if max(sums, default=0) > html_text.SURGE:
            assert html_text.main_text(html) == brute_main_text(lines)
            seen.add(html_text.main_text(html) != "\n".join(t for t, _ in lines))
    assert seen == {True, False}


def test_page_text_of_all_rows(spark):
    body = "".join(f"<p>{w * 30}end</p>" for w in ("word ", "more "))
    want = "\n".join(f"{w * 30}end" for w in ("word ", "more "))
    pages = [body, None, "", body, f"<form action=x>{body}</form>", f"<form><h1>T</h1>{body}</form><div>out</div>", f"{body}<form>Name <p>{'comment here ' * 20}</p></form>"]
    pages += [f'<div class="{c}">{body}</div>' for c in ("layout-with-nav-top", "no-ads", "post share-enabled", "article-comments-open")]
    rows = [(None if i == 3 else i, None if i == 1 else "u", h, "x", 7) for i, h in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_text.op2(table).collect()}
    assert html_text.op2(table).count() == len(pages) and html_text.op2(table.limit(0)).count() == 0
    assert got[1] == (None, "", 0) and got[2] == ("u", "", 0) and got[5][1] == f"T\n{want}\nout"
    assert all(got[i] == ("u", want, len(want)) for i in (None, 0, 4, 6, 7, 8, 9, 10))


def test_hostile_markup_takes_linear_time():
    for bad in ("<a ", "<p class='", '<p class="a', "<!--", "<svg ", "</", "</p", "<script>", "=\"'<x ", "<li>"):
        began = time.process_time()
        html_text.main_text(bad * (1_000_000 // len(bad)))
        assert time.process_time() - began < 20, bad


def test_near_dedup(docs, monkeypatch):
    got = {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.op3(docs).collect()}
    ids = {k[0]: r["component_id"] for k, r in got.items()}
    assert [ids[i] for i in range(4)] == [0, 0, 0, 0] and ids[6] == ids[7] == 6 and ids[4] == 4 and ids[5] == 5 and ids[8] == 8
    assert got[(4, 0)]["kept"] and got[(8, 1)]["n_shingles"] == 1
    assert near_dedup.op3(docs.limit(0)).count() == 0
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert {(r["doc_id"], r["n_shingles"]): r for r in near_dedup.op3(docs).collect()} == got
    clash = docs.withColumn("_kept", F.lit(5))
    assert near_dedup.representatives(clash).columns == clash.columns


def test_near_dedup_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(90)]
    texts = [" ".join(f"r{i}_{k}" if rng.random() < rate else w for k, w in enumerate(base)) for i, rate in enumerate([0.015, 0.03] * 60)]
    sets = [near_dedup.shingles(t)[0] for t in texts]
    counts = near_dedup.shared_counts(sets)
    assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(120) for j in range(i))
    first = list(range(120))
    for _ in first:
        for i in range(120):
            for j in range(i):
                both = counts[i, j]
                if both * 100 >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    first[i] = first[j] = min(first[i], first[j])
    assert 1 < len(set(first)) < 120
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.op3(docs).collect()} == dict(enumerate(first))


def test_url_lists(spark, monkeypatch):
    caps = spark.createDataFrame([(1, "http://a.b.com/x", 5), (2, "http://a.b.com/x", 15), (3, "http://c.org/", 5), (4, None, 5), (5, "http://c.org/", None), (5, "http://c.org/", None)], "page_id long, url string, fetched_at long")
    entries = spark.createDataFrame([("l", "host:b.com", "add", 0), ("l", "host:b.com", "remove", 10), ("m", "url:c.org", "add", 5), ("m", None, "add", 1)], "list string, key string, action string, at long")
    got = {(r["page_id"], r["fetched_at"]): (r["n_active"], r["blocked"]) for r in url_lists.evaluate(caps, entries).collect()}
    assert got == {(1, 5): (1, True), (2, 15): (0, False), (3, 5): (1, True), (4, 5): (0, False), (5, None): (0, False)}
    clash = caps.select("*", F.lit("x").alias("lists"), F.lit("x").alias("key"), F.lit("x").alias("n"), F.lit("x").alias("Blocked"), F.lit("x").alias("at"))
    out = url_lists.evaluate(clash, entries)
    assert out.columns == ["page_id", "url", "fetched_at", "key", "n", "at", "n_active", "lists", "blocked"]
    assert {(r["page_id"], r["fetched_at"]): (r["n_active"], r["blocked"]) for r in out.collect()} == got
    days = [("l", "host:b.com", ("add", "remove")[d % 2], 3 * d) for d in range(400)] + [("k", "host:b.com", "add", 100), ("l", "host:c.org", "add", 7)]
    history = spark.createDataFrame(days, "list string, key string, action string, at long")
    times = spark.createDataFrame([(i, "http://a.b.com/x" if i % 5 else "http://c.org/", i * 7 % 1300) for i in range(600)], "page_id long, url string, fetched_at long")
    for most in (url_lists.BROADCAST_ROWS, 0):
        monkeypatch.setattr(url_lists, "BROADCAST_ROWS", most)
        for r in url_lists.evaluate(times, history).collect():
            at = r["fetched_at"]
            want = (["k"] if at >= 100 else []) + (["l"] if at < 1200 and at // 3 % 2 == 0 else []) if "b.com" in r["url"] else ["l"] * (at >= 7)
            assert r["lists"] == want and r["n_active"] == len(want)
    monkeypatch.setattr(url_lists, "BROADCAST_ROWS", 0)
    assert sorted(map(str, url_lists.evaluate(clash, entries).collect())) == sorted(map(str, out.collect()))
    assert url_lists.evaluate(caps.limit(0), entries).count() == 0 and url_lists.evaluate(caps, entries.limit(0)).filter("blocked").count() == 0


def brute_secrets(text):
    text = text or ""
    named = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in named.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, docs):
    more = ['é token: "x/y.z-1" secret:token: abcdefgh API_KEY==abcdef', "AKIA" * 8, "f" * 23 + " " + "f" * 24, "q" * 30, "7Fk2Zp9QxW4mT1vB8sLd3RhY6nCj0aGe"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in secrets.op5(rows).collect():
        want = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r["spans"].split(",")) or not want
    assert secrets.op5(docs.limit(0)).count() == 0


def test_random_tokens_are_found(spark):
    planted = {
        "aws_key=": "wJ4lrXUtnFEMI7K7MDENGbPxRfiCYzQ8vT2uHsLd",
        "AccountKey=": "q8Zx+T1vB7/sLd3RhY6nCj0aGe7Fk2Zp9QxW4mT1vB8=",
        "sig-": "Kd93/xVq+B7mZt0YpLw2Rj5Hc",
        "https://x.com/cb/": "Xk_3fQ-w9ZbV_7tLmR2c",
        "no_digit=": "ujzPdeIgxLdGncfBAepf",
        "digits=": "58203917460275931846",
        "short:": "k9Qx2ZvB7mWp",
    }
    rows = [(i, f"The {name}{token} of it") for i, (name, token) in enumerate(planted.items())]
    words = ["internationalisation", "straightforwardness", "considerationsthat", "interrelationships", "characteristically", "disproportionately"]
    rows += [(100 + i, f"Some {w} here") for i, w in enumerate(words * 20)]
    got = {r["doc_id"]: (r["base"], r["spans"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, token) in enumerate(planted.items()):
        a = 4 + len(name)
        assert any(s["start"] <= a and a + len(token) <= s["end"] for s in got[i][1] if s["kind"] == 3), name
    assert not any(spans for i, (_, spans) in got.items() if i >= 100)


def normal_tail(z):
    return math.erfc(max(-12.0, min(12.0, z)) / math.sqrt(2)) / 2


def plain_battery(token, alphabet, common):
    """The battery's p-value, test by test, with the exact normal tail."""
    n, size = len(token), len(alphabet)
    chi = sum(token.count(c) ** 2 for c in set(token)) * size / n - n
    spread = 2 / (9 * (size - 1))
    p = [normal_tail((max(chi, 0) / (size - 1)) ** (1 / 3) / spread**0.5 - (1 - spread) / spread**0.5)]
    v = [alphabet.index(c) + 1 - (size + 1) / 2 for c in token]
    high = sum(x > 0 for x in v)  # above the alphabet's middle
    runs = 1 + sum((a > 0) != (b > 0) for a, b in zip(v, v[1:]))
    v = [x - sum(v) / n for x in v]
    power = sum(x * x for x in v)
    z = abs(sum(a * b for a, b in zip(v, v[1:])) / power + 1 / n) * n**0.5 if power else 8
    e = 2 * high * (n - high) / n
    r = abs(runs - e - 1) / (e * (e - 1) / (n - 1)) ** 0.5 if e * (e - 1) > 0 else 8
    p += [2 * normal_tail(z), 2 * normal_tail(r)]
    if common:
        share = len(common) / size
        p.append(normal_tail((sum(c in common for c in token) - 0.5 - n * share) / (n * share * (1 - share)) ** 0.5))
    return min(1.0, len(p) * min(p))


def test_battery_equals_plain_python(spark):
    rng = random.Random(7)
    rows = []
    for name, form, alphabet in secrets.ENCODINGS:
        common = "".join(c for c in secrets.COMMON if c in alphabet) or "".join(c for c in secrets.COMMON.upper() if c in alphabet)
        for n in (12, 13, 19, 40, 300):
            few = rng.sample(alphabet, 3)
            rows += [(t, alphabet, common) for t in ("".join(rng.choices(alphabet, k=n)), "".join(rng.choices(few, k=n)), "".join(sorted(rng.choices(alphabet, k=n))), alphabet[0] * n)]
    table = spark.createDataFrame(rows, "token string, alphabet string, common string")
    got = table.select("*", secrets._battery(F.col("token"), F.col("alphabet"), F.col("common")).alias("p")).collect()
    assert len(got) == 180
    for r in got:
        want = plain_battery(r["token"], r["alphabet"], r["common"])
        assert r["p"] == pytest.approx(want, rel=0.004, abs=1e-30), r


def test_strangeness_equals_plain_python(spark):
    texts = ["The cat sat on it-or not", None, "", "a_b 42 averyverylongword ab\u00e9cd x", "The " * 50]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts, shares = Counter(), Counter(secrets.SIGNS)
    for t in texts:
        for w in re.findall(r"[A-Za-z0-9+/_-]+", t or ""):
            if len(w) < secrets.LEAST:
                counts.update(w[i : i + 2] for i in range(len(w) - 1))
    for pair, n in counts.items():
        shares[pair[1]] += n
    firsts, total, k = Counter(), sum(shares.values()), len(secrets.SIGNS)
    for pair, n in counts.items():
        firsts[pair[0]] += n

    def log_p(a, b):
        known = (counts[a + b] + secrets.PRIOR * shares[b] / total) / (firsts[a] + secrets.PRIOR)
        return math.log((1 - secrets.EVEN) * known + secrets.EVEN / k)

    model = secrets.successions(docs)
    assert model == pytest.approx([log_p(a, b) for a in secrets.SIGNS for b in secrets.SIGNS])
    for i in range(k):  # behind each character the probabilities add up to 1
        assert sum(math.exp(x) for x in model[i * k : (i + 1) * k]) == pytest.approx(1)
    tokens = ["The", "ThThThThThTh", "k9Qx2ZvB7mWp", "x", "a" * 5000]
    array = F.array(*[F.lit(x) for x in model])
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets._strangeness(F.col("t"), F.lit(62), array).alias("z")).collect()
    for r in got:
        t = r["t"]
        assert r["z"] == pytest.approx(sum(-math.log(62) - log_p(a, b) for a, b in zip(t, t[1:])) - math.log(len(secrets.ENCODINGS)))
    assert secrets.successions(docs.limit(0)) == pytest.approx([-math.log(k)] * k * k)
    far = spark.createDataFrame([(-5.0,), (0.0,), (3.0,), (1e9,)], "z double").select(secrets.level_of_ratio(F.col("z"))).collect()
    assert [r[0] for r in far] == [0, 0, math.floor(3 * 20 / math.log(10)), 400]


def test_ordinary_words_are_no_secrets(spark, docs):
    """Long words and compounds that the battery cannot refute one by one are like the text around
    them; tokens in their midst are not."""
    rng = random.Random(2)
    syllables = ["ein", "ver", "ch", "au", "eou", "vie", "une", "ge", "lich", "tion", "ment", "zupf", "quoi", "my", "rhyth", "syz", "gy"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(4000)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + 20]) + " " + "".join(rng.choices(syllables, k=4)) + "chen") for i in range(200)]
    tokens = {1000 + i: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20)) for i in range(20)}
    rows += [(i, f"ein {t} ver") for i, t in tokens.items()] + [(2000, None), (2001, ""), (None, "une vie")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"] for r in got if any(s["kind"] == 3 for s in r["spans"])}
    assert not {i for i in found if i < 1000} and len(found & set(tokens)) >= 18


def test_false_discoveries_in_a_skewed_stratum(spark):
    random_p = [(i + 0.5) / 20_000 for i in range(20_000)]
    far = [10 ** -(4.5 + i / 5) for i in range(60)]  # 0.3 % of the tokens are not random
    p = sorted(random_p + far)
    exact = max(i + 1 for i, x in enumerate(p) if x <= secrets.FDR * (i + 1) / len(p))
    rows = spark.createDataFrame([("s", x) for x in p], "stratum string, p double").withColumn("level", secrets.level_of(F.col("p"))).cache()
    limit = secrets.thresholds(rows.select("stratum", "level"))["s"]
    assert 60 <= exact <= 66 and exact - 3 <= rows.filter(F.col("level") >= limit).count() <= exact
    tails = spark.range(1).select(*[secrets._upper_tail(F.lit(z)).alias(f"z{i}") for i, z in enumerate((-2.0, 0.0, 3.0, 8.0))]).first()
    assert list(tails) == pytest.approx([0.9772499, 0.5, 0.0013498980, 6.2209606e-16], rel=0.004)


def test_exact_dedup(docs):
    got = exact_dedup.op6(docs).collect()
    assert len(got) == 12
    for r in got:
        if r["doc_id"] in (0, 1):
            assert (r["keep_id"], r["group_size"], r["kept"]) == (1, 3, r["doc_id"] == 1)
        if r["doc_id"] in (4, 5):
            assert (r["keep_id"], r["group_size"]) == (5, 2)
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 2, 3, 5, 7, 8, 9]
    salted = exact_dedup.verdicts(docs, hot_rows=1)  # every repeated digest is hot
    assert sorted(map(tuple, salted.select("id", "keep_id", "group_size", "kept").collect()), key=str) == sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=str)
    assert exact_dedup.groups_of_equal_texts(docs, hot_rows=1)[2].count() == 3
    clash = docs.select("*", F.lit(1).alias("_id"), F.lit(2).alias("_digest"), F.lit(3).alias("_place"))
    assert sorted(map(str, exact_dedup.distinct_documents(clash).collect())) == sorted(str(r) for r in kept.select("*", F.lit(1).alias("_id"), F.lit(2).alias("_digest"), F.lit(3).alias("_place")).collect())
    weak = lambda c: F.unhex(F.hex(F.char_length(c) % 2))  # noqa: E731  every digest stands for many texts
    a = {(r["id"], r["keep_id"], r["group_size"]) for r in exact_dedup.verdicts(docs, digest=weak).collect()}
    assert a == {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got}
    assert exact_dedup.op6(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rows = [(i, f"plain text number {i} of many" + (" you fool" if i % 4 == 0 else "")) for i in range(400)] + [(None, None), (400, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.op7(docs, labels).collect()
    assert len(got) == 402 and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert toxicity.clean_documents(docs, labels).count() == 302
    assert {r["predicted"] for r in toxicity.op7(docs, labels.limit(0)).collect()} <= {0, 1} and toxicity.op7(docs.limit(0), labels).count() == 0


def test_toxicity_of_pairs(spark):
    """Labels that no single term tells: an insult or a group's mention, but not both."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(300)}" for _ in range(20)] + ["fool"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult != group)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.op7(table, table).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == rows[r["doc_id"]][2] for r in held) > 0.97 * len(held)
    dealt = table.unionByName(table.limit(50)).repartition(7, "text")
    assert {(r["doc_id"], r["score"]) for r in toxicity.op7(dealt, table.repartition(5)).collect()} == {(r["doc_id"], r["score"]) for r in got}


def test_ids_equal_the_tokenizer_s():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder, rng = Tokenizer.from_file(path), packing.Encoder(path), random.Random(8)
    assert encoder.by_words
    planes = [(32, 127), (32, 127), (160, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0xE000, 0x10000), (0x10000, 0x30000), (0xE0000, 0xE0200)]
    odd = ["\u0130", "\u0958.", "'s", "'\u017f", "\u0301", "<|endoftext|>", "\u00a0", "\x0b", "\u2028", "I\u0307,", "\u03a3.", "\u1e9e", "\u00b2.", "\u01c5!", " ", " ", "\n", "\r\n"]

    def letter():
        kind = rng.random()
        if kind < 0.15:
            return rng.choice(odd)
        return rng.choice(packing.MARKS) if kind < 0.3 else chr(rng.randrange(*rng.choice(planes)))

    texts = ["".join(letter() for _ in range(rng.randrange(12))) for _ in range(20_000)]
    texts += ["DO\u011eRULTU\u0130, \u0130\u0130. \u0130\"", unicodedata.normalize("NFD", "\u00e9t\u00e9, \u00c9T\u00c9.")]
    for text in texts:
        assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids), ascii(text)


def test_known_words_are_bounded(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"w{i % 37}x, {'y' * 50} Ab." for i in range(200)]
    whole = packing.Encoder(path)
    want = [whole.encode(x) for x in texts]
    monkeypatch.setattr(packing, "KNOWN_WORDS", 10)
    encoder = packing.Encoder(path)
    assert [encoder.encode(x) for x in texts] == want
    assert len(encoder.words) <= 12 and len(encoder.words.old) <= 12


def test_little_padding():
    rng = random.Random(1)
    spread, skewed = [rng.randrange(1, 2049) for _ in range(3000)], [int(2048 * rng.random() ** 4) + 1 for _ in range(3000)]
    for lengths, most in ((spread, 1.02 * sum(spread) / 2048), (skewed, 1.02 * sum(skewed) / 2048), ([1500] * 10 + [600] * 10, 14), ([7] * 1000, 4), ([2048] * 3 + [1] * 2049, 5)):
        histogram = {}
        for n in lengths:
            histogram[n] = histogram.get(n, 0) + 1
        packs = packing.patterns(histogram)
        assert sum(many for many, _ in packs) <= most
        used = {}
        for many, sizes in packs:
            assert sum(sizes) <= 2048
            for size in sizes:
                used[size] = used.get(size, 0) + many
        assert used == histogram


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, 64, with_ids=True).collect()
    ids, sequences = {}, {}
    for r in sorted(rows, key=lambda r: r["start"]):
        ids.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"])) == r["ids_crc32"]
    for s in sequences.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for (doc, n), parts in ids.items():
        want = plain.encode(texts[doc] or "", add_special_tokens=False).ids + [1]
        copies = 2 if doc == 0 else 1
        assert n == len(want) and sum(len(p["ids"]) for p in parts) == copies * n
        if copies == 1:
            assert [i for p in parts for i in p["ids"]] == want
    assert packing.op8(docs.limit(0)).count() == 0


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        n = min(10, len(x))
        for j in range(len(x) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, monkeypatch):
    line = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, line), (2, "short item É"), (10, line + " nu"), (3, None), (4, "")]
    texts = [line.upper(), "x " + line.replace("zeta", "zeta,") + " y " + line, " ".join(line.split()[:9]), "a short item É b", "a short item é b", None, "", line * 200]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, line, "s")], "doc_id long, text string, th string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.op9(docs, bench).collect()
    assert len(got) == 10
    for r in got:
        n, hit, found = brute_hits(line if r["doc_id"] is None else texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    clash = docs.select("*", F.lit(1).alias("_id"), F.lit(2).alias("_th"), F.lit(3).alias("id"))
    kept = decontam.clean_documents(clash, bench)
    assert kept.columns == clash.columns and sorted(r["text"] or "" for r in kept.collect()) == ["", "", texts[2], texts[4]]
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)  # nothing is broadcast
    assert sorted(map(str, decontam.op9(docs, bench).collect())) == sorted(map(str, got))
    assert decontam.clean_documents(docs, bench).columns == docs.columns and decontam.op9(docs.limit(0), bench).count() == 0
    assert decontam.op9(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_archives_of_members_and_broken_ones(spark, tmp_path):
    records = [warc.record(i, f"http://a/{i}", f"body {i} ".encode() * 50, "d", None, None) for i in range(3)]
    whole = b"".join(map(gzip.compress, records))
    for name, data in (("members", whole), ("short", gzip.compress(b"".join(records))[:-20]), ("head", gzip.compress(records[0] + b"WARC/1.1\r\nWARC-Type")), ("other", gzip.compress(b"no archive\r\n\r\n")), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    found = lambda name: warc.normalise(spark, spark.createDataFrame([(f"file://{tmp_path / name}",)], "path string"), f"file://{tmp_path}/out")
    assert [(r["record_type"], r["target_uri"]) for r in found("members").orderBy("offset").collect()] == [("response", f"http://a/{i}") for i in range(3)]
    assert found("empty").count() == 0
    for name, words in (("short", "breaks off"), ("head", "breaks off"), ("other", "no WARC archive")):
        with pytest.raises(Exception, match=words):
            found(name)


def test_warc(spark, tmp_path):
    html = "é" * 100_000
    rows = [(1, "http://a/ b", "x" * 100), (2, None, "x" * 100), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", html), (7, "u", html), (None, "u", html), (2, None, "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    streams, index = warc.archive_pages(pages)
    got = sorted((tuple(r) for r in warc.read_records(index).collect()), key=lambda r: (r[0] or 0, r[1]))
    want = [(None, html, "revisit", 6)] + [(1, "x" * 100, "response", None), (2, "x" * 100, "revisit", 1), (2, "x" * 100, "revisit", 1), (3, "x" * 99, "response", None), (4, "x" * 99, "response", None), (5, "", "response", None), (6, html, "response", None), (7, html, "revisit", 6)]
    assert got == [(i, len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), k, f) for i, t, k, f in want]
    assert index.count() == streams.agg(F.sum("records")).first()[0] == 9
    # An archive for each record; the index beside each file says what the table says.
    streams, index = warc.archive_pages(pages, archive_bytes=0)
    assert streams.count() == 9 and sorted((tuple(r) for r in warc.read_records(index).collect()), key=lambda r: (r[0] or 0, r[1])) == got
    beside = {}
    for r in index.collect():
        beside.setdefault(r["path"], []).append({k: v for k, v in r.asDict().items() if k != "path"})
    for path, rows in beside.items():
        side = [json.loads(x) for x in open(path.removeprefix("file://") + ".idx")]
        assert side == sorted(rows, key=lambda r: r["offset"])
    ids = [r["record_id"] for r in index.collect()]
    assert len(set(ids)) == 9 and all(i.startswith("<urn:uuid:") for i in ids)
    assert warc.op10(pages.limit(0)).count() == 0


@pytest.mark.parametrize("k", (1, 5))
def test_labels_that_many_words_tell_only_together(k):
    """One of k insults or one of k groups, but not both: no single word and hardly a pair tells."""
    import numpy as np

    rng, out = random.Random(k), []
    for _ in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"f{rng.randrange(200)}" for _ in range(12)] + [f"i{rng.randrange(k)}z"] * a + [f"g{rng.randrange(k)}q"] * b
        out.append((toxicity.terms_of(" ".join(words), {}), float(a != b)))

    def flat(rows):
        return np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows]), np.array([x for t, _ in rows for x in t]), np.array([y for _, y in rows])

    machine = toxicity.fit(*flat(out[:4800]))
    rows, terms, labels = flat(out[4800:])
    at = machine.place[terms]
    raw, _ = toxicity._raw(rows[at >= 0], at[at >= 0], len(labels), machine.bias, machine.w, machine.v)
    assert np.mean((raw >= 0) == (labels > 0)) >= 0.97


def test_one_label_only(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    for value, predicted in ((0, 0), (1, 1)):
        labels = docs.selectExpr("doc_id", f"{value} AS toxic")
        assert {r["predicted"] for r in toxicity.op7(docs, labels).collect()} == {predicted}


def test_page_text_in_deep_markup_and_formulas():
    text = "word " * 60
    deep = "<div>" * 300 + '<p class="ad">' + "<b>" * 2000 + "Buy this now. " * 20 + "<p>" + text
    assert html_text.main_text(deep) == text.strip()
    assert html_text.main_text(f"<article><p>{text}Let <math><mi>x</mi><annotation>x</annotation></math> be").endswith("Let x be")


def plain_shards(rows, shards, seed=20240):
    """(id, shard, slot) of rows (id, text, source) by the steps of the docstring, in plain Python."""
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    mark = {i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest() for i, _, _ in rows}
    by_source, by_text, fraction, shard = {}, {}, {}, {}
    for i, t, s in sorted(rows, key=lambda r: mark[r[0]]):
        by_source.setdefault(s, []).append(i)
        by_text.setdefault(digest(t), []).append(i)
    for ids in by_source.values():
        fraction |= {i: (r + 0.5) / len(ids) for r, i in enumerate(ids)}
    rooms = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]

    def place(groups):
        for d, n in sorted(groups, key=lambda g: (-g[1], g[0])):
            s = max(range(shards), key=lambda k: (rooms[k], -k))
            shard[d] = s if n <= rooms[s] else None
            rooms[s] -= n if n <= rooms[s] else 0

    groups = {d: len(ids) for d, ids in by_text.items() if len(ids) > 1}
    bound = len(rows) // (shards * sharding.LARGE)
    place([g for g in groups.items() if g[1] > bound])
    small = sorted((d for d, n in groups.items() if n <= bound), key=lambda d: (min(fraction[i] for i in by_text[d]), d))
    room, all_small, start, cuts = sum(rooms), sum(groups[d] for d in small), 0, []
    for s in range(shards - 1):
        cuts.append(sum(rooms[: s + 1]) * all_small // max(room, 1))
    dealt = {}
    for d in small:
        s = sum(c <= start for c in cuts)
        dealt.setdefault(s, []).append(d)
        shard[d], start = s, start + groups[d]
    over = []
    for s, ds in dealt.items():
        if sum(groups[d] for d in ds) > rooms[s]:
            over.append(ds.pop())
        rooms[s] -= sum(groups[d] for d in ds)
    place([(d, groups[d]) for d in over])
    at = {i: shard.get(digest(t)) for i, t, _ in rows}
    order = lambda i: (fraction[i], mark[i])
    for s, i in zip((s for s in range(shards) for _ in range(rooms[s])), sorted((i for i in at if at[i] is None), key=order), strict=True):
        at[i] = s
    return {(i, s, k) for s in range(shards) for k, i in enumerate(sorted((i for i in at if at[i] == s), key=order))}


@pytest.mark.parametrize("shards, groups", [(24, [1] * 900 + [2] * 200 + [3] * 90 + [40] * 4 + [150]), (5, [7] * 40), (3, [1, 1])])
def test_placing_equals_plain_python(spark, shards, groups):
    rng = random.Random(shards)
    texts = [f"text {g}" for g, n in enumerate(groups) for _ in range(n)]
    rows = [(i, t, rng.choice(["a", "a", "b", "c", None])) for i, t in enumerate(texts)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == plain_shards(rows, shards)


def test_patterns_equal_placing_piece_by_piece():
    rng = random.Random(8)
    for length, n in ((10, 40), (64, 300), (64, 3), (2048, 1500)):
        sizes = [min(length, int(length * rng.random() ** rng.choice((1, 3))) + 1) for _ in range(n)]
        free = []  # of each open pack
        for size in sorted(sizes, reverse=True):
            most = max((f for f in free if f >= size), default=None)
            if most is None:
                free.append(length - size)
            else:
                free[free.index(most)] -= size
        packs = packing.patterns(Counter(sizes), length)
        assert sorted(free) == sorted(length - sum(p) for many, p in packs for _ in range(many))
        assert Counter(s for many, p in packs for s in p for _ in range(many)) == Counter(sizes)


def test_shuffled_paths_of_copies(spark, docs, monkeypatch):
    """What is broadcast where it is small gives the same rows where it is shuffled."""
    pages = spark.createDataFrame([(i, "u", f"{i % 7}" * 150) for i in range(60)] + [(None, None, None), (60, "u", "short"), (61, "u", "short")], "page_id long, url string, html string")
    plans = []
    for most in (200_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", most)
        plans.append([sorted(map(str, df.collect())) for df in (warc.op10(pages), exact_dedup.op6(docs), exact_dedup.distinct_documents(docs))])
    assert plans[0] == plans[1] and [len(x) for x in plans[0][:2]] == [63, 12]
