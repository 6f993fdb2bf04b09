import json
import random
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from arkloom.functions import urls
from arkloom.operators import captures, content, site
from arkloom.sources import tables


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_normalize_url(spark):
    cases = {
        "HTTP://A.com:443//x//y/#f": "http://a.com/x/y", "http://a.com:80": "http://a.com/", "http://A.com./": "http://a.com/",
        "http://a.com/p?x=%41&y=&z": "http://a.com/p?x=%41&y=&z", "http://a.com/a%2Fb%20c": "http://a.com/a/b c", "http://a.com/a+b": "http://a.com/a+b",
        "http://a.com/%zz": "http://a.com/%zz", "http://a.com/a;p=1?q": "http://a.com/a?q", " http://a.com/p? ": "http://a.com/p", None: None,
    }
    got = values(spark, [(k,) for k in cases], "u string", urls.normalize_url(F.col("u")))
    assert [x for (x,) in got] == list(cases.values())
    ignore = {"http://a.com/p?v=1.0&method=X": "http://a.com/p?method=X", "http://a.com/p?x=%41&y=&z&v=1": "http://a.com/p?x=A&y=&z=", "http://a.com/p?v=1": "http://a.com/p"}
    got = values(spark, [(k,) for k in ignore], "u string", urls.normalize_url(F.col("u"), ("v",)))
    assert [x for (x,) in got] == list(ignore.values())


def test_references_resolve(spark):
    base = "http://a.com/x/y/z.html?q=1"
    refs = ["b.png", "../b.png", "../../../b", "/r/./s", "?k=2", "//c.com/d", "./", "..", "https://d.e/f#g", "x/../y?z#w"]
    got = values(spark, [(r, base) for r in refs], "r string, b string", urls.resolve_href(F.col("r"), F.col("b")))
    assert [x for (x,) in got] == [urljoin(base, r) for r in refs]
    odd = ["/web/2013im_/http://x/y", "https://web.archive.org/web/id_/http://x/", "#t", "mailto:a", "", None]
    got = values(spark, [(r, base) for r in odd], "r string, b string", urls.resolve_href(F.col("r"), F.col("b")), urls.unwrap_archive_url(F.col("r")))
    assert got[0] == ("http://x/y", "http://x/y") and got[1][1] is None and [g[0] for g in got[2:]] == [None] * 4


def test_relative_path(spark):
    rows = [("t/a/b.html", "t/c.css", "../c.css"), ("a.html", "b.html", "b.html"), ("t/a.html", "u/b/c", "../u/b/c"), ("a/b/c.html", "a/b/d", "d")]
    got = values(spark, rows, "f string, t string, e string", urls.relative_path(F.col("f"), F.col("t")), "e")
    assert all(a == b for a, b in got)


def test_local_paths(spark):
    originals = ["/", "/index.php", "/a", "/a/b.asp", "/p.php?k=1", "/i.png"]
    rows = spark.createDataFrame([(n, "http://h.com" + o, "") for n, o in enumerate(originals)], "n long, original string, prefix string")
    got = {r["original"][12:]: r["local_path"] for r in captures.assign_local_paths(rows, "n").collect()}
    assert got == {"/": "index.html", "/index.php": "index_2.html", "/a": "a/index.html", "/a/b.asp": "a/b.html", "/p.php?k=1": "p/k/1.html", "/i.png": "i.png"}


def sequential_paths(names, used):
    """The rule itself: one name after the other."""
    taken, out = set(used), []
    for name in names:
        html = name.endswith(".html")
        stem, n, found = name[:-5] if html else name, 1, name
        while found in taken:
            n += 1
            found = f"{stem}_{n}" + ".html" * html
        taken.add(found)
        out.append(found)
    return out


def test_unique_paths_equal_sequential_ones(spark):
    rng = random.Random(5)
    pools = [
        (["a.html", "a_2.html", "a_3.html", "b.png", "b.png_2", "c.html"], ["a.html", "c.html", "a_2_2.html"]),
        (["i", "i_2", "i_2_2", "i_3", "i_02", "i_1", "i.html_2", "i.html", "i_2.html"], []),
        ([f"n_{k}.html" for k in range(40)] + ["n.html"] * 3, ["n_7.html", "n.html"]),
        (["x.html"] * 3 + [f"y{k}" for k in range(20)], ["x_5.html"]),
    ]
    rows, there, want = [], [], {}
    for p, (pool, used) in enumerate(pools * 4):
        names = [rng.choice(pool) for _ in range(60)]
        want |= {(f"p{p}", i): x for i, x in enumerate(sequential_paths(names, used))}
        rows += [(i, x, f"p{p}", "kept") for i, x in enumerate(names)]
        there += [(f"p{p}", x) for x in used]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "n long, path string, prefix string, more string")
    got = captures.dedupe_paths(table, "n", used=spark.createDataFrame(there, "prefix string, path string"))
    assert got.columns == table.columns and {(r["prefix"], r["n"]): r["path"] for r in got.collect()} == want


def test_a_family_without_duplicates_needs_no_walk(spark):
    names = spark.range(100_000).select(F.col("id").alias("n"), F.concat(F.lit("p_"), "id", F.lit(".html")).alias("path"), F.lit("s").alias("prefix"))
    more = names.union(spark.createDataFrame([(100_000, "p_5.html", "s"), (100_001, "p_5.html", "s")], names.schema))
    got = captures.dedupe_paths(more, "n")
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
    assert got.select("path").distinct().count() == 100_002
    assert {r["n"]: r["path"] for r in got.filter("n >= 99999").collect()} == {99_999: "p_99999.html", 100_000: "p_5_2.html", 100_001: "p_5_3.html"}


def test_index_responses_become_a_manifest(spark, tmp_path):
    head = ["urlkey", "timestamp", "original", "statuscode", "mimetype", "digest"]
    row = lambda k, ts: [f"com,a)/{k}", ts, f"http://a.com/{k}", "200", "text/html", "d"]
    (tmp_path / "b.json").write_text(json.dumps([head, row("x", "20130101000000"), row("y", "20130101000000"), [], ["resume"]]))
    (tmp_path / "a.json").write_text(json.dumps([head, row("x", "20120101000000")]))
    (tmp_path / "c.json").write_text("[]")
    found = tables.read_cdx(spark, f"file://{tmp_path}")
    assert [(r["timestamp"], r["original"][-1]) for r in found.orderBy("seq").collect()] == [("20120101000000", "x"), ("20130101000000", "x"), ("20130101000000", "y")]
    settings = captures.Settings(snapshot="first", targets=(captures.Target("t", "a.com"), captures.Target("e", "http://a.com/y", match="exact")))
    got = captures.build_manifest(found, settings).orderBy("target_ord", "key").collect()
    assert [(r["target"], r["key"], r["timestamp"], r["local_path"]) for r in got] == [("t", "http://a.com/x", "20120101000000", "t/x.html"), ("t", "http://a.com/y", "20130101000000", "t/y.html"), ("e", "http://a.com/y", "20130101000000", "e/y.html")]


def test_closest_is_a_distance_of_digits(spark):
    rows = spark.createDataFrame([(0, "t", "k", "20130131000000"), (1, "t", "k", "20121231000000")], "seq long, target string, urlkey string, timestamp string")
    assert captures.select_snapshot(rows, "closest:201301").first()["seq"] == 0
    assert captures.select_snapshot(rows, "first").first()["seq"] == 1


def test_media(spark):
    cases = [(b"<!DOCTYPE html>", "a.html", "html"), (b"/*c*/ a{b:c}", "a.html", "css"), (b"var x", "a.html", "js"), (b"a\x00", "a.html", "binary"), (b"x", "a.gif", "binary"), (b"x", "a.txt", "other"), (b"", "a.html", "html")]
    rows = spark.createDataFrame([(bytearray(a), b, c) for a, b, c in cases], "content binary, local_path string, want string")
    assert all(r["media"] == r["want"] for r in content.with_media(rows).collect())


def test_clean_page(spark):
    html = (
        '<html><head><base href="x"><script src="https://web-static.archive.org/a.js"></script></head><body><!-- FILE ARCHIVED --><div id="wm-ipp"><div>bar</div></div>'
        '<script>var t="</p>";</script><a href="/b#f">b</a><a class="k" href="/gone">g</a><a href="http://o.test/">o</a><img src="/web/2013im_/http://c.test/i.png"></body></html>'
    )
    pages = spark.createDataFrame([("s/a.html", "http://a.com/a", html)], "local_path string, url string, html string")
    known = spark.createDataFrame([("http://a.com/b", "s/b.html")], "key string, path string")
    out = site.clean_pages(pages, known, spark.createDataFrame([("a.com",)], "host string"), css_href="/s.css", js_href="/s.js").first()["html"]
    assert '<head><link rel="stylesheet" href="/s.css"><script src="/s.js"></script></head>' in out
    assert "wm-ipp" not in out and "ARCHIVED" not in out and 'var t="</p>"' in out and "<base" not in out
    assert '<a href="b.html#f">b</a>' in out and 'href="#"' in out and 'data-broken="http://a.com/gone"' in out and 'class="k dead"' in out
    assert '<a href="http://o.test/">' in out and 'src="https://web.archive.org/web/2013im_/http://c.test/i.png"' in out


def rewritten(html, *edits):
    return content._rewritten(html, [dict(zip(("ord", "attr", "old", "new", "dead"), e)) for e in edits], None, None, False)


def test_edits_stand_where_they_belong():
    assert rewritten('<a title="go href=/b now" href="/b">', (0, "href", "/b", "x.html", None)) == '<a title="go href=/b now" href="x.html">'
    assert rewritten('<style>a{b:url(a.png)} c{d:url( "xa.png" )}</style>', (0, "text", "a.png", "../l/a.png", None)) == '<style>a{b:url("../l/a.png")} c{d:url( "xa.png" )}</style>'
    assert rewritten('<p style="b:url(a.png?x=1&amp;y=2)">', (0, "style", "a.png?x=1&y=2", "l/a.png", None)) == '<p style="b:url(&quot;l/a.png&quot;)">'
    assert rewritten("<a href=/x/ ><b>", (0, "href", "/x/", "#", "http://d/")) == '<a href="#" data-broken="http://d/" class="dead" ><b>'
    assert rewritten("<a class=k href='/y' id=z/>", (0, "href", "/y", "#", "http://e")) == '<a class="k dead" href="#" id=z/ data-broken="http://e">'


def test_titles_and_references_of_one_pass():
    assert content._scanned("<!-- <title>old</title> --><script>'<title>s</title>'</script><title> new &amp; x </title><h1>a</h1>")[0] == "new & x"
    assert content._scanned("<title></title><h1>x</h1>")[0] == ""
    assert content._scanned("<h1> a <b> b </b><!-- c -->d</h1>e")[0] == "abd"
    assert [r[3:] for r in content._scanned("<title>x<a href='/k&amp;l' rel=r>")[1]] == [("href", "r", "/k&l")]
    assert [r[5] for r in content._scanned('<script>"<img src=no>"</script><img src=a><textarea><img src=no></textarea><img src = "b">')[1]] == ["a", "b"]


def test_hostile_markup_takes_linear_time():
    for bad in ("<a ", "<p class='", '<p class="a', "<!--", "</", "<script>", "<title>", "<h1>", "=\"'<x ", '<a href="', "<a b= "):
        text, began = bad * (500_000 // len(bad)), time.process_time()
        content._scanned(text)
        content._rewritten(text, [], None, None, True)
        assert time.process_time() - began < 20, bad


def test_externals_are_numbered_in_order(spark):
    found = [(f"http://x.test/{'p' if k % 2 else 'P'}?{k}#f" if k % 100 == 0 else f"http://x.test/p_{k}", k) for k in range(1000)]
    refs = spark.createDataFrame(found, "base string, k long").select("base", F.concat(F.lit("https://web.archive.org/web/2013id_/"), "base").alias("fetch_url"), F.lit("asset").alias("kind"), F.lit("a").alias("found_in"), F.lit(1).alias("n_pages"), F.struct("k").alias("first"))
    got = site.external_entries(refs.repartition(7), "t").orderBy("key_seq").collect()
    assert [r["original"] for r in got] == [u for u, _ in found] and len({r["local_path"] for r in got}) == 1000
    assert got[5]["local_path"] == "t/_external/x.test/p_5.html" and got[5]["timestamp"] == "2013"


def test_no_broadcast_changes_nothing(spark, monkeypatch):
    import arkloom.work

    rows = spark.createDataFrame([(i, x, "p") for i, x in enumerate(["a", "a_2", "a", "b", "b", "a_2"])], "n long, path string, prefix string")
    want = [r["path"] for r in captures.dedupe_paths(rows, "n").orderBy("n").collect()]
    assert want == sequential_paths([r["path"] for r in rows.orderBy("n").collect()], [])
    for name in ("captures", "site"):
        monkeypatch.setattr(f"arkloom.operators.{name}.broadcast_if_small", lambda df, most=0: df, raising=False)
    monkeypatch.setattr(arkloom.work, "BROADCAST_ROWS", 0)
    assert [r["path"] for r in captures.dedupe_paths(rows, "n").orderBy("n").collect()] == want
    hosts, scope = spark.createDataFrame([("a.b.com",), ("c.org",)], "host string"), spark.createDataFrame([("b.com",)], "host string")
    for most in (0, 10):
        assert [r["host"] for r in site.in_scope(hosts, scope, most=most).collect()] == ["a.b.com"]


def test_stale_pages_go(spark, tmp_path):
    path = f"file://{tmp_path}/clean"
    row = lambda t, p, m, c: (t, p, m, bytearray(c), "u")
    schema = "target string, path string, media string, content binary, title string"
    tables.write_clean(spark.createDataFrame([row("t", "t/a.html", "html", b"1"), row("t", "t/b.html", "html", b"1"), row("u", "u/a.html", "html", b"1")], schema), path)
    tables.write_clean(spark.createDataFrame([row("t", "t/a.css", "css", b"2"), row("t", "t/b.html", "html", b"2"), row("u", "u/c.html", "html", b"2")], schema), path)
    got = {(r["path"], bytes(r["content"])) for r in spark.read.parquet(path).collect()}
    assert got == {("t/a.css", b"2"), ("t/b.html", b"1"), ("u/a.html", b"1"), ("u/c.html", b"2")}


def test_a_site_with_external_content(spark):
    manifest = spark.createDataFrame([("http://a.com/", "t", "t/index.html", 1), ("http://a.com/s", "t", "t/s.html", 2), ("http://a.com/f.bin", "t", "t/f.bin", 3), ("http://b.com/", "o", "o/index.html", 4)], "original string, target string, local_path string, key_seq long")
    external = spark.createDataFrame([("http://c.test/i.png", "t", "t/_external/c.test/i.png", 1), ("http://c.test/gone.png", "t", "t/_external/c.test/gone.png", 2)], "original string, target string, local_path string, key_seq long")
    page = '<title>T</title><link rel="stylesheet" href="/s"><img src="http://c.test/i.png"><img src="http://c.test/gone.png"><a href="http://a.com/f.bin">f</a>'
    raw = spark.createDataFrame([("t/index.html", bytearray(page.encode())), ("t/s.html", bytearray(b"a{b:url(http://c.test/i.png)}")), ("t/f.bin", bytearray(b"x")), ("t/_external/c.test/i.png", bytearray(b"\0")), ("o/index.html", bytearray(page.encode()))], "local_path string, content binary")
    scope = spark.createDataFrame([("a.com",), ("b.com",)], "host string")
    settings = captures.Settings(targets=(captures.Target("t", "a.com", localize_assets=True), captures.Target("o", "b.com")))
    out = {r["path"]: r for r in site.clean_site(manifest, raw, scope, external=external, settings=settings).collect()}
    assert set(out) == {"t/index.html", "t/s.css", "t/f.bin", "t/_external/c.test/i.png", "o/index.html"}
    html = bytes(out["t/index.html"]["content"]).decode()
    assert 'href="s.css"' in html and 'src="_external/c.test/i.png"' in html and 'src="http://c.test/gone.png"' in html and 'href="f.bin"' in html
    assert '<link rel="stylesheet" href="_style.css">' in html and '<script src="_site.js">' in html
    other = bytes(out["o/index.html"]["content"]).decode()
    assert 'src="http://c.test/i.png"' in other and 'href="../t/f.bin"' in other  # its assets stay, its links do not
    assert bytes(out["t/s.css"]["content"]) == b'a{b:url("_external/c.test/i.png")}'
    assert {p: r["title"] for p, r in out.items()} == {"t/index.html": "T", "t/s.css": "http://a.com/s", "t/f.bin": "http://a.com/f.bin", "t/_external/c.test/i.png": "http://c.test/i.png", "o/index.html": "T"}
    one = site.clean_site(manifest, raw, scope, external=external, settings=settings, target="o").collect()
    assert [r["path"] for r in one] == ["o/index.html"]
    assert [r["local_path"] for r in site.scannable(manifest.withColumn("local_path", F.when(F.col("key_seq") == 4, F.lit("o/_i.html")).otherwise(F.col("local_path"))), raw).orderBy("local_path").collect()] == ["t/index.html", "t/s.html"]


def test_tables_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [("http://a.com/b", "http://a.com/b", "2013", "w", "t/b.html", "t", None), ("http://a.com/a", "http://a.com/a", "2013", "w", "t/a.html", "t", None), ("http://c.com/", "http://c.com/", "2013", "w", "u/index.html", "u", "asset")]
    manifest = spark.createDataFrame(rows, tables.MANIFEST)
    tables.write_manifest(manifest, f"{root}/manifest")
    back = tables.read_manifest(spark, f"{root}/manifest")
    assert {tuple(r[c] for c in manifest.columns) for r in back.collect()} == set(rows)
    (tmp_path / "m.json").write_text(json.dumps([dict(zip(manifest.columns, r)) for r in rows[:1]], indent=2))
    assert [tuple(r) for r in tables.read_manifest(spark, f"{root}/m.json").collect()] == rows[:1]
    assert tables.read_manifest(spark, f"{root}/none", may_be_missing=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_manifest(spark, f"{root}/none")
    (tmp_path / "raw" / "t" / "x").mkdir(parents=True)
    (tmp_path / "raw" / "t" / "x" / "a.png").write_bytes(b"\x89")
    assert [(r["local_path"], bytes(r["content"])) for r in tables.read_raw(spark, f"{root}/raw").collect()] == [("t/x/a.png", b"\x89")]
    index = site.page_index(spark.createDataFrame([("t", "t/b.html", "B"), ("t", "t/a.html", "A"), ("u", "u/index.html", "U")], "target string, local_path string, title string"))
    tables.write_index(index, f"{root}/index")
    assert sorted((r["target"], r["rel_path"], r["title"], r["n_pages"]) for r in spark.read.parquet(f"{root}/index").collect()) == [("t", "a.html", "A", 2), ("t", "b.html", "B", 2), ("u", "index.html", "U", 1)]


def test_what_external_discovery_leaves_out(spark):
    html = '<img src="https://web-static.archive.org/x.png"><img src="http://archive.org/y.png"><img src="http://ads.test/z.png"><img src="http://a.com/own.png"><img src="http://c.test/known.png"><img src="http://c.test/new.png#f"><img src="data:x"><img src="rel.png"><a href="http://c.test/page">p</a>'
    pages = spark.createDataFrame([("t/a.html", html)], "local_path string, html string")
    scope, known = spark.createDataFrame([("a.com",)], "host string"), spark.createDataFrame([("http://c.test/known.png",)], "key string")
    got = site.external_references(pages, scope, known, "local_path", exclude=(r"ads\.",)).collect()
    assert [(r["base"], r["fetch_url"], r["kind"], r["found_in"], r["n_pages"]) for r in got] == [("http://c.test/new.png", "https://web.archive.org/web/id_/http://c.test/new.png", "asset", "t/a.html", 1)]


def test_redirects_and_broken_bytes(spark):
    html = '<head><meta http-equiv="Refresh" content="0;url=x"></head><script>a(1,["NoscriptOverride","redirectToJSPage",[],["u"]]);</script><p>x'
    kept, gone = content._rewritten(html, [], None, None, False), content._rewritten(html, [], None, None, True)
    assert kept == html and gone == "<head></head><script>a(1);</script><p>x"
    one = spark.createDataFrame([(bytearray(b"a\xffb"),)], "c binary").select(content.decode_text(F.col("c"))).first()[0]
    assert one == "a\ufffdb"
