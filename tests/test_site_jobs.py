"""Site jobs on what is overlapping, repeated, broken or large."""

import json
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arkloom.functions import urls
from arkloom.operators import captures, content, site
from arkloom.plans import catalog
from arkloom.sources import tables
from arkloom.streaming import jobs
from arkloom.work import BATCH_BYTES

ENTRY = "original string, target string, local_path string, key_seq long"


def raw_rows(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "local_path string, content binary")


def test_styles_of_pages_become_local(spark):
    html = '<style>a{b:url(i.png)} c{d:url("/web/2013im_/http://a.com/d/i.png")} e{f:url(http://a.com/d/i.png#x)} g{h:url(no.png)}</style><p style="background:url(../d/i.png)">'
    pages = spark.createDataFrame([("t/d/a.html", "http://a.com/d/a", html)], "local_path string, url string, html string")
    known = spark.createDataFrame([("http://a.com/d/i.png", "t/d/i.png")], "key string, path string")
    out = site.clean_pages(pages, known, spark.createDataFrame([("a.com",)], "host string")).first()["html"]
    assert out == '<style>a{b:url("i.png")} c{d:url("i.png")} e{f:url("i.png#x")} g{h:url(no.png)}</style><p style="background:url(&quot;i.png&quot;)">'


def test_merging_adds_each_key_once(spark):
    schema = "original string, timestamp string, target string, target_ord int, local_path string, key_seq long"
    old = spark.createDataFrame([("http://a.com/x", "1", "t", 0, "t/x.html", 1)], schema)
    new = [("http://a.com/y", "2", "u", 1, "u/y.html", 1), ("http://a.com/y", "3", "t", 0, "t/y.html", 7), ("http://a.com/x", "4", "t", 0, "t/x.html", 2), ("http://a.com/z", "5", "t", 0, "t/x.html", 3)]
    for rows in (new, new[::-1]):
        got = captures.merge_manifest(old, spark.createDataFrame(rows, schema)).collect()
        assert {(r["original"], r["local_path"], r["timestamp"]) for r in got} == {("http://a.com/x", "t/x.html", "1"), ("http://a.com/y", "t/y.html", "3"), ("http://a.com/z", "t/x_2.html", "5")} and len(got) == 3


def test_map_of_overlapping_targets(spark):
    rows = [("http://a.com/y", "t", "t/y.html", 5, 0), ("http://a.com/y", "u", "u/y.html", 5, 1), ("http://a.com/z", "t", "t/z.html", 9, 0), ("http://a.com/z", "u", "u/z.html", 1, 1)]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, ENTRY + ", target_ord int")
        assert {r["key"]: r["path"] for r in site.build_url_map(table).collect()} == {"http://a.com/y": "u/y.html", "http://a.com/z": "u/z.html"}
        plain = table.drop("target_ord")  # without an order of targets their names settle ties
        assert {r["key"]: r["path"] for r in site.build_url_map(plain).collect()} == {"http://a.com/y": "u/y.html", "http://a.com/z": "t/z.html"}


def test_streamed_batches_give_the_links_of_one(spark, tmp_path):
    root = f"file://{tmp_path}"
    manifest = spark.createDataFrame([("http://a.com/", "t", "t/index.html", 1), ("http://a.com/s", "t", "t/s.html", 2)], ENTRY)
    external = spark.createDataFrame([("http://c.test/i.png", "t", "t/_external/i.png", 1), ("http://c.test/no.png", "t", "t/_external/no.png", 2)], ENTRY)
    scope = spark.createDataFrame([("a.com",)], "host string")
    page = b'<link rel="stylesheet" href="/s"><img src="http://c.test/i.png"><img src="http://c.test/no.png">'
    batches = [[("t/s.html", b"a{b:c}"), ("t/_external/i.png", b"\0")], [("t/index.html", page)], [("t/s.html", b"a{b:c}"), ("t/index.html", page)]]
    for rows in batches:
        raw_rows(spark, rows).coalesce(1).write.mode("append").parquet(f"{root}/raw")
        stream = spark.readStream.schema("local_path string, content binary").parquet(f"{root}/raw")
        jobs.clean_stream(stream, lambda: manifest, scope, f"{root}/clean", f"{root}/check", external=lambda: external).awaitTermination()
    got = {r["path"]: bytes(r["content"]) for r in spark.read.parquet(f"{root}/clean").collect()}
    assert spark.read.parquet(f"{root}/clean").count() == 3
    whole = site.clean_site(manifest, raw_rows(spark, batches[0] + batches[1]), scope, external=external).collect()
    assert got == {r["path"]: bytes(r["content"]) for r in whole}
    assert b'href="s.css"' in got["t/index.html"] and b'src="_external/i.png"' in got["t/index.html"] and b'src="http://c.test/no.png"' in got["t/index.html"]


# --- elements that go -----------------------------------------------------------------


def tree_without(html):
    """The page without toolbar elements, by a tree: [name, start tag, children, end tag]."""
    root = ["", "", [], ""]
    stack = [root]
    for token in re.findall(r"<[^>]*>|[^<]+", html):
        name = re.sub(r"^</?([a-z]*).*", r"\1", token)
        if not token.startswith("<"):
            stack[-1][2].append(token)
        elif token.startswith("</"):
            if any(x[0] == name for x in stack[1:]):
                while stack.pop()[0] != name:
                    pass
                (stack[-1][2][-1])[3] = token
            else:
                stack[-1][2].append(token)
        else:
            node = [name, token, [], ""]
            stack[-1][2].append(node)
            if name not in ("br", "img") and not token.endswith("/>"):
                stack.append(node)

    def shown(node):
        if isinstance(node, str):
            return node
        return "" if "wm-ipp" in node[1] else node[1] + "".join(map(shown, node[2])) + node[3]

    return shown(root)


def test_elements_end_with_their_parents():
    clean = lambda x: content._rewritten(x, [], None, None, False)
    assert clean('<body><div id="wm-ipp">bar<p>Article<div>more</div></body></html>') == "<body></body></html>"
    assert clean('<div><div id="wm-ipp"><p>x</div>Text</div>') == "<div>Text</div>"
    assert clean('<ul><li id="wm-ipp"><b>x</ul>Text') == "<ul></ul>Text"
    assert clean('<p>a<div id="wm-ipp"/>b<br>c') == "<p>ab<br>c"
    rng = random.Random(6)
    some = ["<div>", "</div>", "<p>", "</p>", "<ul>", "</ul>", "<b>", "</b>", "<br>", "<img/>", "text", '<div id="wm-ipp">', '<p id="wm-ipp">', '<b id="wm-ipp"/>', "</i>"]
    for _ in range(4000):
        page = "".join(rng.choice(some) for _ in range(rng.randint(1, 25)))
        assert clean(page) == tree_without(page), page


# --- captures -------------------------------------------------------------------------


def capture_table(spark, urls_, times=("2012", "2013", "2014")):
    rows = [(k, u, u, f"{t}0601000000", "200", "text/html" if k % 3 else "image/png") for k, (u, t) in enumerate((u, t) for u in urls_ for t in times)]
    return spark.createDataFrame(rows, "seq long, urlkey string, original string, timestamp string, statuscode string, mimetype string")


def test_many_targets_equal_single_ones(spark, monkeypatch):
    hosts = ["a.com", "www.a.com", "b.a.com", "b.org", "x.b.org", "c.net"]
    table = capture_table(spark, [f"http://{h}{p}" for h in hosts for p in ("/", "/d/x", "/d/y.png", "/de/z?k=1")])
    targets = [captures.Target(f"t{n}", u, m, since, until, html, inc, exc) for n, (u, m, since, until, html, inc, exc) in enumerate([
        ("a.com", "domain", "", "", True, (), ()), ("b.a.com", "domain", "2013", "", False, (), ("/de/",)), ("http://a.com/d", "prefix", "", "2013", False, (), ()),
        ("c.net/d/x", "exact", "", "", False, (), ()), ("http://b.org/", "host", "2013", "2014", True, ("x$", "k=1"), ()), ("b.org/", "prefix", "", "", False, ("/d/",), ("png$",)), ("b.org:80", "domain", "", "", False, (), ()),
    ])]
    few = {(r["seq"], r["target"], r["target_ord"]) for r in captures.of_targets(table, tuple(targets)).collect()}
    monkeypatch.setattr(captures, "MOST_EXPRESSIONS", 2)
    for most in (200_000, 0):
        monkeypatch.setattr(captures, "broadcast_if_small", lambda df, most=most: F.broadcast(df) if most else df)
        rows = captures.of_targets(table, tuple(targets)).collect()
        assert {(r["seq"], r["target"], r["target_ord"]) for r in rows} == few and len(rows) == len(few) > 50
    size = lambda n: len(captures.of_targets(table, tuple(captures.Target(f"t{k}", f"h{k}.com") for k in range(n)))._jdf.queryExecution().analyzed().toString())
    assert size(2000) < 1.2 * size(3)


def test_windows_and_sites_reach_the_scan(spark, tmp_path):
    table = capture_table(spark, [f"http://www{k}.h{k}.com/p" for k in range(40)])
    tables.write_captures(table, f"file://{tmp_path}/c")
    written = spark.read.parquet(f"file://{tmp_path}/c")
    targets = (captures.Target("a", "h3.com", since="2013", until="2013"), captures.Target("b", "www5.h5.com", "host", since="2014", html_only=False, until="2014"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    got = captures.of_targets(written, targets)
    pushed = re.search(r"PushedFilters: \[(.*)", got._jdf.queryExecution().toString())[1]
    assert "GreaterThanOrEqual(timestamp,20130000000000)" in pushed and "LessThanOrEqual(timestamp,20149999999999)" in pushed and "StringStartsWith(site,com.h3.)" in pushed
    assert {(r["original"], r["timestamp"][:4]) for r in got.collect()} <= {("http://www3.h3.com/p", "2013"), ("http://www5.h5.com/p", "2014")} and got.count() > 0
    assert {r["target"] for r in captures.of_targets(table, targets).collect()} == {r["target"] for r in got.collect()}


def test_captures_are_read_once_and_pages_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    counted = counted.asNondeterministic()
    table = capture_table(spark, [f"http://a.com/{k % 7}/{k}" for k in range(30)] + ["http://a.com/1/", "http://a.com/1"])
    settings = captures.Settings(snapshot="first", targets=(captures.Target("t", "a.com", html_only=False),))
    manifest = captures.build_manifest(table.withColumn("original", counted("original")), settings)
    assert manifest.count() == 31 and seen.value == table.count()
    for job in (
        lambda pages: site.classify_links(site.resolved_links(pages), spark.createDataFrame([("k", "p")], "key string, path string"), scope),
        lambda pages: site.external_references(pages, scope, spark.createDataFrame([("k",)], "key string"), "local_path"),
        lambda pages: site.inscope_references(pages, scope, spark.createDataFrame([("k",)], "key string"), "local_path"),
    ):
        scope = spark.createDataFrame([("a.com",)], "host string")
        pages = spark.createDataFrame([(f"t/{k}.html", f"http://a.com/{k}", f'<a href="/{k}"><img src="http://c.test/{k}.png"><img src="http://a.com/{k}.png">') for k in range(20)], "local_path string, url string, html string").repartition(3)
        before = seen.value
        assert job(pages.withColumn("html", counted("html"))).count() == 20
        assert seen.value - before == 20


def test_long_responses_are_read_by_lines(spark, tmp_path):
    head = ["urlkey", "timestamp", "original", "statuscode", "mimetype", "digest"]
    for f in range(3):
        rows = [head, *([f"k{f}", f"{2000 + n}", f"http://a.com/{f}/{n}?x=],[", "200", "text/html", "d"] for n in range(400)), ["short"], [], ["resume"]]
        (tmp_path / f"{f}.json").write_text("[" + ",\n".join(json.dumps(r) for r in rows) + "]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        by_lines = tables.read_cdx(spark, f"file://{tmp_path}", lines=True)
        assert by_lines.rdd.getNumPartitions() > 5
        got = [r["original"] for r in by_lines.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [r["original"] for r in tables.read_cdx(spark, f"file://{tmp_path}").orderBy("seq").collect()] == [f"http://a.com/{f}/{n}?x=],[" for f in range(3) for n in range(400)]
    (tmp_path / "0.json").write_text(json.dumps([head, ["a"] * 6, ["b"] * 6]))
    with pytest.raises(Exception, match="not one row"):
        tables.read_cdx(spark, f"file://{tmp_path}", lines=True).collect()


def test_a_large_tangled_family_is_no_group(spark):
    n = 30_000  # rows of one name, and names with every third number
    rows = spark.range(n).select((F.col("id") * 2).alias("n"), F.lit("a.html").alias("path"))
    names = spark.range(2, n).filter("id % 3 = 0").select((F.hash("id") % n + n).alias("n"), F.concat(F.lit("a_"), F.col("id").cast("string"), F.lit(".html")).alias("path"))
    table = rows.union(names).selectExpr("n * 100000 + (CASE WHEN path = 'a.html' THEN 0 ELSE 1 + pmod(hash(path), 99999) END) AS n", "path", "'p' AS prefix")
    got = captures.dedupe_paths(table, "n")
    assert "Pandas" not in got._jdf.queryExecution().toString()
    found = [(r["n"], r["path"]) for r in got.collect()]
    taken, want = set(), []
    last = {}
    for at, name in sorted((r["n"], r["path"]) for r in table.collect()):
        k, new = last.get(name, 1), name
        while new in taken:
            k += 1
            new = f"{name[:-5]}_{k}.html"
        last[name] = k
        taken.add(new)
        want.append((at, new))
    assert sorted(found) == sorted(want)


# --- the clean site -------------------------------------------------------------------


def test_only_buckets_with_stale_pages_are_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}/clean"
    schema = "target string, path string, media string, content binary, title string"
    row = lambda p, m, c: ("t", p, m, bytearray(c), "u")
    tables.write_clean(spark.createDataFrame([row(f"t/{k}.html", "html", b"1") for k in range(100)], schema), path)
    files = lambda: {str(p.relative_to(tmp_path)) for p in (tmp_path / "clean").rglob("*.parquet")}
    before = files()
    tables.write_clean(spark.createDataFrame([row("t/7.css", "css", b"2"), row("t/8.html", "html", b"2")], schema), path)
    gone = {f.rsplit("/", 1)[0] for f in before - files()}
    assert len(gone) == 1
    got = {r["path"]: bytes(r["content"]) for r in spark.read.parquet(path).collect()}
    assert got == {f"t/{k}.html": b"1" for k in range(100) if k != 7} | {"t/7.css": b"2"}


def test_recleaning_reads_the_index_only(spark, tmp_path):
    manifest = spark.createDataFrame([(f"http://a.com/{k}", "t", f"t/{k}.html", k) for k in range(6)], ENTRY)
    external = spark.createDataFrame([("http://c.test/1.png", "t", "t/_external/1.png", 1)], ENTRY)
    scope = spark.createDataFrame([("a.com",)], "host string")
    raw = [(f"t/{k}.html", f'<img src="http://c.test/{k % 3}.png">'.encode()) for k in range(4)] + [("t/5.html", b"a{b:url(http://c.test/1.png)}")]
    clean = site.clean_site(manifest, raw_rows(spark, raw), scope, inject=False)
    rows = clean.select(F.col("path").alias("local_path"), F.decode("content", "UTF-8").alias("html"), "media")
    index = f"file://{tmp_path}/index"
    tables.write_references(site.reference_index(rows.filter("local_path < 't/2'")), index)
    tables.write_references(site.reference_index(rows.filter("local_path >= 't/2'")), index)
    obtained = spark.createDataFrame([("http://c.test/1.png#x",)], "original string")
    now = raw_rows(spark, [*raw, ("t/_external/1.png", b"\0")])
    kept = site.reclean_affected(None, obtained, manifest, now, scope, external=external, index=spark.read.parquet(index)).collect()
    parsed = site.reclean_affected(rows, obtained, manifest, now, scope, external=external).collect()
    assert {r["path"]: bytes(r["content"]) for r in kept} == {r["path"]: bytes(r["content"]) for r in parsed}
    assert {r["path"] for r in kept} == {"t/1.html", "t/5.css"} and all(b"_external/1.png" in bytes(r["content"]) for r in kept)


def test_listings_are_in_order(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit("u")).otherwise(F.lit("t")).alias("target"), F.concat(F.lit("p"), F.lpad((F.col("id") * 7919 % 3000).cast("string"), 5, "0")).alias("rel_path"), F.lit("x").alias("title"), F.lit(1).alias("n_pages"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_index(rows, f"file://{tmp_path}/index")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "index" / "target=t").glob("*.parquet"))
    read = [r["rel_path"] for p in parts for r in spark.read.parquet(f"file://{p}").collect()]
    assert len(parts) > 1 and read == sorted(read) and len(read) == 2700


def test_what_a_wave_says_twice_and_hosts_that_are_left_out(spark):
    hosts = [("", True), ("archive.org", True), ("web.archive.org", True), ("myarchive.org", False), ("archive.org.test", False)]
    got = spark.createDataFrame(hosts, "h string, want boolean").select(urls.is_archive_host(F.col("h")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    # A page and a stylesheet of one wave name the same base: the stylesheet's own time counts.
    page = [("t/a.html", '<iframe src="http://w.test/f"></iframe><link rel="stylesheet" href="http://s.test/s.css">')]
    pages = spark.createDataFrame(page, "local_path string, html string")
    archive = spark.createDataFrame([("http://w.test/f", bytearray(b'<img src="http://both.test/i.png">')), ("http://s.test/s.css", bytearray(b"a{b:url(http://both.test/i.png)}"))], "key string, content binary")
    scope, manifest = spark.createDataFrame([("a.com",)], "host string"), spark.createDataFrame([("http://a.com/",)], "key string")
    found = {r["original"]: r for r in site.discover_external(pages, scope, manifest, archive, "t").collect()}
    assert found["http://both.test/i.png"]["found_in"] == "http://s.test/s.css" and found["http://both.test/i.png"]["wave"] == 1 and len(found) == 3


def test_a_small_wave_does_not_move_a_large_manifest(spark, tmp_path):
    spark.range(5000).select(F.concat(F.lit("http://a.com/"), "id").alias("key"), F.lit(1).alias("_all"), F.concat(F.lit("t/p_"), "id", F.lit(".html")).alias("path")).write.parquet(f"file://{tmp_path}/m")
    manifest = spark.read.parquet(f"file://{tmp_path}/m")
    rows = spark.createDataFrame([("http://a.com/7", 1, "t/p_7.html", 1), ("http://a.com/x", 1, "t/q.html", 2), ("http://a.com/y", 1, "t/p_7.html", 3)], "key string, _all int, path string, n long")
    new = site.drop_known(rows, manifest)
    assert {r["key"] for r in new.collect()} == {"http://a.com/x", "http://a.com/y"}
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 or "BroadcastHashJoin" in plan[plan.index("LeftSemi") - 80 :]
    got = captures.dedupe_paths(new, "n", by=("_all",), used=manifest)
    assert {r["key"]: r["path"] for r in got.collect()} == {"http://a.com/x": "t/q.html", "http://a.com/y": "t/p_7_2.html"}


# --- memory of Python workers ---------------------------------------------------------


def test_references_of_many_pages_are_few_objects(spark):
    pages = [None, "", "<title>a &amp; b</title>"] + ["".join(f'<a href="/{n}/{k}" class="x">' for k in range(100)) for n in range(2000)]
    texts = pa.array(pages)
    tracemalloc.start()
    try:
        got = content.scan_html.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25e6  # 200,000 references; as objects they take five times as much
    assert got.to_pylist() == [{"title": t, "refs": [dict(zip(("ord", "grp", "tag", "attr", "rel", "value"), r)) for r in refs]} for t, refs in (content._scanned(p or "") for p in pages)]


def test_pages_go_to_workers_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for step in (
        lambda pages: content.with_scan(pages),
        lambda pages: content.rewrite_pages(pages, spark.createDataFrame([], "id long, ord int, attr string, old string, new string, dead string"), ["id"]),
    ):
        spark.conf.unset(key)
        assert step(spark.createDataFrame([(1, "<a href=x>")], "id long, html string")).count() == 1
        assert spark.conf.get(key) == str(BATCH_BYTES)


# --- merging as captures arrive -------------------------------------------------------


def test_streamed_captures_give_the_pages_of_all(spark, tmp_path):
    # One URL by two schemes, of which the earlier capture counts; one page by two URLs.
    schema = "seq long, urlkey string, original string, timestamp string, statuscode string, mimetype string"
    row = lambda n, u, year: (n, u.split("//")[1], u, f"{year}0601000000", "200", "text/html")
    batches = [
        [row(1, "https://a.com/x", 2013), row(2, "https://a.com/y", 2013), row(3, "http://a.com/z", 2012)],
        [row(4, "http://a.com/x", 2012), row(5, "http://a.com/y", 2012), row(6, "https://a.com/y?ref=1", 2014), row(7, "https://a.com/z", 2013)],
        [row(8, "https://a.com/x", 2011), row(9, "http://a.com/w", 2013), row(10, "https://a.com/y", 2014)],
    ]
    settings = captures.Settings(snapshot="first", ignore=("ref",), targets=(captures.Target("t", "a.com"),))
    whole = captures.build_manifest(spark.createDataFrame(sum(batches, []), schema), settings)
    want = sorted(r["key"] for r in whole.collect())
    assert want == ["http://a.com/w", "http://a.com/y", "http://a.com/z", "https://a.com/x", "https://a.com/y"]
    for k, order in enumerate((batches, batches[::-1])):
        root = f"file://{tmp_path}/{k}"
        for rows in order:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/captures")
            jobs.merge_stream(spark.readStream.schema(schema).parquet(f"{root}/captures"), settings, f"{root}/manifest", f"{root}/check").awaitTermination()
        got = jobs.merged_manifest(spark, f"{root}/manifest").collect()
        assert sorted(r["key"] for r in got) == want and len({r["local_path"] for r in got}) == 5


def test_references_of_all_pages_and_links_are_deduped(spark, tmp_path):
    # Links count beside what pages load; pages without html or URL load as others do.
    pages = [(0, "http://a.com/0", '<a href="http://a.com/2#x">'), (1, "http://a.com/1", None), (2, "http://a.com/2", '<a href="/web/2012/http://b.test/"><a href="/c">'), (3, None, "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plain, then = "https://web.archive.org/web/id_/", "https://web.archive.org/web/20130101000000"
    want = {("http://cdn0.test/lazy.png", f"{plain}http://cdn0.test/lazy.png", "asset", 0, 4), ("http://outside.test/x", f"{plain}http://outside.test/x", "asset", 0, 4)}
    want |= {(b, f"{then}im_/{b}", "asset", n, 1) for n in range(4) for b in [f"http://cdn{n % 3}.test/i{n}.png"]}
    want |= {(b, f"{then}if_/{b}", "iframe", n, 1) for n in range(4) for b in [f"http://widgets.test/w?id={n}"]}
    want |= {(b, f"{plain}{b}", "asset", n, 2) for n in range(2) for b in [f"http://cdn1.test/s.css?v={n}"]}
    want |= {(b, f"{then}/{b}#top", "asset", n, 1) for n in range(2) for b in [f"http://a.com/{n}"]}
    want |= {("http://a.com/2", f"{plain}http://a.com/2", "asset", 0, 2), ("http://b.test/", "https://web.archive.org/web/2012/http://b.test/", "asset", 2, 1)}
    got = catalog.QUERIES["dedupe_references"](spark, f"file://{tmp_path}").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
