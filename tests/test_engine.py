"""Index, ranking, search, suggestions, pages, urls, crawl, store, streaming, API."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom import api
from textloom.functions import urls
from textloom.operators import crawl, index, pages, rank, search
from textloom.sources import corpus, shared
from textloom.streaming.ingest import ingest, stored


def tokens_index(spark, docs):
    return index.from_tokens(spark.createDataFrame(list(docs.items()), "document_id string, tokens array<string>"))


def scores(df):
    return [(r["document_id"], r["score"]) for r in df.collect()]


def test_bm25_values(spark):
    docs = {"doc1": "databas databas system", "doc2": "databas filler extra word more padding content", "doc3": "system network"}
    built = tokens_index(spark, {k: v.split() for k, v in docs.items()})
    got = scores(rank.top(rank.rank(built, ["databas"]), 10))
    assert [d for d, _ in got] == ["doc1", "doc2"]
    assert [s for _, s in got] == pytest.approx([0.7301027250419194, 0.3514045826136341], abs=1e-12)
    assert rank.rank(built, []).count() == 0 and rank.rank(built, ["absent"]).count() == 0


def test_phrases(spark):
    built = tokens_index(spark, {"docExact": ["distribut", "system", "design"], "docSeparated": ["distribut", "cache", "network", "system"]})
    got = scores(rank.top(rank.rank(built, ["distribut", "system"], [["distribut", "system"]]), 10))
    assert [s for _, s in got] == pytest.approx([1.363932256931874, 0.0342617690619512], abs=1e-12)
    twice = scores(rank.top(rank.rank(built, ["distribut", "system"], [["distribut", "system"]] * 2), 1))
    assert twice[0][1] == pytest.approx(1.363932256931874 / 3.5 * 6)
    many = tokens_index(spark, {"d": ["a1", "a1", "a1"], "e": ["a1", "b", "a1"]})
    assert [tuple(r) for r in rank.phrase_matches(many, ["a1", "a1"]).collect()] == [("d", 2)]
    assert rank.phrase_matches(many, ["a1"]).count() == 0


def test_phrase_matches_against_scan(spark):
    rng = random.Random(1)
    docs = {f"d{i}": [rng.choice("xyz") for _ in range(rng.randrange(30))] for i in range(40)}
    built = tokens_index(spark, docs)
    for phrase in (["x", "y"], ["x", "x", "y"], ["z", "z"]):
        want = {d: n for d, t in docs.items() if (n := sum(t[i : i + len(phrase)] == phrase for i in range(len(t))))}
        assert {r["document_id"]: r["matches"] for r in rank.phrase_matches(built, phrase).collect()} == want


def test_top_and_pages(spark):
    rows = spark.createDataFrame([("a", 4.1), ("b", 1.2), ("c", 9.5), ("d", 3.3), ("e", 7.8), ("f", 6.0), ("g", 6.0), ("h", 0.0)], "document_id string, score double")
    assert scores(rank.top(rows, 3)) == [("c", 9.5), ("e", 7.8), ("f", 6.0)]
    assert [r["rank"] for r in rank.numbered(rows, 20).orderBy("rank").collect()] == list(range(1, 8))
    with pytest.raises(ValueError):
        rank.top(rows, 0)
    assert rank.page_bounds(0, 1, 10) == (1, 10, 1, 10) and rank.page_bounds(95, 99, 10) == (10, 10, 10, 100)
    assert rank.page_bounds(1000, 15, 90) == (15, 50, 20, 200) and rank.page_bounds(5, -3, 0) == (1, 1, 5, 1)


def test_index_parts(spark):
    docs = spark.createDataFrame([("1", "Running runs the runner. The cat"), ("2", "the of a"), ("3", ""), ("4", None)], "document_id string, content string")
    built = index.build(docs)
    assert {r["document_id"]: r["doc_len"] for r in built.doc_lengths.collect()} == {"1": 4, "2": 0}
    assert tuple(built.corpus().first()) == (2, 2.0)
    assert {(r["term"], r["tf"], tuple(r["positions"])) for r in built.postings().collect()} == {("run", 2, (0, 1)), ("runner", 1, (2,)), ("cat", 1, (3,))}
    assert {r["word"] for r in built.vocabulary().collect()} == {"running", "runs", "runner", "cat"}
    assert tuple(search.stats(built, docs).first()) == (2, 3, 2.0, 4)
    empty = index.build(docs.limit(0))
    assert tuple(empty.corpus().first()) == (0, 0.0) and rank.rank(empty, ["run"]).count() == 0
    versions = spark.createDataFrame([("d1", 1, "a b"), ("d1", 2, "c"), ("d2", 1, "x")], "document_id string, v int, content string")
    assert {r["document_id"]: r["content"] for r in index.latest(versions, "v").collect()} == {"d1": "c", "d2": "x"}


def test_suggestions(spark):
    words = spark.createDataFrame([("algorithm", 5), ("algebra", 2), ("algorithmic", 10), ("allocate", 8), ("alga", 2), ("a", 99)], "word string, frequency long")
    found = lambda p, n=5: [r["word"] for r in search.suggest(words, p, n).collect()]
    assert found(" ALG") == ["algorithmic", "algorithm", "alga", "algebra"] and found("alg", 1) == ["algorithmic"]
    assert found("vue") == found("") == found(None) == found("alg", 0) == found("alg", -1) == []
    assert "a" not in found("a", 9)


@pytest.fixture(scope="module")
def site(spark):
    rows = [("http://www.x.com/1", "One", "big data systems"), ("http://x.com/2", "", "data data"), ("http://y.org/3", "Three", "more data here"), ("plain", None, "data"), ("http://y.org/4", "Four", "nothing")]
    return spark.createDataFrame(rows, "document_id string, title string, content string")


def test_search_facets_and_domains(spark, site):
    built = index.build(site)
    got = search.search(built, site, "Data")
    assert (got.total_results, got.total_pages) == (4, 1)
    assert {r["domain"]: r["count"] for r in got.facets.collect()} == {"all": 4, "x.com": 2, "y.org": 1, "other": 1}
    rows = sorted(got.results.collect())
    assert [r["rank"] for r in rows] == [1, 2, 3, 4] and {r["title"] for r in rows} == {"One", "http://x.com/2", "Three", "plain"}
    one = search.search(built, site, "data", domain="X.com")
    assert one.total_results == 2 and {r["domain"]: r["count"] for r in one.facets.collect()}["all"] == 4
    assert one.active_domain == "X.com" and search.search(built, site, "data", domain="ALL").total_results == 0
    assert search.search(built, site, "data", domain="www.x.com").total_results == 0
    none = search.search(built, site, "the of")
    assert (none.total_results, none.total_pages, none.results.count()) == (0, 1, 0)
    assert [tuple(r) for r in none.facets.collect()] == [("all", 0)]
    gone = search.enrich(rank.numbered(rank.rank(built, ["data"]), 5), site.where("document_id <> 'plain'"), "data")
    assert [(r["title"], r["snippet"]) for r in gone.collect() if r["document_id"] == "plain"] == [(None, None)]


def test_api(spark, site):
    built = index.build(site)
    with pytest.raises(api.BadRequest):
        api.search_documents(built, site, "  ")
    got = api.search_documents(built, site, "data", top_k="1", page="x", limit="0", domain=None)
    assert (got.page, got.limit, got.results.count()) == (1, 10, 4)
    assert api.get_suggestions(built, "da", "2") == {"query": "da", "suggestions": ["data"]} and api.get_suggestions(built, " ") == {"query": "", "suggestions": []}
    assert api.get_document(built, site, "plain").first()["token_length"] == 1
    with pytest.raises(api.NotFound):
        api.get_document(built, site, "missing")
    assert api.health(None)[0] == 503 and api.health(built) == (200, {"is_ready": True, "is_rebuilding": False, "total_documents": 5, "total_terms": 6})
    assert api.whole("12abc", 1) == 12 and api.whole("0", 7) == 7


def test_ips_and_urls(spark):
    blocked = ["127.0.0.1", "127.255.255.255", "::1", "::ffff:127.0.0.1", "::ffff:10.0.0.1", "169.254.169.254", "fe80::1", "10.0.0.1", "172.16.5.10", "192.168.1.1", "100.64.0.1", "100.127.255.254", "", "no ip", "0.1.2.3", "255.255.255.255", "224.0.0.1", "fc00::1", "ff02::1", "::"]
    open_ = ["8.8.8.8", "1.1.1.1", "93.184.216.34", "2606:4700::1111", "172.32.0.1", "100.128.0.1", "::ffff:8.8.8.8"]
    got = spark.createDataFrame([(i,) for i in blocked + open_], "ip string").select("ip", urls.is_blocked_ip(F.col("ip")).alias("b")).collect()
    assert {r["ip"]: r["b"] for r in got} == {**dict.fromkeys(blocked, True), **dict.fromkeys(open_, False)}
    names = {"https://www.bbc.co.uk/news": "bbc.co.uk", "https://en.wikipedia.org/wiki/Algorithm": "en.wikipedia.org", "doc_1": "other", "HTTP://WWW.Www.Com:80/": "www.com"}
    got = spark.createDataFrame(list(names.items()), "u string, d string").select(urls.domain(F.col("u")).alias("x"), "d").collect()
    assert all(r["x"] == r["d"] for r in got)
    assert urls.normalize_url("http://EX.org/a/?utm_source=feed#top") == "http://ex.org/a"
    assert urls.normalize_url("http://ex.org/") == urls.normalize_url("http://ex.org:80") == "http://ex.org/"
    assert urls.normalize_url("http://ex.org/a?x=%20y&b&gclid=1") == "http://ex.org/a?x=+y&b=" and urls.normalize_url("nonsense") == "nonsense"


def test_page_parse():
    html = '<head><title> T </title></head><body><nav><a href="/n">N</a></nav><h1>A</h1><p>B</p><div class="x ad">X<div>Y</div></div><footer>F</footer>'
    assert pages.parse("http://ex.org/p", html) == ("T", "AB", ["http://ex.org/n"])
    odd = '<h1> H&amp;<b>1</b></h1><script>var t="</p>";</script><!-- c --><p>a \n b<aside>no</aside><br><p>c<a href="HTTP://Www.Ex.org/z/#q">l</a><a href="x.PNG">i</a><a href="mailto:a@b">m</a><a href="//other.net/?utm_term=1">o</a><a href="/z">again</a>'
    assert pages.parse("http://www.ex.org/p", odd) == ("H&1", "H&1a bcliomagain".replace("om", "mo"), ["http://www.ex.org/z", "http://other.net/"])
    assert pages.parse("http://www.ex.org/p", odd, same_domain=True)[2] == ["http://www.ex.org/z"]
    assert pages.parse("http://ex.org/", None) == ("http://ex.org/", "", [])


@pytest.mark.parametrize(
    "html, text",
    [
        ('<p class="ad">x<p>content<p>more', "contentmore"),
        ('<ul><li class="menu">x<li>content</li></ul>', "content"),
        ('<dl><dt class=ad>x<dd>a<dt>b</dl>c', "abc"),
        ('<table><tr><td class="ad">x<td>a<tr class=menu><td>y<tr><td>b</table>c', "abc"),
        ('<table><tr class="ad"><td><p>x</table>c', "c"),
        ('<div class="ad"><p>x</div>c', "c"),
        ('<div class="ad"><ul><li>x</div>c', "c"),
        ('<ul><li class="ad">x<ul><li>y</ul>z</li><li>a</ul>b', "ab"),
        ('<p class="ad">x<table><tr><td>t</table>', "t"),
        ('<select><option class=ad>x<option>a</select>b', "ab"),
        ('<p class="ad">x<b>y</p>c</b>d', "cd"),
        ("a</p>b</div>c</li>", "abc"),
        ("<head><title>T</title>text<p>a", "texta"),
        ("<div class=ad>x", ""),
        ("a<script>x<!--</script>b<style>y</style>c<!-- d --!> e -->f<!", "abcf"),
        ("a<br/>b<img src='>'>c<textarea><p>&amp;</textarea>d", "abc<p>&d"),
        ('a<a href="b', "a"),
        ("a < b <3 &lt;p&gt;", "a < b <3 <p>"),
        ("<nav>x<nav>y</nav>z</nav>a<aside>b</nav>c</aside>d", "ad"),
    ],
)
def test_pages_with_end_tags_left_out(html, text):
    assert pages.parse("http://ex.org/", html)[1] == text


@pytest.mark.parametrize("broken", ['<a href="', "<p>", "<div>", "<!--", "<script>", "<li><ul>", "<button><p><div>", "<table><tr><td>", "</p></div>", "<a href='\"", "&amp", "<b></i>"])
def test_broken_pages_take_time_in_proportion(broken):
    began = time.process_time()
    pages.parse("http://ex.org/", broken * (1_000_000 // len(broken)))
    assert time.process_time() - began < 15


def test_pages_that_are_read(spark):
    """Content types that are no page, and pages over the limit, are left out; urls are shown short."""
    rows = [(1, "http://a.org/1", "<p>x</p>", "Text/HTML; charset=utf-8"), (2, "http://a.org/2", "x", "application/pdf"), (3, "http://a.org/3", "x", None), (4, "http://a.org/4", "<p>y</p>", "application/xhtml+xml"), (5, "http://a.org/5", "z" * (pages.MAX_BYTES + 1), "text/html")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, content_type string")
    assert sorted((r["page_id"], r["content"]) for r in pages.parsed(table).collect()) == [(1, "x"), (4, "y")]
    shown = {"HTTP://Ex.org:80/a/b?c#d": "ex.org/a/b", "http://ex.org": "ex.org/", "no url": "no url"}
    got = spark.createDataFrame([(u,) for u in shown], "u string").select("u", urls.display_url(F.col("u")).alias("s")).collect()
    assert {r["u"]: r["s"] for r in got} == shown


def test_crawl_reports(spark):
    link = lambda *to: "<title>t</title><body>word " + "".join(f'<a href="{t}">x</a>' for t in to) + "</body>"
    table = spark.createDataFrame([(1, "http://s.org/", link("/a", "/b", "/a")), (2, "http://s.org/a", link("/c")), (3, "http://s.org/c", link())], "page_id long, url string, html string")
    none = spark.createDataFrame([], "document_id string")
    got = crawl.crawl(table, none, "http://s.org/", 2, 5)
    assert [(r["url"], r["depth"], r["outcome"]) for r in got.outcomes.orderBy("depth", "ord").collect()] == [("http://s.org/", 1, "indexed"), ("http://s.org/a", 2, "indexed"), ("http://s.org/b", 2, "error")]
    assert got.summary["stopped_reason"] == "max_depth_reached" and got.documents.count() == 2
    one = crawl.crawl(table, none, "http://s.org/", 2, 1)
    assert (one.status, one.summary["total_pages_indexed"], one.summary["stopped_reason"]) == ("indexed", 1, "max_pages_reached")
    old = spark.createDataFrame([("http://s.org/",)], "document_id string")
    assert one.single == {"status": "indexed", "url": "http://s.org/", "title": "t", "tokens_indexed": 2, "child_links_found": 2} and got.single is None
    again = crawl.crawl(table, old, "http://s.org/?utm_source=x", 1, 1)
    assert again.status == again.single["status"] == "already_indexed" and again.single["url"] == "http://s.org/?utm_source=x"
    assert crawl.crawl(table, none, "http://s.org/", 2, 5, same_domain=True).summary["total_pages_indexed"] == 2
    bad = crawl.crawl(table, none, "http://localhost/", 9, 9)
    assert (bad.status, bad.summary["requested_max_depth"], bad.summary["requested_max_pages"], bad.summary["stopped_reason"]) == ("no_pages_indexed", 2, 5, "queue_empty")
    codes = [("timeout of 10s", "", 504), ("", "ENOTFOUND", 502), ("Unsupported Content Type", "", 415), ("Invalid URL format", "", 400), ("x", None, 500)]
    rows = spark.createDataFrame(codes, "m string, c string, want int").select(crawl.error_status(F.col("m"), F.col("c")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in rows.collect())


def test_store_and_snapshots(spark, tmp_path):
    path = f"{tmp_path}/store"
    first = spark.createDataFrame([("a", "A", "cats run", "a", 1), ("a", "A2", "later", "a", 2), ("b", "B", "dogs", "b", 3)], "document_id string, title string, content string, url string, ord int")
    corpus.insert(spark, path, first)
    corpus.insert(spark, path, first)
    store = spark.read.schema(corpus.SCHEMA).parquet(path)
    assert sorted((r["document_id"], r["title"]) for r in store.collect()) == [("a", "A"), ("b", "B")]
    snaps = corpus.Snapshots(spark, f"{tmp_path}/index")
    assert snaps.current() is None
    old = snaps.rebuild(store)
    corpus.insert(spark, path, spark.createDataFrame([("c", "C", "cat", "c", 1)], first.schema))
    assert snaps.current().corpus().first()["n"] == 2
    assert snaps.rebuild(spark.read.schema(corpus.SCHEMA).parquet(path)) != old
    now = snaps.current()
    assert sorted(d for d, _ in scores(rank.rank(now, ["cat"]))) == ["a", "c"]
    assert [r["word"] for r in search.suggest(now.vocabulary(), "ca").collect()] == ["cat", "cats"]
    plan = now.term_positions(["cat"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,cat)" in plan or "In(term" in plan
    snaps.clear()
    assert snaps.current() is None


def test_streaming_ingest(spark, tmp_path):
    for n, rows in enumerate(([("a", "one two"), ("b", "x")], [("a", "three")])):
        spark.createDataFrame(rows, "document_id string, content string").write.mode("append").parquet(f"{tmp_path}/in")
        ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    new = stored(spark, f"{tmp_path}/out")
    assert {r["document_id"]: r["doc_len"] for r in new.doc_lengths.collect()} == {"a": 1, "b": 0}
    assert [(r["document_id"], r["word"]) for r in new.words().collect()] == [("a", "three")]
    # a search sees what was added to a snapshot, and not what it replaced
    snaps = corpus.Snapshots(spark, f"{tmp_path}/index")
    snaps.rebuild(spark.createDataFrame([("a", "old words three"), ("c", "three old cats")], "document_id string, content string"))
    both = index.merged(snaps.current(), new)
    assert sorted(d for d, _ in scores(rank.rank(both, ["three"]))) == ["a", "c"] and [d for d, _ in scores(rank.rank(both, ["old"]))] == ["c"]
    assert {r["document_id"]: r["doc_len"] for r in both.doc_lengths.collect()} == {"a": 1, "b": 0, "c": 3}
    assert {r["word"]: r["frequency"] for r in both.vocabulary().collect()} == {"three": 2, "old": 1, "cats": 1}
    found = search.search(both, both.documents.withColumn("title", F.lit("t")), "three")
    assert sorted((r["document_id"], r["snippet"]) for r in found.results.collect()) == [("a", "three"), ("c", "three old cats")]


def test_pointer_of_snapshots(spark, tmp_path):
    """A read error is not taken for an empty store, and the greatest name counts."""
    snaps = corpus.Snapshots(spark, f"{tmp_path}/i")
    docs = spark.createDataFrame([("a", "one")], "document_id string, content string")
    first, second = snaps.rebuild(docs), snaps.rebuild(docs)
    names = shared.names(spark, f"{tmp_path}/i/current")
    assert [n.partition("-")[2] for n in names] == [first, second]
    snaps.clear()
    assert snaps.current() is None and snaps.rebuild(docs) and snaps.current().corpus().first()["n"] == 1
    bad = tmp_path / "store"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"no parquet at all")
    rows = spark.createDataFrame([("a", "A", "cats run", "a", 1)], "document_id string, title string, content string, url string, ord int")
    with pytest.raises(Exception, match="parquet"):
        corpus.insert(spark, str(bad), rows)
