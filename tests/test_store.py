"""Stored indexes: batches of queries, bounds, completions, keyed lookups, segments, leases, commits."""

import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import batch, bounded, crawl, index, pages, rank, search
from textloom.plans import registry
from textloom.sources import corpus, shared
from textloom.sources.keyed import Keyed
from textloom.sources.segments import Segments
from textloom.streaming.ingest import ingest_segments

WORDS = ["data", "system", "systems", "query", "running", "index", "the", "tree", "a1", "b"]


def texts(n, seed):
    rng = random.Random(seed)
    return [(f"d{i}", " ".join(rng.choices(WORDS, weights=range(10, 0, -1), k=rng.randrange(0, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "document_id string, content string")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    snaps = corpus.Snapshots(spark, f"{tmp_path_factory.mktemp('index')}/i")
    snaps.rebuild(frame(spark, [*texts(300, 1), ("empty", ""), ("none", None)]))
    return snaps.current()


def shown(rows):
    return [(r["document_id"], round(r["score"], 9)) for r in rows.collect()]


def test_stored_tables_are_those_of_a_fresh_index(spark, built):
    fresh = index.build(frame(spark, texts(300, 1)))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    cols = ["term", "document_id", "tf", "positions", "doc_len"]
    assert same(built.postings().select(cols), fresh.postings().select(cols))
    assert same(built.words(), fresh.words()) and same(built.vocabulary(), fresh.vocabulary())
    assert same(built.document_frequencies(), fresh.document_frequencies()) and built.corpus().collect() == fresh.corpus().collect()


def test_many_queries_are_ranked_as_one_by_one(spark, built):
    asked = {1: 'data "query index"', 2: "the", 3: None, 4: 'tree "data data" "system query" systems', 5: "absent", 6: "a1 a1 b running", 7: '"data the system" index'}
    got = {}
    for r in batch.search(built, spark.createDataFrame(list(asked.items()), "query_id int, query string"), 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["document_id"], round(r["score"], 9)))
    for i, query in asked.items():
        want = shown(rank.top(rank.rank(built, *text.parse_query(query or "")), 7))
        assert sorted(got.get(i, [])) == [(n + 1, *w) for n, w in enumerate(want)]
    assert 4 in got and 3 not in got and 5 not in got
    with pytest.raises(ValueError):
        batch.search(built, spark.createDataFrame([], "query_id int, query string"), 0)
    assert batch.search(built, spark.createDataFrame([], "query_id int, query string")).count() == 0


def test_many_queries_read_the_postings_once(spark, built):
    plan = batch.search(built, spark.createDataFrame([(1, 'data "query index"')], "query_id int, query string"))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("positions" in line and "Relation" in line for line in plan.split("\n")) == 1
    physical = batch.search(built, spark.createDataFrame([(1, "data")], "query_id int, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in physical


@pytest.mark.parametrize("query", ["data", "tree", "data system", "b a1 tree", "absent", "absent tree"])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_bounds_give_the_same_rows(built, query, k):
    terms, _ = text.parse_query(query)
    found = bounded.top(built, terms, k)
    assert shown(found.rows) == shown(rank.top(rank.rank(built, terms), k)) and found.read <= found.total
    if query in ("data", "tree") and k == 1:
        assert found.read < 0.5 * found.total


def test_bounds_of_an_index_without_them(spark):
    fresh = index.build(frame(spark, texts(30, 2)))
    fresh.stored["bounds"] = index.bounds(fresh.postings().withColumn("level", F.lit(0)), 10.0)
    assert shown(bounded.top(fresh, ["data"], 3).rows) == shown(rank.top(rank.rank(fresh, ["data"]), 3))
    with pytest.raises(ValueError):
        bounded.top(fresh, ["data"], 0)


def test_completions_of_every_prefix(spark, built):
    words = {r["word"]: r["frequency"] for r in built.vocabulary().collect()}
    kept = {}
    for r in built.stored["completions"].collect():
        kept.setdefault(r["prefix"], []).append((r["rank"], r["word"], r["frequency"]))
    for p in {w[:n] for w in words for n in range(1, len(w) + 1)}:
        want = sorted(((-f, w) for w, f in words.items() if w.startswith(p)))
        assert sorted(kept[p]) == [(i + 1, w, -f) for i, (f, w) in enumerate(want)]
        assert [r["word"] for r in built.suggestions(p, 2).collect()] == [w for _, w in want[:2]]
    assert set(kept) == {w[:n] for w in words for n in range(1, len(w) + 1)}
    plan = built.suggestions("sy", 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(prefix,sy)" in plan
    assert search.complete(built, " SY ", 1).first()["word"] == "system" and search.complete(built, "", 5).count() == 0


def test_completions_of_long_lists_and_words(spark):
    words = [(f"w{i:03d}", i % 7 + 1) for i in range(120)] + [("x" * 40, 3), ("x" * 30, 3)]
    vocabulary = spark.createDataFrame(words, "word string, frequency long")
    made = index.Index(None, None, None, None, vocabulary, completions=index.completions(vocabulary))
    want = [w for _, w in sorted((-f, w) for w, f in words if w.startswith("w"))]
    assert [r["word"] for r in made.suggestions("w", 50).collect()] == want[:50] and [r["word"] for r in made.suggestions("w", 70).collect()] == want[:70]
    assert [r["word"] for r in made.suggestions("x" * 27, 5).collect()] == ["x" * 30, "x" * 40]


def test_completions_follow_weights(spark):
    rng = random.Random(4)
    words = {"".join(rng.choices("ab", k=rng.randrange(2, 6))): rng.randrange(1, 9) for _ in range(40)}
    table = index.completions(spark.createDataFrame(list(words.items()), "word string, frequency long"), 3)
    changed = {w: words.get(w, 0) + rng.randrange(1, 9) for w in [*rng.sample(sorted(words), 5), "ca", "aabbab"]}
    got = index.reweighted(table, spark.createDataFrame(list(changed.items()), "word string, frequency long"), 3)
    want = index.completions(spark.createDataFrame(list((words | changed).items()), "word string, frequency long"), 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_key_opens_few_files(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") * 7 % 4001).alias("document_id"), F.lit("x").alias("content"))
    rows = rows.unionByName(spark.createDataFrame([(None, "y"), (4001, "first"), (4001, "second")], rows.schema))
    files = {}
    for n in (4, 16):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            store = Keyed.write(rows, f"{tmp_path}/{n}")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        files[n] = len(store.files([1234]))
        assert [r["document_id"] for r in store.find([1234]).collect()] == [1234]
        assert sorted(r["document_id"] for r in store.find([5, None, 77, 9999]).collect()) == [5, 77]
        assert sorted(r["content"] for r in store.find([4001]).collect()) == ["first", "second"]
        assert store.find([]).count() == store.find([None]).count() == store.find([-5]).count() == 0
        assert len(store.rows().inputFiles()) == n
    assert files == {4: 1, 16: 1}
    empty = Keyed.write(rows.limit(0), f"{tmp_path}/none")
    assert empty.find([1]).count() == 0


def test_pages_of_results_look_documents_up(spark, built):
    plain = search.search(built, built.documents, "data system", page=2, limit=5)
    keyed = search.search(built, built.keyed, "data system", page=2, limit=5)
    assert sorted(map(tuple, plain.results.collect())) == sorted(map(tuple, keyed.results.collect())) and keyed.results.count() == 5
    one = search.document(built.keyed, built, "d7").first()
    assert one["token_length"] == built.doc_lengths.where("document_id = 'd7'").first()["doc_len"]
    assert search.document(built.keyed, built, "empty").first()["token_length"] == 0 and search.document(built.keyed, built, "no").isEmpty()


def same_index(got, fresh):
    """All that a search sees of two indexes."""
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert rows(got.postings(), "term", "document_id", "tf", "positions") == rows(fresh.postings(), "term", "document_id", "tf", "positions")
    assert rows(got.document_frequencies(), "term", "df") == rows(fresh.document_frequencies(), "term", "df")
    assert rows(got.vocabulary(), "word", "frequency") == rows(fresh.vocabulary(), "word", "frequency")
    assert rows(got.doc_lengths, "document_id", "doc_len") == rows(fresh.doc_lengths, "document_id", "doc_len")
    assert got.corpus().collect() == fresh.corpus().collect()
    assert shown(rank.top(rank.rank(got, ["data", "tree"]), 5)) == shown(rank.top(rank.rank(fresh, ["data", "tree"]), 5))


def test_segments_equal_a_rebuild(spark, tmp_path):
    """Batches with new documents, changed ones, ones that become empty, and none; merges in between."""
    store, now, rng = Segments(spark, f"{tmp_path}/s", fan=3), {}, random.Random(5)
    assert store.current() is None
    for n in range(9):
        rows = [(f"d{rng.randrange(12)}", t) for _, t in texts(rng.randrange(6), n)]
        rows = list(dict(rows).items()) + ([("d1", "")] if n in (3, 7) and "d1" not in dict(rows) else [])
        now |= dict(rows)
        assert store.add(frame(spark, rows), n) and not store.add(frame(spark, rows), n)
        store.compact()
        tiers = store.sizes()
        assert all(tiers.count(t) < 3 for t in tiers) and tiers == sorted(tiers, reverse=True)
        if n in (3, 5, 8):
            same_index(store.current(), index.build(frame(spark, list(now.items()))))
    assert len(store.sizes()) <= 3
    kept = shared.names(spark, f"{tmp_path}/s/manifests")
    named = {p.split("/")[0] for m in kept for s in json.loads(shared.read_text(spark, f"{tmp_path}/s/manifests/{m}"))["segments"] for p in (s["at"], s["counts"], *s["hidden"])}
    assert len(kept) == 2 and set(shared.names(spark, f"{tmp_path}/s")) == named | {"manifests"}


def test_segments_of_two_writers(spark, tmp_path, monkeypatch):
    """A batch that another one overtakes is counted against it; a merge that is overtaken keeps its marks."""
    a, b = (Segments(spark, f"{tmp_path}/s", fan=2) for _ in range(2))
    a.add(frame(spark, [("x", "data tree"), ("y", "data")]))
    publish, once = Segments._publish, []

    def overtaken(self, number, state):
        if self is a and not once:
            once.append(1)
            b.add(frame(spark, [("y", "system"), ("z", "tree tree")]))
        return publish(self, number, state)

    monkeypatch.setattr(Segments, "_publish", overtaken)
    a.add(frame(spark, [("y", "query"), ("w", "data")]))
    now = {"x": "data tree", "y": "query", "z": "tree tree", "w": "data"}
    same_index(a.current(), index.build(frame(spark, list(now.items()))))
    once.clear()
    assert a.compact() >= 1  # during the merge b replaces a document of a merged segment
    same_index(a.current(), index.build(frame(spark, list((now | {"y": "system", "z": "tree tree"}).items()))))


def test_segments_by_stream(spark, tmp_path):
    for rows in ([("a", "one two"), ("b", "x1")], [("a", "three")], [("c", "three old")]):
        frame(spark, rows).write.mode("append").parquet(f"{tmp_path}/in")
        ingest_segments(spark, f"{tmp_path}/in", f"{tmp_path}/s", f"{tmp_path}/check").awaitTermination()
    same_index(Segments(spark, f"{tmp_path}/s").current(), index.build(frame(spark, [("a", "three"), ("b", "x1"), ("c", "three old")])))


def test_one_rebuild_at_a_time(spark, tmp_path, monkeypatch):
    snaps, docs = corpus.Snapshots(spark, f"{tmp_path}/i"), frame(spark, [("a", "one")])
    write, seen = corpus.write_tables, []

    def slow(session, documents, at):
        if not seen:
            seen.append((corpus.Snapshots(spark, f"{tmp_path}/i").rebuild(docs), snaps.rebuilding()))
        write(session, documents, at)

    monkeypatch.setattr(corpus, "write_tables", slow)
    first = snaps.rebuild(docs)
    assert seen == [(None, True)] and first and not snaps.rebuilding()
    assert len(shared.names(spark, f"{tmp_path}/i/current")) == 1
    # a lease whose holder is lost does not hold for ever
    shared.publish(spark, f"{tmp_path}/i/lease", "somebody")
    assert snaps.rebuild(docs) is None
    monkeypatch.setattr(corpus.Snapshots, "LEASE", -1.0)
    second = snaps.rebuild(docs)
    assert not snaps.rebuilding() and second and snaps.current().corpus().first()["n"] == 1
    # an error leaves the version that is there, and no lease
    monkeypatch.setattr(corpus.Snapshots, "LEASE", 120.0)
    monkeypatch.setattr(corpus, "write_tables", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        snaps.rebuild(docs)
    assert not snaps.rebuilding() and snaps.current().corpus().first()["n"] == 1
    monkeypatch.setattr(corpus, "write_tables", write)
    third = snaps.rebuild(docs)
    left = set(shared.names(spark, f"{tmp_path}/i")) - {"current"}
    assert left == {second, third}  # the first one's tables are gone


def test_a_long_rebuild_renews_its_lease(spark, tmp_path, monkeypatch):
    snaps, docs, ages = corpus.Snapshots(spark, f"{tmp_path}/i"), frame(spark, [("a", "one")]), []
    monkeypatch.setattr(corpus.Snapshots, "LEASE", 6.0)
    write = corpus.write_tables

    def slow(*args):
        time.sleep(8)
        ages.append(shared.age(spark, f"{tmp_path}/i/lease"))
        write(*args)

    monkeypatch.setattr(corpus, "write_tables", slow)
    assert snaps.rebuild(docs) and ages[0] < 4 and not shared.names(spark, f"{tmp_path}/i/lease")


def test_two_inserts_of_one_document(spark, tmp_path, monkeypatch):
    """Both compare with the same store before either commits; one of them has to look again."""
    cols = "document_id string, title string, content string, url string, ord int"
    publish, gate = shared.publish, threading.Barrier(2, timeout=60)
    waited = threading.local()

    def together(*args):
        if not getattr(waited, "done", False):
            waited.done = True
            gate.wait()
        return publish(*args)

    monkeypatch.setattr(corpus.shared, "publish", together)
    again, path = [], f"{tmp_path}/store"
    run = lambda t: again.append(corpus.insert(spark, path, spark.createDataFrame([("a", t, "c", "a", 1), (t, t, "c", t, 2)], cols)))
    both = [threading.Thread(target=run, args=(t,)) for t in ("one", "two")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    rows = spark.read.schema(corpus.SCHEMA).parquet(path).collect()
    assert sorted(r["document_id"] for r in rows) == ["a", "one", "two"] and sorted(again) == [0, 1]


def test_an_insert_that_was_cut_short_is_finished(spark, tmp_path, monkeypatch):
    cols = "document_id string, title string, content string, url string, ord int"
    rows = spark.createDataFrame([("a", "A", "c", "a", 1)], cols)
    move = corpus.shared.move
    monkeypatch.setattr(corpus.shared, "move", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        corpus.insert(spark, f"{tmp_path}/s", rows)
    monkeypatch.setattr(corpus.shared, "move", move)
    corpus.insert(spark, f"{tmp_path}/s", rows)
    assert [r["document_id"] for r in spark.read.schema(corpus.SCHEMA).parquet(f"{tmp_path}/s").collect()] == ["a"]


def test_a_stamp_sees_nested_files(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/t/day=1/h=0")
    before = shared.stamp(spark, f"{tmp_path}/t")
    assert before == shared.stamp(spark, f"{tmp_path}/t")
    spark.range(1).write.parquet(f"{tmp_path}/t/day=1/h=1")
    assert shared.stamp(spark, f"{tmp_path}/t") != before


def test_facets_of_a_stored_index_parse_no_address(spark, sf):
    found = search.facets(registry._page_index(spark, "/root/testdata/sf0.001").hits(["thing"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.lower() and "domain" in plan


def test_a_crawl_looks_pages_up(spark, tmp_path):
    """The same report from a table of pages and from a keyed store of them."""
    link = lambda *to: "<title>t</title><body>word " + "".join(f'<a href="{t}">x</a>' for t in to) + "</body>"
    rows = [(1, "http://s.org/", link("/a", "/b", "http://o.net/", "/a")), (2, "http://s.org/a/", link("/c")), (3, "http://s.org/c", link()), (4, "http://o.net/", link("/z")), (5, "http://S.org/a", link("/no"))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    store = Keyed.write(pages.corpus(table), f"{tmp_path}/pages")
    none, old = spark.createDataFrame([], "document_id string"), spark.createDataFrame([("http://s.org/a",)], "document_id string")
    for args in ((none, "http://s.org/", 2, 5), (old, "http://s.org/", 2, 5), (none, "http://s.org/", 2, 5, True), (none, "http://x.org/", 1, 1)):
        one, two = crawl.crawl(table, *args), crawl.crawl(store, *args)
        assert sorted(map(tuple, one.outcomes.collect()), key=str) == sorted(map(tuple, two.outcomes.collect()), key=str) and one.summary == two.summary


def test_a_build_makes_its_documents_once(spark, tmp_path):
    """Documents that come out of a shuffle, as pages do, are made once, and counting their tokens gives what tokens() has."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    odd = ["The a b2 it's THEN then-the athe", "", None, "x " * 9, "of_of off\tof", "Éa ab é1 is2 this is"]
    rows = [(i, odd[i % len(odd)]) for i in range(60)]
    texts = spark.createDataFrame(rows, "document_id long, content string").mapInPandas(run, "document_id long, content string")
    snapshots = corpus.Snapshots(spark, f"file://{tmp_path}/index")
    snapshots.rebuild(texts.groupBy("document_id").agg(F.max("content").alias("content")))
    assert made.value == len(rows)
    built = snapshots.current()
    counts = {r["document_id"]: r["doc_len"] for r in built.keyed.rows().collect()}
    want = {r["document_id"]: r["n"] for r in spark.createDataFrame(rows, "document_id long, content string").select("document_id", F.size(text.tokens(F.coalesce("content", F.lit("")))).alias("n")).collect()}
    assert counts == want


def test_a_batch_without_phrases_leaves_positions_unread(spark, built):
    asked = [(1, "data query"), (2, "tree")]
    found = batch.scores(built, spark.createDataFrame(asked, "query_id int, query string"))
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    alone = [(q, r["document_id"], round(r["score"], 9)) for q, x in asked for r in rank.rank(built, *text.parse_query(x)).collect()]
    assert sorted((r["query_id"], r["document_id"], round(r["score"], 9)) for r in found.collect()) == sorted(alone) and alone
