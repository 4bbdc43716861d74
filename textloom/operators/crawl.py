"""Crawling a table of pages from a seed: a frontier by depth, and the report of what happened."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text, urls
from textloom.operators.pages import parsed
from textloom.sources.keyed import Keyed

MAX_DEPTH, MAX_PAGES = 2, 5
#: Addresses that are looked up one by one; a longer frontier, of a page with more links, is joined.
LOOKED_UP = 1000


@dataclass
class Report:
    status: str
    summary: dict
    outcomes: DataFrame  # ord, depth, url, outcome, reason, title, tokens_indexed, child_links_found
    documents: DataFrame  # document_id, title, content, url of the pages to store
    single: dict | None = None  # the short form of the answer where one page was asked for


def _fetched(pages: DataFrame | Keyed, todo: DataFrame, same_domain: bool, closed: bool) -> DataFrame:
    """``(url, title, content, links)`` of the pages on the frontier ``todo (url)``."""
    if isinstance(pages, Keyed):
        names = [r["url"] for r in todo.select("url").limit(LOOKED_UP + 1).collect()]
        found = pages.find(names) if len(names) <= LOOKED_UP else pages.rows().join(F.broadcast(todo.select("url")), F.col("document_id") == todo["url"], "left_semi")
        links = F.filter("links", lambda to: urls.domain(to) == urls.domain(F.col("document_id"))) if same_domain else F.col("links")
        return found.select(F.col("document_id").alias("url"), "title", "content", links.alias("links"))
    few = F.broadcast(todo.select(F.col("url").alias("__n")))
    # hosts are compared first, in the JVM; normal forms, which take Python, only of their pages
    hosts = F.broadcast(todo.select(urls.host(F.col("url")).alias("__h")).distinct())
    known = pages.where("url is not null")
    near = known.join(hosts, urls.host(F.col("url")) == F.col("__h"), "left_semi").withColumn("__n", urls.normalized(F.col("url")))
    at = near.join(few, "__n", "left_semi")
    got = parsed(at.groupBy("__n").agg(F.min_by(F.struct("page_id", "url", "html"), "page_id").alias("p")).select("p.*"), same_domain, closed=closed)
    return got.select(F.col("document_id").alias("url"), "title", "content", "links")


def crawl(pages: DataFrame | Keyed, stored: DataFrame, seed: str, max_depth: int = 1, max_pages: int = 1, same_domain: bool = False, closed: bool = False) -> Report:
    """Visit pages breadth first. Depth is held to 1 or 2 and pages to 1 to 5; a url is visited once;
    stored urls are skipped; unsafe and missing ones are errors; only indexed pages count towards
    the limit, and nothing after it is visited.

    pages: ``(page_id, url, html)``, which are read whole for each depth and of which only those on the
    frontier are parsed, or a keyed store of pages.corpus(), in which the frontier is looked up, so what
    a depth reads does not grow with the pages; stored: ``(document_id)``; closed: how a table's pages are
    parsed, see pages.parsed(). The frontier is one page's links per depth, so numbering it needs one small task.
    """
    depth_limit, page_limit = min(max(1, max_depth), MAX_DEPTH), min(max(1, max_pages), MAX_PAGES)
    spark = pages.spark if isinstance(pages, Keyed) else pages.sparkSession
    frontier = spark.createDataFrame([(1, 0, urls.normalize_url(seed))], "depth int, ord long, url string")
    seen, done = None, None
    held: list[DataFrame] = []
    for depth in range(1, depth_limit + 1):
        first = Window.partitionBy("url").orderBy("ord")
        todo = frontier.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
        if seen is not None:
            todo = todo.join(seen, "url", "left_anti")
        todo = todo.withColumn("__problem", urls.url_problem(F.col("url"))).persist()  # a page's links at most
        held.append(todo)
        few = F.broadcast(todo.select(F.col("url").alias("__n")))
        got = _fetched(pages, todo, same_domain, closed)
        old = stored.join(few, F.col("document_id") == F.col("__n"), "left_semi").select(F.col("document_id").alias("url"), F.lit(True).alias("__stored")).distinct()
        rows = todo.join(old, "url", "left").join(got, "url", "left")
        problem = F.col("__problem")
        outcome = F.when(F.col("__stored"), "skipped").when(problem.isNotNull() | F.col("links").isNull(), "error").otherwise("indexed")
        reason = F.when(F.col("__stored"), "already_indexed").when(problem.isNotNull(), problem).when(F.col("links").isNull(), "not_found")
        rows = rows.withColumn("outcome", outcome).withColumn("reason", reason).persist()
        held.append(rows)
        done = rows if done is None else done.unionByName(rows)
        seen = todo.select("url") if seen is None else seen.unionByName(todo.select("url"))
        frontier = rows.where("outcome = 'indexed'").select("ord", F.posexplode("links").alias("k", "url"))
        frontier = frontier.select(F.lit(depth + 1).alias("depth"), (F.col("ord") * 1_000_000 + F.col("k") + 1).alias("ord"), "url")
    turn = Window.orderBy("depth", "ord").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum((F.col("outcome") == "indexed").cast("int")).over(turn), F.lit(0))
    done = done.withColumn("__before", before).where(F.col("__before") < page_limit).persist()
    ok = F.col("outcome") == "indexed"
    shown = done.select(
        "depth", "ord", "url", "outcome", "reason", F.when(ok, F.col("title")).alias("title"),
        F.when(ok, F.size(text.tokens(F.col("content")))).alias("tokens_indexed"), F.when(ok, F.size("links")).alias("child_links_found"), F.when(ok, F.col("content")).alias("content"),
    )
    # a page's links for each of page_limit pages at most: they are kept as rows, and nothing stays cached
    kept = spark.createDataFrame(shown.collect(), shown.schema)
    for x in [done, *held]:
        x.unpersist()
    done, outcomes = kept, kept.drop("content")
    count = lambda what: F.count(F.when(F.col("outcome") == what, 1)).alias(what)
    n = done.agg(count("indexed"), count("skipped"), count("error"), F.coalesce(F.max(F.when(ok, F.col("depth"))), F.lit(0)).alias("deepest")).first()
    why = "max_pages_reached" if n["indexed"] >= page_limit else "max_depth_reached" if n["deepest"] >= depth_limit else "queue_empty"
    alone = page_limit == 1 and n["skipped"] == 1 and not n["indexed"]
    one = done.where(ok).first() if page_limit == 1 and n["indexed"] == 1 else None
    single = {"status": "indexed", **{k: one[k] for k in ("url", "title", "tokens_indexed", "child_links_found")}} if one else None
    if alone:
        single = {"status": "already_indexed", "message": "This URL has already been indexed.", "url": seed}
    status = "indexed" if n["indexed"] else "already_indexed" if alone else "no_pages_indexed"
    summary = {
        "total_pages_indexed": n["indexed"], "total_pages_skipped": n["skipped"], "total_pages_errored": n["error"], "max_depth_reached": n["deepest"],
        "requested_max_depth": depth_limit, "requested_max_pages": page_limit, "stopped_reason": why,
    }
    new = done.where(ok).select(F.col("url").alias("document_id"), "title", "content", "url")
    return Report(status, summary, outcomes, new, single)


def error_status(message: Column, code: Column) -> Column:
    """HTTP status of a failed fetch by its message and code."""
    low = F.lower(F.coalesce(message, F.lit("")))
    code = F.coalesce(code, F.lit(""))
    has = lambda *parts: low.rlike("|".join(parts))
    return F.when((code == "ECONNABORTED") | has("timeout"), 504).when(code.isin("ENOTFOUND", "ECONNREFUSED", "EAI_AGAIN"), 502).when(has("unsupported content type"), 415).when(has("blocked", "disallowed", "invalid protocol", "invalid url"), 400).otherwise(500)
