"""Search over an index: facets, domain filter, pages of results with snippets, suggestions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators import rank
from textloom.operators.index import Index, domain_of
from textloom.sources.keyed import Keyed


@dataclass
class Response:
    """A page of results, the facets, and the counts that go with them."""

    query: str
    total_results: int
    page: int
    limit: int
    total_pages: int
    active_domain: str
    facets: DataFrame  # domain, count
    results: DataFrame  # rank, document_id, title, score, snippet


def facets(candidates: DataFrame) -> DataFrame:
    """``(domain, count)`` of candidates by domain, and ``all`` of them, if only 0; before any domain
    filter. Both come from one read; a domain named ``all`` is added to the total's row."""
    rows = candidates.select(F.explode(F.array(F.lit("all"), domain_of(candidates))).alias("domain"))
    counts = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("count"))
    none = candidates.sparkSession.range(1).select(F.lit("all").alias("domain"), F.lit(0).cast("long").alias("count"))
    return counts.unionByName(none).groupBy("domain").agg(F.sum("count").alias("count"))


def in_domain(candidates: DataFrame, target: str | None) -> DataFrame:
    """Candidates of a domain, in any case; ``all``, in lower case, or nothing keeps every one.
    ``www.`` is not taken off."""
    if not target or target == "all":
        return candidates
    return candidates.where(domain_of(candidates) == target.lower())


def enrich(page: DataFrame, documents: DataFrame | Keyed, query: str) -> DataFrame:
    """A page's rows with title and snippet; a document that is gone has neither. The page has at most
    MAX_RANKED rows: in a keyed store its documents are looked up, else it is broadcast to them."""
    if isinstance(documents, Keyed):
        page = page.sparkSession.createDataFrame(page.collect(), page.schema)
        documents = documents.find([r["document_id"] for r in page.select("document_id").collect()])
    page = F.broadcast(page)
    title = F.col("title") if "title" in documents.columns else F.lit(None).cast("string")
    docs = documents.select(F.col("document_id").alias("__id"), title.alias("__title"), "content")
    found = docs.join(page.select("document_id"), F.col("__id") == F.col("document_id"), "left_semi")
    rows = page.join(found, F.col("document_id") == F.col("__id"), "left")
    name = F.when(F.col("__id").isNotNull(), F.coalesce(F.expr("nullif(__title, '')"), F.col("document_id").cast("string")))
    return rows.select("rank", "document_id", name.alias("title"), "score", F.when(F.col("__id").isNotNull(), text.snippet(F.col("content"), F.lit(query))).alias("snippet"))


def search(index: Index, documents: DataFrame | Keyed, query: str, page: int = 1, limit: int = 10, domain: str | None = "all") -> Response:
    """Terms of the whole query find candidates, quoted phrases rank them, facets count them all."""
    terms, phrases = text.parse_query(query)
    found = index.hits(terms)
    chosen = in_domain(found, domain)
    total = chosen.count()
    page, limit, pages, ranked = rank.page_bounds(total, page, limit)
    scores = rank.rank(index, terms, phrases, domain=None if chosen is found else domain.lower())
    rows = rank.numbered(scores, ranked).where((F.col("rank") > (page - 1) * limit) & (F.col("rank") <= page * limit))
    return Response(query, total, page, limit, pages, domain or "all", facets(found), enrich(rows, documents, query))


def suggest(vocabulary: DataFrame, prefix: str | None, n: int = 5) -> DataFrame:
    """The n most frequent words with the prefix, ties by word; none for an empty prefix or n < 1.
    The prefix reaches the scan of a stored vocabulary as a range."""
    prefix = (prefix or "").strip().lower()
    rows = vocabulary.where(F.length("word") >= 2)
    if not prefix or n < 1:
        return rows.limit(0)
    return rows.where(F.col("word").startswith(prefix)).orderBy(F.col("frequency").desc(), "word").limit(n)


def complete(index: Index, prefix: str | None, n: int = 5) -> DataFrame:
    """suggest() from an index, which may have stored each prefix's best words."""
    prefix = (prefix or "").strip().lower()
    return index.suggestions(prefix, n) if prefix and n >= 1 else index.vocabulary().limit(0)


def document(documents: DataFrame | Keyed, index: Index, document_id) -> DataFrame:
    """A stored document with the number of its tokens, 0 if it is not indexed. A keyed store knows that
    number and opens the files that may hold the document."""
    length = F.coalesce("doc_len", F.lit(0)).cast("long")
    if isinstance(documents, Keyed):
        one = documents.find([document_id])
        return one.withColumn("token_length", length).drop("doc_len")
    one = documents.where(F.col("document_id") == document_id)
    lengths = index.doc_lengths.where(F.col("document_id") == document_id)
    return one.join(lengths, "document_id", "left").withColumn("token_length", length).drop("doc_len")


def stats(index: Index, documents: DataFrame) -> DataFrame:
    """The index's statistics and the number of stored documents, empty ones included."""
    stored = documents.agg(F.count(F.lit(1)).alias("documents_in_database"))
    return index.stats().crossJoin(stored)


def status(index: Index | None, rebuilding: bool = False) -> dict:
    """What a health check reports."""
    if index is None:
        return {"is_ready": False, "is_rebuilding": rebuilding, "total_documents": 0, "total_terms": 0}
    row = index.stats().first()
    return {"is_ready": True, "is_rebuilding": rebuilding, "total_documents": row["total_documents"], "total_terms": row["total_terms"]}
