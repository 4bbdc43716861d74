"""The service's calls as functions: parameters as they come, defaults, and errors by status."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from textloom.operators import crawl as crawling
from textloom.operators import search as searching
from textloom.operators.index import Index


class BadRequest(ValueError):
    """Status 400."""


class NotFound(LookupError):
    """Status 404."""


def whole(value, default: int) -> int:
    """Leading digits as a number; nothing, 0 and other text give the default."""
    m = re.match(r"\s*([+-]?\d+)", str(value if value is not None else ""))
    return int(m[1]) or default if m else default


def search_documents(index: Index, documents: DataFrame, q: str | None, top_k=None, page=None, limit=None, domain: str | None = None) -> searching.Response:
    """top_k is accepted and, as in the service, plays no part."""
    if not (q or "").strip():
        raise BadRequest("Query parameter 'q' is required.")
    return searching.search(index, documents, q, whole(page, 1), whole(limit, 10), domain or "all")


def index_url(pages: DataFrame, stored: DataFrame, url, max_depth=None, max_pages=None, same_domain: bool = False) -> crawling.Report:
    if not isinstance(url, str) or not url.strip():
        raise BadRequest("A url is required.")
    return crawling.crawl(pages, stored, url.strip(), whole(max_depth, 1), whole(max_pages, 1), same_domain)


def get_stats(index: Index, documents: DataFrame) -> DataFrame:
    return searching.stats(index, documents)


def get_suggestions(index: Index, q: str | None, limit=None) -> dict:
    q = (q or "").strip()
    rows = searching.complete(index, q, whole(limit, 5)).collect() if q else []
    return {"query": q, "suggestions": [r["word"] for r in rows]}


def get_document(index: Index, documents: DataFrame, document_id) -> DataFrame:
    if document_id is None or not str(document_id).strip():
        raise BadRequest("A document id is required.")
    found = searching.document(documents, index, document_id)
    if found.isEmpty():
        raise NotFound("Document not found.")
    return found


def health(index: Index | None, rebuilding: bool = False) -> tuple[int, dict]:
    """200 when an index is there, 503 while it warms."""
    return (200 if index is not None else 503), searching.status(index, rebuilding)
