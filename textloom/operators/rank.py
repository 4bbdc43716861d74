"""BM25, phrase matches and their boost, top documents, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.index import Index, domain_of, impact

PHRASE_WEIGHT, PHRASE_PENALTY = 2.5, 0.1
#: Results that are ranked at most, and rows of a page at most.
MAX_RANKED, MAX_PAGE = 200, 50


def idf(index: Index, terms: list[str]) -> DataFrame:
    """``(term, df, idf)`` of the terms that occur; a row a query term."""
    value = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return index.document_frequencies(terms).crossJoin(F.broadcast(index.corpus())).select("term", "df", value.alias("idf"))


def weights(index: Index, terms: list[str]) -> DataFrame:
    """``(term, idf, avgdl)``, a row a query term."""
    return idf(index, terms).crossJoin(F.broadcast(index.corpus().select("avgdl"))).select("term", "idf", "avgdl")


def part(tf: Column, doc_len: Column) -> Column:
    """What a term adds to a document's score; rows have ``idf`` and ``avgdl``."""
    return impact(tf, doc_len, F.col("avgdl")) * F.col("idf")


def bm25(index: Index, terms: list[str]) -> DataFrame:
    """``(document_id, score)`` of every document that holds a term."""
    return _summed(index.postings(terms).join(F.broadcast(weights(index, terms)), "term"), [])


def matches(places: Column, phrase: Column) -> Column:
    """How often the phrase's tokens follow each other, overlaps included, in one document: places is a
    map from a term to its positions. The positions of each token are moved back by its place in the
    phrase; what is common to all of them are the starts. Fewer than two tokens match nowhere."""
    at = lambda j: F.transform(F.coalesce(F.try_element_at(places, F.element_at(phrase, j)), F.array().cast("array<int>")), lambda p: p - j + 1)
    rest = F.sequence(F.lit(2), F.size(phrase))
    starts = F.aggregate(rest, at(F.lit(1)), lambda found, j: F.array_intersect(found, at(j)))
    return F.when(F.size(phrase) >= 2, F.size(starts)).otherwise(0).cast("long")


def boosted(score: Column, counts: list[Column] | Column) -> Column:
    """A score raised by all matches if every phrase occurs, else lowered to a tenth; counts: a column a
    phrase, or an array of them."""
    counts = F.array(*counts) if isinstance(counts, list) else counts
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.when(F.size(counts) == 0, score).when(F.forall(counts, lambda c: c > 0), score * (1 + PHRASE_WEIGHT * total)).otherwise(score * PHRASE_PENALTY)


def _summed(rows: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """Scores of postings with their weights, by document, in one exchange: phrases are looked for among
    the positions that the same exchange brings together."""
    score = F.sum(part(F.col("tf"), F.col("doc_len"))).alias("score")
    if not phrases:
        return rows.groupBy("document_id").agg(score)
    needed = F.col("term").isin(*sorted({t for p in phrases for t in p}))
    places = F.map_from_entries(F.collect_list(F.when(needed, F.struct("term", "positions")))).alias("places")
    found = rows.groupBy("document_id").agg(score, places)
    counts = [matches(F.col("places"), F.array(*map(F.lit, p))) for p in phrases]
    return found.select("document_id", boosted(F.col("score"), counts).alias("score"))


def phrase_matches(index: Index, phrase: list[str]) -> DataFrame:
    """``(document_id, matches)`` of documents that hold the phrase."""
    rows = index.postings(list(dict.fromkeys(phrase)))
    places = F.map_from_entries(F.collect_list(F.struct("term", "positions")))
    found = rows.groupBy("document_id").agg(places.alias("places"))
    return found.select("document_id", matches(F.col("places"), F.array(*map(F.lit, phrase))).alias("matches")).where("matches > 0")


def rank(index: Index, terms: list[str], phrases: list[list[str]] = (), subset: DataFrame | None = None, domain: str | None = None) -> DataFrame:
    """``(document_id, score)`` with a score over 0, of the subset's documents if one is given, or of a
    domain's. Postings hold their document's length, so they meet the weights, which are broadcast, and
    then each other by document."""
    rows = index.postings(terms)
    if domain is not None:
        rows = rows.where(domain_of(rows) == domain)
    if subset is not None:
        rows = rows.join(subset.select("document_id").distinct(), "document_id", "left_semi")
    rows = rows.join(F.broadcast(weights(index, terms)), "term")
    return _summed(rows, list(phrases)).where("score > 0")


def order() -> list:
    """Best first; scores equal to nine places go by document."""
    return [F.round("score", 9).desc(), F.col("document_id").asc()]


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best; Spark keeps k rows a task and merges them."""
    if k <= 0:
        raise ValueError("topK must be greater than 0")
    return scores.where("score > 0").orderBy(*order()).limit(k)


def numbered(scores: DataFrame, k: int) -> DataFrame:
    """The k best with their rank from 1; only those rows are numbered."""
    return ordered(top(scores, k))


def ordered(best: DataFrame) -> DataFrame:
    """A few best rows with their rank from 1."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order())))


def page_bounds(total: int, page: int, limit: int) -> tuple[int, int, int, int]:
    """``(page, limit, total_pages, ranked)`` after clamping; ``ranked`` rows are ranked at most, so
    pages beyond MAX_RANKED results are empty though total_pages counts them."""
    limit = min(max(1, limit), MAX_PAGE)
    pages = max(1, -(-total // limit))
    page = min(max(1, page), pages)
    return page, limit, pages, min(page * limit, MAX_RANKED)
