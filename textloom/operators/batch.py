"""Many queries at once: a table of queries meets the postings in one join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text
from textloom.functions.stem import stem_word
from textloom.operators import rank
from textloom.operators.index import Index


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem_word(w) for w in ws])


#: Stems of an array of words, taken once for each row. The stemmer's column form is for distinct words: a join
#: on its result would push a filter through all its steps, each time writing out the ones before.
stems = _stems.asNondeterministic()


#: Rows of query and term, with their idf some 50 bytes each, that are broadcast to the postings at most.
FEW = 200_000


def parsed(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``(query_id, query)`` the distinct terms ``(query_id, term)``, those of the whole query, and
    the quoted phrases ``(query_id, phrases)`` that keep more than one token. A query without terms,
    null ones among them, has no row. Rows that share a query_id are one query with the terms of all."""
    words = queries.select("query_id", stems(text.tokens(F.col("query"), text.QUERY_LEAST)).alias("terms"))
    terms = words.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).distinct()
    quoted = queries.select("query_id", F.explode(text.query_phrases(F.col("query"))).alias("words"))
    phrases = quoted.select("query_id", stems(F.col("words")).alias("p")).groupBy("query_id").agg(F.collect_list("p").alias("phrases"))
    return terms, phrases


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, document_id, score)`` of every document that holds a term of the query.

    The postings are read once and joined with the queries' terms, which carry their idf, by term; what
    a query finds in a document then meets by query and document, positions of phrases too. Postings
    of terms that no query has drop out in that join; a frequent term's postings are split by
    adaptive execution, as the other side has only the queries that ask for it. Where no query quotes
    anything, positions are neither read nor shuffled: scores are sums of three numbers, taken from forward
    rows where the index has them, so that a document's terms are added up before the exchange. Up to
    FEW terms of queries are broadcast, and postings meet them where they are read.
    """
    terms, phrases = parsed(queries)
    quoted = phrases.select("query_id", F.explode(F.flatten("phrases")).alias("term"), F.lit(True).alias("quoted")).distinct()
    corpus = F.broadcast(index.corpus())  # one row
    value = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(index.document_frequencies(), "term").crossJoin(corpus).select("query_id", "term", value.alias("idf"), "avgdl")
    score = F.sum(rank.part(F.col("tf"), F.col("doc_len"))).alias("score")
    few = weighed.limit(FEW + 1).count() <= FEW
    if phrases.isEmpty():
        if few and index.numbered is not None:
            forward = index.numbered.rows().select("document_id", "doc_len", F.explode(F.arrays_zip("terms.term", "terms.tf")).alias("t"))
            rows = forward.select("document_id", "doc_len", "t.term", "t.tf")
        else:
            rows = index.postings().select("term", "document_id", "tf", "doc_len")
        rows = rows.join(F.broadcast(weighed) if few else weighed, "term")
        return rows.groupBy("query_id", "document_id").agg(score).where("score > 0")
    asked = weighed.join(quoted, ["query_id", "term"], "left")
    rows = index.postings().select("term", "document_id", "tf", "positions", "doc_len").join(F.broadcast(asked) if few else asked, "term")
    places = F.map_from_entries(F.collect_list(F.when(F.col("quoted"), F.struct("term", "positions"))))
    found = rows.groupBy("query_id", "document_id").agg(score, places.alias("places"))
    found = found.join(phrases, "query_id", "left")
    counts = F.transform(F.coalesce("phrases", F.array().cast("array<array<string>>")), lambda p: rank.matches(F.col("places"), p))
    return found.select("query_id", "document_id", rank.boosted(F.col("score"), counts).alias("score")).where("score > 0")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, document_id, score)``: the k best documents of each query ``(query_id, query)``,
    ranked as one query alone would be. Each task keeps a query's k best before they meet."""
    if k <= 0:
        raise ValueError("topK must be greater than 0")
    best = Window.partitionBy("query_id").orderBy(*rank.order())
    found = scores(index, queries).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "document_id", "score")
