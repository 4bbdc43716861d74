"""The inverted index as DataFrames: postings, document lengths, vocabulary, statistics, bounds."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import urls
from textloom.functions.stem import stem_once, with_stem
from textloom.functions.text import DOCUMENT_LEAST, STOP_WORDS

#: Bytes of text that a worker takes from a batch at once, and stems that it remembers.
PIECE, REMEMBERED = 2 << 20, 200_000
_WORD = re.compile(f"[a-z0-9]{{{DOCUMENT_LEAST},}}").findall
_STOPS = frozenset(STOP_WORDS)
#: Bytes of a row group, about: a table with fewer of them than the cores at hand is dealt out first.
ROW_GROUP = 128 << 20
#: BM25's constants, and levels to a unit of a posting's impact, which is less than K1 + 1.
K1, B, LEVELS = 1.5, 0.75, 20
#: Suggestions that are kept for a prefix, and characters of the prefixes that have them.
MAX_SUGGESTED, MAX_PREFIX = 50, 24


class Stems(dict):
    """From a word to its stem; stop words are None. Emptied when it is full."""

    def __missing__(self, word: str) -> str | None:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = None if word in _STOPS else stem_once(word)
        return found


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        yield b.slice(at, end - at)
        at = end


def dealt(documents: DataFrame) -> DataFrame:
    """documents over all cores where their files have fewer row groups than there are cores, so that
    reading gives few tasks; larger tables are read as they lie."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return documents.repartition(cores) if size <= cores * ROW_GROUP else documents


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.array(sizes, np.int64))).astype(np.int32)), values)


def _places(places: list[list[int]]) -> tuple[pa.Array, pa.ListArray]:
    """Lengths of lists, and the lists."""
    sizes = list(map(len, places))
    return pa.array(sizes, pa.int64()), _lists(sizes, pa.array(np.fromiter(chain.from_iterable(places), np.int32, sum(sizes))))


def _positions(kept: list[str], wanted: frozenset | None = None) -> dict[str, list[int]]:
    at: dict[str, list[int]] = {}
    for pos, term in enumerate(kept):
        if wanted is None or term in wanted:
            if term in at:
                at[term].append(pos)
            else:
                at[term] = [pos]
    return at


def _postings(documents: DataFrame, terms: list[str] | None) -> DataFrame:
    """``(term, document_id, tf, positions, doc_len)`` in one narrow pass: a document's words are grouped
    where they are read, and only the terms that are asked for leave the pass."""
    wanted = None if terms is None else frozenset(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem_of = Stems()
        for b in batches:
            for part in _pieces(b):
                owners, found, places, lengths = [], [], [], []
                for i, content in enumerate(part.column(1).to_pylist()):
                    kept = [t for t in map(stem_of.__getitem__, _WORD(content.lower())) if t is not None]
                    at = _positions(kept, wanted)
                    owners += [i] * len(at)
                    lengths += [len(kept)] * len(at)
                    found += at
                    places += at.values()
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), part.column(0).take(pa.array(owners, pa.int64())), *_places(places), pa.array(lengths, pa.int32())], ["term", "document_id", "tf", "positions", "doc_len"])

    kind = documents.schema["document_id"].dataType.simpleString()
    return dealt(documents.select("document_id", "content")).mapInArrow(run, f"term string, document_id {kind}, tf long, positions array<int>, doc_len int")


def analysed(documents: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Documents in one pass, a row each: ``(document_id, doc_len, terms, words)``, terms with tf and
    positions, words, not stemmed, with their number. All tables of an index come from it. only: the
    terms to keep, and no words; every document has its row and its length all the same."""
    wanted = None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem_of = Stems()
        for b in batches:
            for part in _pieces(b):
                lengths, n_terms, terms, places, n_words, words, counts = [], [], [], [], [], [], []
                for content in part.column(1).to_pylist():
                    found = _WORD(content.lower())
                    kept = [t for t in map(stem_of.__getitem__, found) if t is not None]
                    at, n = _positions(kept, wanted), Counter(found if wanted is None else ())
                    for w in _STOPS & n.keys():
                        del n[w]
                    lengths.append(len(kept))
                    n_terms.append(len(at))
                    terms += at
                    places += at.values()
                    n_words.append(len(n))
                    words += n
                    counts += n.values()
                tf, lists = _places(places)
                term = pa.StructArray.from_arrays([pa.array(terms, pa.string()), tf, lists], names=["term", "tf", "positions"])
                word = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int32()), _lists(n_terms, term), _lists(n_words, word)], ["document_id", "doc_len", "terms", "words"])

    kind = documents.schema["document_id"].dataType.simpleString()
    shape = f"document_id {kind}, doc_len int, terms array<struct<term: string, tf: bigint, positions: array<int>>>, words array<struct<word: string, n: bigint>>"
    return dealt(documents.select("document_id", "content")).mapInArrow(run, shape)


def forward(documents: DataFrame) -> DataFrame:
    """analysed() with ``docno``, a number that grows within a task, and ``domain``."""
    return analysed(documents).select(F.monotonically_increasing_id().alias("docno"), "document_id", "doc_len", urls.domain(F.col("document_id").cast("string")).alias("domain"), "terms", "words")


def impact(tf: Column, doc_len: Column, avgdl: Column) -> Column:
    """What a posting adds to a score, but for the term's idf."""
    return F.when(doc_len > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avgdl))).otherwise(0.0)


def inverted(rows: DataFrame, avgdl: float) -> DataFrame:
    """Postings of forward rows: ``(term, level, docno, document_id, tf, positions, doc_len, domain)``. The
    level tells how much a posting adds to a score, 0 the most, so a term's best are its first."""
    flat = rows.select(F.explode("terms").alias("t"), "docno", "document_id", "doc_len", "domain")
    level = F.floor((K1 + 1 - impact(F.col("t.tf"), F.col("doc_len"), F.lit(avgdl))) * LEVELS).cast("int")
    return flat.select("t.term", level.alias("level"), "docno", "document_id", "t.tf", "t.positions", "doc_len", "domain")


def bounds(postings: DataFrame, avgdl: float) -> DataFrame:
    """``(term, level, n, top)``: how many postings of the term are on the level, and their greatest impact."""
    top = F.max(impact(F.col("tf"), F.col("doc_len"), F.lit(avgdl))).alias("top")
    return postings.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), top)


def completions(vocabulary: DataFrame, most: int = MAX_SUGGESTED, longest: int = MAX_PREFIX) -> DataFrame:
    """``(prefix, rank, word, frequency)``: the ``most`` frequent words of each prefix, ties by word.
    Every task thins its words of a prefix to so many before they meet, so the first letters, which
    all words share out among a few, fill no task."""
    words = vocabulary.where(F.length("word") >= 2)
    ends = F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest)))
    rows = words.select(F.explode(ends).alias("n"), "word", "frequency").select(F.substring("word", F.lit(1), F.col("n")).alias("prefix"), "word", "frequency")
    best = Window.partitionBy("prefix").orderBy(F.col("frequency").desc(), "word")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("prefix", "rank", "word", "frequency")


def reweighted(table: DataFrame, changed: DataFrame, most: int = MAX_SUGGESTED, longest: int = MAX_PREFIX) -> DataFrame:
    """completions() after some words, ``changed (word, frequency)``, have come or gained weight: their new
    weights meet the lists of their prefixes, all other lists stay. A word that loses weight may
    make room for one that no list holds; then the lists have to be made anew."""
    fresh = completions(changed, most, longest)
    touched = fresh.select("prefix").distinct()
    old = table.join(touched, "prefix", "left_semi").join(changed.select("word"), "word", "left_anti")
    both = old.select("prefix", "word", "frequency").unionByName(fresh.select("prefix", "word", "frequency"))
    best = Window.partitionBy("prefix").orderBy(F.col("frequency").desc(), "word")
    made = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    return table.join(touched, "prefix", "left_anti").select("prefix", "rank", "word", "frequency").unionByName(made.select("prefix", "rank", "word", "frequency"))


def _counted(documents: DataFrame) -> DataFrame:
    """``(document_id, word, n)`` of the words that are kept, not stemmed; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _pieces(b):
                owners, words, counts = [], [], []
                for i, content in enumerate(part.column(1).to_pylist()):
                    n = Counter(_WORD(content.lower()))
                    for w in _STOPS & n.keys():
                        del n[w]
                    owners += [i] * len(n)
                    words += n
                    counts += n.values()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owners, pa.int64())), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["document_id", "word", "n"])

    kind = documents.schema["document_id"].dataType.simpleString()
    return dealt(documents.select("document_id", "content")).mapInArrow(run, f"document_id {kind}, word string, n long")


def _lengths(documents: DataFrame) -> DataFrame:
    """``(document_id, doc_len)``; documents without tokens count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _pieces(b):
                n = [sum(w not in _STOPS for w in _WORD(x.lower())) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32())], ["document_id", "doc_len"])

    kind = documents.schema["document_id"].dataType.simpleString()
    return dealt(documents.select("document_id", "content")).mapInArrow(run, f"document_id {kind}, doc_len int")


class Index:
    """What searching needs of an index. This one has its tables: ``postings (term, document_id, tf,
    positions, doc_len)``, where positions count the words that are kept, ``words (document_id, word,
    n)``, not stemmed, and ``doc_lengths (document_id, doc_len)``. Stored tables are sorted by term
    and by word, so that the terms of a query are a filter on the scan. A stored index may also
    have, by name: vocabulary, frequencies ``(term, df)``, corpus ``(n, total)``, bounds, completions."""

    def __init__(self, documents: DataFrame, postings: DataFrame, words: DataFrame, doc_lengths: DataFrame, vocabulary: DataFrame | None = None, **stored: DataFrame):
        self.documents, self.doc_lengths = documents, doc_lengths
        self._postings, self._words, self._vocabulary, self.stored = postings, words, vocabulary, stored
        # stores that are looked up by key, if there are any: documents by id, forward rows by docno
        self.keyed = self.numbered = None

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """All postings, or those of the terms."""
        return self._postings if terms is None else _of_terms(self._postings, terms)

    def words(self) -> DataFrame:
        return self._words

    def vocabulary(self) -> DataFrame:
        """``(word, frequency)`` of unstemmed words of two characters or more."""
        if self._vocabulary is not None:
            return self._vocabulary
        return self.words().groupBy("word").agg(F.sum("n").alias("frequency"))

    def dictionary(self) -> DataFrame:
        """``(word, term)``: the stem of each distinct word."""
        return with_stem(self.vocabulary().select("word"))

    def term_positions(self, terms: list[str] | None = None) -> DataFrame:
        """``(document_id, pos, term)``, of all terms or of the given ones only."""
        return self.postings(terms).select("document_id", F.explode("positions").alias("pos"), "term")

    def term_frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """``(term, document_id, tf)``."""
        return self.postings(terms).select("term", "document_id", "tf")

    def document_frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """``(term, df)``: a posting is a document, so counting them is enough."""
        if "frequencies" in self.stored:
            return self.stored["frequencies"] if terms is None else _of_terms(self.stored["frequencies"], terms)
        return self.postings(terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def corpus(self) -> DataFrame:
        """One row ``(n, avgdl)``; an empty index has 0 and 0."""
        if "corpus" in self.stored:
            return self.stored["corpus"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.try_divide(F.sum("total").cast("double"), F.sum("n")), F.lit(0.0)).alias("avgdl"))
        return self.doc_lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl"))

    def stats(self) -> DataFrame:
        """``(total_documents, total_terms, average_document_length)``, the last to two places."""
        terms = self.document_frequencies().select("term").distinct().agg(F.count(F.lit(1)).alias("total_terms"))
        shown = F.floor(F.col("avgdl") * 100 + 0.5) / 100
        return self.corpus().crossJoin(terms).select(F.col("n").alias("total_documents"), "total_terms", shown.alias("average_document_length"))

    def candidates(self, terms: list[str]) -> DataFrame:
        """Documents that hold any of the terms."""
        return self.postings(terms).select("document_id").distinct()

    def hits(self, terms: list[str]) -> DataFrame:
        """Candidates with their ``domain``, which stored postings have beside them."""
        rows = self.postings(terms)
        return rows.select("document_id", domain_of(rows)).distinct()

    def suggestions(self, prefix: str, n: int) -> DataFrame:
        """The n most frequent words ``(word, frequency)`` with the prefix, best first: the prefix's own
        rows of the stored lists, or a range of the vocabulary where these end."""
        if "completions" in self.stored and n <= MAX_SUGGESTED and len(prefix) <= MAX_PREFIX:
            rows = self.stored["completions"].where((F.col("prefix") == prefix) & (F.col("rank") <= n))
            return rows.orderBy("rank").select("word", "frequency")
        rows = self.vocabulary().where((F.length("word") >= 2) & F.col("word").startswith(prefix))
        return rows.orderBy(F.col("frequency").desc(), "word").limit(n)


def _of_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    return rows.where(F.col("term").isin(*terms)) if terms else rows.limit(0)


def domain_of(rows: DataFrame) -> Column:
    """The column ``domain`` of rows that have it, else what the document's id says."""
    return F.col("domain") if "domain" in rows.columns else urls.domain(F.col("document_id").cast("string")).alias("domain")


class Fresh(Index):
    """An index of documents as they are: each table is one narrow pass over the texts, made when it
    is asked for."""

    def __init__(self, documents: DataFrame):
        super().__init__(documents, None, None, _lengths(documents))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        return _postings(self.documents, terms)

    def words(self) -> DataFrame:
        return _counted(self.documents)


def build(documents: DataFrame) -> Fresh:
    """Index ``(document_id, content)``; null and empty contents are left out."""
    return Fresh(documents.where("content is not null and content <> ''").select("document_id", "content"))


def from_tokens(tokens: DataFrame) -> Index:
    """An index over ``(document_id, tokens)`` that are stemmed already; used by tests."""
    words = tokens.select("document_id", F.posexplode("tokens").alias("pos", "term"))
    postings = words.groupBy("term", "document_id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    postings = postings.join(tokens.select("document_id", F.size("tokens").alias("doc_len")), "document_id")
    docs = tokens.select("document_id", F.concat_ws(" ", "tokens").alias("content"))
    return Index(docs, postings, postings.select("document_id", F.col("term").alias("word"), F.col("tf").alias("n")), tokens.select("document_id", F.size("tokens").alias("doc_len")))


def merged(old: Index, new: Index) -> Index:
    """One index of both: documents that the new one has replace those of the old one. Only ids are
    compared; a hidden document's rows are left out by an anti join."""
    ids = new.doc_lengths.select("document_id")

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        cols = [c for c in a.columns if c in b.columns]
        return a.join(ids, "document_id", "left_anti").select(*cols).unionByName(b.select(*cols))

    return Index(both(old.documents, new.documents), both(old.postings(), new.postings()), both(old.words(), new.words()), both(old.doc_lengths, new.doc_lengths))


def latest(versions: DataFrame, by: str) -> DataFrame:
    """One row a document_id, that of the greatest ``by``: adding a document again replaces it."""
    rest = [c for c in versions.columns if c != "document_id"]
    best = versions.groupBy("document_id").agg(F.max(F.struct(by, *(c for c in rest if c != by))).alias("row"))
    return best.select("document_id", *(F.col(f"row.{c}").alias(c) for c in rest))
