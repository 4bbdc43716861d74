"""The document store: schema, readers, unique inserts, and versioned index snapshots."""

from __future__ import annotations

import hashlib
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import token_count
from textloom.operators.index import Index, analysed, bounds, completions, forward, inverted
from textloom.sources import shared
from textloom.sources.keyed import ROW_GROUP, Keyed

SCHEMA = T.StructType(
    [
        T.StructField("document_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("url", T.StringType(), False),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


#: Stored indexes of another format are not read; to be raised when the tables of an index change.
FORMAT = 7


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a corpus: its id keeps its type; titles are unknown."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))


def scan(store: DataFrame) -> DataFrame:
    """What an index build reads: ids and contents that are not empty."""
    return store.select("document_id", "content").where("content is not null and content <> ''")


def exists(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys ``(document_id)`` that are stored."""
    return keys.join(store.select("document_id"), "document_id", "left_semi")


def new_rows(store: DataFrame, rows: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """Rows that may be inserted, one a document_id by ``order``, and the rejected rest."""
    turn = F.row_number().over(Window.partitionBy("document_id").orderBy(order))
    marked = rows.join(store.select("document_id", F.lit(True).alias("__old")).distinct(), "document_id", "left").withColumn("__n", turn)
    fresh = F.col("__old").isNull() & (F.col("__n") == 1)
    return marked.where(fresh).drop("__old", "__n"), marked.where(~fresh).drop("__old", "__n")


def _finish(spark: SparkSession, path: str) -> int:
    """Put the files of the last commit in their place, if whoever made it did not come to it, and say its
    number; 0 before the first."""
    done = shared.names(spark, f"{path}/_commits")
    if not done:
        return 0
    for name in filter(None, shared.read_text(spark, f"{path}/_commits/{done[-1]}").split("\n")):
        shared.move(spark, f"{path}/_staged/{name}", f"{path}/{name.rpartition('/')[2]}")
    return int(done[-1])


def insert(spark: SparkSession, path: str, rows: DataFrame, order: str = "ord") -> int:
    """Append new documents with their times; duplicates are left out. Says how often it had to start again.

    Rows are compared with the store as it is after a commit, written aside, and become the next commit,
    a small file of their files' names. Its number can be taken once: who comes second, compares
    again with what the first one stored, so a document is never stored twice. Then the files are
    moved in, by the one who committed, or by the next one if that one is lost.
    """
    again = 0
    while True:
        number = _finish(spark, path)
        there = [n for n in shared.names(spark, path) if n[0] not in "._"]
        store = spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)
        now = F.current_timestamp()
        fresh, _ = new_rows(store, rows, order)
        full = fresh.select("document_id", "title", "content", "url", now.alias("indexed_at"), now.alias("created_at"), now.alias("updated_at"))
        own = uuid.uuid4().hex
        full.write.parquet(f"{path}/_staged/{own}")
        files = [f"{own}/{n}" for n in shared.names(spark, f"{path}/_staged/{own}") if n.startswith("part-")]
        shared.make_dir(spark, f"{path}/_commits")
        if shared.publish(spark, f"{path}/_commits/{number + 1:012d}", "\n".join(files)):
            _finish(spark, path)
            shared.delete(spark, f"{path}/_staged/{own}")
            return again
        shared.delete(spark, f"{path}/_staged/{own}")
        again += 1


def write_tables(spark: SparkSession, documents: DataFrame, at: str) -> None:
    """The tables of an index of ``(document_id, content)`` under one path. The texts are read once, for the
    forward rows; everything else is made of those, of which each table reads its columns."""
    forward(documents).write.parquet(f"{at}/forward")
    write_postings(spark, at)
    rows = spark.read.parquet(f"{at}/forward")
    df = spark.read.parquet(f"{at}/bounds").groupBy("term").agg(F.sum("n").alias("df"))
    words = rows.select(F.explode("words").alias("w")).groupBy("w.word").agg(F.sum("w.n").alias("frequency"))
    write_counts(at, df, words, rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total")))


def write_postings(spark: SparkSession, at: str) -> None:
    """Postings and bounds of the forward rows at the path, and the ranges of these rows' numbers."""
    rows = Keyed(spark, at, "docno", "forward").measure().rows()
    avgdl = rows.agg(F.avg("doc_len")).first()[0] or 0.0
    order = ("term", "level", "docno")
    inverted(rows, avgdl).repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP).parquet(f"{at}/postings")
    found = bounds(spark.read.parquet(f"{at}/postings"), avgdl)
    found.repartitionByRange("term", "level").sortWithinPartitions("term", "level").write.parquet(f"{at}/bounds")


def write_counts(at: str, frequencies: DataFrame, vocabulary: DataFrame, totals: DataFrame) -> None:
    """``(term, df)``, ``(word, frequency)`` and ``(n, total)`` under the path."""
    frequencies.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/frequencies")
    vocabulary.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{at}/vocabulary")
    totals.write.parquet(f"{at}/corpus")


def write_completions(spark: SparkSession, at: str) -> None:
    """Each prefix's best words, from the vocabulary at the path."""
    made = completions(spark.read.parquet(f"{at}/vocabulary"))
    made.repartitionByRange("prefix").sortWithinPartitions("prefix", "rank").write.option("parquet.block.size", ROW_GROUP).parquet(f"{at}/completions")


class Snapshots:
    """Index versions under one folder. A build writes a new version, postings sorted by term and the
    vocabulary by word, so that other row groups are skipped; last it creates an empty file whose
    name is the version. The greatest name counts: readers see the old version or the new one,
    never a part, and never none. One rebuild runs at a time: it holds a lease, a file that names its
    holder; versions that no reader needs any more are deleted after it."""

    #: Versions that are kept, for readers that opened one before the last rebuild.
    KEPT = 2
    #: Seconds after which a lease that was not renewed no longer counts; its holder renews it six times as often.
    LEASE = 120.0

    #: Seconds after which tables of no version are taken for those of a rebuild that was lost.
    LOST = 86_400.0

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _point(self, version: str) -> None:
        number = int((shared.names(self.spark, f"{self.root}/current") or ["0"])[-1].partition("-")[0]) + 1
        shared.touch(self.spark, f"{self.root}/current/{number:012d}-{version}")

    def rebuilding(self) -> bool:
        """Whether a rebuild is under way."""
        age = shared.age(self.spark, f"{self.root}/lease")
        return age is not None and age <= self.LEASE

    def _take_lease(self, own: str) -> bool:
        shared.make_dir(self.spark, self.root)
        if shared.publish(self.spark, f"{self.root}/lease", own):
            return True
        if self.rebuilding():
            return False
        # its holder is lost: who can rename the old lease away is alone in doing so
        stale = f"{self.root}/stale-{own}"
        try:
            shared.move(self.spark, f"{self.root}/lease", stale)
        except OSError:
            return False
        shared.delete(self.spark, stale)
        return shared.publish(self.spark, f"{self.root}/lease", own)

    def _holds(self, own: str) -> bool:
        return shared.age(self.spark, f"{self.root}/lease") is not None and shared.read_text(self.spark, f"{self.root}/lease") == own

    def _renew(self, own: str, over: threading.Event) -> None:
        """Renew the lease until the rebuild is over; if this process is lost, the lease soon is."""
        while not over.wait(max(1.0, self.LEASE / 6)) and self._holds(own):
            shared.renew(self.spark, f"{self.root}/lease")

    def rebuild(self, store: DataFrame) -> str | None:
        """A new version of all documents ``(document_id, content, ...)``, or nothing where a rebuild is
        under way. An error leaves the old version in place, and so does a lease that ran out."""
        version = uuid.uuid4().hex
        at = f"{self.root}/{version}"
        if not self._take_lease(version):
            return None
        over = threading.Event()
        threading.Thread(target=self._renew, args=(version, over), daemon=True).start()
        try:
            self._write(store, at, version)
            self._clean()  # while the lease is held, so no other rebuild has tables that no pointer names
        finally:
            over.set()
            if self._holds(version):
                shared.delete(self.spark, f"{self.root}/lease")
        return version

    def _write(self, store: DataFrame, at: str, version: str) -> None:
        try:
            # the store may be costly to make, such as pages that are parsed: it is made once, the tables read what lies there
            documents = Keyed.write(store, f"{at}/documents", made={"doc_len": token_count(F.coalesce("content", F.lit("")))})
            write_tables(self.spark, scan(documents.rows()), at)
            write_completions(self.spark, at)
            if not self._holds(version):
                raise TimeoutError("the lease of the rebuild ran out")
            self._point(version)
        except BaseException:
            shared.delete(self.spark, at)
            raise

    def _clean(self) -> None:
        """Delete the pointers and tables of all but the last KEPT versions, clear()'s among them, and what
        rebuilds that were lost have left."""
        names = shared.names(self.spark, f"{self.root}/current")
        kept = {n.partition("-")[2] for n in names[-self.KEPT :]}
        for n in names[: -self.KEPT]:
            shared.delete(self.spark, f"{self.root}/current/{n}")
        for folder in shared.names(self.spark, self.root):
            old = shared.age(self.spark, f"{self.root}/{folder}/documents")
            if folder not in kept | {"current", "lease"} and (old is None or old > self.LOST or any(n.endswith(folder) for n in names)):
                shared.delete(self.spark, f"{self.root}/{folder}")

    def current(self) -> Index | None:
        """The index of the current version, or nothing before the first build and after clear()."""
        version = (shared.names(self.spark, f"{self.root}/current") or ["0-"])[-1].partition("-")[2]
        if not version:
            return None
        found = read_tables(self.spark, f"{self.root}/{version}", ("completions",))
        found.keyed = Keyed(self.spark, f"{self.root}/{version}/documents")
        found.documents = found.keyed.rows().drop("doc_len")
        return found

    def clear(self) -> None:
        """From now on there is no index."""
        self._point("")


def read_tables(spark: SparkSession, at: str, more: tuple[str, ...] = ()) -> Index:
    """The index that write_tables() wrote; it has no documents of its own."""
    read = lambda name: spark.read.parquet(f"{at}/{name}")
    rows = read("forward")
    words = rows.select("document_id", F.explode("words").alias("w")).select("document_id", "w.word", "w.n")
    stored = {name: read(name) for name in ("frequencies", "corpus", "bounds", *more)}
    found = Index(rows.select("document_id", F.lit(None).cast("string").alias("content")), read("postings"), words, rows.select("document_id", "doc_len"), read("vocabulary"), **stored)
    found.numbered = Keyed(spark, at, "docno", "forward")
    return found


def stored_index(spark: SparkSession, name: str, source: str, make) -> Index:
    """The stored index of a source's documents, in the shared folder: built from ``make()`` where none
    was, and again where the source's files have changed. Who finds another one building it waits."""
    key = hashlib.sha1(f"{FORMAT} {name} {shared.stamp(spark, source)}".encode()).hexdigest()
    snapshots = Snapshots(spark, f"{shared.shared_dir(spark)}/textloom-index/{key}")
    while (found := snapshots.current()) is None:
        if snapshots.rebuild(make()) is None:
            time.sleep(1)
    return found


class OneQuestion:
    """An index for the terms of one query over documents that have none: they are written once to the shared
    folder and read in one pass, which keeps each document's length and its postings of these terms. That
    takes a small part of an index build, so a single search does not pay for all that later ones
    might ask. As a context it deletes what it wrote at its end; results have to be held by then."""

    def __init__(self, store: DataFrame, terms: list[str]):
        self.spark, self.terms, self.store = store.sparkSession, terms, store
        self.at = f"{shared.shared_dir(self.spark)}/textloom/{self.spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def __enter__(self) -> Index:
        try:
            self.store.write.parquet(f"{self.at}/documents")
            documents = self.spark.read.schema(self.store.schema).parquet(f"{self.at}/documents")
            analysed(scan(documents), self.terms).drop("words").write.parquet(f"{self.at}/terms")
        except BaseException:
            shared.delete(self.spark, self.at)
            raise
        rows = self.spark.read.parquet(f"{self.at}/terms")
        postings = rows.select(F.explode("terms").alias("t"), "document_id", "doc_len").select("t.term", "document_id", "t.tf", "t.positions", "doc_len")
        return Index(documents, postings, None, rows.select("document_id", "doc_len"))

    def __exit__(self, *error) -> None:
        shared.delete(self.spark, self.at)


def held(rows: DataFrame) -> DataFrame:
    """A few rows, such as a page of results, as they are now, whatever becomes of what they were made of."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
