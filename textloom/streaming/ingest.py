"""Incremental ingest: new document files become the index's tables, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.index import Index, build
from textloom.sources.segments import Segments


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "document_id string, content string") -> StreamingQuery:
    """Postings, words and lengths of documents that arrive as parquet files under ``source``. A batch
    that is tried again overwrites its own folder, so each document is added once; documents that
    come again in later batches are for the reader to thin (see stored())."""

    def add(batch: DataFrame, number: int) -> None:
        index = build(batch)
        for name, rows in (("documents", index.documents), ("postings", index.postings()), ("words", index.words()), ("doc_lengths", index.doc_lengths)):
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_segments(spark: SparkSession, source: str, root: str, checkpoint: str, schema: str = "document_id string, content string", merge: bool = True) -> StreamingQuery:
    """Documents that arrive as parquet files under ``source`` become segments of an index that searches
    read (see sources.segments). A batch that is tried again is added once; of documents that come
    twice in a batch the one with the greater content counts. Full tiers are merged after a batch."""
    segments = Segments(spark, root)

    def add(batch: DataFrame, number: int) -> None:
        segments.add(batch.groupBy("document_id").agg(F.max("content").alias("content")), number)
        if merge:
            segments.compact()

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, target: str) -> Index:
    """An index of each document's last batch, to be searched on its own or merged (see
    index.merged) with a snapshot, whose documents it replaces."""
    read = {n: spark.read.parquet(f"{target}/{n}") for n in ("documents", "postings", "words", "doc_lengths")}
    last = read["doc_lengths"].groupBy("document_id").agg(F.max("batch").alias("batch"))
    keep = lambda n: read[n].join(last, ["document_id", "batch"], "left_semi").drop("batch")
    return Index(*map(keep, read))
