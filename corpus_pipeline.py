"""A corpus from raw documents to token ids, in five stages, each written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import byte_bpe, line_crf, line_dedup, mixing, simhash
from textloom.llm.common import materialise, table
from textloom.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them. Rows that repeat, and rows
    with a null id, are judged each; an empty table stays empty; other columns play no part."""
    return line_crf.filter_quality(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first by id stays; a document that loses its last line goes, one that had no
    line, or a null text, stays. n_chars follows the text. Each row decides for itself, so of equal
    rows one keeps its lines; an empty table stays empty."""
    out = line_dedup.dedup_lines(docs)
    n_lines, n_removed = (F.col(f"`{c}`") for c in out.columns[-2:])
    out = out.where((n_removed < n_lines) | (n_lines == 0))
    changed = F.when(n_removed > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by words of five and a similarity of 0.8, the one with the smallest doc_id stays
    (null last, ties by a hash of the text, of equal rows any). Null and empty texts are copies of
    each other; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a document comes as often as the mix takes it. Null sources are
    one source, rows without words go, rows equal in id and text are taken one by one; an empty
    table stays empty."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, and how many; null and empty texts have none. Rows are independent;
    an empty table stays empty, and a column named ids plays no part."""
    out = byte_bpe.encode(docs, tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Labelling by Viterbi, MinHash and BPE are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
