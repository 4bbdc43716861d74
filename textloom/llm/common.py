"""What the operators share: tables, the shared scratch folder, connected components."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.shared import delete, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark's reader gives it; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new path under the shared folder, which driver and executors all see."""
    return f"{_own(spark)}/{uuid.uuid4().hex}"


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths."""
    for p in paths:
        delete(spark, p)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder and not yet deleted. Results
    of the operators read from there: call it when they have been written or collected."""
    forget(spark, _own(spark))


def materialise(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, the rows survive a lost
    executor, and Spark knows their size. The path goes to ``keep``, for forget(); else it stays
    until clear()."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # hashes and texts do not repeat
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that a worker takes from an Arrow batch at once, and bytes of such a batch.
PIECE, BATCH = 2 << 20, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send Arrow batches of BATCH bytes at most to Python workers. Spark's own bound
    of 64 MB is held several times over on both sides, for each task of an executor at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def pieces(b: pa.RecordBatch, text: int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batch in slices with some ``most`` bytes in column number ``text``, of one row at least. What
    a worker makes of a slice is so bounded, whatever the texts' lengths."""
    size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield b.slice(at, end - at)
        at = end
    release()


def release() -> None:
    """Give memory that is free back to the system; workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
        if trim:
            trim(0)


#: Bytes that a side of a join may have to be broadcast.
MAX_BROADCAST = 24 << 20


def small(df: DataFrame, size: int | None = None) -> DataFrame:
    """df, to be broadcast if its rows have MAX_BROADCAST bytes at most; beyond that the join shuffles.
    size: the bytes, where rows hold arrays or structs; else they are summed now, 24 a row, 8 a
    column and the bytes of strings."""
    if size is None:
        texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
        size = df.agg(F.sum(sum(texts, F.lit(24 + 8 * len(df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= MAX_BROADCAST else df


#: Keys that come in more than this share of all rows are few, so they may always be broadcast.
HOT = 1e-4


def join_hot(rows: DataFrame, side: DataFrame, key: str, n: str, total: int, size: int | None = None) -> DataFrame:
    """Inner join with ``side``, one row a key, whose column ``n`` is the number of rows the key has of
    ``total``. A small side is broadcast. Else only the keys that have over HOT of all rows are,
    fewer than 1 / HOT; the others are joined by shuffle, where no key fills a task. size: see small()."""
    if (told := small(side, size)) is not side:
        return rows.join(told, key)
    hot = F.col(n) > HOT * total
    often = materialise(side.where(hot))
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti")
    return rows.join(F.broadcast(often), key).unionByName(rest.join(side.where(~hot), key))


def numbered(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs written once, columns named c0, c1, ... by their place, with a ``row`` number that tells
    equal rows apart."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return materialise(plain.withColumn("row", F.monotonically_increasing_id()), keep)


def renamed(rows: DataFrame, docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """rows of numbered(docs) under the names that docs has, and ``extra`` columns after them; where
    docs has such a name, the extra column's gets leading underscores."""
    out, names = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], set(docs.columns)
    for c in extra:
        name = c
        while name in names:
            name = f"_{name}"
        names.add(name)
        out.append(F.col(c).alias(name))
    return rows.select(*out)


def _rank(node: Column, turn: int) -> Column:
    return node if turn % 2 == 0 else F.xxhash64(node, F.lit(turn))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(src, dst)`` as ``(node, component)``, where
    component is the smallest node. Nodes without an edge to another node are not returned.

    Randomised contraction: each node joins the neighbour (or itself) of least rank, edges are
    relabelled and made distinct, and so on until none is left; then labels are carried back. Ranks
    alternate between the node itself, which folds a star around its least node in one turn, and
    a fresh hash, which halves paths. Every turn is a few shuffles, aggregates with partial results;
    nothing comes to the driver but one emptiness test a turn. The edges of a hub meet in its joins
    with ``reps``, which adaptive execution splits by size (one row a node on the other side).
    """
    spark, paths, turns = edges.sparkSession, [], []
    left = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    left = materialise(left.distinct(), paths)
    turn = 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        if turn % 2 == 0:
            best = both.groupBy("src").agg(F.min("dst").alias("near"))
        else:
            best = both.groupBy("src").agg(F.min_by("dst", _rank(F.col("dst"), turn)).alias("near"))
        rep = F.when(_rank(F.col("near"), turn) < _rank(F.col("src"), turn), F.col("near")).otherwise(F.col("src"))
        reps = materialise(best.select(F.col("src").alias("node"), rep.alias("rep")), paths)
        turns.append(reps)
        a = reps.select(F.col("node").alias("src"), F.col("rep").alias("a"))
        b = reps.select(F.col("node").alias("dst"), F.col("rep").alias("b"))
        moved = left.join(a, "src").join(b, "dst").where("a <> b")
        left = materialise(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), paths)
        turn += 1
    if not turns:
        node = edges.schema["src"].dataType
        return edges.select(F.col("src").alias("node"), F.col("src").cast(node).alias("component")).where("false")
    labels = turns[-1]
    for reps in reversed(turns[:-1]):
        up = labels.select(F.col("node").alias("rep"), F.col("rep").alias("root"))
        labels = materialise(reps.join(up, "rep", "left").select("node", F.coalesce("root", "rep").alias("rep")), paths)
    least = labels.groupBy("rep").agg(F.min("node").alias("component"))
    least = materialise(least, paths)
    out = materialise(labels.join(least, "rep").select("node", "component"))
    forget(spark, *paths)
    return out
