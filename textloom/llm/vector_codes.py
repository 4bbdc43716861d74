"""Vector codes: each part of a vector becomes the index of its nearest codebook entry.

Codebooks come from Lloyd's rounds in whole numbers, kept up by differences. Vectors are written once
as integers, dealt to buckets by row; each round writes the rows' new assignments, dealt alike, so
vectors meet their previous assignments bucket by bucket without a shuffle. An entry's sum and count
run on from round to round: only parts that moved are counted, plus where they went and minus where they
came from, and only these counts, summed within tasks first, are shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import forget, materialise, scratch, small, small_batches

#: Values that a worker compares with the codebooks at once.
CHUNK = 1 << 18
#: Bytes of integer vectors in a bucket, about.
BUCKET = 128 << 20
#: Up to this magnitude distances are exact in doubles; beyond it Python's integers count.
EXACT = 1 << 21
LONG = np.iinfo(np.int64)


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null for a vector that is null or empty or holds null or
    non-finite components. Components beyond a long's range stop at its ends."""
    x = F.transform(vector, lambda v: v.cast("double"))
    infinite = F.lit(float("inf"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < infinite)) & (F.size(x) > 0)
    top = F.lit(float(1 << 62))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(x, lambda v: F.floor(F.greatest(F.least(v * float(scale), top), -top)).cast("long")))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest entry, the lower index of equals, and its squared distance."""
    if max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) < EXACT:
        a, e = x.astype(np.float64), entries.astype(np.float64)
        d = (e * e).sum(1) - 2 * (a @ e.T)
        at = d.argmin(1)
        return at, (d[np.arange(len(x)), at] + (a * a).sum(1)).astype(np.int64)
    a, e = x.astype(object), entries.astype(object)
    d = ((a[:, None, :] - e[None, :, :]) ** 2).sum(2)
    at = np.array([min(range(len(e)), key=row.__getitem__) for row in d], np.int64)
    return at, np.array([min(int(d[i, j]), LONG.max) for i, j in enumerate(at)], np.int64)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``(row, part)`` and squared distances alike, of rows ``(row, part, place)``."""
    codes, errors = np.zeros(x.shape[:2], np.uint8), np.zeros(x.shape[:2], np.int64)
    step = max(1, CHUNK // max(1, books.shape[1] * x.shape[1]))
    for at in range(0, len(x), step):
        for p in range(x.shape[1]):
            codes[at : at + step, p], errors[at : at + step, p] = nearest(x[at : at + step, p], books[p])
    return codes, errors


def _rows(column: pa.Array, parts: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, len(flat) // max(1, len(column)) // parts)


@dataclass
class Compressed:
    """``codes (id, label, code, error)``, code being a byte a part, and the final codebooks, by part,
    entry and place."""

    codes: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in order, as decimals parted by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


class Lloyd:
    """The state of a run: vectors ``(row, q)`` in buckets, the last assignments ``(row, code)`` in the
    same buckets, and on the driver, as small as the codebooks, each entry's count and sums."""

    def __init__(self, vectors: DataFrame, parts: int, books: np.ndarray):
        """vectors: (row, q) and whatever else the result needs."""
        self.spark: SparkSession = vectors.sparkSession
        self.parts, self.books = parts, books
        self.counts = np.zeros(books.shape[:2], np.int64).astype(object)
        self.sums = np.zeros(books.shape, np.int64).astype(object)
        self.paths, self.tables = [], []
        size = vectors.agg(F.sum(F.size("q").cast("long") * 8)).first()[0] or 0
        self.buckets = max(self.spark.sparkContext.defaultParallelism, -(-size // BUCKET))
        self.vectors = self._keep(vectors.repartition(self.buckets, "row"))
        self.assigned: DataFrame | None = None

    def _keep(self, df: DataFrame) -> DataFrame:
        """df as a table in buckets by row, in the shared folder."""
        name, at = f"textloom_{uuid.uuid4().hex}", scratch(self.spark)
        df.write.bucketBy(self.buckets, "row").option("path", at).saveAsTable(name)
        self.paths.append(at)
        self.tables.append(name)
        return self.spark.table(name)

    def _meet(self) -> DataFrame:
        """Vectors with their last code, null in the first round."""
        if self.assigned is None:
            return self.vectors.withColumn("old", F.lit(None).cast("binary"))
        return self.vectors.join(self.assigned.select("row", F.col("code").alias("old")).hint("shuffle_hash"), "row")

    def round(self) -> bool:
        """Assign all parts, count those that moved, and replace the entries; false if none moved."""
        parts, books = self.parts, self.books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _rows(b.column(1), parts)
                codes, _ = assign(x, books)
                old = b.column(2)
                first = old.null_count == len(old)
                before = np.full(codes.shape, -1, np.int16) if first else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(codes.shape).astype(np.int16)
                row, part = np.nonzero(before != codes)
                moved = pa.StructArray.from_arrays(
                    [pa.array(part.astype(np.int16)), pa.array(before[row, part]), pa.array(codes[row, part].astype(np.int16)), pa.FixedSizeListArray.from_arrays(pa.array(x[row, part].ravel()), x.shape[2]).cast(pa.list_(pa.int64()))],
                    names=["part", "old", "new", "x"],
                )
                ends = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), moved)], ["row", "code", "moved"])

        found = self._meet().select("row", "q", "old").mapInArrow(run, "row long, code binary, moved array<struct<part: smallint, old: smallint, new: smallint, x: array<bigint>>>")
        self.assigned = self._keep(found)
        moved = self.assigned.where("size(moved) > 0").select(F.explode("moved").alias("m")).select("m.*")
        plus_minus = F.array(F.struct(F.col("new").alias("entry"), F.lit(1).alias("sign")), F.struct(F.col("old").alias("entry"), F.lit(-1).alias("sign")))
        rows = moved.select("part", "x", F.explode(plus_minus).alias("e")).where("e.entry >= 0")
        wide = F.col("e.sign").cast("decimal(1,0)")
        total = [F.sum(F.col("x")[i].cast("decimal(20,0)") * wide).alias(f"s{i}") for i in range(books.shape[2])]
        deltas = rows.groupBy("part", "e.entry").agg(F.sum("e.sign").alias("n"), *total).collect()  # a row an entry
        for r in deltas:
            self.counts[r["part"], r["entry"]] += int(r["n"])
            self.sums[r["part"], r["entry"]] += np.array([int(r[f"s{i}"]) for i in range(books.shape[2])], object)
        used = self.counts > 0
        fresh = books.astype(object)
        fresh[used] = self.sums[used] // self.counts[used][:, None]
        self.books = fresh.astype(np.int64)
        while len(self.tables) > 2:  # vectors and the last assignments
            self.spark.sql(f"drop table {self.tables.pop(1)}")
            forget(self.spark, self.paths.pop(1))
        return bool(deltas)

    def finish(self) -> DataFrame:
        """The vectors' other columns with ``code`` and ``error`` by the final entries, written."""
        parts, books = self.parts, self.books
        rest = [c for c in self.vectors.columns if c not in ("row", "q")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes, errors = assign(_rows(b.column(0), parts), books)
                whole = errors.astype(object).sum(1) if len(errors) and errors.max() > LONG.max // parts else errors.sum(1)
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[1:], code, pa.array([min(int(e), LONG.max) for e in whole], pa.int64())], [*rest, "code", "error"])

        kinds = ", ".join(f"{c} {self.vectors.schema[c].dataType.simpleString()}" for c in rest)
        out = materialise(self.vectors.select("q", *rest).mapInArrow(run, f"{kinds}, code binary, error long"))
        for name, at in zip(self.tables, self.paths, strict=True):
            self.spark.sql(f"drop table {name}")
            forget(self.spark, at)
        return out


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Compressed:
    """Codes of all vectors that have finite components only, and the codebooks.

    Codebooks start as the parts of the vectors with the smallest ids (null last, ties by components);
    with fewer vectors than ``entries`` they are shorter. The first of them tells the length of a
    vector, which ``parts`` must divide; vectors of another length take no part. Repeated rows each
    count; no vectors give no codes; other columns play no part. Rounds end early, with the same
    result, when nothing moves. Errors beyond a long stop at its end.
    """
    if entries > 256:
        raise ValueError("a code is a byte a part: 256 entries at most")
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), quantised(F.col(vector_col), scale).alias("q")).where("q is not null")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    size = len(first[0]["q"]) if first else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components do not have {parts} equal parts")
    rows = rows.where(F.size("q") == size)
    start = np.array([r["q"] for r in first if len(r["q"]) == size], np.int64).reshape(-1, parts, size // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    if not len(start):
        return Compressed(rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books)
    run = Lloyd(rows.withColumn("row", F.monotonically_increasing_id()), parts, books)
    for _ in range(rounds):
        if not run.round():
            break
    return Compressed(run.finish(), run.books)


def decode(code: Column, books: np.ndarray, scale: int = 4096) -> Column:
    """The vector that a code stands for: the middle of its entries' cells."""
    values = F.lit([[[(v + 0.5) / scale for v in entry] for entry in part] for part in books.tolist()])
    index = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    return F.flatten(F.array(*(values[p][index(p)] for p in range(len(books)))))


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with ``label_error``, the errors of equal labels summed, nulls together. A label's sum comes
    back by broadcast where labels are few; else by a join with one row a label on one side."""
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    codes = codes.withColumn("__key", key)
    sums = materialise(codes.groupBy("__key").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("label_error")))
    sums = sums.withColumn("label_error", F.least("label_error", F.lit(LONG.max).cast("decimal(30,0)")).cast("long"))
    return codes.join(small(sums), "__key").drop("__key")
