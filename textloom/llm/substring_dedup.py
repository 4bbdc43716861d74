"""Passages that repeat across documents, found level by level: windows that repeat at one length, and
only those, are extended to twice the length, up to the length asked for.

The first level need not look at every window. A long window is stood for by the short one in it with
the least hash, the leftmost of equals; what repeats as a whole repeats there too, so nothing is lost,
and some two in ``window / 2`` windows are compared. At the second level all windows around short
ones that repeat are named by 128 bits; from then on a window of twice the length is named by the two
names that make it up, without the text. Documents whose text a smaller document repeats as a whole
leave after the first level: whatever they hold is found there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, join_hot, materialise, pieces, small_batches

WINDOW = 50
#: Words that a worker remembers.
REMEMBERED = 200_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """From a word to 64 bits; emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def _mixed(x: np.ndarray, y: np.ndarray, odd: np.uint64) -> np.ndarray:
    """One number of two, in order, with all bits stirred."""
    z = x * odd + (y ^ (y >> np.uint64(32)))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int, odd: np.uint64) -> np.ndarray:
    """A hash of each ``length`` words in a row, by doubling; the last step's halves may overlap."""
    h, n = words, 1
    while n < length:
        step = min(n, length - n)
        h, n = _mixed(h[: max(0, len(h) - step)], h[step:], odd), n + step
    return h


def least_in(h: np.ndarray, length: int) -> np.ndarray:
    """For each ``length`` values in a row the place of the least, the leftmost of equals."""
    if len(h) < length:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(h, length).argmin(1) + np.arange(len(h) - length + 1)


def _half(window: int) -> int:
    return (window + 1) // 2


def _stood_for(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of half the length, and for each window the place of the one that stands for it."""
    h = window_hashes(words, _half(window), _A)
    return h, least_in(h, window - _half(window) + 1)


def _key(id_: Column, text: Column) -> list[Column]:
    """What names a row: its id, and a hash of id and text. Rows that share both are alike."""
    return [id_.alias("id"), F.xxhash64(id_, text).alias("k")]


def _order(id_: Column) -> Column:
    """Ids in order, null last."""
    return F.struct(id_.isNull().alias("none"), id_.alias("id"))


def short_windows(docs: DataFrame, window: int) -> DataFrame:
    """``(id, k, h, at)``: places and hashes of the short windows that stand for longer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = Hashes()
        for b in batches:
            for part in pieces(b, 2):
                owners, found, places = [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    words = _WORDS(text)
                    if len(words) >= window:
                        h, at = _stood_for(np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words)), window)
                        at = np.unique(at)
                        owners.append(np.full(len(at), i))
                        found.append(h[at])
                        places.append(at)
                if owners:
                    own = pa.array(np.concatenate(owners))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], ["id", "k", "h", "at"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "k", "text").where("text is not null").mapInArrow(run, f"id {kind}, k long, h long, at int")


def windows_around(docs: DataFrame, live: DataFrame, window: int) -> DataFrame:
    """``(id, k, a, b, at)``: the windows that the places ``live (id, k, places)`` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = Hashes()
        for b in batches:
            for part in pieces(b, 2):
                owners, lanes, places = [], [], []
                for i, (text, live_at) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    words = _WORDS(text)
                    w = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
                    _, by = _stood_for(w, window)
                    starts = np.flatnonzero(np.isin(by, live_at))
                    owners.append(np.full(len(starts), i))
                    lanes.append([window_hashes(w, window, odd)[starts] for odd in (_A, _B)])
                    places.append(starts)
                own = pa.array(np.concatenate(owners))
                a, b_ = (pa.array(np.concatenate([x[j] for x in lanes]).view(np.int64)) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), a, b_, pa.array(np.concatenate(places).astype(np.int32))], ["id", "k", "a", "b", "at"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.where("text is not null").join(live.select(F.col("id").alias("__id"), F.col("k").alias("__k"), "places"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__k")))
    return rows.select("id", "k", "text", "places").mapInArrow(run, f"id {kind}, k long, a long, b long, at int")


def repeated(rows: DataFrame, name: list[str]) -> DataFrame:
    """rows whose name another document has too, with ``later``: whether a smaller document has it. Names
    are counted with partial sums; those of very many rows come back by broadcast, all others by
    shuffle, so a passage that a third of all documents share fills no task."""
    own = _order(F.col("id"))
    named = rows.groupBy(*name).agg(F.min(own).alias("least"), F.max(own).alias("most"), F.count(F.lit(1)).alias("n"))
    named = materialise(named.where("least < most").select(*name, "least", "n"))
    n = named.agg(F.sum("n")).first()[0] or 0
    found = join_hot(rows, named, name, "n", n, size=named.count() * 64)
    return found.withColumn("later", F.col("least") < own).drop("least", "n")


def whole_copies(docs: DataFrame) -> DataFrame:
    """``(id, k)`` of rows whose whole text a smaller document has too."""
    marks = docs.where("text is not null").select("id", "k", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))
    return repeated(marks, ["a", "b"]).where("later").select("id", "k").distinct()


def doubled(rows: DataFrame, step: int) -> DataFrame:
    """Windows longer by ``step``, of those in ``rows`` whose continuation is there as well."""
    rest = rows.select(F.col("id").alias("__id"), F.col("k").alias("__k"), (F.col("at") - step).alias("__at"), F.col("a").alias("__a"), F.col("b").alias("__b"))
    both = rows.join(rest, F.col("id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__k")) & (F.col("at") == F.col("__at")))
    return both.select("id", "k", F.xxhash64("a", "__a").alias("a"), F.xxhash64(F.lit(7), "b", "__b").alias("b"), "at")


def repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Of docs ``(id, k, text)``: ``(id, k, starts)``, the places of all windows whose words also stand in a
    document with a smaller id, and ``(id, k)`` of whole copies, which are not in the first."""
    keep: list[str] = []
    base = min(window, WINDOW)  # windows of this length are the first that are all named
    short = materialise(short_windows(docs, base), keep)
    live = repeated(short, ["h"]).select("id", "k", "at")
    copies = materialise(whole_copies(docs))
    # equal rows have equal places: a set has each of them once
    live = live.groupBy("id", "k").agg(F.collect_set("at").alias("places"))
    gone = copies.select(F.col("id").alias("__id"), F.col("k").alias("__k"))
    live = materialise(live.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__k")), "left_anti"), keep)
    named = materialise(windows_around(docs, live, base), keep)
    length, survivors = base, repeated(named, ["a", "b"])
    while length < window:
        survivors = materialise(survivors.drop("later").distinct(), keep)
        if survivors.isEmpty():
            break
        step = min(length, window - length)
        length, survivors = length + step, repeated(materialise(doubled(survivors, step), keep), ["a", "b"])
    found = survivors.where("later") if "later" in survivors.columns else survivors.where("false")
    found = materialise(found.groupBy("id", "k").agg(F.collect_set("at").alias("starts")))
    forget(docs.sparkSession, *keep)
    return found, copies


def dedup_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, n_removed, text)`` per row of docs: words covered by a window that also starts
    in a document with a smaller id are removed, and the kept words joined by one space.

    Null and empty texts have no words and give an empty text. Null ids come after all others. Rows
    that share an id take nothing from each other; repeated rows come out alike; a document shorter
    than the window stays whole; an empty table gives an empty result; other columns play no part.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(*_key(F.col("id"), F.col("text")), "text")
    found, copies = repeats(rows, window)
    marks = found.unionByName(copies.select("id", "k", F.array(F.lit(-1)).alias("starts")))
    marks = marks.select(F.col("id").alias("__id"), F.col("k").alias("__k"), "starts")
    rows = rows.join(marks, F.col("id").eqNullSafe(F.col("__id")) & (F.col("k") == F.col("__k")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, 1):
                sizes, removed, kept = [], [], []
                for text, starts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = _WORDS(text or "")
                    sizes.append(len(words))
                    if starts and len(words) >= window:
                        left = _uncovered(len(words), starts, window)
                        removed.append(len(words) - len(left))
                        kept.append(" ".join([words[i] for i in left]))
                    else:
                        removed.append(0)
                        kept.append(" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.select("id", "text", "starts").mapInArrow(run, f"id {kind}, n_words long, n_removed long, text string")
    return out.withColumnRenamed("id", id_col)


def _uncovered(n: int, starts: list[int], window: int) -> list[int]:
    """Places of n words that no window covers; a start of -1 covers all."""
    if starts == [-1]:
        return []
    depth = np.zeros(n + 1, np.int64)
    at = np.array(starts)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + window, -1)
    return np.flatnonzero(np.cumsum(depth[:n]) == 0).tolist()
