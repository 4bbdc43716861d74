"""The best documents from the best postings: levels of impact, and bounds for what was not read.

A term's postings lie by level, the greatest impact first. A search reads each term's first levels. A
document that it met has at least the score of what it read, and at most the bounds of the terms that it
did not see more; one that it did not meet has at most all bounds. Once no other document can reach
the k-th of the least scores, the few that can are looked up by number and scored in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import rank
from textloom.operators.index import Index

#: Shares of the terms' postings that are read in turn; beyond the last one, all are.
SHARES = (1 / 64, 1 / 8, 1 / 3)
#: Documents that are looked up by number at most.
LOOKED_UP = 2000
#: Scores are ordered to nine places, so a bound less than this below a score may still tie with it.
CLOSE = 1e-8


@dataclass
class Found:
    """Ranked rows, and how many of the terms' postings were read for them."""

    rows: DataFrame  # document_id, score
    read: int
    total: int


def levels(index: Index, terms: list[str]) -> dict[str, list[tuple[int, int, float]]]:
    """Of each term ``(level, n, top)``, best first, top with its idf: some fifty rows a term."""
    rows = index.stored["bounds"].where(F.col("term").isin(*terms)) if terms else index.stored["bounds"].limit(0)
    out: dict[str, list[tuple[int, int, float]]] = {}
    for r in rows.join(F.broadcast(rank.idf(index, terms)), "term").orderBy("level").collect():
        out.setdefault(r["term"], []).append((r["level"], r["n"], r["top"] * r["idf"]))
    return out


def cuts(of: dict[str, list[tuple[int, int, float]]], most: float) -> dict[str, int]:
    """The last level of each term that is read, -1 for none: all levels that can add a like part of their
    term's best, as small a part as ``most`` postings allow."""
    steps = sorted({top / rows[0][2] for rows in of.values() for _, _, top in rows}, reverse=True)
    chosen = {t: -1 for t in of}
    for part in steps:
        now = {t: max((lv for lv, _, top in rows if top >= part * rows[0][2]), default=-1) for t, rows in of.items()}
        if sum(n for t, rows in of.items() for lv, n, _ in rows if lv <= now[t]) > most:
            break
        chosen = now
    return chosen


def top(index: Index, terms: list[str], k: int) -> Found:
    """The rows of rank.top(rank.rank()), from as few of the postings as the bounds allow. A share is
    read, more if that does not settle it, and at last everything: the rows are the same always.
    To the driver come bounds, a row a term and level, and at most LOOKED_UP documents' numbers."""
    if k <= 0:
        raise ValueError("topK must be greater than 0")
    of = levels(index, terms)
    total, read = sum(n for rows in of.values() for _, n, _ in rows), 0
    for share in SHARES if index.numbered is not None else ():
        cut = cuts(of, total * share)
        new = sum(n for t, rows in of.items() for lv, n, _ in rows if lv <= cut[t])
        if new < k or new == read:
            continue
        read = new
        numbers = _survivors(index, of, cut, k)
        if numbers is not None:
            return Found(rank.top(_scored(index, terms, numbers), k), read, total)
    return Found(rank.top(rank.rank(index, terms), k), total, total)


def _survivors(index: Index, of: dict, cut: dict[str, int], k: int) -> list[int] | None:
    """Numbers of all documents that may be among the k best, or nothing if that cannot be told yet."""
    open_ = {t: next((top for lv, _, top in rows if lv > cut[t]), 0.0) for t, rows in of.items()}
    parts = [(F.col("term") == t) & (F.col("level") <= c) for t, c in cut.items() if c >= 0]
    wanted = parts[0]
    for p in parts[1:]:
        wanted = wanted | p
    rows = index.postings().where(wanted).join(F.broadcast(rank.weights(index, list(of))), "term")
    bound = F.create_map(*(x for t, b in open_.items() for x in (F.lit(t), F.lit(b))))[F.col("term")]
    met = rows.groupBy("docno").agg(F.sum(rank.part(F.col("tf"), F.col("doc_len"))).alias("least"), F.sum(bound).alias("seen")).persist()
    try:
        best = met.orderBy(F.col("least").desc()).limit(k).agg(F.min("least").alias("kth"), F.count(F.lit(1)).alias("n")).first()
        rest = sum(open_.values())
        if best["n"] < k or rest >= best["kth"] - CLOSE:
            return None
        able = met.where(F.col("least") + rest - F.col("seen") >= best["kth"] - CLOSE)
        numbers = [r["docno"] for r in able.select("docno").limit(LOOKED_UP + 1).collect()]
        return numbers if len(numbers) <= LOOKED_UP else None
    finally:
        met.unpersist()


def _scored(index: Index, terms: list[str], numbers: list[int]) -> DataFrame:
    """``(document_id, score)`` of a few documents, by their forward rows."""
    rows = index.numbered.find(numbers).select("document_id", "doc_len", F.explode(F.arrays_zip("terms.term", "terms.tf")).alias("t"))
    rows = rows.select("document_id", "doc_len", F.col("t.term").alias("term"), F.col("t.tf").alias("tf")).where(F.col("term").isin(*terms))
    rows = rows.join(F.broadcast(rank.weights(index, terms)), "term")
    return rows.groupBy("document_id").agg(F.sum(rank.part(F.col("tf"), F.col("doc_len"))).alias("score"))
