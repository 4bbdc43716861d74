"""An index that grows by batches: segments, deletion marks, counts kept as differences, and merges.

A manifest, a numbered file, lists the segments. Who adds a batch writes a segment and publishes the next
number; who finds it taken looks again at what the other one added. A document that comes again is
marked in the segments that had it, and the new segment counts it off: the number of documents, their
length, and the documents and occurrences of a term or word are sums over all segments. FAN segments of
one size become one of the next, without the marked documents, so a search reads few segments.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.index import Index
from textloom.sources import shared
from textloom.sources.corpus import scan, write_counts, write_postings, write_tables

#: Segments of a tier that become one of the next.
FAN = 4
#: Manifests that are kept, with what they name, for readers that opened one.
KEPT = 2


class Segments:
    def __init__(self, spark: SparkSession, root: str, fan: int = FAN):
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan

    # manifests

    def _state(self) -> tuple[int, dict]:
        """The last manifest and its number: ``segments``, oldest first, each ``{at, tier, hidden}``, where
        hidden names tables of marked ids, and ``batch``, the last numbered batch."""
        names = shared.names(self.spark, f"{self.root}/manifests")
        if not names:
            return 0, {"segments": [], "batch": -1}
        return int(names[-1]), json.loads(shared.read_text(self.spark, f"{self.root}/manifests/{names[-1]}"))

    def _publish(self, number: int, state: dict) -> bool:
        shared.make_dir(self.spark, f"{self.root}/manifests")
        return shared.publish(self.spark, f"{self.root}/manifests/{number:012d}", json.dumps(state))

    def _read(self, at: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{at}/{name}")

    def _live(self, segment: dict, name: str) -> DataFrame:
        """A segment's table without the marked documents. Marks are ids only; a segment without any is
        read as it is."""
        rows = self._read(segment["at"], name)
        if not segment["hidden"]:
            return rows
        marks = self.spark.read.parquet(*(f"{self.root}/{h}" for h in segment["hidden"]))
        return rows.join(marks, "document_id", "left_anti").select(*rows.columns)

    # adding

    def add(self, documents: DataFrame, batch: int | None = None) -> bool:
        """Add documents ``(document_id, content)``, one row an id; those that are there are replaced. Empty
        contents are not indexed, and a document that becomes empty leaves. batch: a number that
        grows; a batch that was added before is left out, so it may be tried again. False if it was."""
        own = uuid.uuid4().hex
        write_tables(self.spark, scan(documents), f"{self.root}/{own}/new")
        ids = documents.select("document_id").where("document_id is not null").distinct()
        turn = 0
        while True:
            number, state = self._state()
            if batch is not None and batch <= state["batch"]:
                shared.delete(self.spark, f"{self.root}/{own}")
                return False
            at = f"{own}/{turn}"
            segments = [dict(s) for s in state["segments"]]
            gone = self._mark(segments, ids, at)
            self._count(own, at, gone)
            segments.append({"at": f"{own}/new", "counts": at, "tier": 0, "hidden": []})
            if self._publish(number + 1, {"segments": segments, "batch": state["batch"] if batch is None else batch}):
                break
            shared.delete(self.spark, f"{self.root}/{at}")
            turn += 1
        self._clean()
        return True

    def _mark(self, segments: list[dict], ids: DataFrame, at: str) -> DataFrame | None:
        """Mark the ids in the segments that have them, and give these documents' forward rows. Ids are
        looked for in the forward tables' id columns; their rows are read only where there are any."""
        gone = []
        for i, s in enumerate(segments):
            marks = self._live(s, "forward").select("document_id").join(ids, "document_id", "left_semi")
            marks.write.parquet(f"{self.root}/{at}/marks-{i}")
            marks = self._read(at, f"marks-{i}")
            if not marks.isEmpty():
                gone.append(self._read(s["at"], "forward").join(marks, "document_id", "left_semi"))
                s["hidden"] = [*s["hidden"], f"{at}/marks-{i}"]
        return reduce(DataFrame.unionByName, gone) if gone else None

    def _count(self, own: str, at: str, gone: DataFrame | None) -> None:
        """What the batch adds to the counts, and takes off for the documents it replaces."""
        df, words, totals = (self._read(f"{own}/new", n) for n in ("frequencies", "vocabulary", "corpus"))
        if gone is not None:
            df = df.unionByName(gone.select(F.explode("terms.term").alias("term"), F.lit(-1).cast("long").alias("df")))
            less = gone.select(F.explode("words").alias("w")).select("w.word", (-F.col("w.n")).alias("frequency"))
            words = words.unionByName(less)
            totals = totals.unionByName(gone.select(F.lit(-1).cast("long").alias("n"), (-F.col("doc_len")).cast("long").alias("total")))
        write_counts(f"{self.root}/{at}", *self._summed(df, words, totals))

    @staticmethod
    def _summed(df: DataFrame, words: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        return (
            df.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"),
            words.groupBy("word").agg(F.sum("frequency").alias("frequency")).where("frequency <> 0"),
            totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")),
        )

    # reading

    def current(self) -> Index | None:
        """An index of all documents as they are now, or nothing before the first batch."""
        _, state = self._state()
        segments = state["segments"]
        if not segments:
            return None
        union = lambda name: reduce(DataFrame.unionByName, (self._live(s, name) for s in segments))
        counts = lambda name: reduce(DataFrame.unionByName, (self._read(s["counts"], name) for s in segments))
        df, words, totals = self._summed(counts("frequencies"), counts("vocabulary"), counts("corpus"))
        rows = union("forward")
        flat = rows.select("document_id", F.explode("words").alias("w")).select("document_id", "w.word", "w.n")
        none = rows.select("document_id", F.lit(None).cast("string").alias("content"))
        return Index(none, union("postings").drop("level", "docno"), flat, rows.select("document_id", "doc_len"), words, frequencies=df, corpus=totals)

    def sizes(self) -> list[int]:
        """The tiers of the segments, oldest first."""
        return [s["tier"] for s in self._state()[1]["segments"]]

    # merging

    def compact(self) -> int:
        """Merge full tiers until none is left; the number of merges. A merge that others overtake, by
        merging the same segments, is given up."""
        done = 0
        while (full := self._full()) is not None:
            done += self._merge(full)
        return done

    def _full(self) -> list[dict] | None:
        by: dict[int, list[dict]] = {}
        for s in self._state()[1]["segments"]:
            by.setdefault(s["tier"], []).append(s)
        return next((by[t][: self.fan] for t in sorted(by) if len(by[t]) >= self.fan), None)

    def _merge(self, parts: list[dict]) -> int:
        own = uuid.uuid4().hex
        at = f"{own}/new"
        rows = reduce(DataFrame.unionByName, (self._live(s, "forward") for s in parts)).drop("docno")
        rows.select(F.monotonically_increasing_id().alias("docno"), "*").write.parquet(f"{self.root}/{at}/forward")
        write_postings(self.spark, f"{self.root}/{at}")
        counts = lambda name: reduce(DataFrame.unionByName, (self._read(s["counts"], name) for s in parts))
        # counted off for later batches or not, a segment's counts go on as they are: only their sum counts
        write_counts(f"{self.root}/{own}/0", *self._summed(counts("frequencies"), counts("vocabulary"), counts("corpus")))
        known = {s["at"]: set(s["hidden"]) for s in parts}
        while True:
            number, state = self._state()
            now = {s["at"]: s for s in state["segments"]}
            if not known.keys() <= now.keys():
                shared.delete(self.spark, f"{self.root}/{own}")
                return 0
            late = [h for a, before in known.items() for h in now[a]["hidden"] if h not in before]
            merged = {"at": at, "counts": f"{own}/0", "tier": parts[0]["tier"] + 1, "hidden": late}
            first = min(i for i, s in enumerate(state["segments"]) if s["at"] in known)
            rest = [s for s in state["segments"] if s["at"] not in known]
            if self._publish(number + 1, {**state, "segments": [*rest[:first], merged, *rest[first:]]}):
                self._clean()
                return 1

    def _clean(self) -> None:
        """Delete manifests but the last KEPT, and segments that only the deleted ones name."""
        names = shared.names(self.spark, f"{self.root}/manifests")
        folders = lambda state: {p.split("/")[0] for s in state["segments"] for p in (s["at"], s["counts"], *s["hidden"])}
        read = lambda n: json.loads(shared.read_text(self.spark, f"{self.root}/manifests/{n}"))
        kept = set().union(*(folders(read(n)) for n in names[-KEPT:]))
        for n in names[:-KEPT]:
            for folder in folders(read(n)) - kept:
                shared.delete(self.spark, f"{self.root}/{folder}")
            shared.delete(self.spark, f"{self.root}/manifests/{n}")
