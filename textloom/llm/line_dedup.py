"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, components.

A line is compared in its normal form: lower case, white space folded. Lines of one normal form are
one class, named by a 64-bit hash (of 10^11 classes some 270 pairs would share a name). Classes
whose sets of K-character shingles have a Jaccard similarity of at least 0.8 are linked, links are
closed to components, and of each component exactly one line stays: the first by id, text, line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import forget, join_hot, materialise, numbered, renamed, small
from textloom.llm.minhash import SIMILAR, Chars, lines, linked, sketched

K = 8


def duplicates(rows: DataFrame) -> DataFrame:
    """``(row, n_lines, gone array<int>)`` of every row ``(row, id, text)``: how many lines have more than
    white space, and the places of those that are not the first of their component, null for none.

    The first is by id (null last), then by a hash of the text, the row's number and the place. So each
    row decides for itself, whether its id is null, repeated or its own.
    """
    paths: list[str] = []
    sketch = materialise(sketched(rows, lines, Chars(K)), paths)
    found = linked(rows, sketch, lines, Chars(K), SIMILAR)
    places = sketch.where("classes is not null").select("row", "id", "mark", F.posexplode("classes").alias("no", "line")).where("line is not null")
    per_line = places.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    per_line = per_line.join(small(found), per_line["line"] == found["node"], "left").where("n > 1 or node is not null")
    per_line = materialise(per_line.select("line", "n", F.coalesce("component", "line").alias("component")), paths)
    again = per_line.groupBy("component").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("component")
    rule = materialise(per_line.join(small(materialise(again, paths)), "component").select("line", "n", "component"), paths)
    total = rule.agg(F.sum("n")).first()[0] or 0
    places = materialise(join_hot(places, rule, "line", "n", total).drop("line", "n"), paths)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "row", "no")).alias("first")
    best = places.groupBy("component").agg(first, F.count(F.lit(1)).alias("n"))
    best = materialise(best.select("component", "n", F.col("first.row").alias("keep_row"), F.col("first.no").alias("keep_no")), paths)
    gone = join_hot(places.select("row", "no", "component"), best, "component", "n", total).where("row <> keep_row or no <> keep_no")
    gone = materialise(gone.groupBy("row").agg(F.collect_list("no").alias("gone")), paths)
    size = gone.agg(F.sum(F.size("gone") * 4 + 64)).first()[0] or 0
    per_row = sketch.where("classes is not null").select("row", F.size(F.array_compact("classes")).alias("n_lines"))
    out = materialise(per_row.join(small(gone, size), "row", "left"))
    forget(rows.sparkSession, *paths)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's surviving lines, and ``n_lines`` and ``n_removed`` long (lines with more
    than white space; columns of docs that have these names keep them, and the new ones get a
    leading underscore). Null texts stay null; blank lines stay. A text may become empty. Rows that
    repeat, or have no id, are rows of their own: of equal rows one keeps its lines. An empty table
    gives an empty result."""
    rows = numbered(docs)
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.col(name[text_col])
    found = duplicates(rows.select("row", F.col(name[id_col]).alias("id"), text.alias("text")))
    size = found.agg(F.sum(F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")) * 4 + 48)).first()[0] or 0
    out = rows.join(small(found, size), "row").withColumn("n_lines", F.col("n_lines").cast("long"))
    out = out.withColumn("n_removed", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    out = out.withColumn(name[text_col], F.when(F.col("gone").isNull(), text).otherwise(kept))
    return renamed(out, docs, ("n_lines", "n_removed"))
