"""Mixing sources to target weights: whole copies, then Pareto order sampling. DataFrame functions only.

A source's target is its weighted share of all words, held under ``most`` times its own words. Within
a source a document's expected copies fall with the number of binary digits of its size, so that no
giant decides the source's share; they are scaled to meet the target and stop at ``most``. The whole
part of them is certain. The rest, p, is the inclusion probability of one more copy: documents are
ranked by their random odds over their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in
that order until the source's remaining words are met as nearly as whole documents can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialise, numbered, renamed, small

WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the rank's histogram; only the documents of one cell a source are ever sorted.
CELLS = 1 << 16


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digits(size: str = "size") -> Column:
    return F.length(F.bin(F.col(size)))


def source_targets(sizes: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(source, source_size, target)`` of ``(source, size)``: weights repeat over the sources by
    code point, null last; a source at its cap passes the excess on by weight. The sources' order
    needs one task, which holds a row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))) + 1).cast("double"))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    whole = Window.partitionBy(F.lit(1))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    level = F.try_divide(F.sum("source_size").over(whole) - zero(F.sum("cap").over(before)), F.sum("w").over(whole) - zero(F.sum("w").over(before)))
    per = per.withColumn("full", level > F.col("ratio"))
    rest = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    left = F.sum("source_size").over(whole) - zero(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole))
    return per.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.try_divide(F.col("w") * left, rest))).alias("target"))


def expected_copies(sizes: DataFrame, targets: DataFrame, most: float = 3.0) -> DataFrame:
    """``(source, digits, whole, p)`` for each source and number of binary digits of a size."""
    cells = sizes.groupBy("source", _digits().alias("digits")).agg(F.sum("size").alias("s"))
    t = targets.select(F.col("source").alias("__s"), "target")
    cells = cells.join(small(t), F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("w", F.lit(1.0) / F.col("digits"))
    own = Window.partitionBy("source")
    before = own.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    after = own.orderBy("digits").rowsBetween(0, Window.unboundedFollowing)
    scale = F.try_divide(F.col("target") - most * F.coalesce(F.sum("s").over(before), F.lit(0)), F.sum(F.col("w") * F.col("s")).over(after))
    cells = cells.withColumn("full", F.coalesce(scale * F.col("w") >= most, F.lit(False)))
    free = F.sum(F.when(~F.col("full"), F.col("w") * F.col("s"))).over(own)
    left = F.col("target") - most * F.coalesce(F.sum(F.when(F.col("full"), F.col("s"))).over(own), F.lit(0))
    copies = F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.coalesce(F.try_divide(F.greatest(left, F.lit(0.0)), free) * F.col("w"), F.lit(0.0))))
    cells = cells.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    return cells.select("source", "digits", "whole", (F.col("copies") - F.col("whole")).alias("p"), "s")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that the parts fix."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def drawn(row: Column, ident: Column, source: Column, text: Column, seed: int) -> list[Column]:
    """Columns ``row, source, size, u, v``: u is fixed by the id and the text, v, which no two rows share,
    tells rows apart that have both in common."""
    plain = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    u = _uniform(plain(ident), F.md5(plain(text)), F.lit(str(seed)))
    return [row.alias("row"), source.alias("source"), size_of(text).alias("size"), u.alias("u"), F.xxhash64(row).alias("v")]


def _edge(cells: DataFrame, left: DataFrame) -> DataFrame:
    """``(source, edge, base, left)``: the cell in which a source's sum, in the order of its cells
    and from ``below`` on, reaches ``left``, and the sum before it. A source has CELLS / 256 or
    256 cells here, so its window is short however many documents it has."""
    upto = F.sum("s").over(Window.partitionBy("source").orderBy("cell"))
    sums = cells.withColumn("upto", upto).join(small(left.withColumnRenamed("source", "__l")), F.col("source").eqNullSafe(F.col("__l")))
    sums = sums.withColumn("upto", F.col("upto") + F.col("below")).withColumn("base", F.col("upto") - F.col("s"))
    return materialise(sums.where("upto >= left and base < left").select("source", F.col("cell").alias("edge"), "base", "left"))


class Mix:
    """What deciding a document's copies needs: a row a source, and a row a source and size class."""

    def __init__(self, sizes: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)):
        """sizes: see drawn(). Aggregates go by source, then by source and cell with partial sums, so
        a source with a third of all rows is never gathered in one task; only the distinct odds of
        the cell that holds a source's cut are ordered."""
        self.targets = materialise(source_targets(sizes, most, weights))
        cells = expected_copies(sizes, self.targets, most)
        self.classes = materialise(cells)
        ranked = self.ranked(sizes).where("p > 0 and size > 0")
        left = self.classes.groupBy("source").agg(F.sum(F.col("whole") * F.col("s")).alias("certain"))
        left = self.targets.join(left.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).select("source", (F.col("target") - F.col("certain")).alias("left"))
        hist = materialise(ranked.groupBy("source", "cell").agg(F.sum("size").alias("s")))
        rough = hist.groupBy("source", F.shiftright("cell", 8).alias("cell")).agg(F.sum("s").alias("s"))
        band = _edge(rough, left.select("source", "left", F.lit(0).cast("long").alias("below")))
        inner = band.select(F.col("source").alias("__b"), F.col("edge").alias("__e"))
        fine = hist.join(small(inner), F.col("source").eqNullSafe(F.col("__b")) & (F.shiftright("cell", 8) == F.col("__e"))).select("source", "cell", "s")
        edge = _edge(fine, band.select("source", "left", F.col("base").alias("below"))).withColumnRenamed("source", "__s")
        inside = ranked.join(small(edge), F.col("source").eqNullSafe(F.col("__s")) & (F.col("cell") == F.col("edge")))
        tied = inside.groupBy("source", "odds", "base", "left").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("source").orderBy("odds").rowsBetween(Window.unboundedPreceding, -1)
        tied = tied.withColumn("before", F.col("base") + F.coalesce(F.sum("s").over(order), F.lit(0)))
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("left") - F.col("before")) / F.col("s")))
        # a single row is taken or not; of rows with equal odds, as many as come nearest to the target
        tied = tied.withColumn("m", F.when(F.col("n") == 1, (part > 0.5).cast("long")).otherwise(F.round(part * F.col("n")).cast("long")))
        sum_ = F.col("before") + F.col("m") / F.col("n") * F.col("s")
        best = F.struct(F.abs(sum_ - F.col("left")).alias("off"), sum_.alias("sum"), "odds", "m", "n")
        cut = tied.groupBy("source").agg(F.min(best).alias("best")).select(F.col("source").alias("__c"), "best")
        cut = edge.join(cut, F.col("__s").eqNullSafe(F.col("__c")), "left")
        cuts = materialise(cut.select("__s", "edge", F.col("best.odds").alias("cut"), F.col("best.m").alias("m"), F.col("best.n").alias("n")))
        last = self._last(ranked, cuts.where("m > 0 and m < n"))
        cuts = cuts.join(last, F.col("__s").eqNullSafe(F.col("__v")), "left")
        vcut = F.when(F.col("m") == F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("vcut"))
        self.cuts = materialise(cuts.select("__s", "edge", "cut", vcut.alias("vcut")))

    def _last(self, ranked: DataFrame, cuts: DataFrame) -> DataFrame:
        """``(__v, vcut)``: of a source's rows that are equal in odds the m-th by v. They may be very many:
        they are counted by v's upper bits first, and only those of one such cell are put in order."""
        some = small(cuts.select(F.col("__s").alias("__t"), "cut", "m"))
        equal = ranked.join(some, F.col("source").eqNullSafe(F.col("__t")) & (F.col("odds") == F.col("cut"))).withColumn("high", F.shiftright("v", 48))
        upto = F.sum("k").over(Window.partitionBy("source").orderBy("high"))
        hist = equal.groupBy("source", "high", "m").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", upto)
        cell = hist.where((F.col("upto") >= F.col("m")) & (F.col("upto") - F.col("k") < F.col("m")))
        cell = cell.select(F.col("source").alias("__h"), F.col("high").alias("__c"), (F.col("m") - F.col("upto") + F.col("k")).alias("nth"))
        inside = equal.join(small(materialise(cell)), F.col("source").eqNullSafe(F.col("__h")) & (F.col("high") == F.col("__c")))
        turn = F.row_number().over(Window.partitionBy("source").orderBy("v"))
        return inside.withColumn("turn", turn).where("turn = nth").select(F.col("source").alias("__v"), F.col("v").alias("vcut"))

    def ranked(self, df: DataFrame) -> DataFrame:
        """df, which has source and size, with whole, p, odds and cell."""
        c = small(self.classes.select(F.col("source").alias("__k"), F.col("digits").alias("__d"), "whole", "p"))
        u = F.col("u")
        df = df.join(c, F.col("source").eqNullSafe(F.col("__k")) & (_digits() == F.col("__d"))).drop("__k", "__d")
        df = df.withColumn("odds", F.when(F.col("p") > 0, (u / (1 - u)) * ((1 - F.col("p")) / F.col("p"))))
        return df.withColumn("cell", F.floor(F.col("odds") / (1 + F.col("odds")) * CELLS).cast("int"))

    def decide(self, df: DataFrame) -> DataFrame:
        """df, which has source and size, with source_size, target and copies; a left join to
        tables of a row a source, by broadcast where they are small."""
        t = self.targets.select(F.col("source").alias("__t"), "source_size", "target")
        df = self.ranked(df).join(small(t), F.col("source").eqNullSafe(F.col("__t"))).drop("__t")
        df = df.join(small(self.cuts), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        below = (F.col("odds") < F.col("cut")) | ((F.col("odds") == F.col("cut")) & (F.col("v") <= F.col("vcut")))
        taken = (F.col("cell") < F.col("edge")) | ((F.col("cell") == F.col("edge")) & below)
        copies = F.col("whole") + F.coalesce(taken & (F.col("p") > 0), F.lit(False)).cast("long")
        return df.withColumn("copies", copies.cast("long")).drop("whole", "p", "odds", "cell", "edge", "cut", "vcut", "u", "v")


def mix(docs: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: ``(id_col, source, size, source_size, target, copies, taken)``.

    Null and empty texts have size 0 and are taken 0 words. A document's random number is fixed by
    its id and text, so reruns agree; of rows that have both in common as many are taken as the target
    needs, whichever they are and however they are dealt out, whether their id is null or not. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    sizes = materialise(rows.select("id", *drawn(F.col("row"), F.col("id"), F.col("source"), F.col("text"), seed)))
    out = Mix(sizes, most, weights).decide(sizes)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its columns as they came. Rows
    without words get no copies; null sources are one source; see mix() for ids and repeated rows.
    The texts are written once, with row numbers; targets and cuts come to them by broadcast."""
    rows = numbered(docs)
    name = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)}
    drawn_ = drawn(F.col("row"), name[id_col], name[source_col], name[text_col], seed)
    sizes = materialise(rows.select(*drawn_))
    base = rows.select(F.struct(*(f"c{i}" for i in range(len(docs.columns)))).alias("doc"), *drawn_[1:])
    out = Mix(sizes, most, weights).decide(base)
    out = out.where("copies > 0 and size > 0").select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc"))
    return renamed(out.select("doc.*"), docs)
