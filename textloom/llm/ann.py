"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialise

#: The tree is fitted on at most about so many vectors, and calibrated on so many queries.
SAMPLE, CALIBRATION = 100_000, 64
BRANCHES, LEAF = 8, 24
#: Vectors, and queries, that meet in one group about.
BLOCK, QUERIES = 2048, 512
#: Copies of one vector are thinned in so many heaps before they meet.
SALTS = 16


@dataclass
class Tree:
    """Nodes by number, 0 the root; centres of a node's children, their numbers, and for each leaf
    its number among leaves."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf_of: dict[int, int] = field(default_factory=dict)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to when it goes to the nearest child every time."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
            elif len(rows):
                near = _nearest(x[rows], self.centres[node])
                todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first: a queue of nodes by distance to their centre."""
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if node in self.leaf_of:
                out.append(self.leaf_of[node])
            else:
                for d, c in zip(((self.centres[node] - q) ** 2).sum(1).tolist(), self.children[node], strict=True):
                    heapq.heappush(heap, (d, c))
        return out


    def cells(self, sizes: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """The cell of each leaf: neighbouring leaves together, in the order of the tree, until they have
        about ``block`` of the rows that ``sizes`` counts; a larger leaf is a cell of its own."""
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            todo += reversed(self.children[node])
            if node in self.leaf_of:
                order.append(self.leaf_of[node])
        out, cell, held = np.zeros(len(order), np.int64), 0, 0
        for leaf in order:
            if held and held + sizes[leaf] > block:
                cell, held = cell + 1, 0
            out[leaf] = cell
            held += sizes[leaf]
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def fit_tree(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, rounds: int = 8, seed: int = 5) -> Tree:
    """k-means within each node until a node has ``leaf`` rows of the sample or cannot be split."""
    rng, tree = np.random.default_rng(seed), Tree()
    tree.centres.append(np.empty((0, x.shape[1])))
    tree.children.append([])
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        own = x[rows]
        centres = np.unique(own, axis=0) if len(rows) <= leaf * 4 else own
        if len(rows) > leaf and len(centres) > 1:
            k = min(branches, len(centres), max(2, len(rows) // leaf))
            centres = centres[rng.choice(len(centres), k, replace=False)]
            for _ in range(rounds):
                near = _nearest(own, centres)
                centres = np.stack([own[near == i].mean(0) if (near == i).any() else centres[i] for i in range(k)])
            near = _nearest(own, centres)
            full = [i for i in range(k) if (near == i).any()]
        else:
            full = []
        if len(full) < 2:
            tree.leaf_of[node] = len(tree.leaf_of)
            continue
        tree.centres[node] = centres[full]
        for i in full:
            tree.children[node].append(len(tree.children))
            tree.centres.append(np.empty((0, x.shape[1])))
            tree.children.append([])
            todo.append((tree.children[node][-1], rows[near == i]))
    return tree


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v array<double>)`` of the vectors that take part: not null, without null, NaN or
    infinite components, not zero, and of the commonest length (the greatest, if tied)."""
    v = F.col(vec_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("id"), v.alias("v")).where("v is not null and id is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``(v, ids)``: each vector once, with its ``most`` smallest ids. Copies beyond those can be
    in no answer. Partial limits before each exchange keep a vector that a third of the rows share
    from meeting in one task."""
    rows = rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64("v", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(SALTS)))
    thin = rows.withColumn("n", F.row_number().over(Window.partitionBy("h", "g", "salt").orderBy("id"))).where(F.col("n") <= most)
    thin = thin.withColumn("n", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("n") <= most)
    return thin.groupBy("h", "g").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.empty((0, 0))


def _collected(rows: DataFrame) -> np.ndarray:
    """The vectors ``v`` of a bounded number of rows, as one matrix."""
    found = rows.select("v").toArrow().column(0).combine_chunks()
    return found.flatten().to_numpy().reshape(len(found), -1) if len(found) else np.empty((0, 0))


def _best(q: np.ndarray, x: np.ndarray, ids: list, seen: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query the nearest ``k`` ``(distance, id)`` among the rows it has seen, ties to the smaller
    id. A matrix product leaves out what is surely too far; distances are then taken exactly."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms = (q**2).sum(1)[:, None], (x**2).sum(1)[None, :]
        near = norms[0] + norms[1] - 2 * q @ x.T
    out = []
    for i, d in enumerate(near):
        own = np.flatnonzero(seen[i])
        d = d[own]
        if len(d) > k and np.isfinite(d).all():
            slack = 1e-9 * (norms[0][i, 0] + norms[1][0, own].max())  # far above the product's error
            own = own[d <= np.partition(d, k - 1)[k - 1] + slack]
        exact = _distances(x[own], q[i])
        out.append(sorted((float(e), int(n)) for e, j in zip(exact, own, strict=True) for n in ids[j])[:k])
    return out


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def _calibrate(index: DataFrame, tree: Tree, queries: np.ndarray, k: int, target: float) -> int:
    """How many leaves to visit so that, over these queries, at least ``target`` of the true nearest
    (found against all rows, in blocks) lie in the visited ones. It is widened leaf by leaf."""

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, leaf = _matrix(b["v"]), b["leaf"].to_numpy()
            rows = []
            for i, q in enumerate(queries):
                d = _distances(x, q)
                d[d == 0] = np.inf  # the query itself
                near = np.argsort(d, kind="stable")[:k]
                rows += [(i, float(d[j]), int(leaf[j])) for j in near if np.isfinite(d[j])]
            yield pd.DataFrame(rows, columns=["q", "d", "leaf"])

    found = index.select("leaf", "v").mapInPandas(block, "q int, d double, leaf long")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "leaf"))).where(F.col("n") <= k).select("q", "leaf").toPandas()
    if not len(found):
        return 1
    order = {i: {leaf: n for n, leaf in enumerate(tree.visits(q, len(tree.leaf_of)))} for i, q in enumerate(queries)}
    need = np.array([order[i][leaf] for i, leaf in zip(found["q"], found["leaf"], strict=True)])
    visits = 1
    while (need < visits).mean() < target:
        visits += 1
    return visits


def search(rows: DataFrame, k: int = 10, every: int = 100, target: float = 0.95, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the k nearest found of each row whose id is divisible by
    ``every``, by Euclidean distance in double precision, ties to the smaller id.

    The tree is fitted on a bounded sample; every row is indexed. Neighbouring leaves are put into
    cells of bounded size, larger ones are dealt into several groups, and so are the queries that
    visit them, so neither a crowded leaf nor a popular query fills a task. Unusable vectors (see
    usable()) are neither queries nor answers. Rows that repeat an id count once for each copy of
    their vector; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = usable(rows, id_col, vec_col)
    unique = materialise(distinct_vectors(rows, k + 1))
    n = unique.count()
    schema = "q long, id long, score double"
    if not n:
        empty = spark.createDataFrame([], schema)
        return empty.select(F.col("q").alias("query_id"), F.lit(1).alias("rank"), "id", "score")
    part = F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n))
    tree = fit_tree(_collected(unique.where(part)))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=tree.assign(_matrix(b["v"])))

    index = materialise(unique.mapInPandas(leaves, "h long, g long, v array<double>, ids array<long>, leaf long"))
    asked = rows.where(F.col("id") % every == 0).select("id", F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("g"))
    asked = materialise(asked)
    vectors = materialise(index.join(asked.select("h", "g").distinct(), ["h", "g"], "left_semi").select("h", "g", "v"))
    m = max(vectors.count(), 1)
    some = vectors.where(F.pmod(F.xxhash64("h", F.lit(4)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, CALIBRATION / m)))
    visits = _calibrate(index, tree, _collected(some).reshape(-1, tree.centres[0].shape[1]), k, target)

    sizes = np.zeros(len(tree.leaf_of), np.int64)  # as many as leaves, which the sample bounds
    for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    cell_of = tree.cells(sizes)

    def visiting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, g, v in zip(b["h"], b["g"], b["v"], strict=True):
                leaves = np.array(tree.visits(v, visits))
                cells = cell_of[leaves]
                out += [(h, g, v, int(c), leaves[cells == c]) for c in np.unique(cells)]
            yield pd.DataFrame(out, columns=["h", "g", "v", "cell", "leaves"])

    goes = materialise(vectors.mapInPandas(visiting, "h long, g long, v array<double>, cell long, leaves array<long>"))
    rows_of = np.bincount(cell_of, sizes).astype(int)
    blocks = spark.createDataFrame([(c, max(1, -(-n // BLOCK))) for c, n in enumerate(rows_of.tolist())], "cell long, xs long")
    dealt = goes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("qs")).join(blocks, "cell")
    dealt = F.broadcast(materialise(dealt))  # no more rows than leaves
    cell = F.broadcast(spark.createDataFrame(list(enumerate(cell_of.tolist())), "leaf long, cell long"))
    own = lambda size, s: F.pmod(F.xxhash64("h", F.lit(s)), F.col(size))
    every_one = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1))
    xs = index.join(cell, "leaf").join(dealt, "cell").withColumn("x", own("xs", 5)).withColumn("y", every_one("qs")).select("cell", "x", "y", "leaf", "v", "ids")
    qs = goes.join(dealt, "cell").withColumn("y", own("qs", 6)).withColumn("x", every_one("xs")).select("cell", "x", "y", "h", "g", "v", "leaves")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            leaf = b["leaf"].to_numpy()
            seen = np.stack([np.isin(leaf, x) for x in a["leaves"]])
            found = _best(_matrix(a["v"]), _matrix(b["v"]), b["ids"].tolist(), seen, k + 1)
            out = [(h, g, i, s) for h, g, best in zip(a["h"], a["g"], found, strict=True) for s, i in best]
        return pd.DataFrame(out, columns=["h", "g", "id", "score"])

    met = qs.groupBy("cell", "x", "y").cogroup(xs.groupBy("cell", "x", "y")).applyInPandas(meet, "h long, g long, id long, score double")
    best = met.withColumn("n", F.row_number().over(Window.partitionBy("h", "g").orderBy("score", "id"))).where(F.col("n") <= k + 1)
    best = materialise(best.select("h", "g", F.col("id").alias("found"), "score"))
    answers = asked.withColumnRenamed("id", "query_id").join(best, ["h", "g"]).where("found <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "found"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias("id"), "score")
