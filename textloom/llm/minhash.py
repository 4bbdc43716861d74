"""MinHash banding over classes of equal texts: candidates, exact Jaccard, components.

A unit is what is compared: a line, or a whole text. Units of one normal form are one class, named by
a 64-bit hash. Sets of shingles are compared by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import components, forget, materialise, pieces, small, small_batches

SIMILAR = 0.8
#: 10 bands of 4: a pair at 0.8 shares a band with probability 0.995, at 0.9 with 0.99998.
BANDS, ROWS = 10, 4
#: Buckets with up to so many classes give pairs, which other buckets often give, too; larger ones are
#: dealt into blocks.
PAIRWISE = 12
#: Members of a block about, and bytes of their texts.
BLOCK, BLOCK_BYTES = 128, 8 << 20
#: Cells of a slice of the 0-1 matrices.
CELLS = 4_000_000
#: Code points that are hashed together.
CHUNK = 1 << 15
#: Classes that a worker remembers to have sketched; beyond it the memory is emptied.
SEEN = 200_000

_SEED = np.random.default_rng(20240601)
_MUL = (_SEED.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def normal(text: str) -> str:
    """Lower case, white space folded and trimmed; blank texts are empty."""
    return " ".join(text.lower().split())


#: What a text does not hold whose lines need no folding: white space but for single blanks inside of
#: lines and line ends.
_UNEVEN = ["  ", " \n", "\n ", *(chr(c) for c in (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]


def lines(text: str) -> list[str | None]:
    """The normal form of each line, None for blank ones. Even texts are folded as they are."""
    low = text.lower()
    if low.startswith(" ") or low.endswith(" ") or any(map(low.__contains__, _UNEVEN)):
        return [normal(x) or None for x in text.split("\n")]
    return [x or None for x in low.split("\n")]


def whole(text: str) -> list[str]:
    return [normal(text)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(k: int) -> np.ndarray:
    return np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(k)], np.uint64)


def windows(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k values that do not cross the border of two texts; counts >= k."""
    h = np.zeros(len(values) - k + 1, np.uint64)
    for i, p in enumerate(powers(k)):
        h += values[i : len(values) - k + 1 + i] * p
    keep = np.ones(len(h), bool)
    starts = np.cumsum(counts)[:-1]
    for i in range(1, k):
        keep[starts - i] = False
    return mix(h[keep])


class Chars:
    """Shingles of k code points; a shorter text is one shingle."""

    def __init__(self, k: int):
        self.k = k

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        part = [x if len(x) >= self.k else x.ljust(self.k, "\0") for x in texts]
        counts = np.array([len(x) for x in part])
        code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        return windows(code, counts, self.k), counts - self.k + 1

    def of(self, text: str) -> set:
        return {text[i : i + self.k] for i in range(max(1, len(text) - self.k + 1))}


class Words:
    """Shingles of k words; a shorter text is one shingle."""

    def __init__(self, k: int):
        self.k = k

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        from xxhash import xxh64_intdigest

        part = [w + [b""] * (self.k - len(w)) for w in (x.encode("utf-8", "surrogatepass").split(b" ") for x in texts)]
        counts = np.array([len(w) for w in part])
        code = np.fromiter((xxh64_intdigest(w) for p in part for w in p), np.uint64, int(counts.sum()))
        return windows(code, counts, self.k), counts - self.k + 1

    def of(self, text: str) -> set:
        w = text.split(" ")
        return {tuple(w[i : i + self.k]) for i in range(max(1, len(w) - self.k + 1))}


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts that have some CHUNK code points together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end]) + 8
            end += 1
        yield at, end
        at = end


def signatures(texts: list[str], shingles: Chars | Words) -> np.ndarray:
    """A row of BANDS keys for each text."""
    out = np.empty((len(texts), BANDS), np.uint64)
    tag = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for at, end in _chunks(texts):
            h, counts = shingles.hashes(texts[at:end])
            h32 = (h >> np.uint64(32)).astype(np.uint32)
            first, turned = np.cumsum(counts) - counts, np.empty_like(h32)
            low = np.stack([np.minimum.reduceat(np.multiply(h32, m, out=turned), first) for m in _MUL], 1).astype(np.uint64)
            key = np.zeros((end - at, BANDS), np.uint64)
            for r in range(ROWS):
                key = mix(key + low[:, r::ROWS] + np.uint64(0x51ED27))
            out[at:end] = mix(key + tag)
    return out


def shingle_sets(texts: list[str], shingles: Chars | Words) -> list[np.ndarray]:
    """For each text the hashes of its shingles, each once and in order."""
    out = []
    with np.errstate(over="ignore"):
        for at, end in _chunks(texts):
            h, counts = shingles.hashes(texts[at:end])
            for x in np.split(h, np.cumsum(counts)[:-1]):
                x.sort()
                new = np.empty(len(x), bool)
                new[0] = True
                np.not_equal(x[1:], x[:-1], out=new[1:])
                out.append(x[new])
    return out


def shared_by(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two arrays of distinct values share."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def similarities(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarities of all sets of x with all of y: products of 0-1 matrices, by slices
    of the hashes that come twice at least, CELLS cells each."""
    sets = [*x, *y]
    sizes = np.array([len(s) for s in sets])
    h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(h)
    h, row = h[order], row[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    col = np.cumsum(new) - 1
    often = np.bincount(col)[col] > 1
    row, col = row[often], (np.cumsum(new & often) - 1)[often]
    both = np.zeros((len(x), len(y)))
    wide = max(1, CELLS // len(sets))
    at = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else -1) + wide + 1, wide))
    for i, j in zip(at, at[1:], strict=False):
        if i < j:
            cells = np.zeros((len(sets), min(wide, col[j - 1] - col[i] + 1)), np.float32)
            cells[row[i:j], col[i:j] - col[i]] = 1
            both += cells[: len(x)] @ cells[len(x) :].T
    return both / (sizes[: len(x), None] + sizes[None, len(x) :] - both)


def sketched(rows: DataFrame, units: Callable[[str], list[str | None]], shingles: Chars | Words, tag: Callable[[str], int] = lambda text: 0) -> DataFrame:
    """rows: ``(row, id, text)``. A row ``(row, id, mark, tag, classes)`` for each of them, with a hash of
    the text, what ``tag`` gives for it and the class of every unit (null for None), and rows
    ``(row, no, cls, bands)`` of the classes with a place where each stands, at least once a class
    and mostly once a task."""
    from xxhash import xxh64_intdigest

    small_batches(rows.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, mark long, tag long, classes array<long>, no int, cls long, bands array<long>"

    def name(x: str | None) -> int:
        return 0 if x is None else xxh64_intdigest(x.encode("utf-8", "surrogatepass"))

    def listed(values: pa.Array, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for part in pieces(b, 2):
                texts = [t or "" for t in part.column(2).to_pylist()]
                cut = list(map(units, texts))
                flat = [x for u in cut for x in u]
                counts = np.fromiter(map(len, cut), np.int64, len(cut))
                names = list(map(name, flat))
                array = np.array(names, np.uint64).view(np.int64)
                blank = np.fromiter((x is None for x in flat), bool, len(flat))
                n = part.num_rows
                void = lambda kind, n=n: pa.nulls(n, kind)
                mark = np.fromiter(map(name, texts), np.uint64, n).view(np.int64)
                head = [part.column(0), part.column(1), pa.array(mark), pa.array(list(map(tag, texts)), pa.int64()), listed(pa.array(array, mask=blank), counts)]
                fields = ["row", "id", "mark", "tag", "classes", "no", "cls", "bands"]
                yield pa.RecordBatch.from_arrays([*head, void(pa.int32()), void(pa.int64()), void(pa.list_(pa.int64()))], fields)
                if len(seen) > SEEN:
                    seen.clear()
                new = [i for i, x in enumerate(names) if flat[i] is not None and not (x in seen or seen.add(x))]
                if not new:
                    continue
                keys = signatures([flat[i] for i in new], shingles).view(np.int64)
                at, n = np.array(new), len(new)
                owner = np.repeat(np.arange(part.num_rows), counts)[at]
                place = (at - (np.cumsum(counts) - counts)[owner]).astype(np.int32)
                row = part.column(0).take(pa.array(owner))
                bands = listed(pa.array(keys.ravel()), np.full(n, BANDS))
                yield pa.RecordBatch.from_arrays([row, void(part.column(1).type, n), void(pa.int64(), n), void(pa.int64(), n), void(pa.list_(pa.int64()), n), pa.array(place), pa.array(array[at]), bands], fields)

    return rows.select("row", "id", "text").mapInArrow(run, schema)


def _texts(rows: DataFrame, places: DataFrame, units: Callable[[str], list[str | None]]) -> DataFrame:
    """``(cls, norm, size)`` of the classes that stand at ``(cls, row, no)``."""
    by_row = materialise(places.groupBy("row").agg(F.collect_list(F.struct("no", "cls")).alias("at")))
    bytes_ = by_row.agg(F.sum(F.size("at") * 24 + 48)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, 0):
                cls, norm = [], []
                for t, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = units(t or "")
                    cls += [x["cls"] for x in at]
                    norm += [own[x["no"]] for x in at]
                size = [len(x.encode("utf-8", "surrogatepass")) for x in norm]
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(norm, pa.string()), pa.array(size, pa.int64())], ["cls", "norm", "size"])

    return rows.join(small(by_row, bytes_), "row").select("text", "at").mapInArrow(run, "cls long, norm string, size long")


def _verified(pairs: DataFrame, texts: DataFrame, shingles: Chars | Words, similar: float) -> DataFrame:
    """Those of the pairs ``(src, dst)`` whose texts are similar enough. A class is cut into shingles
    once a slice of a batch, whatever the number of its pairs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, 2):
                src, dst, ta, tb = (part.column(i).to_pylist() for i in range(4))
                text = dict(zip(src, ta, strict=True)) | dict(zip(dst, tb, strict=True))
                sets = dict(zip(text, shingle_sets(list(text.values()), shingles), strict=True))
                good = []
                for p, q in zip(src, dst, strict=True):
                    x, y = sets[p], sets[q]
                    n = len(x) + len(y)
                    good.append(min(len(x), len(y)) >= similar * max(len(x), len(y)) and (m := shared_by(x, y)) >= similar * (n - m))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["src", "dst"]).filter(pa.array(good, pa.bool_()))

    # pairs go to the texts, and a text moves only as the first or as the second of a pair
    a = texts.select(F.col("cls").alias("src"), F.col("norm").alias("ta")).join(small(pairs), "src")
    b = texts.select(F.col("cls").alias("dst"), F.col("norm").alias("tb")).join(small(pairs.select("dst").distinct()), "dst", "left_semi")
    return a.join(b, "dst").select("src", "dst", "ta", "tb").mapInArrow(run, "src long, dst long")


def forest(alike: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric matrix that span its components."""
    left, out = np.ones(len(alike), bool), []
    for i in range(len(alike)):
        todo = [i] if left[i] else []
        left[i] = False
        while todo:
            j = todo.pop()
            near = np.flatnonzero(alike[j] & left)
            left[near] = False
            out += [(j, int(n)) for n in near]
            todo += near.tolist()
    return out


def _links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"src": pa.array(np.minimum(a, b), pa.int64()), "dst": pa.array(np.maximum(a, b), pa.int64())})


def _inside(dealt: DataFrame, shingles: Chars | Words, similar: float) -> DataFrame:
    """Links ``(src, dst)`` that span the components of each block ``(key, block)``. The blocks of a task
    come sorted, one after another, and only one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key, block = (b.column(i).to_numpy() for i in range(2))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), b.num_rows]
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (key[0], block[0]):
                cuts = [0, *cuts]  # what is held is whole
            for i, j in zip(cuts, cuts[1:], strict=False):
                held.append(b.slice(i, j - i))
                if j < b.num_rows:
                    yield from meet(held)
                    held = []
        yield from meet(held)

    def meet(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([x.column(2).to_numpy() for x in held] or [np.empty(0, np.int64)])
        if len(ids) > 1:
            sets = shingle_sets([t for x in held for t in x.column(3).to_pylist()], shingles)
            pairs = np.array(forest(similarities(sets, sets) >= similar), int).reshape(-1, 2)
            yield from _links(ids[pairs[:, 0]], ids[pairs[:, 1]]).to_batches()

    rows = dealt.repartition("key", "block").sortWithinPartitions("key", "block").select("key", "block", "cls", "norm")
    return rows.mapInArrow(run, "src long, dst long").distinct()


def _across(members: DataFrame, shingles: Chars | Words, similar: float) -> DataFrame:
    """Links ``(src, dst)`` between members ``(key, cls, block, blocks, c, main, norm)`` of different
    components of a bucket: each block's members outside the main component meet every block of
    the bucket in a group of its own. A link for each pair of components is emitted."""
    open_ = members.where("c <> main")
    xs = materialise(open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n1"), F.ceil(F.sum(F.octet_length("norm")) / BLOCK_BYTES).alias("n2")).select("key", F.greatest("n1", "n2").alias("xs")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = open_.join(small(xs), "key").withColumn("x", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("xs"))).withColumn("y", every("blocks")).select("key", "x", "y", "cls", "c", "norm")
    y = members.join(small(xs), "key").withColumn("x", every("xs")).select(F.col("key").alias("key_b"), F.col("x").alias("x_b"), F.col("block").alias("y_b"), F.col("cls").alias("cls_b"), F.col("c").alias("c_b"), F.col("norm").alias("norm_b"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _links(np.empty(0, np.int64), np.empty(0, np.int64))
        alike = similarities(shingle_sets(a["norm"].to_pylist(), shingles), shingle_sets(b["norm_b"].to_pylist(), shingles)) >= similar
        c, d = a["c"].to_numpy(), b["c_b"].to_numpy()
        i, j = np.nonzero(alike & (c[:, None] != d[None, :]))
        _, one = np.unique(np.stack([c[i], d[j]], 1), axis=0, return_index=True)
        return _links(a["cls"].to_numpy()[i[one]], b["cls_b"].to_numpy()[j[one]])

    return x.groupBy("key", "x", "y").cogroup(y.groupBy("key_b", "x_b", "y_b")).applyInArrow(meet, "src long, dst long").distinct()


def linked(rows: DataFrame, sketch: DataFrame, units: Callable[[str], list[str | None]], shingles: Chars | Words, similar: float = SIMILAR, buckets: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` of the classes that are linked to another. rows: ``(row, text)``; sketch:
    of them, see sketched(); buckets: further ``(key, cls)``, whose members are candidates.

    Candidates are the classes that share a bucket. Up to PAIRWISE classes give pairs. More are dealt
    into blocks by a hash, each compared with itself in full, and only links that span its
    components are emitted. In a bucket of several blocks the members outside its largest
    component then meet every block (see _across). So no link that banding offers is lost, and
    no pairs are written out for a family of any size. Rows with one text are one class; no rows, or
    no candidates, give an empty result.
    """
    paths: list[str] = []
    banded = sketch.where("cls is not null").select(F.explode("bands").alias("key"), "cls")
    if buckets is not None:
        banded = banded.unionByName(buckets.select("key", "cls"))
    # one exchange by key serves both sides and distinct(), however many keys are shared
    banded = banded.repartition("key")
    shared = banded.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("key")
    met = materialise(banded.join(shared.hint("shuffle_hash"), "key").distinct(), paths)
    crowded = materialise(met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRWISE), paths)
    needed = materialise(met.select("cls").distinct(), paths)
    places = sketch.where("cls is not null").select("cls", "row", "no").join(small(needed), "cls").groupBy("cls").agg(F.min(F.struct("row", "no")).alias("at")).select("cls", "at.row", "at.no")
    texts = materialise(_texts(rows, places, units), paths)

    few = met.join(small(crowded.select("key")), "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("cls")).alias("all"))
    pairs = few.select("all", F.explode("all").alias("src")).select("src", F.explode(F.filter("all", lambda x: x > F.col("src"))).alias("dst"))
    tried = materialise(pairs.distinct(), paths)
    links = materialise(_verified(tried, texts, shingles, similar), paths)
    many = not crowded.isEmpty()
    if many:
        large = met.join(small(crowded), "key")
        size = large.join(texts.select("cls", "size"), "cls").groupBy("key").agg(F.ceil(F.sum("size") / BLOCK_BYTES).alias("m"))
        blocks = materialise(crowded.join(size, "key").select("key", F.greatest(F.ceil(F.col("n") / BLOCK), "m").alias("blocks")), paths)
        dealt = large.join(small(blocks), "key").withColumn("block", F.pmod(F.xxhash64("cls", "key"), F.col("blocks"))).select("key", "cls", "block", "blocks")
        dealt = materialise(dealt, paths)
        own = materialise(_inside(dealt.join(texts, "cls"), shingles, similar), paths)
        links = links.unionByName(own)
    found = components(links)
    if many:
        wide = dealt.where("blocks > 1").join(found, F.col("cls") == F.col("node"), "left").select("key", "cls", "block", "blocks", F.coalesce("component", "cls").alias("c"))
        wide = materialise(wide, paths)
        parts = wide.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
        main = parts.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count(F.lit(1)).alias("cs")).where("cs > 1").select("key", "main")
        main = materialise(main, paths)
        if not main.isEmpty():
            open_ = materialise(wide.join(small(main), "key"), paths)
            more = materialise(_across(materialise(small(open_).join(texts, "cls"), paths), shingles, similar), paths)
            if not more.isEmpty():
                found = components(links.unionByName(more))
    forget(rows.sparkSession, *paths)
    return found
