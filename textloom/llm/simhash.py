"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import components, forget, join_hot, materialise, numbered, renamed, small, small_batches
from textloom.llm.minhash import Words, linked, sketched, whole

#: Lower-cases A-Z only; bytes.split() then splits on exactly \x20 and \x09-\x0D.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A block with more fingerprints than this is linked through one-bit variants, not pairwise.
PAIRWISE = 32
CHUNK = 1 << 17


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text, as a signed long; no words: 0. A bit is 1 if it is set
    in over half of the shingles' hashes, repeats counted."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        parts, n = iter([b" ".join(words)]), 1
    else:
        parts, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), len(words) - shingle + 1
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), parts), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):  # bounds the unpacked bits of very long texts
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp long)`` for every row; null and empty texts get 0."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t.as_py(), shingle) for t in texts], pa.int64())

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` whose components are those of all pairs of the distinct ``fp`` at 2 or
    fewer differing bits. No fingerprints give no edges, nor does one alone.

    Of four 16-bit blocks, such a pair agrees in two at least, so each of the six pairs of blocks
    is a join key of 32 bits. Keys with up to PAIRWISE fingerprints are compared pair by pair. In
    larger ones each fingerprint goes, besides itself, to its 32 variants with one of the other
    bits flipped: two are within 2 bits just when they share a variant. A variant has 33
    fingerprints at most, so this is exact and in proportion to the rows, however large the group.
    """
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = [F.struct(F.lit(k).alias("k"), (F.shiftleft(block[i], 16).bitwiseOR(block[j])).alias("v")) for k, (i, j) in enumerate(pairs)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.v")
    sizes = materialise(rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = materialise(rows.join(sizes, ["k", "v"]))

    few = met.where(F.col("n") <= PAIRWISE).groupBy("k", "v").agg(F.collect_list("fp").alias("all"))
    near = lambda a: F.filter("all", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= 2))
    pairwise = few.select("all", F.explode("all").alias("src")).select("src", F.explode(near(F.col("src"))).alias("dst"))

    rest = [[b for i in range(4) if i not in pair for b in range(16 * i, 16 * i + 16)] for pair in pairs]
    masks = F.array(*(F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in [0, *(1 << b for b in bits)])) for bits in rest))
    flips = F.element_at(masks, F.col("k") + 1)
    hot = met.where(F.col("n") > PAIRWISE).select("k", "v", "fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    shared = hot.groupBy("k", "v", "variant").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    starred = shared.select(F.array_min("all").alias("src"), F.explode("all").alias("dst")).where((F.col("src") != F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2))
    return pairwise.unionByName(starred)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Per row of docs: ``(id, fp long, component)``, component being the smallest id reachable
    over links of 2 or fewer bits. Rows with a null id keep their fingerprint's component; it is
    null only where no row of the component has an id. Repeated rows are returned as often as they
    come; an empty table gives an empty result.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle))
    fps = materialise(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")))
    linked = components(links(fps.select("fp"))).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = materialise(fps.join(small(linked), "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")))
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("m")))
    prints, total = least.agg(F.sum("m")).first()[0] or 0, fps.agg(F.sum("n")).first()[0] or 0
    of_fp = materialise(join_hot(rooted, least, "root", "m", prints).select("fp", "n", "component"))
    return join_hot(rows, of_fp, "fp", "n", total).select("id", "fp", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: float = 0.8) -> DataFrame:
    """One row of docs of each group, the first by id (null last), then by a hash of its text; other
    columns are untouched.

    Groups are the components of pairs whose sets of ``shingle``-word shingles have a Jaccard
    similarity of ``similar`` or more. Candidates share a component of the fingerprints' pigeonhole
    links, or a MinHash band: pairs at 0.8 differ in up to 14 of 64 bits, which no two or three
    agreeing blocks can promise, so blocks alone would miss them. All candidates are verified.
    Texts that are equal but for case and white space are one class; null texts count as empty.
    Each row is one of its own, so repeated and null ids hide nothing: of equal rows one stays. An
    empty table gives an empty result.
    """
    paths: list[str] = []
    rows = numbered(docs)
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = rows.select("row", F.col(name[id_col]).alias("id"), F.col(name[text_col]).alias("text"))
    sketch = materialise(sketched(plain, whole, Words(shingle), partial(fingerprint_of, shingle=shingle)), paths)
    places = sketch.where("classes is not null").select("row", "id", "mark", F.col("tag").alias("fp"), F.col("classes")[0].alias("cls"))
    fps = materialise(places.select("fp").distinct(), paths)
    near = components(links(fps))
    of_fp = places.select("fp", "cls").distinct().join(small(near), F.col("fp") == F.col("node"), "left")
    buckets = of_fp.select(F.xxhash64(F.lit("fingerprint"), F.coalesce("component", "fp")).alias("key"), "cls")
    found = linked(plain, sketch, whole, Words(shingle), similar, buckets)

    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "row")).alias("first")
    per = places.groupBy("cls").agg(first, F.count(F.lit(1)).alias("n"))
    rooted = per.join(small(found), per["cls"] == found["node"], "left").where("n > 1 or node is not null")
    rooted = materialise(rooted.select("cls", "n", "first", F.coalesce("component", "cls").alias("root")), paths)
    best = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("all")).where(F.col("all") > 1)
    best = materialise(best.select("root", F.col("keep.row").alias("keep")), paths)
    rule = materialise(rooted.select("cls", "n", "root").join(small(best), "root").select("cls", "n", "keep"), paths)
    total = rule.agg(F.sum("n")).first()[0] or 0
    gone = materialise(join_hot(places.select("row", "cls"), rule, "cls", "n", total).where("row <> keep").select("row"))
    forget(docs.sparkSession, *paths)
    return renamed(rows.join(small(gone), "row", "left_anti"), docs)
