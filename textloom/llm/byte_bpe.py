"""Byte-level BPE with forced boundaries: encode fragments on their own, then concatenate."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import pieces, small_batches

#: The pre-tokenizer's pattern, a fixed value of byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a worker remembers from one slice of a batch to the next (some 220 bytes each), and
#: bytes of text of a slice.
REMEMBERED, SLICE = 80_000, 1 << 20
#: Fragments with more bytes are merged one by one, by a heap.
LONG = 64
#: Rank of a pair that is never merged.
_NEVER = np.iinfo(np.int32).max
#: Above every id; pairs of ids are numbered with it.
_IDS = 1 << 24


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: printable Latin-1 for itself, the others
    from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encodes as the file's tokenizer does without special tokens added; strings of added tokens
    in a text become their ids, as there."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        self.vocab = {bytes(letter[c] for c in k): i for k, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: k for k, i in self.vocab.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letter[c] for c in x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.ranks[a, b] = r
        # the same by ids, in order of the pairs' numbers, with what each pair becomes
        rows = sorted((self.vocab[a] * _IDS + self.vocab[b], r, self.vocab[a + b]) for (a, b), r in self.ranks.items())
        self.pairs, self.rank, self.becomes = (np.array([*c, *last], kind) for c, last, kind in zip(zip(*rows, strict=True), ([1 << 62], [_NEVER], [0]), (np.int64, np.int32, np.int32), strict=True))
        self.byte_ids = np.array([self.vocab.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.pattern = regex.compile(PATTERN)
        # by two bytes' number: whether they stand together inside some token; else a cut is certain
        self.joined = np.zeros(1 << 16, bool)
        for k in self.vocab:
            for a, b in zip(k, k[1:], strict=False):
                self.joined[a << 8 | b] = True
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.table = np.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], dtype=object)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where pairs of ids stand in the table of merges; its last row is for those it does not have."""
        key = a.astype(np.int64) * _IDS + b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, at, len(self.pairs) - 1)

    def merge_all(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments that lie one after another in ``raw`` bytes, and how many each has. All
        fragments take their next merge, the pair of least rank and, of its places, the leftmost, at
        the same time; those without one drop out."""
        ids = self.byte_ids[raw]
        out, count = np.empty(len(ids), np.int32), np.zeros(len(sizes), np.int64)
        begin = np.cumsum(sizes) - sizes  # where a fragment's ids are put
        own = np.arange(len(sizes))  # fragments still at work, and their ids, ranks of pairs and ends
        while len(own):
            first = np.cumsum(sizes) - sizes
            last = first + sizes - 1
            if len(own) == len(count):
                pair = self._pair(ids, np.append(ids[1:], 0))
                pair[last] = len(self.pairs) - 1
            rank = self.rank[pair]
            least = np.minimum.reduceat(rank, first)
            done = least == _NEVER
            if done.any():
                gone = np.repeat(done, sizes)
                n = sizes[done]
                to = np.repeat(begin[own[done]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out[to] = ids[gone]
                count[own[done]] = n
                ids, pair, rank = ids[~gone], pair[~gone], rank[~gone]
                own, sizes, least = own[~done], sizes[~done], least[~done]
                if not len(own):
                    break
                first = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            at = hits[np.searchsorted(hits, first)]
            ids[at] = self.becomes[pair[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one id fewer in each fragment before
            ids, pair = ids[keep], np.delete(pair, np.flatnonzero(~keep))
            sizes = sizes - 1
            first = np.cumsum(sizes) - sizes
            end = at == first + sizes - 1
            pair[at] = np.where(end, len(self.pairs) - 1, self._pair(ids[at], ids[np.minimum(at + 1, len(ids) - 1)]))
            left = at[at > first]
            pair[left - 1] = self._pair(ids[left - 1], ids[left])
        place = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return out[place], count

    def merge_long(self, part: bytes) -> list[int]:
        """As merge(), in n log n for fragments of any length: a heap over a linked list."""
        n = len(part)
        bits: list[bytes | None] = [part[i : i + 1] for i in range(n)]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, bits[i], bits[i + 1]) for i in range(n - 1) if (r := self.ranks.get((bits[i], bits[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if bits[i] != a or j < 0 or bits[j] != b or bits[i] is None:
                continue
            bits[i], bits[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((bits[x], bits[y]))) is not None:
                    heapq.heappush(heap, (r, x, bits[x], bits[y]))
        return [self.vocab[b] for b in bits if b is not None]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, and how many each has. A pre-token is cut where two bytes stand together in
        no token, and its fragments are encoded on their own."""
        parts = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(parts), np.uint8)
        cut = ~self.joined[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        cut[np.cumsum(size)[:-1] - 1] = True
        starts = np.append(0, np.flatnonzero(cut) + 1)
        sizes = np.diff(np.append(starts, len(raw)))
        long = sizes > LONG
        ids, count = self.merge_all(raw[np.repeat(~long, sizes)], sizes[~long])
        if long.any():
            found = iter(np.split(ids, np.cumsum(count)[:-1]))
            each = [np.array(self.merge_long(raw[a : a + n].tobytes()), np.int32) if n > LONG else next(found) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            ids, count = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
        return ids, np.add.reduceat(count, np.searchsorted(starts, np.cumsum(size) - size))

    def encode_chunks(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Distinct chunks and their ids. Chunks are pre-tokenized together where their borders are certain. Each
        distinct pre-token is encoded once."""
        plain, odd = [], []
        for c in chunks:
            (odd if c[0] != " " or c[-1].isspace() else plain).append(c)
        cut = self.pattern.findall("".join(plain))
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        upto = np.searchsorted(np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))), ends) + 1  # pre-tokens up to each chunk's end
        more = []
        for c in odd:
            cut += self.pattern.findall(c)
            more.append(len(cut))
        number = {p: n for n, p in enumerate(dict.fromkeys(cut))}
        ids, count = self.encode_pieces(list(number))
        which = np.fromiter(map(number.__getitem__, cut), np.int64, len(cut))
        size = count[which]
        begin = (np.cumsum(count) - count)[which]
        flat = ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())].astype("<u4").tobytes()
        at = (4 * np.append(0, np.cumsum(size))[np.concatenate([[0], upto, more]).astype(np.int64)]).tolist()
        return zip(plain + odd, map(flat.__getitem__, map(slice, at, at[1:])), strict=False)

    def chunks(self, text: str) -> list[str]:
        """The text cut before each blank that follows no white space. Whatever the pre-tokenizer's
        pattern matches ends there, so each chunk can be pre-tokenized and encoded alone."""
        if _BLANKS.search(text):
            return _BEFORE_BLANK.split(text)
        parts = text.split(" ")
        return [parts[0], *map(" ".__add__, parts[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. Chunks that are not known from
        earlier calls are encoded together; those that these texts have are known in the next call,
        the others as long as there is room."""
        cuts = []
        for text in texts:
            own: list[str] = []
            for part in self.split_added.split(text) if self.split_added else [text]:
                if part in self.added:
                    own.append(part)
                elif part:
                    own += self.chunks(part)
            cuts.append(own)
        here = set().union(*cuts)
        here.discard("")
        new = [c for c in here if c not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {c: x for c, x in self.known.items() if c in here}
        tokens = [c for c in new if c in self.added]
        self.known |= {c: np.array([self.added[c]], "<u4").tobytes() for c in tokens}
        new = [c for c in new if c not in self.added] if tokens else new
        if new:
            self.known |= self.encode_chunks(new)
        self.known[""] = b""
        return [b"".join(map(self.known.__getitem__, c)) for c in cuts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of the ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.table[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


_BLANKS = re.compile(r"\s ")
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")


@lru_cache(2)
def loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode it again: ``(id, n_tokens, ids_sha256, decoded_sha256)``.
    Null and empty texts have no tokens. Rows are independent, so repeated rows, ties and other
    columns change nothing, and an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            for part in pieces(b, 1, SLICE):
                ids = bpe.encode_all([t or "" for t in part.column(1).to_pylist()])
                cols = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ``ids_col array<int>`` for the text (a column of that name is replaced); null and empty
    texts get an empty array. Rows are independent; an empty table gives an empty result."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        bpe, out = loaded(path), []
        for part in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), 0, SLICE):
            ids = bpe.encode_all([t or "" for t in part.column(0).to_pylist()])
            ends = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    small_batches(docs.sparkSession)
    return docs.withColumn(ids_col, ids_of(F.col(text_col)))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """docs with ``decoded_col string`` for the ids (a column of that name is replaced); null ids count
    as none. Rows are independent; an empty table gives an empty result."""

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        bpe = loaded(path)
        return pa.array([bpe.decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in ids], pa.string())

    return docs.withColumn(decoded_col, text_of(F.col(ids_col)))
