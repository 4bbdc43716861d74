"""Token ids in files: Re-Pair grammar compression by shard, with random access.

A shard file holds, after a head of counts: ids of the documents, for each the number of its symbols
and of its tokens, the distinct token ids, the rules (a pair of symbols each), the length each rule
expands to, and the symbols, in as many bytes as they need. In a file symbols are numbered through,
distinct ids first, then rules; in memory rules are numbered from ``base``. No rule spans two
documents, so a document, or a range of it, is decoded alone. A file holds a task's shards and, last,
how many tokens they have. Files are written by Spark's text writer, a shard a row, and read by its
binary file source.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.byte_bpe import byte_letters
from textloom.llm.common import pieces, small, small_batches

MAGIC = b"TLRP2\n"
HEAD = struct.Struct("<6sqqqqqqq")  # magic, shard, documents, distinct ids, rules, symbols, base, bytes a symbol
#: The last row of a file: its task's number and how many tokens the file has; and its bytes, with the
#: row separator.
END, END_BYTES = b"TLRPE %019d %019d", 46
#: A pair that comes so often in a shard becomes a rule; a round replaces pairs down to that share
#: of the most frequent one's count.
LEAST, SHARE = 8, 0.003
SLOTS = 1 << 20
#: Tokens after which a task closes a shard.
SHARD = 1_000_000
#: Bytes of text a task should get, and takes from a batch at once.
TASK_BYTES, PIECE = 64 << 20, 3 << 20
#: Parts a worker remembers, twice at most (some 200 bytes each), and encodes in one call.
REMEMBERED, TOGETHER = 200_000, 2000


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    """A slot for each key; slots is a power of two, and keys of 32 or 64 bits are used as they come."""
    wide = key.dtype.itemsize * 8
    turn = key.dtype.type(0x9E3779B97F4A7C15 >> (64 - wide) | 1)
    return (key * turn >> key.dtype.type(wide + 1 - slots.bit_length())).astype(np.int64)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each comes."""
    key = np.sort(key)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.diff(np.append(at, len(key)))


def _pairs(seq: np.ndarray, after: np.ndarray, live: np.ndarray, narrow: bool) -> np.ndarray:
    """A number for the pair at each live place; of 32 bits as long as symbols have 16."""
    a, b = seq[live], seq[after[live]]
    if narrow:
        return a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def compress(seq: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (-1 parts documents and stays), rules and expansion lengths. Rounds go on until no
    pair of neighbours comes LEAST times. In each round the pairs that come at least SHARE as often
    as the most frequent one are replaced at once, from the left where they overlap; pairs that this
    leaves with fewer than LEAST places wait for another round.

    Every place is counted. A pair of old symbols never becomes more frequent, so once it comes too
    seldom its places are not looked at again until a neighbour is replaced; the places of a slot
    that has too few are dropped without sorting them. Places keep their numbers until the end;
    ``after`` and ``before`` name the neighbours that are left. Inside, ids are numbered through and
    rules after them, so that pairs are short numbers.
    """
    kinds = np.flatnonzero(np.bincount(seq[seq >= 0].astype(np.int64), minlength=1))
    local = np.zeros(int(kinds[-1]) + 2 if len(kinds) else 2, np.int32)
    local[kinds] = np.arange(len(kinds), dtype=np.int32)
    local[-1] = -1
    seq = np.append(local[seq], np.int32(-1))  # the last place has a neighbour, too
    n = len(kinds)
    rules, lengths = [np.empty((0, 2), np.int64)], np.empty(0, np.int64)
    after, before = np.arange(1, len(seq) + 1, dtype=np.int32), np.arange(-1, len(seq) - 1, dtype=np.int32)
    gone, open_ = np.zeros(len(seq), bool), np.zeros(len(seq), bool)
    live = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    while len(live):
        narrow = n + len(lengths) <= 1 << 16
        slots = min(SLOTS, 4 << len(live).bit_length())
        key = _pairs(seq, after, live, narrow)
        slot = _slot(key, slots)
        often = (np.bincount(slot, minlength=slots) >= LEAST)[slot]
        live, key, slot = live[often], key[often], slot[often]
        if not len(live):
            break
        found, count = _counted(key)
        if count.max() < LEAST:
            break
        often = count >= max(LEAST, count.max() * SHARE)
        found, count = found[often], count[often]
        found = found[np.lexsort((found, -count))]
        table = np.full(slots, -1, np.int32)
        table[_slot(found, slots)[::-1]] = np.arange(len(found))[::-1]  # of pairs in one slot the most frequent
        number = table[slot]
        hit = np.flatnonzero((number >= 0) & (found[number] == key))
        at, number = live[hit], number[hit]
        nth = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.concatenate([[True], at[1:] != after[at[:-1]]]), nth, 0))
        other = (nth - run) % 2 == 0  # every other place of a run of overlapping pairs
        at, number = at[other], number[other]
        uses = np.bincount(number, minlength=len(found))
        made = uses >= min(LEAST, uses.max())
        at, number = at[made[number]], number[made[number]]
        seq[at] = n + len(lengths) + (np.cumsum(made) - 1)[number]
        out = after[at]
        gone[out] = True
        after[at] = after[out]
        before[after[at]] = at
        open_[live] = open_[at] = open_[before[at[before[at] >= 0]]] = True
        near = np.flatnonzero(open_)
        open_[near] = False
        live = near[~gone[near] & (seq[near] >= 0) & (seq[after[near]] >= 0)]
        bits = found.dtype.type(16 if narrow else 32)
        pairs = np.stack([found[made] >> bits, found[made] & ((found.dtype.type(1) << bits) - found.dtype.type(1))], 1).astype(np.int64)
        size = np.where(pairs >= n, np.append(lengths, 1)[np.where(pairs >= n, pairs - n, -1)], 1)
        rules.append(pairs)
        lengths = np.concatenate([lengths, size.sum(1)])
    own = np.concatenate([kinds, base + np.arange(len(lengths)), [-1]])  # -1 is the last
    return own[seq[:-1][~gone[:-1]]], own[np.concatenate(rules)], lengths


def pack(shard: int, doc_ids: list[int | None], tokens: list[np.ndarray], base: int) -> bytes:
    """A shard file's bytes. A null document id is written as the least long."""
    gap = np.array([0xFFFFFFFF], "<u4")
    whole = np.concatenate([x for t in tokens for x in (t, gap)]).view("<i4") if tokens else np.empty(0, "<i4")
    seq, rules, lengths = compress(whole, base)
    ends = np.flatnonzero(seq < 0)
    sizes = np.diff(np.concatenate([[-1], ends])) - 1
    symbols = seq[seq >= 0]
    kinds = np.flatnonzero(np.bincount(whole[whole >= 0], minlength=1))  # ids that the shard has
    local = np.zeros(base + len(rules), np.int64)
    local[kinds] = np.arange(len(kinds))
    local[base:] = len(kinds) + np.arange(len(rules))
    wide = next(w for w in (2, 3, 4) if len(kinds) + len(rules) <= 1 << 8 * w)
    ids = np.array([-(1 << 63) if i is None else i for i in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, shard, len(ids), len(kinds), len(rules), len(symbols), base, wide)
    arrays = (ids, sizes.astype("<u4"), np.array([len(t) for t in tokens], "<u4"), kinds.astype("<u4"), local[rules].astype("<u4"), lengths.astype("<u4"), local[symbols].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide])
    return head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """A shard's arrays, and decoding from them."""

    def __init__(self, data: bytes, at: int = 0):
        magic, self.number, n, kinds, rules, symbols, self.base, wide = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at += HEAD.size
        take = lambda kind, count: np.frombuffer(data, kind, count, at)
        self.doc_ids = take("<i8", n)
        at += 8 * n
        self.sizes = take("<u4", n).astype(np.int64)
        at += 4 * n
        self.n_tokens = take("<u4", n).astype(np.int64)
        at += 4 * n
        local = np.concatenate([take("<u4", kinds).astype(np.int64), self.base + np.arange(rules)])
        at += 4 * kinds
        self.rules = local[take("<u4", 2 * rules).reshape(-1, 2)]
        at += 8 * rules
        self.lengths = take("<u4", rules).astype(np.int64)
        at += 4 * rules
        whole = np.zeros((symbols, 4), np.uint8)
        whole[:, :wide] = take(np.uint8, wide * symbols).reshape(-1, wide)
        self.symbols = local[whole.view("<u4")[:, 0]]
        self.end = at + wide * symbols
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self._flat = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Every rule's tokens one after the other, and where each rule's begin. Rules that name no rule
        of their own stretch are spelt together, from those before."""
        if self._flat is None:
            at = np.concatenate([[0], np.cumsum(self.lengths)])
            flat = np.empty(at[-1], np.int64)
            names = self.rules.max(axis=1) - self.base if len(self.rules) else np.empty(0, np.int64)
            start = 0
            while start < len(names):
                later = np.flatnonzero(names[start:] >= start)
                end = start + int(later[0]) if len(later) else len(names)
                symbols = self.rules[start:end].ravel()
                is_rule = symbols >= self.base
                k = np.where(is_rule, symbols - self.base, 0)
                sizes = np.where(is_rule, self.lengths[k], 1)
                first = np.cumsum(sizes) - sizes
                flat[at[start] : at[end]] = flat[np.repeat(np.where(is_rule, at[k], 0) - first, sizes) + np.arange(at[end] - at[start])] if start else 0
                flat[at[start] + first[~is_rule]] = symbols[~is_rule]
                start = end
            self._flat = flat, at
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, at = self._expansions()
        table = np.concatenate([flat, symbols])  # plain symbols are read from the tail
        rule = np.maximum(symbols - self.base, 0)
        is_rule = symbols >= self.base
        sizes = np.where(is_rule, self.lengths[rule] if len(self.lengths) else 1, 1)
        begin = np.where(is_rule, at[rule] if len(self.lengths) else 0, len(flat) + np.arange(len(symbols)))
        before = np.cumsum(sizes) - sizes
        return table[np.repeat(begin - before, sizes) + np.arange(sizes.sum())]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[i] : self.starts[i + 1]])

    def window(self, i: int, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop of the i-th document, expanding only the symbols that cover them."""
        own = self.symbols[self.starts[i] : self.starts[i + 1]]
        sizes = np.where(own >= self.base, self.lengths[np.maximum(own - self.base, 0)] if len(self.lengths) else 1, 1)
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        skip = start - (ends[a - 1] if a else 0)
        return self.expand(own[a : b + 1])[skip : skip + max(0, stop - start)]


def shards_of(data: bytes) -> Iterator[Shard]:
    at = 0
    while at < len(data) and data[at : at + len(MAGIC)] == MAGIC:
        s = Shard(data, at)
        yield s
        at = s.end + 1  # the writer's row separator


#: What a plain text does not hold: added tokens begin so, and are matched before all else; signs that
#: are neither printable ASCII, its white space nor accented Latin-1 letters.
_ODD = "<\\||[^!-~À-ÖØ-öø-ÿ \\t\\n\\r\\x0b\\x0c]"
#: What the file's pre-tokenizer cuts out of lower-case plain texts, between runs of letters: short
#: forms, digits one by one, runs of other signs.
_CUTS = "('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-zß-öø-ÿ0-9 \\t\\n\\r\\x0b\\x0c]+)"
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch


class Words(dict):
    """From a part of a text to its ids, by the tokenizers library, remembered. The file's tokenizer
    drops white space and joins nothing over it, nor over its own cuts, so a text's ids are its
    parts' one after another: parts by its cuts in plain texts, which its normalizer only
    lower-cases, else by white space. Texts are cut by Arrow, and each distinct part of a batch is
    looked up once."""

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # ids that end a word, as the file's model marks them
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.last = np.zeros(self.base, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        fast = getattr(self.tokenizer, "encode_batch_fast", None) or self.tokenizer.encode_batch
        self.batch = lambda parts: fast(parts, add_special_tokens=False)
        # runs of lower-case letters need no more of the tokenizer than its model, on bytes as letters
        words = Tokenizer(self.tokenizer.model)
        words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        joined = getattr(words, "encode_batch_fast", None) or words.encode_batch
        self.joined = lambda parts: joined([" ".join(parts)], add_special_tokens=False)[0].ids
        self.letters = {b: ord(c) for c, b in byte_letters().items()}

    def ids_of(self, parts: list[str]) -> list[bytes]:
        """Each part's ids; those that are not known are encoded together. When REMEMBERED are known they
        become the old ones, from which what is asked for again comes back, and those before go."""
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        ids = list(map(self.get, parts))
        at = [i for i, x in enumerate(ids) if x is None]
        names = list(map(parts.__getitem__, at))
        back = list(map(self.old.get, names))
        self.update((p, x) for p, x in zip(names, back, strict=True) if x is not None)
        letters, other = [], []
        for p, x in zip(names, back, strict=True):
            if x is None:
                (letters if _LETTERS(p) else other).append(p)
        for i in range(0, len(letters), TOGETHER):
            some = letters[i : i + TOGETHER]
            self.update(zip(some, self.encoded(some), strict=True))
        self.update(zip(other, self.each(other), strict=True))
        for i, x in zip(at, map(self.__getitem__, names), strict=True):
            ids[i] = x
        return ids

    def each(self, parts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.batch(parts)]

    def encoded(self, parts: list[str]) -> list[bytes]:
        """Ids of runs of letters in one call, as the words of a text, cut after each id that ends a word.
        Where a word has no such id, it holds letters that the model does not know: then each is
        encoded on its own."""
        spelt = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in parts]
        flat = np.array(self.joined(spelt), "<u4")
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) == len(parts) and ends[-1] == len(flat):
            data, at = flat.tobytes(), (4 * np.append(0, ends)).tolist()
            return list(map(data.__getitem__, map(slice, at, at[1:])))
        return self.each(parts)

    def encode(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text and, last, ``end``."""
        odd = pc.match_substring_regex(texts, _ODD)
        plain = pc.replace_substring_regex(pc.utf8_lower(texts), _CUTS, r" \1 ")
        lists = pc.ascii_split_whitespace(pc.if_else(odd, texts, plain))
        parts = lists.flatten().dictionary_encode()
        ids = self.ids_of(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        which = parts.indices.to_numpy()
        own = sizes[which]
        ends = np.cumsum(own, dtype=np.int64)
        begin = (np.cumsum(sizes, dtype=np.int64) - sizes)[which]
        at = np.repeat((begin - ends + own).astype(np.int32), own)  # a slice has far less than 2^31 tokens
        at += np.arange(len(at), dtype=np.int32)
        tokens = flat[at]
        upto = np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))]
        tail = np.array([end], "<u4")
        return [np.concatenate([tokens[a:b], tail]) for a, b in zip(upto.tolist(), upto[1:].tolist(), strict=False)]


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Shard files under ``path``/shards, in ascending id order by task and within tasks, and a
    table ``path``/manifest of ``(task, first)``: ids written before each task's.

    Null texts are empty, null ids come first; rows that repeat an id keep their order in the table, and
    may lie in several tasks. The ranges come from Spark's sampling of the ids, which reads no text;
    the texts move once. Each file ends with the number of its tokens, which is all that the manifest
    reads.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // TASK_BYTES))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row").select(F.spark_partition_id().alias("task"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(tokenizer)
        ids: list = []
        tokens: list[np.ndarray] = []
        held, task, total = 0, 0, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(task, ids, tokens, known.base)], pa.binary())], ["record"])

        for b in batches:
            for part in pieces(b, 2, PIECE):
                task = part.column(0)[0].as_py()
                ids += part.column(1).to_pylist()
                tokens += known.encode(part.column(2), end)
                more = sum(map(len, tokens[-part.num_rows :]))
                held, total = held + more, total + more
                if held >= SHARD:
                    yield closed()
                    ids, tokens, held = [], [], 0
        if ids:
            yield closed()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([END % (task, total)], pa.binary())], ["record"])

    small_batches(spark)
    shards = rows.mapInArrow(run, "record binary")
    shards.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/shards")
    tail = F.substring("content", -END_BYTES, END_BYTES - 1).cast("string")
    totals = _files(spark, path).where(F.length("content") > 0).select(F.substring(tail, 7, 19).cast("long").alias("task"), F.substring(tail, 27, 19).cast("long").alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))  # a row a task
    totals.select("task", F.coalesce(before, F.lit(0)).alias("first")).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards").select("content")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of each document, and its ``ids`` on demand, as the files have
    them: a document without text has its end id only, rows that repeat are told each, null ids stay
    null, and files of an empty table give no rows."""
    names = ["task", "id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                seen = 0
                for s in shards_of(b.column(0)[i].as_py()):
                    flat = s.expand(s.symbols).astype("<u4")
                    ends = np.cumsum(s.n_tokens)
                    docs = [flat[e - n : e] for e, n in zip(ends, s.n_tokens, strict=True)]
                    least = -(1 << 63)
                    cols = [pa.array([s.number] * len(docs), pa.int64()), pa.array([None if x == least else x for x in s.doc_ids.tolist()], pa.int64()), pa.array(seen + ends - s.n_tokens, pa.int64()), pa.array(s.n_tokens, pa.int64()), pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([d.astype(np.int32) for d in docs], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(cols, names)
                    seen += int(ends[-1])

    kinds = "task long, id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = _files(spark, path).mapInArrow(run, kinds)
    out = rows.join(small(spark.read.parquet(f"{path}/manifest")), "task")  # a row a task
    return out.withColumn("start", F.col("start") + F.col("first")).drop("task", "first")
