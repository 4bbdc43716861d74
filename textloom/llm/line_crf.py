"""Quality rules: base statistics of a text, and a linear-chain CRF that labels its lines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import pieces, small_batches

# The characters that count as symbols, and the white space between words.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

WINDOW = 8
#: Lines of a training sequence; longer texts give several.
SEGMENT = 24
FEATURES = ("bias", "symbols", "upper", "shouts", "variety", "same_as_before", "repeats", "short", "stops", "digits", "bars", "length")
_UPPER, _DIGIT, _SYMBOL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", SYMBOLS.encode()
#: Share of its words in content lines that a text needs to be kept.
SHARE = 0.5


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of that many words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        key = np.zeros(n, np.uint64)
        for i in range(window):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    for i in np.flatnonzero(hit).tolist():  # equal hashes are held to equal words
        w = tuple(words[i : i + window])
        seen[w] = seen.get(w, 0) + 1
    edge = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(hit).tolist():
        if seen[tuple(words[i : i + window])] > 1:
            edge[i] += 1
            edge[i + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def base_stats(text: str) -> tuple[int, int, int, int, int, bool]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeats = repeated_words(words)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, n < 20 or 100 * repeats > 30 * n


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES and the number of words for each line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        raw = line.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        if not n:
            continue
        size = len(raw)
        letters = size - raw.count(b" ")
        runs = sum(map(bytes.__eq__, words, words[1:]))
        last = raw.rstrip()[-1]
        rows.append((1.0, min(1.0, 5 * (size - len(raw.translate(None, _SYMBOL))) / letters), (size - len(raw.translate(None, _UPPER))) / letters, min(1.0, raw.count(b"!") / n), len(set(words)) / n, float(line in seen), runs / n, float(n < 4), float(last in b".!?"), (size - len(raw.translate(None, _DIGIT))) / letters, min(1.0, 2 * raw.count(b" | ") / n), math.log1p(n) / 5))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(sizes, np.int64)


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label of each line: 1 content, 0 boilerplate. scores: what each line adds for
    content, against 0 for boilerplate; move[a][b]: what label b after label a adds."""
    m00, m01, m10, m11 = (float(x) for x in move.ravel())
    off, on, back = 0.0, 0.0, []
    for i, s in enumerate(scores.tolist()):
        if i:
            a, b, c, d = off + m00, on + m10, off + m01, on + m11
            back.append((int(b > a), int(d >= c)))
            off, on = max(a, b), max(c, d) + s
        else:
            on = s
    label = int(on >= off)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return np.array(out[::-1][: len(scores)], np.int64)


def padded(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences' features in one array, and a mask of the lines that are there."""
    x = np.zeros((len(lines), max(map(len, lines)), len(FEATURES)))
    mask = np.zeros(x.shape[:2])
    for i, f in enumerate(lines):
        x[i, : len(f)], mask[i, : len(f)] = f, 1
    return x, mask


def marginals(x: np.ndarray, mask: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition of each sequence, probability of label 1 of each line, and of each pair of labels
    of neighbours, by forward-backward."""
    move = theta[-4:].reshape(2, 2)
    emit = np.stack([np.zeros(mask.shape), x @ theta[:-4]], -1) * mask[..., None]
    fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
    fwd[:, 0] = emit[:, 0]
    for i in range(1, mask.shape[1]):
        new = np.logaddexp.reduce(fwd[:, i - 1, :, None] + move, axis=1) + emit[:, i]
        fwd[:, i] = np.where(mask[:, i, None] > 0, new, fwd[:, i - 1])
    for i in range(mask.shape[1] - 2, -1, -1):
        new = np.logaddexp.reduce(move + (emit[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
        bwd[:, i] = np.where(mask[:, i + 1, None] > 0, new, 0.0)
    z = np.logaddexp.reduce(fwd[:, -1], axis=1)
    p = np.exp(fwd + bwd - z[:, None, None])[..., 1] * mask
    step = mask[:, 1:] * mask[:, :-1]
    both = np.exp(fwd[:, :-1, :, None] + move + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * step[..., None, None]
    return z, p, both


def gradient(x: np.ndarray, mask: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Of the log likelihood of the labels y, by theta."""
    _, p, both = marginals(x, mask, theta)
    step = mask[:, 1:] * mask[:, :-1]
    seen = np.array([[(step * (y[:, :-1] == a) * (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    return np.concatenate([np.einsum("nl,nlf->f", y * mask - p, x), (seen - both.sum((0, 1))).ravel()])


def climb(x: np.ndarray, mask: np.ndarray, y: np.ndarray, theta: np.ndarray, rounds: int, rate: float = 0.2, ridge: float = 1e-3) -> np.ndarray:
    """theta after rounds of Adam on the mean log likelihood, held back by a ridge."""
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        g = gradient(x, mask, y, theta) / mask.sum() - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta


def agreeing(labels: np.ndarray, scores: np.ndarray, sizes: np.ndarray, good: bool, share: float = SHARE) -> np.ndarray:
    """The labels, changed in as few lines as give the text the verdict it is marked with: the lines
    whose scores speak least against the change come first."""
    out, words = labels.copy(), sizes.sum()
    for i in np.argsort(-scores if good else scores, kind="stable"):
        if (out @ sizes >= share * words) == good:
            break
        out[i] = int(good)
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], turns: int = 3, rounds: int = 80) -> dict:
    """Weights of a two-label linear-chain CRF from texts ``(features, sizes, mark)`` whose lines have no
    labels: expectation-maximisation with best labellings. At first every line has its text's mark.
    Then, in turns, the weights climb the likelihood of the labels, and the labels become Viterbi's,
    changed where they disagree with the text's mark (see agreeing). Without texts, or with marks
    of one kind only, the same rule holds: no weights, or weights that find one kind only."""
    theta = np.zeros(len(FEATURES) + 4)
    if docs:
        cuts = [(d, i) for d, (f, _, _) in enumerate(docs) for i in range(0, len(f), SEGMENT)]
        x, mask = padded([docs[d][0][i : i + SEGMENT] for d, i in cuts])
        labels = [np.full(len(f), y) for f, _, y in docs]
        for turn in range(turns):
            if turn:
                move = theta[-4:].reshape(2, 2)
                scores = [f @ theta[:-4] for f, _, _ in docs]
                labels = [agreeing(viterbi(s, move), s, sizes, bool(y)) for s, (_, sizes, y) in zip(scores, docs, strict=True)]
            y = np.zeros(mask.shape, int)
            for n, (d, i) in enumerate(cuts):
                part = labels[d][i : i + SEGMENT]
                y[n, : len(part)] = part
            theta = climb(x, mask, y, theta, rounds)
    return {"emit": theta[:-4].tolist(), "move": theta[-4:].reshape(2, 2).tolist()}


def labelled(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """At most about ``limit`` labelled rows ``(doc_id, text, y)``, one an id, chosen by a hash of the id,
    and never one whose crc32(doc_id) mod 4 is 2. Of several labels, or texts, of an id the least
    counts. The labels sent to the documents are so bounded, and what comes back."""
    usable = labels.where(f"doc_id is not null and {target} is not null and crc32(cast(doc_id as string)) % 4 <> 2").groupBy("doc_id").agg(F.min(F.col(target).cast("int")).alias("y"))
    n = usable.count()
    chosen = usable.where((F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, limit / max(n, 1)))))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, limit: int = 2000, most_lines: int = 240) -> dict:
    """Weights learned from at most about ``limit`` labelled texts, of each at most ``most_lines`` lines
    in stretches spread over it; only their features come to the driver. Null and empty texts teach
    nothing; without labels the weights are 0, and every line counts as content."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, 2):
                found = []
                for t in part.column(2).to_pylist():
                    f, sizes = line_features(t or "")
                    if len(f) > most_lines:
                        starts = np.linspace(0, len(f) - SEGMENT, most_lines // SEGMENT).astype(int)
                        f, sizes = (np.concatenate([a[i : i + SEGMENT] for i in starts]) for a in (f, sizes))
                    found.append((f.astype("<f4").tobytes(), sizes.astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["doc_id", "y", "x", "sizes"])

    small_batches(docs.sparkSession)
    got = labelled(docs, labels, "quality", limit)
    got = got.select(F.col("doc_id").cast("string"), "y", "text").mapInArrow(featured, "doc_id string, y int, x binary, sizes binary").where("length(x) > 0").collect()
    got.sort(key=lambda r: r["doc_id"])
    return fit([(np.frombuffer(r["x"], "<f4").reshape(-1, len(FEATURES)).astype(float), np.frombuffer(r["sizes"], "<i8"), int(r["y"] > 0)) for r in got])


def judge(text: str, model: dict, share: float) -> tuple[float, bool]:
    """Share of words in lines labelled content, and whether that reaches ``share``; no words: 0."""
    f, sizes = line_features(text)
    if not len(f):
        return 0.0, False
    content = int(sizes[viterbi(f @ np.array(model["emit"]), np.array(model["move"])) == 1].sum())
    part = content / int(sizes.sum())
    return part, part >= share


def _stats(text: str | None, model: dict, share: float) -> tuple:
    stats = base_stats(text or "")
    part, good = judge(text or "", model, share)
    return *stats, part, good and not stats[-1]


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
_TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]


def quality(docs: DataFrame, model: dict, share: float = SHARE) -> DataFrame:
    """Per row: the base statistics, the share of words in content lines and the verdict.

    Null and empty texts have no words and fail the base rules. Rows that repeat are judged each;
    an empty table gives an empty result; other columns play no part.
    """
    names = ["doc_id", *(x.split()[0] for x in STATS.split(", "))]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b, 1):
                cols = zip(*(_stats(t, model, share) for t in part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols, _TYPES)], names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judged, f"doc_id long, {STATS}")


def filter_quality(docs: DataFrame, model: dict, share: float = SHARE, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they came. Null and empty texts go;
    repeated rows are judged each; an empty table stays empty."""

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array) -> pa.Array:
        return pa.array([_stats(t.as_py(), model, share)[-1] for t in texts], pa.bool_())

    small_batches(docs.sparkSession)
    return docs.where(kept(F.col(text_col)))
