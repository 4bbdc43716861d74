"""Quality classifier: Bradley-Terry ranking of documents from preference pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches
from textloom.llm.line_crf import SYMBOLS, labelled

#: Bounds of the fit, both documented parameters of train().
MAX_TEXTS, MAX_PAIRS = 20_000, 60_000
SYMBOL = SYMBOLS.encode()
UPPER, DIGIT, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:"


def features(text: str) -> list[float]:
    """Dense features of a whole text; nothing but the text is read. Empty texts: all 0 but one."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * 17
    size = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    part = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    runs = sum(map(bytes.__eq__, words, words[1:]))
    symbols, upper, shouts, bars = part(SYMBOL), part(UPPER), raw.count(b"!") / n, raw.count(b"|") / n
    return [
        0.0, min(1.0, 4 * symbols), math.sqrt(symbols), upper, math.sqrt(upper), min(1.0, shouts), math.sqrt(min(1.0, bars)), kinds / n, pairs / n, runs / n, math.sqrt(runs / n),
        1 - len(set(lines)) / len(lines), math.log1p(n) / 10, min(2.0, size / n / 8), part(STOPS) * 5, part(DIGIT) * 5, math.log1p(n / len(lines)) / 5, float(n < 5),
    ]


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_texts: int = MAX_TEXTS, max_pairs: int = MAX_PAIRS, rounds: int = 300, rate: float = 0.05, ridge: float = 1e-4, seed: int = 7) -> dict:
    """Weights w so that sigmoid(w . (x_good - x_bad)) is likely over pairs of a good and a bad
    text, by Adam on the logistic loss of feature differences; then the cut: the quantile of the
    training scores below which as great a share lies as is marked bad.

    Features of at most about ``max_texts`` labelled texts come to the driver; ``max_pairs`` pairs
    are drawn from them. Rows with crc32(doc_id) mod 4 = 2 are never learned from. Without texts
    of both kinds the weights are 0 and every score is 0.7.
    """

    @F.arrow_udf("array<double>")
    def featured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py() or "") for t in texts], pa.list_(pa.float64()))

    small_batches(docs.sparkSession)
    got = labelled(docs, labels, target, max_texts).select("doc_id", "y", featured("text").alias("x")).collect()
    got.sort(key=lambda r: r["doc_id"])
    wide = len(features(""))
    if len({r["y"] for r in got}) < 2:
        return {"w": [0.0] * wide, "mean": [0.0] * wide, "sd": [1.0] * wide, "cut": 0.0, "scale": 1.0}
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    mean, sd = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / sd
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = min(max_pairs, 20 * max(len(good), len(bad)))
    d = x[rng.choice(good, n)] - x[rng.choice(bad, n)]
    w, m, v = np.zeros(wide), np.zeros(wide), np.zeros(wide)
    for t in range(1, rounds + 1):
        g = d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) / n - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    z = np.sort(x @ w)
    k = min(len(bad), len(z) - 1)
    cut = float((z[k - 1] + z[k]) / 2)
    return {"w": w.tolist(), "mean": mean.tolist(), "sd": sd.tolist(), "cut": cut, "scale": float(max(1e-6, np.std(z)))}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` for every row: 0.7 at the cut, rising with the learned rank, in 0 to 1.
    Null and empty texts are scored as texts without words; repeated rows each get their score."""
    w, mean, sd = (np.array(model[k]) for k in ("w", "mean", "sd"))
    at = math.log(0.7 / 0.3)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.float64())
        z = ((np.array([features(t.as_py() or "") for t in texts]) - mean) / sd) @ w
        return pa.array(1 / (1 + np.exp(-np.clip(2 * (z - model["cut"]) / model["scale"] + at, -40, 40))))

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), scored(F.col(text_col)).alias("score"))
