"""Quality from a factorisation machine.

Features of a text are hashed words (share of the text's words), structure statistics in ranges (capitals, symbols, table bars, digits,
word lengths, repeats, lines, length) and metadata (the stored length, if there is one). The machine has a weight per feature and a
short vector per feature; a pair of features interacts by the product of their vectors. The sum over all pairs comes from the square of
the sum less the sum of squares, so a text costs time linear in its features. Training is by gradient steps in numpy.

Defined results: null and empty texts have the statistics of an empty text; a missing stored length gives no feature; without any
labelled row the score is 1, so nothing is thrown away unlearned. An input column named like the
result stays, and the result, always the last column, takes the next longer free name (``common.free_name``).
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
import pyarrow as pa

from snapledger.llm.common import _bytes, free_name, labelled_sample

WORDS = 2048
EDGES = np.array([0.002, 0.01, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])
STATS = ["upper", "symbol", "bar", "digit", "bang", "odd_word", "repeat", "neighbour", "stop"]
LENGTHS = 24
FEATURES = WORDS + len(STATS) * (len(EDGES) + 1) + len(STATS) + LENGTHS * 3
MAX_ROWS = 5000

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[128:] = 4
_KIND[[c for c in b"#$%&*@^~<>{}[]\\_=+"]] = 5
_KIND[ord("|")] = 6
_KIND[ord("!")] = 7


def features(text: bytes | None, stored: int | None, row: np.ndarray) -> None:
    """Write the features of one text into ``row`` (zeros)."""
    text = text or b""
    words = text.split()
    n = len(words)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8).astype(float)
    letters = max(1.0, kinds[1] + kinds[2] + kinds[4])
    hashed = np.fromiter((crc32(w) for w in words), np.uint32, n)
    distinct = len(np.unique(hashed))
    same = float((hashed[1:] == hashed[:-1]).mean()) if n > 1 else 0.0
    if n:
        row[:WORDS] = np.bincount(hashed & (WORDS - 1), minlength=WORDS) / n
    size = max(1, len(text))
    stats = [
        kinds[1] / max(1.0, kinds[1] + kinds[2]), min(1.0, 4 * kinds[5] / size), min(1.0, 4 * kinds[6] / size), kinds[3] / size,
        min(1.0, 4 * kinds[7] / size), min(1.0, letters / max(1, n) / 20), 1 - distinct / n if n else 0.0, same,
        min(1.0, len(text.split(b"\n")) / max(1, n)),
    ]
    at = WORDS
    for value in stats:
        row[at + np.searchsorted(EDGES, value)] = 1.0
        at += len(EDGES) + 1
    row[at : at + len(stats)] = stats
    at += len(stats)
    row[at + min(LENGTHS - 1, n.bit_length())] = 1.0
    at += LENGTHS
    row[at + min(LENGTHS - 1, len(text).bit_length())] = 1.0
    at += LENGTHS
    if stored is not None and stored >= 0:
        row[at + min(LENGTHS - 1, int(stored).bit_length())] = 1.0


def matrix(texts: list[bytes | None], stored: list[int | None]) -> np.ndarray:
    rows = np.zeros((len(texts), FEATURES), np.float32)
    for k, (text, n) in enumerate(zip(texts, stored)):
        features(text, n, rows[k])
    return rows


class Machine:
    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def logits(self, x: np.ndarray) -> np.ndarray:
        summed = x @ self.factors
        pairs = 0.5 * ((summed * summed).sum(1) - (x * x) @ (self.factors * self.factors).sum(1))
        return self.bias + x @ self.weights + pairs

    def scores(self, texts: list[bytes | None], stored: list[int | None], block: int = 512) -> np.ndarray:
        parts = [self.logits(matrix(texts[k : k + block], stored[k : k + block])) for k in range(0, len(texts), block)]
        logit = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500).astype(np.float64)))


def train(x: np.ndarray, y: np.ndarray, rank: int = 4, epochs: int = 30, rate: float = 0.02, batch: int = 128, decay: float = 2e-4, seed: int = 3) -> Machine:
    """Adam on the logistic loss; ``decay`` pulls weights and vectors of rare features to zero."""
    if not len(y):
        return Machine(500.0, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, rank), np.float32))
    rng = np.random.default_rng(seed)
    params = [np.zeros(1, np.float32), np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, rank)).astype(np.float32)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            k = order[at : at + batch]
            xs, bias, w, v = x[k], *params
            summed, squared = xs @ v, xs * xs
            logit = bias[0] + xs @ w + 0.5 * ((summed * summed).sum(1) - squared @ (v * v).sum(1))
            delta = ((1 / (1 + np.exp(-np.clip(logit, -60, 60)))) - y[k]).astype(np.float32) / len(k)
            grads = [delta.sum(keepdims=True), xs.T @ delta + decay * w, xs.T @ (delta[:, None] * summed) - v * (squared.T @ delta)[:, None] + decay * v]
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, (mean, square) in zip(params, grads, state):
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                p -= (rate * fix * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
    return Machine(float(params[0][0]), params[1], params[2])


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", max_rows: int = MAX_ROWS
) -> Machine:
    """Train on about ``max_rows`` of the labelled rows, drawn by hash; rows without a label of 0 or 1 are skipped."""
    usable = labelled.filter(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull())
    chosen = labelled_sample(usable, F.col(id_col), max_rows)
    rows = chosen.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), _length(length_col).alias("n"), F.col(label_col).alias("y"))
    held = sorted((tuple(r) for r in rows.toLocalIterator()), key=lambda r: (str(r[0]), r[1], r[3]))
    x = matrix([r[1].encode("utf-8") for r in held], [r[2] for r in held])
    return train(x, np.array([r[3] for r in held], np.float32))


def _length(column: str) -> Column:
    return F.expr(f"try_cast(`{column}` as bigint)")


def scored(df: DataFrame, model: Machine, text_col: str = "text", length_col: str = "n_chars", out: str = "quality_score") -> DataFrame:
    """All rows and columns, and the probability of good quality."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: a short vector per feature

    def run(texts: pa.Array, stored: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(_bytes(texts), stored.to_pylist()), pa.float64())

    score = arrow_udf(run, "double").asNondeterministic()
    return df.withColumn(free_name(df, out), score(F.col(text_col).cast("string"), _length(length_col)))
