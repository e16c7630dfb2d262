"""Toxicity from subword-bag embeddings.

A word is a bag of its character n-grams, which share one half of its weight, and of itself, which has the other; all are hashed into
buckets. A passage is the average of its words' embeddings, and a linear softmax over the passage gives the probability of the toxic class. Buckets seen in fewer than ``MIN_TEXTS`` training texts stand for
nothing, so that no single text is learnt by heart. Embeddings and softmax are trained jointly by gradient steps
in numpy. Misspelt or inflected words share most n-grams, so their vectors are near those seen in training.

A passage is ``WINDOW`` neighbouring words and every passage of the whole text is scored; the score of a text is that of its worst
passage, so a few words in a long text count as much as in a short one. Training follows that: each step uses, for each text, the passage
that the model finds worst so far.

For scoring, softmax and embeddings collapse into one number per bucket, so a text costs one table look-up per n-gram.

Defined results: null, empty and wordless texts get the score of an empty passage. Equal texts get equal scores. Without any labelled
row the score is 0. An input column named like the
result stays, and the result, always the last column, takes the next longer free name (``common.free_name``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import free_name, labelled_sample, per_row

SIZES = (3, 4, 5, 6)
WINDOW = 2
BUCKETS = 1 << 20
MIN_TEXTS = 4
MAX_ROWS = 6000
PIECE = 1 << 18

# Bytes that belong to words: ASCII letters and digits, and all bytes beyond ASCII.
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


_TURN = np.uint64(0x9E3779B97F4A7C15)  # an odd constant, so that its powers can be undone
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base)]), dtype=np.uint64)[:n]


def _grams(raw: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(bucket, word number) of all n-grams of each size, the bucket of each whole word, and the place where each word starts.

    ``raw`` is lower-case text as bytes; any byte outside words is a border, and a border next to a word belongs to its n-grams.
    """
    data = np.zeros(len(raw) + 2, np.uint32)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD_BYTE[raw]
    data[1:-1] = np.where(inside[1:-1], raw.astype(np.uint32) + 1, 0)
    first = inside[1:] & ~inside[:-1]
    word = np.cumsum(first, dtype=np.int32) - 1  # of position 1, 2, ...
    starts = np.flatnonzero(first)
    found = []
    hashed = data.copy()
    # hashed[i]: of the n bytes from i; whole[i]: whether the bytes between the first and the last are word bytes.
    whole = np.ones(len(data), bool)
    for n in range(2, max(SIZES) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        hashed = hashed[:m] * np.uint32(0x01000193) + data[n - 1 :]
        if n > 2:
            whole = whole[:m] & inside[n - 2 : n - 2 + m]
        if n in SIZES:
            at = np.flatnonzero(whole[:m])
            mixed = hashed[at]
            mixed = mixed ^ (mixed >> np.uint32(15))
            mixed = (mixed * np.uint32(0x85EBCA6B)) ^ np.uint32(n * 7919)
            found.append(((mixed >> np.uint32(9)).astype(np.int32) & (BUCKETS - 1), word[at]))
    # A whole word: its bytes times rising powers, from differences of a running sum, turned back to the word's start.
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    running = np.concatenate([[np.uint64(0)], np.cumsum(data * _powers(_TURN, len(data)), dtype=np.uint64)])
    value = (running[ends] - running[starts + 1]) * _powers(_BACK, len(data))[starts + 1]
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return found, (value >> np.uint64(40)).astype(np.int32) & (BUCKETS - 1), starts


def _pieces(raw: bytes) -> list[bytes]:
    """Cuts between words, so that memory stays bounded on very long texts."""
    out = []
    while len(raw) > PIECE:
        at = raw.rfind(b" ", 0, PIECE) + 1 or PIECE
        out.append(raw[:at])
        raw = raw[at:]
    return [*out, raw]


def _lower(text: bytes | None) -> bytes:
    return text.decode("utf-8", "replace").lower().encode("utf-8") if text else b""


def word_scores(raw: bytes, table: np.ndarray) -> np.ndarray:
    """A number for each word of a lower-case text: half its n-grams' average, half its own."""
    parts = []
    for piece in _pieces(raw):
        found, own, starts = _grams(np.frombuffer(piece, np.uint8))
        sums, counts = np.zeros(len(starts)), np.zeros(len(starts))
        for bucket, word in found:
            sums += np.bincount(word, table[bucket], len(starts))[: len(starts)]
            counts += np.bincount(word, minlength=len(starts))[: len(starts)]
        parts.append(0.5 * sums / np.maximum(counts, 1) + 0.5 * table[own])
    return np.concatenate(parts)


def passages(words: np.ndarray) -> np.ndarray:
    """Average over every passage; a text shorter than a passage is one."""
    if len(words) <= WINDOW:
        return np.array([words.mean() if len(words) else 0.0])
    total = np.concatenate([[0.0], np.cumsum(words)])
    return (total[WINDOW:] - total[:-WINDOW]) / WINDOW


class Model:
    """``table``: the logit of each bucket; ``bias``: the logit of nothing."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        """Worst passage of each text. Short texts are scored together, since each call has a fixed cost."""
        out = np.empty(len(texts))
        for group in _groups([_lower(t) for t in texts]):
            joined = b" ".join(raw for _, raw in group)
            words = word_scores(joined, self.table)
            held = np.frombuffer(joined, np.uint8)
            edge = _WORD_BYTE[held]
            starts = np.flatnonzero(edge & ~np.concatenate([[False], edge[:-1]]))
            ends = np.cumsum([len(raw) + 1 for _, raw in group])
            cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
            for (k, _), a, b in zip(group, cuts, cuts[1:]):
                out[k] = passages(words[a:b]).max()
        return out + self.bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def _groups(raws: list[bytes]):
    group, used = [], 0
    for k, raw in enumerate(raws):
        group.append((k, raw))
        used += len(raw) + 1
        if used > PIECE:
            yield group
            group, used = [], 0
    if group:
        yield group


def train(texts: list[bytes | None], labels: np.ndarray, dim: int = 8, epochs: int = 14, rate: float = 0.05, batch: int = 64, seed: int = 1) -> Model:
    """Joint training by Adam. Texts without a label of either class give a constant model."""
    labels = np.asarray(labels)
    if not len(labels):
        return Model(np.zeros(BUCKETS, np.float32), -500.0)
    if labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 8.0 if labels[0] else -8.0)
    rng = np.random.default_rng(seed)
    seen = np.zeros(BUCKETS, np.int32)
    for t in texts:
        grams, _, own = _bag(_lower(t))
        seen[np.unique(np.concatenate([grams, own]))] += 1
    kept = np.flatnonzero(seen >= MIN_TEXTS)
    slot = np.zeros(BUCKETS, np.int32)  # row 0 is the vector of nothing
    slot[kept] = np.arange(1, len(kept) + 1)
    bags = [_reduced(_bag(_lower(t)), slot) for t in texts]
    emb = rng.normal(0, 0.1, (len(kept) + 1, dim)).astype(np.float32)
    emb[0] = 0
    out = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.array([0.0, 0.0], np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, out, bias)]
    step = 0
    # Both classes weigh the same in the first steps, then as in the sample, so that scores are probabilities.
    share = labels.mean()
    for epoch in range(epochs):
        balance = 0.5 / share if epoch < epochs // 2 else 1.0
        line = (emb @ (out[:, 1] - out[:, 0])).astype(np.float64)
        worst = [_worst(bag, line) for bag in bags]
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            buckets, weights, owner = [], [], []
            for row, k in enumerate(chosen):
                grams, ends, own, sizes_of = bags[k]
                a, b = worst[k]
                lo, hi = (ends[a - 1] if a else 0), (ends[b - 1] if b else 0)
                sizes = np.diff(ends[a:b], prepend=lo)
                buckets += [grams[lo:hi], own[a:b]]
                weights += [np.repeat(0.5 / np.maximum(sizes_of[a:b], 1) / max(1, b - a), sizes), np.full(b - a, 0.5 / max(1, b - a))]
                owner.append(np.full(hi - lo + b - a, row))
            buckets, owner = np.concatenate(buckets), np.concatenate(owner)
            weights = np.concatenate(weights).astype(np.float32)
            hidden = np.zeros((len(chosen), dim), np.float32)
            np.add.at(hidden, owner, emb[buckets] * weights[:, None])
            logit = hidden @ out + bias
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            y = labels[chosen]
            delta = prob.astype(np.float32)
            delta[np.arange(len(y)), y] -= 1
            delta *= np.where(y == 1, balance, 1.0)[:, None].astype(np.float32) / len(y)
            grad_hidden = delta @ out.T
            used, where = np.unique(buckets, return_inverse=True)
            grad_emb = np.zeros((len(used), dim), np.float32)
            np.add.at(grad_emb, where, grad_hidden[owner] * weights[:, None])
            grad_emb[used == 0] = 0
            step += 1
            _adam(emb, grad_emb, state[0], rate, step, used)
            _adam(out, hidden.T @ delta, state[1], rate, step)
            _adam(bias, delta.sum(0), state[2], rate, step)
    table = np.zeros(BUCKETS, np.float32)
    table[kept] = (emb @ (out[:, 1] - out[:, 0]))[1:]
    return Model(table, float(bias[1] - bias[0]))


def _adam(value, grad, state, rate, step, rows=slice(None)):
    mean, square = state
    mean[rows] = 0.9 * mean[rows] + 0.1 * grad
    square[rows] = 0.999 * square[rows] + 0.001 * grad * grad
    fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
    value[rows] -= (rate * fix * mean[rows] / (np.sqrt(square[rows]) + 1e-7)).astype(value.dtype)


def _bag(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams ordered by word, where each word's buckets end, and the words' own buckets."""
    buckets, words, owns, base = [], [], [], 0
    for piece in _pieces(raw):
        found, own, starts = _grams(np.frombuffer(piece, np.uint8))
        owns.append(own)
        for bucket, word in found:
            buckets.append(bucket)
            words.append(word + base)
        base += len(starts)
    if not base:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
    bucket, word = np.concatenate(buckets), np.concatenate(words)
    order = np.argsort(word, kind="stable")
    return bucket[order], np.cumsum(np.bincount(word, minlength=base)), np.concatenate(owns)


def _reduced(bag, slot: np.ndarray):
    """A bag without the buckets that stand for nothing, and the number of n-grams each word had with them."""
    grams, ends, own = bag
    mapped = slot[grams]
    kept = mapped > 0
    before = np.concatenate([[0], np.cumsum(kept)])
    sizes = np.diff(ends, prepend=0)
    return mapped[kept], before[ends].astype(np.int32), slot[own], np.minimum(sizes, 65535).astype(np.uint16)


def _worst(bag, line: np.ndarray) -> tuple[int, int]:
    grams, ends, own, sizes = bag
    if len(ends) <= WINDOW:
        return 0, len(ends)
    total = np.concatenate([[0.0], np.cumsum(line[grams])])
    sums = total[ends] - total[np.concatenate([[0], ends[:-1]])]
    a = int(np.argmax(passages(0.5 * sums / np.maximum(sizes, 1) + 0.5 * line[own])))
    return a, a + WINDOW


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Train on about ``max_rows`` of the labelled rows (id, text, label 0 or 1), drawn by hash; rows without a label are skipped."""
    usable = labelled.filter(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull())
    rows = labelled_sample(usable, F.col(id_col), max_rows).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("y"))
    held = sorted((str(r["i"]), r["t"].encode("utf-8"), r["y"]) for r in rows.toLocalIterator())
    return train([t for _, t, _ in held], np.array([y for _, _, y in held], np.int64))


def scored(df: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """All rows and columns, and the probability that the text is toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: a number per bucket

    def run(texts: list[bytes | None]) -> dict:
        return {"score": shared.value.scores(texts)}

    return df.withColumn(free_name(df, out), per_row(run, "score double")(F.col(text_col).cast("string"))["score"])
