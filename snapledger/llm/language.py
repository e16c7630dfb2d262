"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the UTF-8 bytes of a text, one forwards, one backwards, and every position gets a probability per
language from both. A text's probabilities are the averages over all of its positions. The network is trained in numpy by
backpropagation through time on passages drawn from labelled texts.

The whole text is read, in stretches of ``STRETCH`` bytes that run side by side through the network, so memory does not grow with a
text's length beyond the bytes themselves.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to the first language by name; without any
labelled text every text is ``und``. Equal texts get equal results. An input column named like the
result stays, and the result, always the last column, takes the next longer free name (``common.free_name``).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import free_name, labelled_sample, per_row

UNDETERMINED = "und"
HIDDEN = 8
STRETCH = 128
LANES = 2048
MAX_ROWS = 4000
_LETTER = re.compile(r"[^\W\d_]")


def _lettered(text: str) -> bool:
    """Whether a text has a letter; signs such as ½ and ² match the pattern too and are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def _gate(x: np.ndarray) -> np.ndarray:
    """Logistic function, through tanh, in place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _forward(x: np.ndarray, table: np.ndarray, rec: np.ndarray, keep: bool = False):
    """States of one direction over bytes ``x`` (time, lanes): array (time, hidden, lanes).

    ``table`` (3 hidden, 256) is what a byte adds to the update gate, the reset gate and the candidate; ``rec`` (3 hidden, hidden) is
    what the state adds.
    """
    steps, lanes = x.shape
    h2 = rec.shape[0] // 3
    state = np.zeros((h2, lanes), np.float32)
    out = np.empty((steps, h2, lanes), np.float32)
    tape = []
    for t in range(steps):
        given = table.take(x[t], axis=1)
        held = rec @ state
        gates = _gate(given[: 2 * h2] + held[: 2 * h2])
        z, r = gates[:h2], gates[h2:]
        hn = held[2 * h2 :]
        cand = r * hn
        cand += given[2 * h2 :]
        np.tanh(cand, out=cand)
        new = state - cand
        new *= z
        new += cand
        if keep:
            tape.append((state, z, r, hn, cand))
        state = out[t] = new
    return out, tape


def _backward(x, tape, rec, grad_out, grad_table, grad_rec):
    """Backpropagation through time; adds to the gradients."""
    h = rec.shape[0] // 3
    carried = np.zeros_like(tape[0][0])
    for t in range(len(tape) - 1, -1, -1):
        before, z, r, hn, cand = tape[t]
        g = grad_out[t] + carried
        g_cand = g * (1 - z) * (1 - cand * cand)
        g_z = g * (before - cand) * z * (1 - z)
        g_r = g_cand * hn * r * (1 - r)
        given = np.concatenate([g_z, g_r, g_cand])
        held = np.concatenate([g_z, g_r, g_cand * r])
        np.add.at(grad_table.T, x[t], given.T)
        grad_rec += held @ before.T
        carried = g * z + rec.T @ held


class Model:
    def __init__(self, languages: list[str], params: list[np.ndarray]):
        self.languages, self.params = languages, params

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Per language, position and lane: (time, languages, lanes)."""
        table_f, rec_f, table_b, rec_b, out, bias = self.params
        ahead, _ = _forward(x, table_f, rec_f)
        back, _ = _forward(x[::-1], table_b, rec_b)
        logit = out[:, :HIDDEN] @ ahead + out[:, HIDDEN:] @ back[::-1] + bias[:, None]
        logit -= logit.max(axis=1, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=1, keepdims=True)
        return logit

    def label(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """Language and pooled probability of each text."""
        result: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.languages:
            return result
        known = [k for k, t in enumerate(texts) if t and _lettered(t.decode("utf-8", "replace"))]
        for k, sums in self._sums([(k, texts[k]) for k in known]):
            best = int(np.argmax(sums))
            result[k] = self.languages[best], float(min(1.0, sums[best] / sums.sum()))
        return result

    def _sums(self, texts):
        """(number of the text, probabilities summed over its positions), stretch by stretch, many stretches at a time."""
        lanes, owners, pending = [], [], {}
        for k, text in texts:
            count = -(-len(text) // STRETCH)
            pending[k] = [count, np.zeros(len(self.languages))]
            for at in range(0, len(text), STRETCH):
                lanes.append(text[at : at + STRETCH])
                owners.append(k)
                if len(lanes) == LANES:
                    yield from self._flush(lanes, owners, pending)
                    lanes, owners = [], []
        if lanes:
            yield from self._flush(lanes, owners, pending)

    def _flush(self, lanes, owners, pending):
        sizes = np.array([len(s) for s in lanes])
        x = np.frombuffer(b"".join(s.ljust(STRETCH, b" ") for s in lanes), np.uint8).reshape(len(lanes), STRETCH).T[: sizes.max()]
        p = self.probabilities(np.ascontiguousarray(x))
        p *= (np.arange(len(p))[:, None] < sizes)[:, None, :]
        for k, sums in zip(owners, p.sum(axis=0, dtype=np.float64).T):
            left = pending[k]
            left[0] -= 1
            left[1] += sums
            if not left[0]:
                yield k, pending.pop(k)[1]


def train(texts: list[bytes], labels: list[str], steps: int = 260, lanes: int = 96, length: int = 96, rate: float = 0.02, seed: int = 5) -> Model:
    """Adam on the log loss of every position of passages drawn at random places, each language as often as the others."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k, h = len(languages), HIDDEN
    emb = [rng.normal(0, 0.5, (3 * h, 256)).astype(np.float32) for _ in range(2)]
    rec = [(rng.normal(0, 1, (3 * h, h)) / np.sqrt(h)).astype(np.float32) for _ in range(2)]
    params = [emb[0], rec[0], emb[1], rec[1], rng.normal(0, 0.3, (k, 2 * h)).astype(np.float32), np.zeros(k, np.float32)]
    if not languages:
        return Model([], params)
    by = [[t for t, lab in zip(texts, labels) if lab == name and t] or [b" "] for name in languages]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, k, lanes)
        rows = []
        for lab in y:
            text = by[lab][rng.integers(len(by[lab]))]
            at = rng.integers(0, max(1, len(text) - length + 1))
            rows.append(text[at : at + length].ljust(length, b" "))
        x = np.ascontiguousarray(np.frombuffer(b"".join(rows), np.uint8).reshape(lanes, length).T)
        table_f, rec_f, table_b, rec_b, out, bias = params
        ahead, tape_f = _forward(x, table_f, rec_f, keep=True)
        back, tape_b = _forward(x[::-1], table_b, rec_b, keep=True)
        both = np.concatenate([ahead, back[::-1]], axis=1)
        logit = out @ both + bias[:, None]
        logit -= logit.max(axis=1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(lanes)] -= 1
        p /= lanes * length
        grads = [np.zeros_like(q) for q in params]
        grads[4] = np.einsum("tkl,thl->kh", p, both)
        grads[5] = p.sum(axis=(0, 2))
        g = out.T @ p
        _backward(x, tape_f, rec_f, g[:, :h], grads[0], grads[1])
        _backward(x[::-1], tape_b, rec_b, g[::-1, h:], grads[2], grads[3])
        norm = np.sqrt(sum(float((q * q).sum()) for q in grads))
        fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * min(1.0, 1.0 / max(norm, 1e-12))
        pace = rate * (1 - 0.9 * step / steps)
        for q, d, (mean, square) in zip(params, grads, state):
            d = d * min(1.0, 1.0 / max(norm, 1e-12))
            mean += 0.1 * (d - mean)
            square += 0.001 * (d * d - square)
            q -= (pace * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
    return Model(languages, params)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Train on about ``max_rows`` of the rows with a text and a language, drawn by hash."""
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = labelled_sample(usable, F.col(id_col), max_rows).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("y"))
    held = sorted((tuple(r) for r in rows.toLocalIterator()), key=lambda r: (str(r[0]), r[1], r[2]))
    return train([r[1].encode("utf-8") for r in held], [r[2] for r in held])


def identified(df: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """All rows and columns, and a struct (lang, score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: the network's weights

    def run(texts: list[bytes | None]) -> dict:
        found = shared.value.label(texts)
        return {"lang": [f[0] for f in found], "score": [f[1] for f in found]}

    return df.withColumn(free_name(df, out), per_row(run, "lang string,score double")(F.col(text_col).cast("string")))
