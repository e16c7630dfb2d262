"""Byte-pair encoding of the SentencePiece kind through a prefix table, and decoding.

The pieces of a text are found without merging. For every prefix there is one piece that the encoding of that prefix ends with. The
automaton over all pieces gives the pieces that end at a position; the right one is that which is compatible with the last piece of
the prefix before it: the two must not merge, nor be cut differently, when encoded together. The ids are then read backwards from
the last entry of the table.

No piece of such a model holds a word-start mark after another character, so no piece crosses that border. A text is cut there and
equal stretches are encoded once per task, as long as they are short. Characters outside the vocabulary become their UTF-8 bytes.

Defined results: null and empty texts give the begin and end ids alone; texts of any length are taken whole. An input column named like the
result stays, and the result, always the last column, takes the next longer free name (``common.free_name``).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import free_name, per_row

MARK = "▁"
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceEncoder:
    """Encoder and decoder of one model file (BPE, identity normaliser, byte fallback)."""

    def __init__(self, model_file: str, memo: int = 120_000, memo_chars: int = 48):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.control = {i for i in range(n) if model.is_control(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece holds a word-start mark after another character")
        # A merge's turn: higher scores first. Single characters are never merged into.
        self.turn = {i: -model.get_score(i) for i in plain}
        self.halves: dict[int, tuple[int, int]] = {}
        self.reachable: set[int] = set()
        self._derive()
        self.automaton = ahocorasick.Automaton()
        for i in self.reachable:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, tuple[bytes, bytes]] = {}
        self._older: dict[str, tuple[bytes, bytes]] = {}
        self._memo_size, self._memo_chars = memo, memo_chars
        self._chars = frozenset(p for p in self.id_of if len(p) == 1)
        self._length = [len(p) for p in self.pieces]
        self._packed_id = [i.to_bytes(4, "little") for i in range(n)]
        self._bytes_of = [
            b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(MARK, " ").encode()
            for i in range(n)
        ]

    def _derive(self) -> None:
        """The last merge that makes each piece, in the order merges are done; pieces that no merge makes are left out."""
        for i in sorted(self.id_of.values(), key=lambda i: (len(self.pieces[i]) > 1, self.turn[i])):
            text = self.pieces[i]
            if len(text) == 1:
                self.reachable.add(i)
                continue
            parts = self._merge(text)
            if len(parts) == 2 or (len(parts) == 1 and parts[0] == i):
                if len(parts) == 2:
                    self.halves[i] = (parts[0], parts[1])
                self.reachable.add(i)

    def _merge(self, text: str) -> list[int | str]:
        """Merge step by step, with every piece but the whole of ``text``; used for single pieces only."""
        parts = list(text)
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.turn[i] < best):
                    best, at = self.turn[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id_of.get(p, p) for p in parts]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two pieces stay as they are when their joined text is encoded."""
        # Undo the later of the two merges until neither is left; whenever a merge across the border would have come before the
        # merges still standing, the border would not exist. The bound is the turn of the merge undone last, with its side: on equal
        # turns the leftmost merge comes first.
        bound, bound_left = float("inf"), False
        infinite = float("inf")
        while True:
            joined = self.id_of.get(self.pieces[a] + self.pieces[b])
            if joined is not None:
                turn = self.turn[joined]
                if turn < bound or (turn == bound and not bound_left):
                    return False
            ta = self.turn[a] if a in self.halves else -infinite
            tb = self.turn[b] if b in self.halves else -infinite
            if ta == tb == -infinite:
                return True
            if ta > tb:
                bound, bound_left = ta, True
                a = self.halves[a][1]
            else:
                # On equal turns the right one is done last, so it is undone first.
                bound, bound_left = tb, False
                b = self.halves[b][0]

    def _table(self, text: str) -> list[int]:
        """Ids of a text of known characters: fill the prefix table left to right, then recover the ids backwards."""
        last = [-1] * (len(text) + 1)
        fits, known = self._fits, self._fits.get
        for end, (size, i) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            if end > size:
                pair = last[end - size], i
                ok = known(pair)
                if ok is None:
                    if len(fits) >= self._memo_size:
                        fits.clear()
                    ok = fits[pair] = self._compatible(*pair)
                if not ok:
                    continue
            last[end] = i
        ids, at, length = [], len(text), self._length
        while at:
            i = last[at]
            ids.append(i)
            at -= length[i]
        ids.reverse()
        return ids

    def stretch_ids(self, text: str) -> list[int]:
        """Ids of one stretch; characters that are no piece stand alone and never merge."""
        known = self._chars
        if known.issuperset(text):
            return self._table(text)
        ids: list[int] = []
        for c_known, run in groupby(text, known.__contains__):
            run = "".join(run)
            ids += self._table(run) if c_known else [self.byte_ids[b] for b in run.encode("utf-8")]
        return ids

    def _packed(self, stretch: str) -> tuple[bytes, bytes]:
        found = self._older.get(stretch)
        if found is None:
            ids = self.stretch_ids(stretch)
            found = b"".join([self._packed_id[i] for i in ids]), self._raw(ids)
        if len(stretch) <= self._memo_chars:
            if len(self._memo) >= self._memo_size:  # the older half goes
                self._older, self._memo = self._memo, {}
            self._memo[stretch] = found
        return found

    def _raw(self, ids: list[int]) -> bytes:
        return b"".join([self._bytes_of[i] for i in ids])

    def encode_packed(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, with begin and end, and the bytes these ids decode to."""
        begin, end = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        if not text:
            return begin + end, b""
        memo = self._memo.get
        found = [memo(s) or self._packed(s) for s in _STRETCH.findall(MARK + text.replace(" ", MARK))]
        return begin + b"".join([f[0] for f in found]) + end, b"".join([f[1] for f in found])[1:]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; one space at the start belongs to the model, bytes that are no UTF-8 become U+FFFD."""
        raw = self._raw(ids)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PieceEncoder:
    return PieceEncoder(model_file)


TOKENS = "n_tokens long,ids binary,decoded string"
DIGESTS = "n_tokens long,ids_sha256 string,decoded_sha256 string"


def encoded(df: DataFrame, model_file: str, text_col: str = "text", out: str = "tokens", digests: bool = False) -> DataFrame:
    """All rows and columns, and a struct of token count, packed ids and decoded text, or of their SHA-256 digests."""

    def run(texts: list[bytes | None]) -> dict:
        model = encoder(model_file)
        found = [model.encode_packed((t or b"").decode("utf-8")) for t in texts]
        counts = [len(ids) // 4 for ids, _ in found]
        if digests:
            sha = [[hashlib.sha256(part).hexdigest() for part in pair] for pair in found]
            return {"n_tokens": counts, "ids_sha256": [s[0] for s in sha], "decoded_sha256": [s[1] for s in sha]}
        return {"n_tokens": counts, "ids": [f[0] for f in found], "decoded": [f[1].decode("utf-8", "replace") for f in found]}

    fn = per_row(run, DIGESTS if digests else TOKENS)
    return df.withColumn(free_name(df, out), fn(F.col(text_col).cast("string")))
