"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of benchmark words. For patterns of one length the search keeps a table of blocks (pairs of neighbouring words)
with the distance from a block's last place in any pattern to the pattern's end. The scan looks at one block, skips as many words as
that distance allows, and only where it is zero looks up the patterns that end with this block and compares them word by word.

Items too short for a window form their own length class with its own tables. The benchmark is sent to the tasks in blocks of a bounded
number of windows; long items are divided. A benchmark beyond one block is searched in several passes, which carry the found spans along
in stored rows and shuffle nothing.

Defined results: null texts have no words; items without words have no window; a null item id counts as an item named by an empty
text; equal item ids count once. Windows of equal text belong to all their items. Copies of a document each get the full result.
An input column named like the result stays, and the result, always the last column, takes the next longer free name.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from snapledger.llm.common import free_name, stored

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# About 300 bytes of tables a window: 60 MB a block in the driver and in each task.
BLOCK_WINDOWS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case: letters and digits of ASCII, and everything beyond ASCII."""
    return _WORD.findall(text.lower()) if text else []


class Matcher:
    """Shift and bucket tables for pieces (item, words, window) of a benchmark.

    A pattern is a place in one list of all words, so its words are stored once however many windows they belong to.
    """

    def __init__(self, pieces: Iterable[tuple[str, list[bytes], int]]):
        known: dict[bytes, bytes] = {}
        self.words: list[bytes] = []
        first: dict[tuple[bytes, ...], int] = {}  # distinct windows, needed while the tables are made
        self.owners: dict[int, str | set[str]] = {}
        for item, words, size in pieces:
            base = len(self.words)
            self.words += [known.setdefault(w, w) for w in words]
            for k in range(base, len(self.words) - size + 1):
                at = first.setdefault(tuple(self.words[k : k + size]), k)
                held = self.owners.setdefault(at, item)
                if isinstance(held, set):
                    held.add(item)
                elif held != item:
                    self.owners[at] = {held, item}
        by_length: dict[int, list[int]] = defaultdict(list)
        for pattern, at in first.items():
            by_length[len(pattern)].append(at)
        self.classes = []
        for m, places in sorted(by_length.items()):
            block = min(2, m)
            shift: dict[tuple[bytes, ...], int] = {}
            bucket: dict[tuple[bytes, ...], int | list[int]] = {}
            for at in places:
                for end in range(block, m + 1):
                    key = tuple(self.words[at + end - block : at + end])
                    shift[key] = min(shift.get(key, m), m - end)
                key = tuple(self.words[at + m - block : at + m])
                held = bucket.get(key)
                if held is None:
                    bucket[key] = at
                elif isinstance(held, list):
                    held.append(at)
                else:
                    bucket[key] = [held, at]
            self.classes.append((m, block, m - block + 1, shift, bucket))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, past the last) of all occurrences, and the items they come from."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        n = len(words)
        for m, block, far, shift, bucket in self.classes:
            at = m  # past the last word of the current window
            get = shift.get
            while at <= n:
                key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
                skip = get(key, far)
                if skip:
                    at += skip
                    continue
                here, places = words[at - m : at], bucket.get(key, ())
                for place in places if isinstance(places, (list, tuple)) else (places,):
                    if self.words[place : place + m] == here:
                        spans.append((at - m, at))
                        owners = self.owners[place]
                        found |= owners if isinstance(owners, set) else {owners}
                at += 1
        return spans, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pieces(item: str, words: list[bytes], window: int, most: int) -> Iterator[tuple[str, list[bytes], int]]:
    """An item as stretches of at most ``most`` windows, which share the words that a window across their border needs."""
    size = min(window, len(words))
    for k in range(0, len(words) - size + 1 if size else 0, most):
        yield item, words[k : k + most + size - 1], size


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_windows: int) -> Iterator[Matcher]:
    """Tables for the benchmark in blocks of at most ``block_windows`` windows, one block held at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    held, count = [], 0
    for row in items.toLocalIterator():
        words = words_of(row["t"].encode("utf-8")) if row["t"] is not None else []
        for piece in _pieces(row["i"], words, window, block_windows):
            more = len(piece[1]) - piece[2] + 1
            if held and count + more > block_windows:
                yield Matcher(held)
                held, count = [], 0
            held.append(piece)
            count += more
    if held or not count:
        yield Matcher(held)


HITS = "n_words:long,spans:array<int>,items:array<string>"
_KIND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _scanner(shared):
    """The search as a column function of the text and of what earlier blocks of the benchmark have found."""

    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        search, rows = shared.value.search, []
        for text, old in zip(texts.cast(pa.binary()), before):
            words = words_of(text.as_py())
            spans, items = search(words)
            if (old := old.as_py()) is not None:
                spans += list(zip(old["spans"][::2], old["spans"][1::2]))
                items |= set(old["items"])
            rows.append({"n_words": len(words), "spans": [x for s in _merged(spans) for x in s], "items": sorted(items)})
        return pa.array(rows, _KIND)

    return arrow_udf(scan, f"struct<{HITS}>").asNondeterministic()


def contaminated(
    df: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    block_windows: int = BLOCK_WINDOWS, out: str = "hits",
) -> DataFrame:
    """All rows and columns, and a struct (n_words, spans, items): the words in all, the hit spans and the items that occur.

    ``spans`` is a flat list of first and past-the-last word numbers of separate stretches in order.
    """
    context, name = df.sparkSession.sparkContext, free_name(df, out)
    done = df.withColumn(name, F.lit(None).cast(f"struct<{HITS}>"))
    for number, matcher in enumerate(_blocks(benchmark, item_col, item_text_col, window, block_windows)):
        if number:
            # Between two blocks the rows are stored, so a task holds the tables of one block and not of all.
            done = stored(done)
        scan = _scanner(context.broadcast(matcher))
        done = done.withColumn(name, scan(F.col(text_col).cast("string"), F.col(name)))
    return done


def hit_words(spans) -> F.Column:
    """Number of words in the separate stretches of ``spans``."""
    ends = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.coalesce(ends, F.lit(0).cast("long"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
