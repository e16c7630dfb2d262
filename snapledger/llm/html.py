"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and words. Words score by the elements they stand in, mostly positive, tags score negative; the weights come
from labelled pages by logistic regression. One linear scan finds the contiguous region of the highest total. Inside the region, texts
in elements that the same weights put outside the article (an advert between paragraphs) are left out; below an element whose own names
say article they cost nothing, so a long advert does not cut the article in two, and a box there is judged by its own names. Blocks are separated at block elements.

Defined results: null, empty and textless pages give an empty text. Scripts, styles, comments, titles, controls and hidden elements never
count. An element that is never closed reaches to the end of its parent. Character references without a semicolon are decoded as
browsers do; cut-off references stay as they are. Of equal regions the first one is taken. An input column named like the
result stays, and the result, always the last column, takes the next longer free name (``common.free_name``).
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import free_name, per_row
from snapledger.llm.labelled_pages import labelled_pages

# Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template title textarea select option button svg iframe object canvas audio video head math datalist".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
VOID = frozenset("br hr img input meta link source wbr area base col embed track param".split())
BLOCK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th tbody thead tfoot caption section article blockquote pre figure figcaption "
    "header footer main aside nav form fieldset address hr body html details summary dialog center".split()
)
# Elements that count as surroundings of the words in them; the others only mark up.
AROUND = frozenset(
    "nav header footer aside main article section div form ul ol li table a figure figcaption blockquote pre dialog ins label p h1 h2 h3 h4 h5 h6".split()
)
CLOSED_BY_NEXT = frozenset("p h1 h2 h3 h4 h5 h6".split())
FRAME = frozenset("<aside> <nav> <form> <footer> <dialog> <ins>".split())
BOX = frozenset("div section ul ol aside nav form footer dialog ins".split())
CONTAINER = frozenset("article main section div".split())
PROSE = frozenset("p blockquote h1 h2 h3 h4 h5 h6 td dd figcaption pre".split())

# Quotes count after an equals sign, as in browsers, and up to 16,384 characters: an open quote does not take the rest of the page.
_PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]{0,16384}+"|'[^']{0,16384}+')|=)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+>""", re.S
)
_NAME = re.compile(r"""(?:\b(?:class|id|role)\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none""", re.I)
# Least weight of an element's own tag and names for it to count as the article's.
NAMED = 1.0
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=4096)
def _features_of(tag: str, attributes: str) -> tuple[frozenset[str], bool]:
    """What an element adds to the surroundings of its words, and whether it is hidden."""
    found = {f"<{tag}>"}
    for m in _NAME.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        found |= {p.lower() for p in _PART.findall(value)}
        found |= {re.sub(r"[^a-z]", "", v.lower()) for v in value.split()}
    found.discard("")
    return frozenset(found), bool(_HIDDEN.search(attributes)) if attributes else False


class Place(NamedTuple):
    """Where a piece of a page stands."""

    features: frozenset[str]  # of all open elements together
    prose: bool  # below an element of running text
    article: bool  # below an element that the weights take for the article


NOWHERE = Place(frozenset(), False, False)


def scan(page: str, using: Weights | None = None):
    """Yields (kind, value, place): a text, a border between blocks, or a tag.

    With weights, features they do not know are left out, so that a page cannot enlarge the sets by names of its own, and a tag costs
    the same at any depth.
    """
    at, open_ = 0, []  # open_: (tag, place)
    held: Counter[str] = Counter()  # open elements by tag
    silent: list[str] = []
    foreign = 0  # open svg and math elements; only in them an element may close itself
    while at < len(page):
        m = _PIECE.search(page, at)
        end = m.start() if m else len(page)
        here = open_[-1][1] if open_ else NOWHERE
        if end > at and not silent:
            yield "text", page[at:end], here
        if not m:
            return
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), (m[3] or m[6] or "")
        if tag in ("svg", "math"):
            foreign = max(0, foreign - 1) if closing else foreign + (not attributes.endswith("/"))
        if tag in RAW and not closing and not (foreign and attributes.endswith("/")):
            m2 = _RAW_END[tag].search(page, at)
            at = len(page) if m2 is None else m2.start()
            m2 = _PIECE.match(page, at)
            at = m2.end() if m2 else at
            continue
        if silent:
            if closing and tag == silent[-1]:
                silent.pop()
            elif not closing and tag == silent[-1]:
                silent.append(tag)
            elif tag == "body" and not closing:
                silent.clear()
            if silent:
                continue
        elif tag in SILENT and not closing:
            if not attributes.endswith("/"):
                silent.append(tag)
            continue
        if tag in BLOCK:
            yield "border", tag, here
            while not closing and open_ and open_[-1][0] in CLOSED_BY_NEXT:
                held[open_.pop()[0]] -= 1
        elif tag == "br":
            yield "text", " ", here
        if tag in AROUND:
            if closing:
                while held[tag]:
                    last, _ = open_.pop()
                    held[last] -= 1
                    if last == tag:
                        break
            elif not attributes.endswith("/"):
                open_.append((tag, _inside(open_[-1][1] if open_ else NOWHERE, tag, attributes, using)))
                held[tag] += 1
        if tag not in VOID:
            yield "tag", tag, open_[-1][1] if open_ else NOWHERE


def _inside(outer: Place, tag: str, attributes: str, using: Weights | None) -> Place:
    """The place inside an element that opens in ``outer``."""
    read = _features_of if len(attributes) <= 500 else _features_of.__wrapped__  # long strings are not kept
    own, hidden = read(tag, attributes)
    if tag == "a" and outer.prose:
        own = frozenset()  # a link in running text says nothing about the text
    if hidden:
        own |= {"hidden"}
    if using:
        own = frozenset(f for f in own if f in using.values or f == "hidden")
    if outer.article and tag in BOX and using.names_other(own):
        # What its names say is not outvoted by those of the article around it.
        return Place(own, outer.prose or tag in PROSE, True)
    joined = outer.features if own <= outer.features else outer.features | own
    article = outer.article or bool(using and tag in CONTAINER and using.names_article(own) and using.word(joined) > 0)
    return Place(joined, outer.prose or tag in PROSE, article)


class Weights:
    """Score of a word in given surroundings, and of a tag."""

    def __init__(self, bias: float, values: dict[str, float], tag: float):
        self.bias, self.values, self.tag = bias, values, tag
        self._memo: dict = {}

    def word(self, around: frozenset[str]) -> float:
        known = self._memo.get(around)
        if known is None:
            if len(self._memo) > 20000:
                self._memo.clear()
            known = -50.0 if "hidden" in around else self.bias + sum(self.values.get(f, 0.0) for f in sorted(around))
            known = self._memo[around] = max(-6.0, min(4.0, known))
        return known

    def names_article(self, own: frozenset[str]) -> bool:
        """Whether an element's own tag and names speak for the article, by more than a plain element's."""
        return sum(self.values.get(f, 0.0) for f in own) >= NAMED

    def names_other(self, own: frozenset[str]) -> bool:
        """Whether an element's names, or a tag that only frames, speak against it."""
        return sum(self.values.get(f, 0.0) for f in own if not f.startswith("<") or f in FRAME) <= -NAMED


def learn(pages: list[list[tuple[str, bool]]], steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Weights:
    """Logistic regression of article or not over the texts of labelled pages, each text once per word up to ten."""
    rows, labels, sizes, tags = [], [], [], [0, 0]
    for page in pages:
        ends, inside = np.cumsum([len(p) for p, _ in page]), [a for _, a in page]
        whole, at = "".join(p for p, _ in page), 0
        for kind, value, around in scan(whole):
            if kind != "text" or not value.strip():
                continue
            at = whole.index(value, at)
            label = inside[int(np.searchsorted(ends, at, side="right"))]
            rows.append(around.features)
            labels.append(label)
            sizes.append(min(10, len(value.split())))
    names = sorted(set().union(*rows))
    index = {n: k for k, n in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for k, row in enumerate(rows):
        x[k, [index[f] for f in row]] = 1
    y, size = np.array(labels, float), np.array(sizes, float)
    w = np.zeros(len(names) + 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * size) / size.sum() + decay * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * mean / (np.sqrt(square) + 1e-8)
    # A tag costs a tenth of what a plain article word earns.
    return Weights(float(w[-1]), {n: float(w[k]) for n, k in index.items()}, -0.1 * float(np.median((x @ w)[y == 1])))


@lru_cache(maxsize=1)
def weights() -> Weights:
    return learn(labelled_pages())


def blocks(page: str, using: Weights) -> list[str]:
    """Blocks of the main text in page order."""
    texts: list[tuple[int, str, float]] = []  # block number, text, score of its words
    scores: list[float] = []
    owner: list[int] = []
    block = 0
    for kind, value, around in scan(page, using):
        if kind == "border":
            block += 1
        elif kind == "tag":
            scores.append(using.tag)
            owner.append(-1)
        else:
            each = using.word(around.features)
            # A box in the article, however long, costs its tags and does not cut the article.
            scores.append(max(each, 0.0) * len(value.split()) if around.article else each * len(value.split()))
            owner.append(len(texts))
            texts.append((block, value, each))
    # Linear scan for the region of the highest total.
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, best_at = total, (start, k + 1)
    found: dict[int, list[str]] = {}
    for k in range(*best_at):
        if owner[k] >= 0:
            number, text, each = texts[owner[k]]
            if each > 0 or not text.strip():
                found.setdefault(number, []).append(text)
    made = (" ".join(references.unescape("".join(parts)).split()) for parts in found.values())
    return [b for b in made if b]


def extracted(df: DataFrame, html_col: str = "html", using: Weights | None = None, out: str = "main") -> DataFrame:
    """All rows and columns, and a struct (text, n_chars) of the main text, its blocks joined by an empty line."""
    learnt = using or weights()
    shared = df.sparkSession.sparkContext.broadcast(Weights(learnt.bias, learnt.values, learnt.tag))  # some hundred numbers

    def run(pages: list[bytes | None]) -> dict:
        texts = ["\n\n".join(blocks(p.decode("utf-8"), shared.value)) if p else "" for p in pages]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return df.withColumn(free_name(df, out), per_row(run, "text string,n_chars long")(F.col(html_col).cast("string")))
