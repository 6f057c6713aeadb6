"""Passages of evaluation texts inside documents: pigeonhole pieces, then Myers' bit-parallel distance.

A passage is a window of ``window`` words of an item. With at most ``errors`` edits in it, one of its errors + 1 equal
pieces occurs unchanged; so every run of window // (errors + 1) words of an item is a piece, all of a document's runs
of that length are looked up among the pieces, and the windows around a hit are verified by their distance. The items
are the fixed query set: their pieces are hashed once, broadcast in blocks of bounded size, and each block goes over
all documents. Words are numbers there, and the runs of a batch of documents are hashed all at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.functions.chars import plain

_WORD = re.compile(r"[^\W_]+")


def read_words(text: str | None) -> list[str]:
    """The words as a reader sees them: runs of letters and digits of the plain text in lower case."""
    return _WORD.findall(plain(text).lower())


def myers(pattern: str, text: str, limit: int) -> int:
    """Edits of the best occurrence of ``pattern`` anywhere in ``text``, or limit + 1 if there are more."""
    m = len(pattern)
    if not m:
        return 0
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, m
    for c in text:
        x = eq.get(c, 0)
        d = ((((x & up) + up) ^ up) | x | down) & mask
        plus, minus = (down | ~(d | up)) & mask, up & d
        score += (plus & high > 0) - (minus & high > 0)
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = (minus | ~(d | plus)) & mask, plus & d
        best = min(best, score)
    return min(best, limit + 1)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the runs of ``size`` known words, their hashes); 0 is an unknown word."""
    if len(codes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = np.concatenate(([0], np.cumsum(codes > 0)))
    at = np.flatnonzero(known[size:] - known[:-size] == size)
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = h * _STEP + codes[at + j].astype(np.uint64)
    return at, h


class Pieces:
    """The pieces of a block of items: words as numbers, and by length of piece the sorted hashes with item and position."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, errors: int):
        self.items, self.errors = items, errors
        self.codes: dict[str, int] = {}
        self.spans: list[tuple[int, int]] = []
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, words) in enumerate(items):
            own = min(window, len(words))
            size = max(1, own // (errors + 1))
            self.spans.append((own, size))
            coded = np.fromiter((self.codes.setdefault(w, len(self.codes) + 1) for w in words), np.int64, len(words))
            at, h = _hashes(coded, size)
            by_size.setdefault(size, []).append((h, np.full(len(at), k), at))
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in by_size.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.by_size[size] = h[order], item[order], at[order]

    def hits(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in ``codes``, item, position in the item) of every piece; equal hashes, whose words are compared later."""
        for size, (known, item, where) in self.by_size.items():
            at, h = _hashes(codes, size)
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            for i in np.flatnonzero(high > low).tolist():
                for j in range(low[i], high[i]):
                    yield int(at[i]), int(item[j]), int(where[j])

    def verified(self, words: list[str], k: int, hits: list[tuple[int, int]]) -> tuple[int, int]:
        """(fewest edits of a window around a hit, longest run of equal words); more than the allowed edits are errors + 1.

        Windows and texts are compared with a space at either end, so that a window of no edits is a run of whole words.
        """
        item, errors, (window, size) = self.items[k][1], self.errors, self.spans[k]
        best, run = errors + 1, 0
        windows: dict[tuple[int, int], int] = {}
        covered: dict[int, int] = {}
        for at, start in sorted(hits):
            if words[at : at + size] != item[start : start + size]:
                continue
            for piece in range(errors + 1):
                w, first = start - piece * size, at - piece * size
                if 0 <= w <= len(item) - window and (w, first) not in windows:
                    near = set(words[max(0, first - errors) : max(0, first + window + errors)])
                    windows[w, first] = sum(map(near.__contains__, item[w : w + window]))
            if covered.get(at - start, -1) >= at:
                continue
            a, b = at, start
            while a and b and words[a - 1] == item[b - 1]:
                a, b = a - 1, b - 1
            n = 0
            while a + n < len(words) and b + n < len(item) and words[a + n] == item[b + n]:
                n += 1
            covered[at - start] = a + n - 1
            run = max(run, n)
        # an edit changes two words at most, so of windows with fewer equal words no distance is needed; the likeliest come first
        for (w, first), equal in sorted(windows.items(), key=lambda x: -x[1]):
            if not best or equal < window - 2 * errors:
                break
            near, wanted = words[max(0, first - errors) : max(0, first + window + errors)], item[w : w + window]
            here, there = Counter(near), Counter(wanted)
            # nor where more letters of the window are missing than edits are allowed
            if (Counter("".join((there - here).elements())) - Counter("".join((here - there).elements()))).total() <= errors:
                best = min(best, myers(f" {' '.join(wanted)} ", f" {' '.join(near)} ", errors))
        return best, run


def leaks(docs: DataFrame, items: DataFrame, window: int = 10, errors: int = 1, block_words: int = 500_000) -> DataFrame:
    """``doc_id, eval_id, edits, window, run_words``: documents (doc_id, text) that hold a window of an item (eval_id, text) with at most ``errors`` edits.

    ``edits`` is the fewest edits of a window found: 0 means that the document holds the ``window`` words of the item as they
    are; ``run_words`` is the longest run of equal consecutive words. An item of fewer words than asked for is one window of
    its own. A block of items holds ``block_words`` words and one item more at most. Defined cases: null and empty texts
    match nothing; an item that occurs twice gives a row for each eval_id; repeated rows of a document give one row.
    """
    out = None
    block: list[tuple[int, list[str]]] = []
    n = 0
    schema = "doc_id long, eval_id long, edits int, window int, run_words int"

    def over(part: list[tuple[int, list[str]]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Pieces(part, window, errors))
        return docs.select("doc_id", "text").where("text <> ''").mapInPandas(lambda batches: _search(shared.value, batches), schema)

    for row in items.select("eval_id", "text").where("text <> ''").distinct().toLocalIterator():
        words = read_words(row["text"])
        if not words:
            continue
        block.append((row["eval_id"], words))
        n += len(words)
        if n >= block_words:
            out = over(block) if out is None else out.unionByName(over(block))
            block, n = [], 0
    if block or out is None:
        out = over(block) if out is None else out.unionByName(over(block))
    return out.groupBy("doc_id", "eval_id").agg(F.min("edits").alias("edits"), F.max("window").alias("window"), F.max("run_words").alias("run_words"))


def _search(pieces: Pieces, batches: Iterator[pd.DataFrame], slice_: int = 256) -> Iterator[pd.DataFrame]:
    """Hits and their verification; ``slice_`` documents are hashed at once."""
    for pdf in batches:
        rows = []
        for lo in range(0, len(pdf), slice_):
            ids, texts = pdf["doc_id"].iloc[lo : lo + slice_].tolist(), [read_words(t) for t in pdf["text"].iloc[lo : lo + slice_]]
            # an unknown word behind each document, so that no run crosses two
            starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
            codes = np.zeros(starts[-1], np.int64)
            for a, t in zip(starts.tolist(), texts, strict=False):
                codes[a : a + len(t)] = list(map(pieces.codes.get, t, repeat(0)))
            found: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for at, k, p in pieces.hits(codes):
                d = int(np.searchsorted(starts, at, "right")) - 1
                found.setdefault((d, k), []).append((at - int(starts[d]), p))
            for (d, k), hits in found.items():
                edits, run = pieces.verified(texts[d], k, hits)
                if edits <= pieces.errors:
                    rows.append((ids[d], pieces.items[k][0], edits, pieces.spans[k][0], run))
        yield pd.DataFrame(rows, columns=["doc_id", "eval_id", "edits", "window", "run_words"])
