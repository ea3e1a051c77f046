"""Runs: stretches of words that repeat with a period, found with suffix trees.

A run is a longest stretch in which words ``period`` apart are equal, with the
smallest such period, of at least ``POWER`` periods and ``LEAST`` words. Every run
holds, one period long, the longest Lyndon word that starts at some place in one
of two orders of the words, one the reverse of the other. So a text's longest
Lyndon words in both orders, two per place, are all candidates there are. Each is
extended as far as it repeats: to the right by the longest common extension of
its place and the place one period on, to the left by that of the reversed text.

Common extensions are answered in constant time: Ukkonen's algorithm builds the
suffix tree of the text and that of its reversal, a tour of the tree numbers its
nodes, and the depth of two leaves' lowest common ancestor is a minimum over a
range of the tour, taken from a table of minima over powers of two. The order of
the leaves in the tour is the order of the suffixes, which gives the Lyndon words
as well.

Before that a text is cut where no run can pass: within a stretch of m words a
period is at most m / POWER, so each word of a run must recur within that
distance. Words that don't are borders, and cuts are repeated in what they leave.
Only stretches that stay go into a tree; a text without repetition has none.

Defined results: null, empty and blank texts have no runs and collapse to the
empty text. Repeated rows have the same result each. Null ids are carried along.
An empty table gives an empty result. Only the columns asked for are read, so
others may have any name. Texts are taken whole, whatever their length; a task
holds the trees of one stretch of words at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship_package

# A run has so many words, and so many periods, at least.
LEAST = 6
POWER = 4
# Rounds of cutting; stretches that are left go into trees.
_CUTS = 12
_OUT = (
    "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint,"
    " runs_sha256 string, collapsed_sha256 string, collapsed string"
)


class SuffixTree:
    """Suffix tree of a sequence of numbers from 0, with constant-time longest common extensions of its suffixes.

    A unique end mark closes the text, below all symbols, so every suffix is a leaf.
    """

    def __init__(self, symbols: list[int]):
        self.n = len(symbols) + 1
        self._build([*symbols, -1])
        self._tour()

    def _build(self, text: list[int]) -> None:
        """Ukkonen: all suffixes grow by one symbol a step; ``edges`` leads from (node, first symbol) to the node below."""
        n = len(text)
        begin, end, link, edges = [0], [0], [0], [{}]
        node, edge, length, left = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            left += 1
            pending = -1
            while left:
                if not length:
                    edge = i
                below = edges[node].get(text[edge])
                if below is None:
                    edges[node][text[edge]] = len(begin)
                    begin.append(i), end.append(n), link.append(0), edges.append({})
                    if pending >= 0:
                        link[pending] = node
                    pending = -1
                else:
                    span = min(end[below], i + 1) - begin[below]
                    if length >= span:
                        # The place lies further down.
                        edge, length, node = edge + span, length - span, below
                        continue
                    if text[begin[below] + length] == symbol:
                        length += 1
                        if pending >= 0:
                            link[pending] = node
                        break
                    fork, leaf = len(begin), len(begin) + 1
                    edges[node][text[edge]] = fork
                    cut = begin[below] + length
                    begin.append(begin[below]), end.append(cut), link.append(0)
                    edges.append({text[cut]: below, symbol: leaf})
                    begin.append(i), end.append(n), link.append(0), edges.append({})
                    begin[below] = cut
                    if pending >= 0:
                        link[pending] = fork
                    pending = fork
                left -= 1
                if node == 0:
                    if length:
                        length -= 1
                        edge = i - left + 1
                else:
                    node = link[node]
        self._begin, self._end, self._edges = begin, end, edges

    def _leaves(self, turned: bool) -> tuple[list[int], list[int]]:
        """Suffixes in the order of a tour, and the depth at which the tour turned before each.

        Between two leaves lies their lowest common ancestor, at the least of the
        depths at which the tour turned between them. ``turned`` reverses the order
        of the symbols, but for the end mark, which stays the smallest.
        """
        begin, end, edges = self._begin, self._end, self._edges
        suffixes, turns, turn = [], [], 0
        # Children are pushed last first, so that they come off in order.
        stack = [(0, 0, 0)]
        while stack:
            node, above, depth = stack.pop()
            turn = min(turn, above)
            below = edges[node]
            if not below:
                suffixes.append(self.n - depth)
                turns.append(turn)
                turn = depth
                continue
            symbols = sorted(below, reverse=not turned)
            if turned and symbols[0] < 0:
                symbols.append(symbols.pop(0))
            for child in map(below.__getitem__, symbols):
                stack.append((child, depth, depth + end[child] - begin[child]))
        return suffixes, turns

    def ranks(self, turned: bool = False) -> np.ndarray:
        """Place of each suffix among all of them."""
        found = np.empty(self.n, np.int64)
        found[self._leaves(turned)[0]] = np.arange(self.n)
        return found

    def _tour(self) -> None:
        """Numbers the leaves and tables the minima over 1, 2, 4, ... turns of the tour."""
        suffixes, turns = self._leaves(False)
        self.rank = np.empty(self.n, np.int64)
        self.rank[suffixes] = np.arange(self.n)
        minima = [np.array(turns, np.int32)]
        while 2 << (len(minima) - 1) <= self.n:
            half = 1 << (len(minima) - 1)
            minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
        self._minima = minima

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, a <> b."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            found[at] = np.minimum(self._minima[k][low[at]], self._minima[k][high[at] - (1 << int(k))])
        return found


def _lyndon(rank: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place: up to the next place with a smaller suffix."""
    n = len(rank)
    following, lengths = [], [0] * n
    for i in range(n - 1, -1, -1):
        while following and rank[following[-1]] > rank[i]:
            following.pop()
        lengths[i] = (following[-1] if following else n) - i
        following.append(i)
    return lengths


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least two periods, each once."""
    n = len(symbols)
    forward, backward = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    place, period = [], []
    for order in (forward.rank[:n], forward.ranks(turned=True)[:n]):
        place.append(np.arange(n))
        period.append(np.array(_lyndon(order.tolist()), np.int64))
    place, period = np.concatenate(place), np.concatenate(period)
    other = place + period
    inside = other < n
    right = np.zeros(len(place), np.int64)
    right[inside] = forward.extension(place[inside], other[inside])
    # The words before a place are those from n - place on of the reversal.
    left = np.zeros(len(place), np.int64)
    some = inside & (place > 0)
    left[some] = backward.extension(n - place[some], n - other[some])
    start, length = place - left, left + period + right
    whole = length >= 2 * period
    found = np.unique(np.stack((start, period, length), axis=1)[whole], axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _recurring(symbols: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) that may hold a run; ``before`` and ``after`` are the places of each word's last and next like it."""
    at = np.arange(len(symbols))
    label = np.zeros(len(symbols), np.int64)
    first, size = np.zeros(1, np.int64), np.array([len(symbols)])
    for _ in range(_CUTS):
        # Places that are left, with the stretch that each lies in.
        reach = (size // POWER)[label]
        begin = first[label]
        end = begin + size[label]
        stays = ((after[at] < end) & (after[at] - at <= reach)) | ((before[at] >= begin) & (at - before[at] <= reach))
        kept = at[stays]
        breaks = np.flatnonzero((np.diff(kept) > 1) | (np.diff(label[stays]) > 0)) + 1
        bounds = np.concatenate(([0], breaks, [len(kept)])) if len(kept) else np.zeros(1, np.int64)
        sizes = np.diff(bounds)
        long = sizes >= LEAST
        label = np.repeat(np.cumsum(long) - 1, sizes)
        keep = np.repeat(long, sizes)
        same = len(kept) == len(at) and keep.all() and long.sum() == len(size)
        at, label = kept[keep], label[keep]
        first, size = kept[bounds[:-1]][long] if len(kept) else np.zeros(0, np.int64), sizes[long]
        if same or not len(at):
            break
    return list(zip(first.tolist(), (first + size).tolist()))


def word_runs(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least LEAST words and POWER periods, by start, then period."""
    if len(symbols) < LEAST:
        return []
    order = np.argsort(symbols, kind="stable")
    same = symbols[order][1:] == symbols[order][:-1]
    n = len(symbols)
    before, after = np.full(n, -n), np.full(n, 3 * n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    found = []
    for begin, end in _recurring(symbols, before, after):
        codes = np.unique(symbols[begin:end], return_inverse=True)[1]
        start, length, period = runs_of(codes)
        long = length >= np.maximum(LEAST, POWER * period)
        found += zip((start[long] + begin).tolist(), length[long].tolist(), period[long].tolist())
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_tail(key: object, words: list[bytes]) -> list[bytes]:
    """For keys whose CRC-32 ends in 0: the words with a tail that repeats its beginning; a null key's stay."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, of each run only the first period."""
    if runs:
        step = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            step[start + period] += 1
            step[start + length] -= 1
        words = [w for w, inside in zip(words, np.cumsum(step).tolist()) if not inside]
    return b" ".join(words)


def _scan(change: Callable[[object, list[bytes]], list[bytes]] | None, with_text: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for key, text in zip(batch.column("id"), batch.column("text")):
                words = (text.as_py() or "").encode().split()
                if change is not None:
                    words = change(key.as_py(), words)
                known: dict[bytes, int] = {}
                codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                # Words that are all different have no run.
                runs = word_runs(codes) if len(known) < len(words) else []
                kept = collapsed(words, runs)
                best = None
                for run in runs:
                    # Greatest length / period, exactly; ties keep the earlier one.
                    if best is None or run[1] * best[2] > best[1] * run[2]:
                        best = run
                start, length, period = best or (None, None, None)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                row = (
                    len(words), len(runs), start, length, period, 1000 * length // period if best else None,
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
                    kept.decode() if with_text else None,
                )
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 6 + [pa.string()] * 3
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = [x.split()[0] for x in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", *names])

    return scan


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    change: Callable[[object, list[bytes]], list[bytes]] | None = None, with_text: bool = False,
) -> DataFrame:
    """Per row ``id``, its runs' number, the strongest run, digests of all runs and of the text without repeats.

    ``change`` may alter a row's words first, from its id and words. ``with_text``
    returns the text without repeats too, as ``collapsed``.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan(change, with_text), f"id {kind}, {_OUT}")
