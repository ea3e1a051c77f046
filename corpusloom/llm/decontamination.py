"""Benchmark decontamination by suffix arrays of the training text.

Documents are indexed in shards of bounded size, inside the tasks that read
them. A shard keeps the runs of words that the benchmark knows and that are long
enough for a match, and sorts all their suffixes by prefix doubling. Every
benchmark suffix is binary-searched in the shard's suffix array: its place there
gives its longest verbatim match, and if that is long enough, the suffixes that
share its first words give all places. Suffixes that begin with the same window
have the same places, so these are looked up once per different window, however
many items share it; a document's items are those of its windows, as a set.
Documents with matches are removed.

On request, matches that go on along a document and an item are joined to
maximal ones. Their number is that of places times the items that share them.

Suffixes are compared by ranks of their first 1, 2, 4, ... words, so a comparison
takes as many steps as its length has binary digits.

No text is shuffled. The benchmark is a query set: it is read in blocks of
bounded size, each sent to all tasks, with a pass over the documents per block.

An item matches where ``window`` of its words in a row occur; an item of fewer
words, but not none, where all of them do.

Defined results: words are runs of ASCII letters and digits (lower-cased) and of
all characters past ASCII. A null, empty or wordless text has no words and no
match; so has a null item. A null item id marks words but isn't listed. Repeated
items count once per id, repeated documents each for themselves. Empty tables
give no matches. Columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ship_package

WINDOW = 10
# Words of a benchmark block and of a shard of documents (a longer document is a shard of its own).
BLOCK_WORDS = 1 << 20
SHARD_WORDS = 1 << 20
SPAN = "struct<doc_start:bigint,n:bigint>"
MATCH = "struct<item:string,doc_start:bigint,item_start:bigint,n:bigint>"

# Bytes of words stay, A-Z lower-cased; other ASCII ends a word.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


@dataclass
class Group:
    """Items of one window length: their words' ids, and the suffixes that begin with a whole window."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    words: list[int] | np.ndarray = field(default_factory=list)
    items: list[str | None] = field(default_factory=list)
    # Of each suffix: item, start in the item, start in ``words``, words left.
    suffixes: list[tuple[int, int, int, int]] | np.ndarray = field(default_factory=list)
    # Suffixes by their first window: those of window k stand from ``bounds[k]`` to ``bounds[k + 1]``.
    by_window: np.ndarray | None = None
    bounds: np.ndarray | None = None

    def add(self, item: str | None, found: list[bytes]) -> None:
        base, n = len(self.words), len(found)
        self.words += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found]
        self.suffixes += [(len(self.items), at, base + at, n - at) for at in range(n - self.window + 1)]
        self.items.append(item)

    def packed(self) -> Group:
        """With arrays for lists, to be sent to the tasks."""
        words, suffixes = np.array(self.words, np.int64), np.array(self.suffixes, np.int64).reshape(-1, 4)
        levels = ranks(words, self.window)
        first = suffixes[:, 2]
        # Two stretches of the same length cover a window.
        rest = self.window - (1 << (len(levels) - 1))
        windows = _numbered(levels[-1][first], levels[-1][first + rest])
        by_window = np.argsort(windows, kind="stable")
        bounds = np.searchsorted(windows[by_window], np.arange(windows.max() + 2))
        return Group(self.window, self.vocabulary, words, self.items, suffixes, by_window, bounds)

    def of_windows(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with each of these windows, and their number by window."""
        count = self.bounds[windows + 1] - self.bounds[windows]
        return self.by_window[_ranges(self.bounds[windows], count)], count


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` numbers from each ``start`` on, one after another."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers from 0 for equal pairs of ``a`` and ``b``, in the pairs' order."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def ranks(text: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each power of two up to ``depth``: ranks of the stretches of so many words that begin at each place.

    Past its end the text goes on with zeros.
    """
    levels = [text]
    while 2 << (len(levels) - 1) <= depth:
        last, step = levels[-1], 1 << (len(levels) - 1)
        following = np.full(len(last), last[-1] if len(last) and not text[-1] else 0, last.dtype)
        following[: max(len(last) - step, 0)] = last[step:]
        levels.append(_numbered(last, following).astype(np.int32))
    return levels


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[Group]]:
    """The benchmark in blocks of at most ``block_words`` words (or one item), each as groups by window length."""
    groups: dict[int, Group] = {}
    held = 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        found = split_words(row[1])
        if not found:
            continue
        if held and held + len(found) > block_words:
            yield [group.packed() for group in groups.values()]
            groups, held = {}, 0
        length = min(window, len(found))
        groups.setdefault(length, Group(length)).add(row[0], found)
        held += len(found)
    if groups:
        yield [group.packed() for group in groups.values()]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of ``text`` (ids >= 0) by their first ``depth`` words, by prefix doubling."""
    n = len(text)
    bits = max(int(text.max()).bit_length(), 1)
    packed = min(63 // bits, depth)
    padded = np.concatenate((text.astype(np.int64), np.zeros(packed, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_by = packed
    while True:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if sorted_by >= depth or rank[order[-1]] == n - 1:
            return order
        following = np.zeros(n, np.int64)
        following[: max(n - sorted_by, 0)] = rank[sorted_by:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        sorted_by *= 2


class Index:
    """A shard's suffix array over the runs of known words that can hold a window."""

    def __init__(self, ids: np.ndarray, window: int, depth: int) -> None:
        known = np.concatenate(([False], ids > 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= window
        starts, lengths = starts[long], (ends - starts)[long] + 1
        # One place past each run is its end mark; ids[end] is 0 or past the last word.
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = np.repeat(starts, lengths) + place
        text = np.concatenate((ids, [0]))[self.place] if len(self.place) else np.zeros(0, ids.dtype)
        self.order = suffix_array(text, depth) if len(text) else np.zeros(0, np.int64)
        self.text = np.concatenate((text, [0]))

    def common(self, at: np.ndarray, words: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Number of leading words, at most ``limit``, that suffix ``at`` shares with the query at ``start``."""
        shared = np.zeros(len(at), np.int64)
        live = np.flatnonzero(limit > 0)
        while len(live):
            k = shared[live]
            live = live[self.text[at[live] + k] == words[start[live] + k]]
            shared[live] += 1
            live = live[shared[live] < limit[live]]
        return shared

    def search(self, words: np.ndarray, start: np.ndarray, limit: np.ndarray, after: bool, common=None) -> np.ndarray:
        """First place in the order whose suffix is not below the query's first ``limit`` words, or is above them."""
        common = common or self.common
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            at = self.order[middle]
            shared = common(at, words, start[live], limit[live])
            whole = shared == limit[live]
            k = np.where(whole, 0, shared)
            below = np.where(whole, after, self.text[at + k] < words[start[live] + k])
            low[live] = np.where(below, middle + 1, low[live])
            high[live] = np.where(below, high[live], middle)
            live = live[low[live] < high[live]]
        return low

    def occurrences(self, group: Group) -> tuple[np.ndarray, np.ndarray]:
        """All places (in ``text``) where a window of the group begins, in order, and the number of that window."""
        start = group.suffixes[group.by_window[group.bounds[:-1]], 2]
        # A window whose first word isn't in the shard doesn't occur.
        there = np.zeros(len(group.vocabulary) + 1, bool)
        there[self.text] = True
        window = np.flatnonzero(there[group.words[start]])
        start, limit = start[window], np.full(len(window), group.window, np.int64)
        low = self.search(group.words, start, limit, False)
        count = self.search(group.words, start, limit, True) - low
        at, window = self.order[_ranges(low, count)], np.repeat(window, count)
        order = np.argsort(at)
        return at[order], window[order]

    def longest(self, group: Group, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        """The longest verbatim match of each item that has one of these windows: place in ``text``, item, start in the item, number of words."""
        item, offset, start, left = group.suffixes[group.of_windows(windows)[0]].T
        items, one = np.unique(item, return_index=True)
        base, length = start[one] - offset[one], offset[one] + left[one]
        words = group.words[_ranges(base, length)]
        start = (np.cumsum(length) - length)[np.searchsorted(items, item)] + offset
        common = _by_ranks(ranks(np.concatenate((words, self.text)), int(left.max(initial=1))), len(words))
        best, place = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        found = self.search(words, start, left, False, common)
        for neighbour in (found - 1, found):
            inside = np.flatnonzero((neighbour >= 0) & (neighbour < len(self.order)))
            at = self.order[neighbour[inside]]
            shared = common(at, words, start[inside], left[inside])
            better = shared > best[inside]
            best[inside[better]], place[inside[better]] = shared[better], at[better]
        # Of each item: the longest, of these the first in the item.
        order = np.lexsort((offset, -best, item))
        order = order[np.concatenate(([True], item[order][1:] != item[order][:-1]))[: len(order)]]
        return place[order], item[order], offset[order], best[order]

    def matches(self, group: Group, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, ...]:
        """Maximal matches: place of the first word, item, start in the item, number of words."""
        suffix, count = group.of_windows(window)
        item, offset, start, _ = group.suffixes[suffix].T
        at = np.repeat(at, count)
        order = np.lexsort((at, at - start))
        at, item, offset, start = at[order], item[order], offset[order], start[order]
        goes_on = np.concatenate(
            ([False], (at[1:] == at[:-1] + 1) & (start[1:] == start[:-1] + 1) & (item[1:] == item[:-1]))
        )[: len(at)]
        first = np.flatnonzero(~goes_on)
        length = np.diff(np.concatenate((first, [len(at)]))) + group.window - 1
        return at[first], item[first], offset[first], length


def _by_ranks(levels: list[np.ndarray], text_at: int) -> Callable[..., np.ndarray]:
    """Like ``Index.common``, from the ranks of the queries' words and the text after them."""
    top = len(levels) - 1

    def common(at: np.ndarray, words: np.ndarray, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
        shared = np.zeros(len(at), np.int64)
        for k in range(top, -1, -1):
            live = np.flatnonzero(shared + (1 << k) <= limit)
            while len(live):
                a, b = start[live] + shared[live], text_at + at[live] + shared[live]
                live = live[levels[k][a] == levels[k][b]]
                shared[live] += 1 << k
                # Stretches of the greatest length may follow each other.
                live = live[shared[live] + (1 << k) <= limit[live]] if k == top else live[:0]
        return shared

    return common


@dataclass
class Found:
    """What a text has of the benchmark."""

    items: set[str] = field(default_factory=set)
    spans: list[dict] = field(default_factory=list)
    longest: list[dict] = field(default_factory=list)
    matches: list[dict] = field(default_factory=list)


def _find(texts: list[str | None], groups: list[Group], shard_words: int, every: bool) -> tuple[list[int], list[Found]]:
    """Number of words of every text, and what is found in it; all maximal matches if ``every``."""
    counts: list[int] = []
    results = [Found() for _ in texts]
    shard: list[tuple[int, list[np.ndarray]]] = []
    held = 0

    def finish() -> None:
        for k, group in enumerate(groups):
            # A 0 after each document keeps runs within it.
            ids = np.concatenate([np.concatenate((found[k], [0])) for _, found in shard])
            bounds = np.cumsum([0, *(len(found[k]) + 1 for _, found in shard)])
            index = Index(ids, group.window, int(group.suffixes[:, 3].max()))
            at, window = index.occurrences(group)
            if len(at):
                report(group, index, bounds, at, window)
        shard.clear()

    def report(group: Group, index: Index, bounds: np.ndarray, at: np.ndarray, window: np.ndarray) -> None:
        place = index.place[at]
        document = np.searchsorted(bounds, place, side="right") - 1
        first = np.flatnonzero(np.concatenate(([True], (np.diff(place) > group.window) | (np.diff(document) > 0))))
        last = np.concatenate((first[1:], [len(place)])) - 1
        for d, a, b in zip(document[first].tolist(), place[first].tolist(), place[last].tolist()):
            results[shard[d][0]].spans.append({"doc_start": a - int(bounds[d]), "n": b - a + group.window})
        number = len(group.bounds)
        d, w = np.divmod(np.unique(document * number + window), number)
        suffix, count = group.of_windows(w)
        d, i = np.divmod(np.unique(np.repeat(d, count) * len(group.items) + group.suffixes[suffix, 0]), len(group.items))
        for d, i in zip(d.tolist(), i.tolist()):
            if group.items[i] is not None:
                results[shard[d][0]].items.add(group.items[i])
        put(group, index, bounds, index.longest(group, np.unique(window)), "longest")
        if every:
            put(group, index, bounds, index.matches(group, at, window), "matches")

    def put(group: Group, index: Index, bounds: np.ndarray, found: tuple[np.ndarray, ...], name: str) -> None:
        at, item, offset, length = found
        place = index.place[at]
        document = np.searchsorted(bounds, place, side="right") - 1
        for d, p, i, o, n in zip(document.tolist(), (place - bounds[document]).tolist(), item.tolist(), offset.tolist(), length.tolist()):
            getattr(results[shard[d][0]], name).append({"item": group.items[i], "doc_start": p, "item_start": o, "n": n})

    for at, text in enumerate(texts):
        found = split_words(text)
        counts.append(len(found))
        if found:
            ids = [np.fromiter(map(g.vocabulary.get, found, repeat(0)), np.int64, len(found)) for g in groups]
            shard.append((at, ids))
            held += len(found)
        if held >= shard_words:
            finish()
            held = 0
    if shard:
        finish()
    return counts, results


def _pass(groups, text_at: int, seen: bool, shard_words: int, every: bool):
    """Adds ``n_words``, ``items``, ``spans``, ``longest`` and ``matches``, or adds to those of an earlier pass."""
    span = [("doc_start", pa.int64()), ("n", pa.int64())]
    match = pa.list_(pa.struct([("item", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n", pa.int64())]))
    kinds = {"items": pa.list_(pa.string()), "spans": pa.list_(pa.struct(span)), "longest": match, "matches": match}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, results = _find(batch.column(text_at).to_pylist(), groups.value, shard_words, every)
            columns, names = batch.columns, batch.schema.names
            if seen:
                for result, *earlier in zip(results, *[c.to_pylist() for c in columns[-4:]]):
                    result.items.update(earlier[0])
                    result.spans[:0], result.longest[:0], result.matches[:0] = earlier[1:]
                columns, names = columns[:-5], names[:-5]
            made = [pa.array([list(getattr(r, name)) for r in results], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), *made], [*names, "n_words", *kinds])

    return run


def _searched(docs: DataFrame, text_at: int, found: Iterator[list[Group]], shard_words: int, every: bool) -> DataFrame:
    """``docs`` with what ``_pass`` adds, after a pass for each block."""
    spark = docs.sparkSession
    ship_package(spark)
    added = f"n_words bigint, items array<string>, spans array<{SPAN}>, longest array<{MATCH}>, matches array<{MATCH}>"
    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes) + f", {added}"
    seen = False
    for groups in found:
        sent = spark.sparkContext.broadcast(groups)
        docs = docs.mapInArrow(_pass(sent, text_at, seen, shard_words, every), schema)
        seen = True
    if not seen:
        docs = docs.mapInArrow(_pass(spark.sparkContext.broadcast([]), text_at, False, shard_words, every), schema)
    return docs


def words_hit(spans: Column) -> Column:
    """Number of words in the spans, each counted once."""
    spans = F.sort_array(F.transform(spans, lambda x: F.struct(x["doc_start"].alias("a"), (x["doc_start"] + x["n"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        zero,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["b"]).alias("end"),
            (acc["n"] + F.greatest(x["b"] - F.greatest(acc["end"], x["a"]), F.lit(0).cast("long"))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    matches: bool = False,
) -> DataFrame:
    """``(id, n_words, n_hit, items, spans, longest)`` of every document, and all maximal ``matches`` if asked for.

    ``items`` are sorted id strings. ``spans`` are the places that windows cover.
    ``longest`` holds the longest verbatim match of each item in a shard, at a
    document that has it. Starts count words from 0.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = blocks(benchmark, item_col, item_text_col, window, block_words)
    searched = _searched(rows, 1, found, shard_words, matches)
    items = F.sort_array("items").alias("items")
    columns = ["id", "n_words", words_hit(F.col("spans")).alias("n_hit"), items, "spans", "longest"]
    return searched.select(*columns, *(["matches"] if matches else []))


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The documents without a match, with their columns as they are."""
    names = docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    found = blocks(benchmark, item_col, item_text_col, window, block_words)
    searched = _searched(rows, names.index(text_col), found, shard_words, False)
    return searched.where(F.size("spans") == 0).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
