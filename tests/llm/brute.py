"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def contaminated(docs, items, window=10):
    """``docs`` and ``items`` as (id, text); rows (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = defaultdict(set)
    lengths = set()
    for item, text in items:
        words = ASCII_WORD.findall((text or "").translate(LOWER))
        if words:
            m = min(window, len(words))
            lengths.add(m)
            for at in range(len(words) - m + 1):
                windows[tuple(words[at : at + m])].add(item)
    rows = []
    for doc, text in docs:
        words = ASCII_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for m in lengths:
            for at in range(len(words) - m + 1):
                known = windows.get(tuple(words[at : at + m]))
                if known:
                    hit.update(range(at, at + m))
                    found |= known
        named = sorted(str(x) for x in found if x is not None)
        rows.append((doc, len(words), len(hit), len(named), sha(",".join(named)), bool(hit)))
    return rows


def sizes(docs):
    """(id, size, crc) of each (id, text)."""
    return [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs]


def features(text):
    words = SPACE_WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_bullets": sum(x.strip(" \t\n\x0b\x0c\r")[0] in "-*•·▪" for x in lines),
        "n_ellipses": sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines),
        "n_no_letter": sum(all(" " < c <= "~" and not c.isalpha() for c in w) for w in words),
        "n_top_word": max(Counter(words).values(), default=0),
    }


def kept(text) -> bool:
    f = features(text)
    return not (
        f["n_words"] < 50
        or 100 * f["n_repeat_words"] > 50 * f["n_words"]
        or 100 * f["n_symbols"] > 25 * f["n_words"]
        or 100 * f["n_dup_lines"] > 50 * f["n_lines"]
        or not 2 * f["n_words"] <= f["word_chars"] <= 20 * f["n_words"]
        or 100 * f["n_bullets"] > 90 * f["n_lines"]
        or 100 * f["n_ellipses"] > 30 * f["n_lines"]
        or 100 * f["n_no_letter"] > 50 * f["n_words"]
        or 100 * f["n_top_word"] > 30 * f["n_words"]
    )


def targets(sizes_by_source: dict, weights=(3, 1, 2), share=1.5, most=2) -> dict:
    """Deals the share by weight; what passes a cap is dealt anew until none does."""
    order = sorted(sizes_by_source, key=lambda s: (s is None, s if s is None else s.encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, fixed = share * sum(sizes_by_source.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        dealt = {s: left * weight[s] / total for s in free}
        over = [s for s in free if dealt[s] > most * sizes_by_source[s]]
        if not over:
            return fixed | dealt
        for s in over:
            fixed[s] = most * sizes_by_source[s]
            left -= fixed[s]


def fingerprint(text, shingle=4) -> int:
    words = SPACE_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints: list[int], distance=4) -> list[int]:
    """A class per position: the first position that is reachable."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(x) for x in range(len(prints))]


def smallest_ids(ids, classes):
    least = {}
    for i, c in zip(ids, classes):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) for c in classes]


def greedy_pieces(word: str, pieces: set[str]) -> int | None:
    """Longest match first, by trying every length."""
    count, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return None
        count, at = count + 1, end
    return count
