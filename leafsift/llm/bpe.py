"""Byte-level BPE over a public vocabulary: a contiguous rank array per short word.

A word's part boundaries and the ranks of adjacent parts lie in two flat arrays. The merge loop
scans for the smallest rank, deletes that boundary, and refreshes the two neighbouring ranks. The
scan is quadratic in the word's length, so words over ``LONG`` bytes take a heap over a linked
list, which gives the same parts in n log n.
"""

from __future__ import annotations

import base64
import heapq

LONG = 200
CACHE_WORDS = 400_000
NONE = 1 << 60


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    out = {}
    for line in raw.splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    bounds = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while rank:
        best = min(rank)
        if best == NONE:
            break
        i = rank.index(best)
        del bounds[i + 1]
        del rank[i]
        if i < len(rank):
            rank[i] = get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            rank[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = right[i]
        if j < n:
            r = ranks.get(word[i : right[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, right[j]))

    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or right[right[i]] != end:
            continue
        j = right[i]
        alive[j] = False
        right[i] = end
        if end < n:
            left[end] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : right[i]]])
        i = right[i]
    return out


class ByteBPE:
    """Encodes texts; ``pattern`` cuts a text into words, inside which parts are merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.words = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        raw = w.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        else:
            ids = merge_short(raw, self.ranks) if len(raw) <= LONG else merge_long(raw, self.ranks)
        if len(raw) <= LONG:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[w] = ids
        return ids

    def encode_into(self, text: str, out: list[int]) -> None:
        get, word = self.cache.get, self.word
        for w in self.words(text):
            ids = get(w)
            out.extend(ids if ids is not None else word(w))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            self.encode_into(text, out)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        get, word, n = self.cache.get, self.word, 0
        for w in self.words(text):
            ids = get(w)
            n += len(ids if ids is not None else word(w))
        return n
