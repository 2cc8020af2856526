"""String comparison in plain Python, called on batches only."""

from __future__ import annotations

import re
from functools import lru_cache

_HEARD_I, _HEARD_K, _TWICE = re.compile("ee|ea|ie|y"), re.compile("ck|c(?![h])|q"), re.compile(r"([a-z])\1+")


@lru_cache(maxsize=30_000)
def sounds(word: str) -> str:
    """Spelling reduced to what is heard: ph = f, oo = u, ee = i, doubled letters once, and so on."""
    w = word.lower().replace("ph", "f").replace("oo", "u").replace("ou", "u")
    if "y" in w or "e" in w:
        w = _HEARD_I.sub("i", w)
    w = w.replace("w", "v")
    if "c" in w or "q" in w:
        w = _HEARD_K.sub("k", w)
    w = w.replace("sh", "s").replace("x", "ks").replace("z", "s").replace("th", "t").replace("ae", "e")
    return _TWICE.sub(r"\1", w)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the bits of one integer as the row of the table."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; two empty texts are equal."""
    if not a and not b:
        return 1.0
    return 2.0 * lcs_length(a, b) / (len(a) + len(b))


def within(a: str, b: str, k: int) -> bool:
    """Whether insertions, deletions, replacements and swaps of neighbours, at most k, make a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    i = 0
    n = min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b) <= k
    if k == 0:
        return False
    before, row = None, list(range(len(b) + 1))
    for x, c in enumerate(a, 1):
        new = [x]
        for y, d in enumerate(b, 1):
            cost = min(row[y] + 1, new[y - 1] + 1, row[y - 1] + (c != d))
            if before is not None and y > 1 and c == b[y - 2] and a[x - 2] == d:
                cost = min(cost, before[y - 2] + 1)
            new.append(cost)
        if min(new) > k:
            return False
        before, row = row, new
    return row[-1] <= k


def _one_less(w: str) -> list[str]:
    return [w[:i] + w[i + 1 :] for i in range(len(w))]


def _two_less(w: str) -> list[str]:
    n = len(w)
    return [w[:i] + w[i + 1 : j] + w[j + 1 :] for i in range(n) for j in range(i + 1, n)]


class NearLookup:
    """Words of a small vocabulary within one or two errors of a token, found by shared deletions."""

    def __init__(self, words, reach):
        self.reach, self.index = reach, {}
        for w in words:
            for d in {w, *_one_less(w), *(_two_less(w) if reach(w) > 1 else ())}:
                self.index.setdefault(d, []).append(w)
        self.deep = any(reach(w) > 1 for w in words)
        self.lengths = {len(w) + k for w in words for k in range(-reach(w), reach(w) + 1)}

    def find(self, token: str) -> str:
        """The nearest word, '' if none; of equally near ones the first in the alphabet."""
        n = len(token)
        if n not in self.lengths:
            return ""
        index = self.index
        hits = [d for d in (token, *_one_less(token)) if d in index]
        if self.deep and n >= 7:
            hits += [d for d in _two_less(token) if d in index]
        if not hits:
            return ""
        words = {w for d in hits for w in index[d]}
        for k in (0, 1, 2):
            near = sorted(w for w in words if k <= self.reach(w) and within(token, w, k))
            if near:
                return near[0]
        return ""
