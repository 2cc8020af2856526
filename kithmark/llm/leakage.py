"""Pages that hold passages of held-out test items, found by Wu-Manber multi-pattern search.

Pages are put into printed order and reduced to a stream of letters in which characters that machines
confuse are one, so that word breaks, lost blanks, casing, punctuation and most misreadings vanish.
Test passages are reduced alike and cut into overlapping patterns of equal length. The search jumps over
positions by the shift table of blocks, picks patterns by the hash of their last block, and confirms by
direct comparison. From each confirmed pattern the exact check reads on in both directions through misreadings and insertions
and counts the consecutive words of the passage that the page holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kithmark.llm.pages import page_lines
from kithmark.runtime import cut

#: Pattern length, distance between the starts of patterns, and block length of the search, in letters.
PATTERN, STRIDE, BLOCK = 16, 6, 6
#: How far two patterns of a stretch may be off their distance, in letters.
DRIFT = 8
#: Behind an insertion (advert, heading) of any length the passage goes on if so many letters agree: within NEAR letters, and beyond.
NEAR, GOES_ON, GOES_ON_FAR = 280, 10, 16
#: Passages searched in one pass over the corpus; more are taken in blocks.
PASSAGES_PER_PASS = 20_000
#: Slots of the shift table, one byte each; blocks that share a slot only shorten the shift.
SLOTS = 1 << 22

# Groups of characters that machines confuse; the first stands for all.
_CONFUSED = ("hb", "ec", "ao0", "tf", "nup", "rvy", "il1j!|", "s5", "gq9")
_FOLD = {ord(c): g[0] for g in _CONFUSED for c in g}
_PAIRS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("vy", "w"), ("ii", "u"))
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_NOT_LETTER = re.compile(r"[\W_]+")


# punctuation beyond ASCII goes first, so that most pages are ASCII from then on
_DROP = {ord(c): None for c in "“”„‘’‚«»‹›—–‐‑‒­·•…£§°\u00a0¬"} | {ord("ß"): "ss", ord("ſ"): "s"}
_QUOTES = "“”’¬­—•"
_MARKS = re.compile("[\u0300-\u036f]+")
_NO_ALNUM = bytes(i for i in range(128) if not chr(i).isalnum())
_FOLD_BYTES = bytes(ord(_FOLD.get(i, chr(i))) if i < 128 else i for i in range(256))


def _bare(text: str) -> str:
    t = text.lower()
    if not t.isascii():
        for c in _QUOTES:
            t = t.replace(c, "")
        if not t.isascii():
            t = t.translate(_DROP)
            if not t.isascii():
                t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
    return t


def stream(text: str) -> str:
    """Letters and digits only, confusable ones as one."""
    t = _bare(text)
    if t.isascii():  # most pages: tables of bytes are far quicker than tables of characters
        b = t.encode().translate(None, _NO_ALNUM)
        for pair, one in _PAIRS:
            b = b.replace(pair.encode(), one.encode())
        return b.translate(_FOLD_BYTES).decode()
    t = _NOT_LETTER.sub("", t)
    for pair, one in _PAIRS:
        t = t.replace(pair, one)
    return t.translate(_FOLD)


class Passage:
    """A passage as a stream of letters, and to which word each letter belongs."""

    def __init__(self, text: str):
        self.words = _WORD.findall(_bare(text))
        # pairs may span words, so the owner of a letter is found in the unfolded letters
        bare, who = "", []
        for i, w in enumerate(self.words):
            w = _NOT_LETTER.sub("", w)
            bare += w
            who += [i] * len(w)
        for pair, one in _PAIRS:
            while (at := bare.find(pair)) >= 0:
                bare = bare[:at] + one + bare[at + 2 :]
                del who[at + 1]
        self.letters, self.owner = bare.translate(_FOLD), who
        self.turned = self.letters[::-1]
        self.sizes = [who.count(i) for i in range(len(self.words))]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _hashes(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the letters from each of the places on."""
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = (h + codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class WuManber:
    """Many patterns of one length: shift table by hash of blocks, buckets by hash, direct comparison.

    It consists of a few arrays and the letters of the passages, is built once, and is shared by all workers as it stands.
    """

    def __init__(self, letters: list[str]):
        self.letters = letters
        self.shift = np.full(SLOTS, PATTERN - BLOCK + 1, np.uint8)
        hashes, who, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for n, s in enumerate(letters):
            at = np.arange(0, len(s) - PATTERN + 1, STRIDE)
            if not len(at):
                continue
            codes = _codes(s)
            slots = (_hashes(codes, np.arange(len(s) - BLOCK + 1), BLOCK) % np.uint64(SLOTS)).astype(np.int64)
            for end in range(BLOCK, PATTERN + 1):  # of every block its least distance to the end of a pattern
                k = slots[at + end - BLOCK]
                self.shift[k] = np.minimum(self.shift[k], PATTERN - end)
            hashes.append(_hashes(codes, at, PATTERN))
            who.append(np.full(len(at), n, np.int32))
            where.append(at.astype(np.int32))
        order = np.argsort(h := np.concatenate(hashes), kind="stable")
        self.hashes, self.who, self.where = h[order], np.concatenate(who)[order], np.concatenate(where)[order]

    def find(self, text: str) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(where a pattern starts in the text, the passages and places it comes from)."""
        n = len(text)
        if n < PATTERN:
            return
        codes = _codes(text)
        shift = self.shift[(_hashes(codes, np.arange(n - BLOCK + 1), BLOCK) % np.uint64(SLOTS)).astype(np.int64)].tobytes()
        ends, end = [], PATTERN
        while end <= n:
            d = shift[end - BLOCK]
            if d:
                end += d
                continue
            ends.append(end)
            end += 1
        starts = np.array(ends, np.int64) - PATTERN
        h = _hashes(codes, starts, PATTERN)
        for i, lo, hi in zip(starts.tolist(), np.searchsorted(self.hashes, h, "left").tolist(), np.searchsorted(self.hashes, h, "right").tolist()):
            if lo < hi:
                pat = text[i : i + PATTERN]
                hit = [(p, j) for p, j in zip(self.who[lo:hi].tolist(), self.where[lo:hi].tolist()) if self.letters[p].startswith(pat, j)]
                if hit:
                    yield i, hit


#: Ways to go on after a misreading: letters to skip on the page and in the passage, cheapest first.
_STEPS = sorted(((x, y) for x in range(7) for y in range(7) if x or y), key=lambda s: (max(s), abs(s[0] - s[1]), s))


def _follow(page: str, i: int, text: str, j: int) -> tuple[int, int]:
    """Reads on in page and text from i and j as long as they agree, through misreadings and insertions.

    Returns where the agreement ends. After a stop, an insertion is passed if the text goes on behind it.
    """
    n, m, good, worst = len(page), len(text), 0, []
    end_i, end_j, begun = i, j, j
    while i < n and j < m:
        if page[i] == text[j]:
            i += 1
            j += 1
            good += 1
            if good >= 3:
                end_i, end_j = i, j
            continue
        worst = [w for w in worst if j - w < 36]
        for x, y in _STEPS if len(worst) < 12 else ():
            k = 4 if max(x, y) <= 3 else 5
            part = text[j + y : j + y + k]
            if len(part) == k and page[i + x : i + x + k] == part:
                worst += [j] * max(x, y)
                i, j, good = i + x, j + y, 0
                break
        else:
            if end_j - begun < 18:
                return end_i, end_j
            for o in range(0, 9):
                part = text[end_j + o : end_j + o + GOES_ON_FAR]
                if len(part) < GOES_ON:
                    return end_i, end_j
                at = page.find(part[:GOES_ON], end_i, end_i + NEAR)
                if at < 0 and len(part) == GOES_ON_FAR:
                    at = page.find(part, end_i + NEAR - GOES_ON)
                if at >= 0:
                    i, j, good, worst, begun = at, end_j + o, 0, [], end_j
                    break
            else:
                return end_i, end_j
    return end_i, end_j


def held_words(page: str, i: int, passage: Passage, j: int, reverse: tuple[str, str]) -> tuple[int, int, int]:
    """(words, from, to): the consecutive words of the passage held by the page around a confirmed pattern at i and j.

    ``reverse``: page and passage backwards. A word counts if at least 60 % of its letters are in the stretch.
    """
    _, hi = _follow(page, i, passage.letters, j)
    _, back = _follow(reverse[0], len(page) - i, reverse[1], len(passage.letters) - j)
    lo = len(passage.letters) - back
    owner, sizes = passage.owner, passage.sizes
    first, last = owner[lo], owner[hi - 1]
    n = last - first + 1
    if first == last:
        return n, lo, hi
    head = next(k for k in range(lo, hi) if owner[k] != first) - lo
    tail = hi - 1 - next(k for k in range(hi - 1, lo - 1, -1) if owner[k] != last)
    return n - (head < 0.6 * sizes[first]) - (tail < 0.6 * sizes[last]), lo, hi


def search_page(page: str, engine: WuManber, passages, least_words: int) -> list[tuple[int, int]]:
    """(passage, words held) for the passages (a function of their number) of which the page holds at least ``least_words``.

    The exact check is made where two patterns that don't overlap stand in the passage's distance, give or take DRIFT.
    """
    best: dict[int, int] = {}
    hits: dict[int, list[tuple[int, int]]] = {}
    done: dict[int, list[tuple[int, int, int, int]]] = {}
    turned = ""
    for i, sources in engine.find(page):
        for n, j in sources:
            seen = hits.get(n)
            if seen is None:
                hits[n] = [(i, j)]
                continue
            d = i - j
            near = False
            for a, b in seen:
                if -DRIFT <= d - a + b <= DRIFT and (j - b >= PATTERN or b - j >= PATTERN):
                    near = True
                    break
            seen.append((i, j))
            if not near or any(lo <= j < hi and a <= i <= b for lo, hi, a, b in done.get(n, ())):
                continue
            p = passages(n)
            turned = turned or page[::-1]
            words, lo, hi = held_words(page, i, p, j, (turned, p.turned))
            done.setdefault(n, []).append((lo, hi, i - (j - lo) - 20, i + (hi - j) + 20))
            if words >= least_words and words > best.get(n, 0):
                best[n] = words
    return sorted(best.items())


def leaked_passages(docs: DataFrame, items: DataFrame, *, least_words: int = 24, boxes: str | None = "line_boxes") -> DataFrame:
    """``doc_id, item_id, n_words``: pages that hold at least ``least_words`` consecutive words of an item's passage.

    Items that share a passage are all reported. Null and empty passages and pages, and passages shorter than
    the least, are never cases. Pages are searched whole. The passages of one pass (PASSAGES_PER_PASS) go
    to every worker; more items mean more passes. Repeated pages of one id give one row; further columns are ignored.
    """
    spark = docs.sparkSession
    passages = items.where("passage is not null").select("passage").distinct()
    passes = max(1, -(-passages.count() // PASSAGES_PER_PASS))
    pages = docs.select("doc_id", "text", *[(F.col(f"{boxes}.{f}") if boxes else F.lit(None).cast("array<int>")).alias(f) for f in ("x0", "y0", "x1")])
    pages = pages.where("text is not null and text <> ''")

    def letters(b: pd.DataFrame) -> list[str]:
        return [stream("\n".join(page_lines(*r))) for r in zip(b["text"], b["x0"], b["y0"], b["x1"])]

    def streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "page": letters(b)})

    if passes > 1:  # pages are put in order once
        pages = cut(pages.mapInPandas(streams, "doc_id long, page string"))
    found = None
    for k in range(passes):
        # about PASSAGES_PER_PASS texts; those of one pass are given up before the next
        texts = [r["passage"] for r in passages.where(F.pmod(F.xxhash64("passage"), F.lit(passes)) == k).collect()]
        shared = spark.sparkContext.broadcast((texts, WuManber([Passage(t).letters for t in texts])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            texts, engine = shared.value
            parsed = lru_cache(maxsize=2000)(lambda n: Passage(texts[n]))
            for b in batches:
                rows = [(d, texts[p], w) for d, page in zip(b["doc_id"], b["page"] if "page" in b else letters(b)) for p, w in search_page(page, engine, parsed, least_words)]
                yield pd.DataFrame(rows, columns=["doc_id", "passage", "n_words"]).astype({"doc_id": "int64", "n_words": "int64"})

        part = pages.mapInPandas(run, "doc_id long, passage string, n_words long")
        if passes > 1:
            part = cut(part)
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    named = items.where("passage is not null").select("item_id", "passage").distinct()
    return found.join(named, "passage").groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
