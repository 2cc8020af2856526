"""Pages of keywords, link lists and product tags, told from writing by how neighbouring words go together.

Every page is put into printed order and cut into words once; the words are kept as hashes in a table. Two passes over it
gather counts over the whole corpus: in how many pages a word occurs, and in how many two words stand side by side. All
words and pairs above a share of the pages are counted, of any language; a text that occurs several times counts once. The mean
pointwise mutual information of neighbours says whether a line is coherent; word salad is not. Words and pairs that
the corpus doesn't know give no evidence either way. A pair of unknown words that a page repeats, or a word that makes up
much of the page, is excessively repeated and counts as incoherent, known or not. An extension to the method: links and tags
have no neighbours to speak of and are told by their form. A page is spam if more than half of its lines are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from kithmark.llm.leakage import _FOLD
from kithmark.llm.pages import page_lines
from kithmark.operators.heavy_keys import skew_join
from kithmark.runtime import cut

#: Words and pairs in at least this share of the pages are counted, and in so many pages at least. A page has about 400 pairs, so
#: at most 400 / SUPPORT of them are known, whatever the size of the corpus.
SUPPORT, LEAST_PAGES = 0.0002, 3
#: A line is incoherent if the mean information of the neighbours in it and beside it is below this.
INCOHERENT = -1.4
#: Bounds of the information of a pair; a pair in this share of the pages is writing, unless a page repeats it too much.
LOWEST, HIGHEST, WRITING = -3.0, 2.0, 0.003
#: A pair of unknown words is excessive if a page has it this often; an excessive pair counts with this information.
REPEATED, EXCESSIVE = 3, -3.5
#: So often at least, and in more than this share of the words of a page, a word is a keyword: unknown, a name, or any word.
OFTEN, KEYWORD, NAME_REFRAIN, ANY_WORD = 8, 0.05, 0.16, 0.27
WORD, NAME, NUMBER, END = range(4)

_BROKEN = re.compile(r"[-¬=~\u00ad]\n(?<=[^\W\d_].\n)([a-zß-ÿ]+)")
_TOKEN_OR_LINE = re.compile(r"[^\W_]+|\n")
_TAG = re.compile(r"(?:^|\s)[#@+~][^\W\d_]\w")
# an article's number, size or count, or a mark that leads on, at the end of a short line
_PRODUCT = re.compile(r"\b(?:sk[un]|ref|art)\b[.:# ]{0,2}\d|\bsku\d|\b[s5][i1l]ze ?[\dlosb]{2}\b|\([\dlosb]{2,4}\)\s*$|\w\s*>\s*$", re.M)
_PRODUCT_HINTS = ("sku", "skn", " ref", " art", ">", "(", "ize", "1ze", "lze")
_PAIR = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("vy", "w"))
_LINE_PAIRS = tuple((a.encode(), b.encode()) for a, b in _PAIR)
_FOLD_LINE = bytes(ord(_FOLD.get(i, chr(i))) if i < 128 and (chr(i).isalnum()) else i for i in range(256))


def fold(word: str) -> str:
    """A word in lower case, without accents, with confusable letters as one."""
    w = word.lower()
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w.replace("ß", "ss")) if not unicodedata.combining(c))
    for a, b in _PAIR:
        w = w.replace(a, b)
    return w.translate(_FOLD)


# Ends and beginnings of addresses on the web, those reserved for examples included.
_ENDS = "|".join(sorted({fold(x) for x in "com org info biz example invalid test html".split()}))
_LINK = re.compile(
    rf"(?:https?|ftp):?/|\b(?:{fold('http')}s?|{fold('ftp')})\b ?[:;]|{fold('http')}s?[:;]|{fold('ftp')}[:;]/|\bwww?\b ?[.,]|\bwww|[a-z0-9~-] ?(?:[.]| {fold('dot')} ) ?(?:{_ENDS})(?![a-z])"
)
_HINTS = [x.encode() for x in ("//", "ww", fold("http"), fold("ftp"), f" {fold('dot')} ", *(f"{d}{e}" for e in _ENDS.split("|") for d in (".", ". ")))]


def link_lines(text: str) -> list[bool]:
    """For each line: whether it holds a link or a tag, through misreadings."""
    low = text.lower()
    b = low.encode("ascii", "replace")
    for x, y in _LINE_PAIRS:
        b = b.replace(x, y)
    b = b.translate(_FOLD_LINE)
    tagged = any(m in text for m in "#@+~") or any(h in low for h in _PRODUCT_HINTS) and _PRODUCT.search(low) is not None
    if not tagged and not any(h in b for h in _HINTS):
        return [False] * (text.count("\n") + 1)
    out = [any(h in l for h in _HINTS) and _LINK.search(l.decode()) is not None for l in b.split(b"\n")]
    if tagged:
        out = [o or _TAG.search(l) is not None or _PRODUCT.search(l) is not None for o, l in zip(out, low.split("\n"))]
    return out


def printed_text(text: str, x0=None, y0=None, x1=None) -> str:
    """The page column by column; a word broken at the end of a line stands where it begins."""
    return _BROKEN.sub(r"\1\n", "\n".join(page_lines(text, x0, y0, x1)))


def _printed(b: pd.DataFrame) -> Iterator[str]:
    return map(printed_text, b["text"], b["x0"], b["y0"], b["x1"])


def _pages(docs: DataFrame, record: str, text: str, boxes: str | None) -> DataFrame:
    corners = [(F.col(f"{boxes}.{f}") if boxes else F.lit(None).cast("array<int>")).alias(f) for f in ("x0", "y0", "x1")]
    return docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(record).alias("doc_id"), F.col(text).alias("text"), *corners)


class Coder:
    """Token -> hash of its folded form and its kind; remembers tokens, up to a bound."""

    def __init__(self, most: int = 400_000):
        self.most, self.seen = most, {"\n": END}

    def codes(self, text: str) -> np.ndarray:
        """Of every token and line end of a text: 32 bits of hash and two of kind. On pages mostly in capitals these aren't names."""
        tokens = _TOKEN_OR_LINE.findall(text)
        if len(self.seen) > self.most:
            self.seen = {"\n": END}
        seen = self.seen
        for t in tokens:
            if t not in seen:
                seen[t] = self._code(t)
        out = np.fromiter(map(seen.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        capitals = (out & 4) > 0
        if 2 * capitals.sum() > ((out & 3) != END).sum():
            out[capitals] &= ~3
        return (out >> 3) << 2 | (out & 3)

    def _code(self, token: str) -> int:
        digits = sum(c.isdigit() for c in token)
        if digits * 2 >= len(token) and digits:
            return NUMBER
        h = xxhash.xxh32_intdigest(fold(token)) << 3
        return h | (NAME if token[0].isupper() else WORD) | (4 if len(token) > 1 and token.isupper() else 0)


class Knowledge:
    """Counts of the corpus as sorted arrays: hashes of known words, codes of known pairs and their information.

    ``words`` has a row for each word: w, n pages, and in how many it is written small and with a capital.
    """

    def __init__(self, pages: int, words: pd.DataFrame, pairs: np.ndarray, pair_pages: np.ndarray):
        self.pages, self.words, self.word_pages, self.least = pages, words["w"].to_numpy(np.int64), words["n"].to_numpy(np.float64), support(pages)
        self.name = (words["capital"] >= words["small"]).to_numpy(bool)
        self.small = np.clip(np.log((words["small"] + 0.1) / (words["n"] + 0.1)), LOWEST, 0).to_numpy(np.float32)
        order = np.argsort(pairs)
        self.pairs, n = pairs[order], pair_pages[order].astype(np.float64)
        size = max(1, len(words))
        expected = self.word_pages[self.pairs // size] * self.word_pages[self.pairs % size] / max(1, pages) if len(words) else n
        value = np.clip(np.log((n - 1 + 0.1) / (expected + 0.1)), LOWEST, HIGHEST)  # other pages than the one that is judged
        self.info = np.where(n >= max(LEAST_PAGES, WRITING * pages), np.maximum(value, 0), value).astype(np.float32)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, -1 if unknown."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def information(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of word indices; 0, neither for nor against, without evidence.

        A pair of known words that isn't known itself is in less pages than the support; that tells something if more are expected.
        """
        out = np.zeros(len(a))
        both = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(both):
            return out
        x, y = a[both].astype(np.int64), b[both].astype(np.int64)
        expected = self.word_pages[x] * self.word_pages[y] / max(1, self.pages)
        value = np.where(expected > self.least, np.clip(np.log((0.5 * self.least + 0.1) / (expected + 0.1)), LOWEST, HIGHEST), 0)
        if len(self.pairs):
            code = x * len(self.words) + y
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            value = np.where(self.pairs[at] == code, self.info[at], value)
        out[both] = value
        return out


def support(pages: int) -> int:
    return max(LEAST_PAGES, math.ceil(SUPPORT * pages))


def line_flags(codes: np.ndarray, links: np.ndarray, knowledge: Knowledge) -> np.ndarray:
    """For each line that has words or links: whether it is keywords, links or tags."""
    kind, f = codes & 3, codes >> 2
    line, word = np.cumsum(kind == END), kind != END
    kind, f, line = kind[word], f[word], line[word]
    kept = links | (np.bincount(line, minlength=len(links)) > 0)
    n, flags = int(kept.sum()), links[kept].copy()
    plain = ~links[line]
    kind, f, o = kind[plain], f[plain], (np.cumsum(kept) - 1)[line[plain]]
    if len(f) > 1:
        known = knowledge.known(f)
        there = known >= 0
        name = there & knowledge.name[known] if len(knowledge.words) else there
        # words that are names for the corpus tell nothing of their neighbours, and numbers neither
        index = np.where(name | (kind == NUMBER), -1, known)
        v = knowledge.information(index[:-1], index[1:])
        if name.any():  # but a name is seldom written small in writing
            small = np.where(name & (kind == WORD), knowledge.small[known], 0)
            v = np.maximum(v + (small[:-1] + small[1:]) / 2, LOWEST)
        pair = f[:-1] << 32 | f[1:]
        _, where, count = np.unique(pair, return_inverse=True, return_counts=True)
        open_ = ~there & (kind != NUMBER)
        excessive = (count[where] >= REPEATED) & open_[:-1] & open_[1:]
        # a word that makes up much of the page is a keyword; names may return in a refrain, and common words in any line
        which = np.unique(f, return_inverse=True)[1]
        much = np.bincount(which)[which]
        share = much / len(f)
        rare = ~there | (knowledge.word_pages[known] < WRITING * knowledge.pages) if len(knowledge.words) else ~there
        keyword = (much >= OFTEN) & (kind != NUMBER) & ((share > ANY_WORD) | rare & (share > np.where(kind == NAME, NAME_REFRAIN, KEYWORD)))
        excessive |= keyword[:-1] | keyword[1:]
        v = np.where(excessive, EXCESSIVE, v)
        near = o[1:] - o[:-1] <= 1  # no pair across a line of links
        at = o[1:][near]
        total, m = np.bincount(at, v[near], n), np.bincount(at, minlength=n).astype(float)
        pad = lambda x: np.concatenate(([0.0], x, [0.0]))
        t, k = pad(total), pad(m)
        t, k = 2 * total + t[:-2] + t[2:], 2 * m + k[:-2] + k[2:]
        flags |= (k > 0) & (t < INCOHERENT * k)
    return flags


def _repeated(pages: DataFrame) -> DataFrame:
    """``doc_id``: pages whose letters another page with a smaller id has, too."""
    letters = F.xxhash64(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", ""))
    signed = pages.select("doc_id", letters.alias("sig"))
    groups = signed.groupBy("sig").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sig", "first")
    return skew_join(signed, groups, "sig").where("doc_id > first").select("doc_id").distinct()


def coded_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, once, codes, links``: the words and the lines with links of every page, in a table; each page is parsed here and nowhere else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder()
        for b in batches:
            texts = list(_printed(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "once": b["once"], "codes": [_packed(coder.codes(t)) for t in texts], "links": [np.packbits(link_lines(t)).tobytes() for t in texts], "lines": [t.count("\n") + 1 for t in texts]})

    marked = pages.join(_repeated(pages).withColumn("again", F.lit(True)), "doc_id", "left").select("*", F.isnull("again").alias("once")).drop("again")
    return cut(marked.mapInPandas(run, "doc_id long, once boolean, codes binary, links binary, lines int"))


def _packed(codes: np.ndarray) -> bytes:
    """Hashes of four bytes, then kinds of one byte."""
    return (codes >> 2).astype(np.uint32).tobytes() + (codes & 3).astype(np.uint8).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, np.uint32, n).astype(np.int64) << 2 | np.frombuffer(data, np.uint8, n, 4 * n)


def corpus_knowledge(coded: DataFrame) -> Knowledge:
    """What the corpus tells of words and pairs, over all different pages."""
    some = coded.where("once").select("codes")

    def counted(per_page, most: int = 2_000_000):
        """Sums over the pages of a task; at times what has come together is passed on."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept, size = [], 0
            for b in batches:
                for c in b["codes"]:
                    kept.append(per_page(_unpacked(c)))
                    size += len(kept[-1])
                if size > most:
                    yield total(kept)
                    kept, size = [], 0
            yield total(kept)

        return run

    def total(kept: list) -> pd.DataFrame:
        k, n = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pd.DataFrame({"k": k, "n": n.astype(np.int64)})

    def words(c: np.ndarray) -> np.ndarray:
        c = c[(c & 3) <= NAME]
        every = (np.unique(c >> 2) << 2) + 2  # a page counts once for a word, and once for each of its writings
        return np.concatenate((np.unique(c), every, [-1]))  # -1 carries the pages

    seen = some.mapInPandas(counted(words), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    by_word = cut(seen.where("k >= 0").groupBy(F.shiftright("k", 2).alias("w")).agg(*[F.sum(F.expr(f"if((k & 3) = {x}, n, 0)")).alias(c) for x, c in ((2, "n"), (WORD, "small"), (NAME, "capital"))]).unionByName(seen.where("k < 0").select(F.lit(-1).cast("long").alias("w"), "n", F.lit(0).cast("long").alias("small"), F.lit(0).cast("long").alias("capital"))))
    pages = by_word.where("w < 0").agg(F.max("n")).first()[0] or 0
    least = support(pages)
    top = by_word.where(f"w >= 0 and n >= {least}").orderBy("w").toPandas()  # at most the words of a page / SUPPORT
    known = top["w"].to_numpy(dtype=np.int64)
    shared = coded.sparkSession.sparkContext.broadcast(known)

    def pairs(c: np.ndarray) -> np.ndarray:
        words = shared.value
        f = c[(c & 3) != END] >> 2
        if not len(words) or len(f) < 2:
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(words, f), len(words) - 1)
        ok = words[at] == f
        both = ok[:-1] & ok[1:]
        return np.unique(at[:-1][both] * len(words) + at[1:][both])

    counts = some.mapInPandas(counted(pairs), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(f"n >= {least}").toPandas()  # at most the pairs of a page / SUPPORT
    return Knowledge(pages, top, counts["k"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.int64))


def spam_pages(docs: DataFrame, *, record: str = "doc_id", text: str = "text", boxes: str | None = "line_boxes") -> DataFrame:
    """``doc_id, n_lines, spam_lines, spam`` for every page that has lines with words.

    Null and empty pages are no cases and don't appear. Pages are read whole. Pages repeated under one id give one row. An empty table gives an empty result; further columns
    are ignored.
    """
    coded = coded_pages(_pages(docs, record, text, boxes))
    shared = docs.sparkSession.sparkContext.broadcast(corpus_knowledge(coded))  # bounded by SUPPORT

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        knowledge = shared.value
        for b in batches:
            flags = [line_flags(_unpacked(c), np.unpackbits(np.frombuffer(l, np.uint8))[:n].astype(bool), knowledge) for c, l, n in zip(b["codes"], b["links"], b["lines"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_lines": [len(f) for f in flags], "spam_lines": [int(f.sum()) for f in flags]})

    judged = coded.select("doc_id", "codes", "links", "lines").mapInPandas(judge, "doc_id long, n_lines int, spam_lines int").where("n_lines > 0")
    judged = judged.groupBy("doc_id").agg(F.max(F.struct("spam_lines", "n_lines")).alias("m")).select("doc_id", "m.n_lines", "m.spam_lines")
    return judged.withColumn("spam", F.col("spam_lines") * 2 > F.col("n_lines"))
