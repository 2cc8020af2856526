import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from kithmark.llm.spam import _TOKEN_OR_LINE, HIGHEST, LOWEST, Coder, Knowledge, coded_pages, corpus_knowledge, fold, line_flags, link_lines, printed_text, spam_pages, support, _pages

R = random.Random(5)
DOCS = "doc_id long, text string, line_boxes array<struct<x0:int,y0:int,x1:int>>, spam string"
NOUNS = ["mill", "canal", "school", "bridge", "auction", "garden", "chapel", "market", "tenant", "harbour", "library", "quarry", "museum", "theatre", "foundry"]
GOODS = ["soap", "sofas", "pianos", "loans", "watches", "lamps", "rugs", "tickets", "hotels", "tyres", "phones", "shoes", "gold", "deals", "boots"]


def prose(n):
    s = [f"the {R.choice(NOUNS)} of the town was opened by the {R.choice(NOUNS)} and the {R.choice(NOUNS)} for the sum of {R.randint(2, 99)} pounds while {R.choice(GOODS)} were dear." for _ in range(n)]
    w = " ".join(s).split()
    return "\n".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6))


def salad(n):
    return "\n".join(" ".join(R.choices(GOODS + NOUNS, k=5)) for _ in range(n))


def links(n):
    return "\n".join(f"http://www.{R.choice(GOODS)}{i}.example/{R.choice(GOODS)}" for i in range(n))


def corpus(spark):
    rows = [(i, prose(8)) for i in range(150)] + [(1000 + i, salad(20)) for i in range(8)] + [(2000, links(20)), (2001, "\n".join(f"#{R.choice(GOODS)} #{R.choice(NOUNS)}" for _ in range(20)))]
    rows += [(3000, None), (3001, ""), (3002, prose(8) + "\n" + salad(4)), (3003, prose(400)), (2000, links(20)), (3004, "... --- ..."), (3005, "  \n\n")]
    return spark.createDataFrame([(i, t, None, "clash") for i, t in rows], DOCS)


def test_spam_is_told_from_prose(spark):
    out = spam_pages(corpus(spark)).collect()
    assert len(out) == len({r["doc_id"] for r in out})
    assert {r["doc_id"] for r in out if r["spam"]} == {*range(1000, 1008), 2000, 2001}
    assert not {3000, 3001, 3004, 3005} & {r["doc_id"] for r in out}


def test_empty(spark):
    assert spam_pages(corpus(spark).where("false")).count() == 0


def test_counts_equal_brute_force(spark):
    pages = _pages(corpus(spark), "doc_id", "text", "line_boxes")
    k = corpus_knowledge(coded_pages(pages))
    texts = {"".join(c for c in r["text"].lower() if c.isalnum()): r["text"] for r in pages.collect()}.values()  # a text counts once
    assert k.pages == len(texts)
    single, both = Counter(), Counter()
    for t in texts:
        w = [fold(x) for x in _TOKEN_OR_LINE.findall(printed_text(t)) if x != "\n"]
        single.update(set(w))
        both.update(set(zip(w, w[1:])))
    index = lambda w: k.known(np.array([xxhash.xxh32_intdigest(w)]))
    for a, b in (("the", "mill"), ("of", "the"), ("soap", "gold"), ("gold", "the"), ("was", "opened")):
        a, b = fold(a), fold(b)
        n, want = both[a, b], single[a] * single[b] / len(texts)
        want = np.log((max(n - 1, 0.5 * support(len(texts)) if n < support(len(texts)) else n - 1) + 0.1) / (want + 0.1)) if n >= support(len(texts)) or want > support(len(texts)) else 0
        want = np.clip(want, LOWEST, HIGHEST)
        assert k.information(index(a), index(b))[0] == pytest.approx(max(want, 0) if n >= max(3, 0.003 * len(texts)) else want, abs=0.01), (a, b)


def judged(text, knowledge):
    return line_flags(Coder().codes(text), np.array(link_lines(text)), knowledge)


SPANISH = "La noche estaba tranquila y el viento soplaba desde las montañas\ncuando los viajeros llegaron a la pequeña aldea cerca del río\ndonde una anciana les ofreció pan y queso junto al fuego\ny les contó la historia de su familia hasta el amanecer"


def test_an_unknown_language_is_not_spam(spark):
    nothing = Knowledge(0, pd.DataFrame({"w": [], "n": [], "small": [], "capital": []}), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not judged(SPANISH, nothing).any()
    assert not judged(SPANISH, corpus_knowledge(coded_pages(_pages(corpus(spark), "doc_id", "text", "line_boxes")))).any()
    assert judged("gorbal tindra\n" * 20, nothing).all()  # but what a page repeats again and again is


def test_frequency_acquits_no_spam(spark):
    """A third of all pages are copies of one keyword page, and another third repeat a keyword beside changing words."""
    r = random.Random(3)
    rows = [(i, prose(8)) for i in range(60)] + [(1000 + i, "\n".join(["soap sofas gold soap pianos soap soap"] * 20)) for i in range(60)]
    rows += [(2000 + i, "\n".join(f"{r.choice(NOUNS)} loans {r.choice(NOUNS)} loans" for _ in range(20))) for i in range(60)]
    out = spam_pages(spark.createDataFrame([(i, t, None, "clash") for i, t in rows], DOCS)).collect()
    assert {x["doc_id"] for x in out if x["spam"]} == {i for i, _ in rows if i >= 1000}


@pytest.mark.parametrize("line, want", [
    ("see http://www.shop.example/x", True), ("ftp://a-b.test", True), ("www . sofas . example", True), ("hftp://sofas dot exomple", True), ("#soap #gold", True), ("soap (295)", True), ("red size 42", True),
    ("Dr. Vidran opened the mill.", False), ("market. The tea was dear", False), ("Stomlar 1, Sagro 6", False), ("", False),
])
def test_links_and_tags(line, want):
    assert link_lines(line) == [want]
