import random

from kithmark.llm import leakage
from kithmark.llm.leakage import PATTERN, Passage, WuManber, leaked_passages, stream
from kithmark.llm.pages import page_lines

R = random.Random(11)
VOCABULARY = ["".join(R.choices("abdefghiklmnoprstuvw", k=R.randint(3, 9))) for _ in range(900)]
words = lambda n: R.sample(VOCABULARY, n) if n < 400 else R.choices(VOCABULARY, k=n)
DOCS = "doc_id long, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:double>>, n_words int"
ITEMS = "item_id long, passage string, n_words string"


def wrap(ws, width=5):
    return "\n".join(" ".join(ws[i : i + width]) for i in range(0, len(ws), width))


def test_search_finds_what_a_scan_finds():
    passages = [Passage(" ".join(words(40))) for _ in range(6)]
    engine = WuManber([p.letters for p in passages])
    page = stream(" ".join(words(50)) + passages[2].letters[30:110] + " ".join(words(20)) + passages[4].letters[5:90])
    patterns = {}
    for n, p in enumerate(passages):
        for at in range(0, len(p.letters) - PATTERN + 1, 6):
            patterns.setdefault(p.letters[at : at + PATTERN], []).append((n, at))
    want = [(i, sorted(patterns[page[i : i + PATTERN]])) for i in range(len(page) - PATTERN + 1) if page[i : i + PATTERN] in patterns]
    assert want and [(i, sorted(s)) for i, s in engine.find(page)] == want


def test_pages(spark):
    passage, other = words(60), words(60)
    noisy = [w[:2] + "c" + w[3:] if i % 7 == 0 and len(w) > 4 and w[2] == "e" else w for i, w in enumerate(passage)]
    broken = wrap(words(30) + noisy[10:50] + words(30)).replace("\n", "-\n", 1)
    advert = wrap(words(20) + passage[5:20]) + "\nTO LET a new house near\nthe mill apply within\n" + wrap(passage[20:40] + words(20))
    docs = [
        (1, wrap(words(40) + passage + words(40)), None, 1), (2, broken, None, 1), (3, wrap(words(40) + passage[:23] + words(40)), None, 1), (4, wrap(words(40) + passage[30:55] + words(40)), None, 1),
        (5, advert, None, 1), (6, None, None, 1), (7, "", None, 1), (8, wrap(words(200)), None, 1), (9, wrap(words(3000) + other), None, 1), (1, wrap(words(40) + passage + words(40)), None, 1),
    ]
    items = [(100, " ".join(passage), "a"), (101, " ".join(passage), "b"), (102, " ".join(other).upper() + "!", None), (103, None, ""), (104, "", ""), (105, "short text", "")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in leaked_passages(d, i).collect()}
    assert got == {(n, k) for n in (1, 2, 4, 5) for k in (100, 101)} | {(9, 102)}
    assert leaked_passages(d.where("false"), i).count() == 0 and leaked_passages(d, i.where("false")).count() == 0


def test_columns_read_across(spark):
    passage = words(60)
    left, right = wrap(words(10) + passage[:35], 5).split("\n"), wrap(passage[35:] + words(20), 5).split("\n")
    lines, boxes = [], []
    for k, (a, b) in enumerate(zip(left, right)):
        for x, t in ((100, a), (900, b)):
            lines.append(t)
            boxes.append((x, 40 * k, x + 600, 40 * k + 30, 0.9))
    d = spark.createDataFrame([(1, "\n".join(lines), boxes, 0)], DOCS)
    got = leaked_passages(d, spark.createDataFrame([(7, " ".join(passage), "")], ITEMS)).collect()
    assert len(got) == 1 and got[0]["n_words"] == 60


def test_page_lines_of_fused_columns():
    text = "a one   b one\na two   b two\na three   b three"
    assert page_lines(text, [0, 0, 0], [0, 10, 20], [260, 260, 320]) == ["a one", "a two", "a three", "b one", "b two", "b three"]
    assert page_lines(None) == [] and page_lines("x\ny") == ["x", "y"]


def test_insertions_of_any_length(spark):
    passage = words(60)
    docs = [(n, wrap(words(20) + passage[5:25] + words(n) + passage[25:45] + words(20)), None, 1) for n in (5, 30, 60, 250)]
    docs.append((1, wrap(words(20) + passage[5:25] + words(60) + passage[30:33] + words(20)), None, 1))  # a short common phrase is none
    got = leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(7, " ".join(passage), "")], ITEMS)).collect()
    assert {r["doc_id"] for r in got} == {5, 30, 60, 250}


def test_several_passes_find_what_one_finds(spark, monkeypatch):
    passages = [words(40) for _ in range(9)]
    docs = spark.createDataFrame([(n, wrap(words(20) + p[:30] + words(20)), None, 1) for n, p in enumerate(passages[:6])], DOCS)
    items = spark.createDataFrame([(n, " ".join(p), "") for n, p in enumerate(passages)], ITEMS)
    one = sorted(leaked_passages(docs, items).collect())
    monkeypatch.setattr(leakage, "PASSAGES_PER_PASS", 2)
    assert len(one) == 6 and sorted(leaked_passages(docs, items).collect()) == one
