from collections import Counter

import pytest

from kithmark.llm.mixture import mix, tokenizer_path, with_token_counts

DOCS = "doc_id long, source string, text string, slot int, n_tokens string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS)


def corpus(spark):
    size = {"big": 400, "mid": 120, "small": 12}
    rows = [(k * 1000 + i, s, f"the page number {i} of {s} " * (3 + i % 9)) for k, (s, n) in enumerate(size.items()) for i in range(n)]
    return frame(spark, rows + [(9001, None, "no source"), (9002, "unknown", "other"), (9003, "big", None), (9004, "big", "")])


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


T = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("absent", 0.0, 1)]


def test_shares_are_reached(spark):
    m = mix(corpus(spark), targets(spark, T), block_tokens=128)
    rows = m.schedule.collect()
    assert len({(r["doc_id"], r["repetition"]) for r in rows}) == len(rows)
    limits = {s: r for s, _, r in T}
    assert all(1 <= r["repetition"] <= limits[r["source"]] for r in rows)
    for r in m.shares.collect():
        assert r["target_met"] and abs(r["actual_share"] - r["target_share"]) < 0.05
        assert r["chosen_tokens"] == sum(x["n_tokens"] for x in rows if x["source"] == r["source"])
    # every stretch of the schedule has nearly the target shares
    half = max(r["slot"] for r in rows) // 2
    first = [r for r in rows if r["slot"] < half]
    assert abs(sum(r["n_tokens"] for r in first if r["source"] == "big") / sum(r["n_tokens"] for r in first) - 0.5) < 0.08


def test_blocks_hold_equally_many_tokens(spark):
    m = mix(corpus(spark), targets(spark, T), block_tokens=128)
    blocks, sizes = m.blocks.collect(), {(r["doc_id"]): r["n_tokens"] for r in with_token_counts(corpus(spark), ["doc_id"], "text", tokenizer_path()).collect()}
    slots, pages = Counter(), {}
    for r in blocks:
        slots[r["slot"]] += r["n_tokens"]
        pages.setdefault((r["doc_id"], r["repetition"]), []).append((r["first_token"], r["n_tokens"]))
    assert sum(n == 128 for n in slots.values()) >= len(slots) - 6 and max(slots.values()) == 128
    for (d, _), parts in pages.items():  # pieces of a page join without gap or overlap
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= sizes[d]


def test_many_sources(spark):
    n = 5000
    docs = frame(spark, [(i, f"s{i % n}", "word " * 20) for i in range(3 * n)])
    m = mix(docs, targets(spark, [(f"s{i}", 1.0 / n, 1) for i in range(n)]), total_tokens="corpus", block_tokens=20)
    rows = m.schedule.collect()
    assert len({r["source"] for r in rows}) == n and len(rows) == len({r["doc_id"] for r in rows})


def test_unreachable_target_is_reported(spark):
    m = mix(corpus(spark), targets(spark, T), total_tokens="corpus", block_tokens=128)
    shares = {r["source"]: r for r in m.shares.collect()}
    assert not shares["small"]["target_met"] and shares["small"]["most_repeats"] == 3
    assert shares["small"]["chosen_tokens"] == 3 * shares["small"]["available_tokens"]


def test_repetition_comes_after_all_pages_were_used(spark):
    rows = mix(corpus(spark), targets(spark, T), block_tokens=128).schedule.where("source = 'small'").collect()
    again = {r["doc_id"] for r in rows if r["repetition"] == 2}
    assert not again or {r["doc_id"] for r in rows if r["repetition"] == 1} == {2000 + i for i in range(12)}


def test_edges(spark):
    empty = corpus(spark).where("false")
    assert mix(empty, targets(spark, T)).schedule.count() == 0
    assert mix(corpus(spark), targets(spark, [])).shares.count() == 0
    one = frame(spark, [(1, "big", "word " * 50_000)] * 2)
    m = mix(one, targets(spark, [("big", 1.0, 1)]))
    assert m.schedule.count() == 1


def test_token_counts_round_trip(spark):
    tiktoken = pytest.importorskip("tiktoken")
    from kithmark.llm.mixture import _encoder

    enc = _encoder(tokenizer_path())
    assert isinstance(enc, tiktoken.Encoding)
    texts = ["", "plain words", "élan — naïve", "x" * 5000, None]
    rows = frame(spark, [(i, "s", t) for i, t in enumerate(texts)])
    for r in with_token_counts(rows, ["doc_id"], "text", tokenizer_path()).collect():
        t = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert r["n_tokens"] == len(ids) and enc.decode(ids) == t
