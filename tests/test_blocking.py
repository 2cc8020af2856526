import random

from kithmark.operators import blocking as B

COLUMNS = "entity_id string, business_name_normalized string, business_address_normalized string, country_clean string"


def tables(spark, seed):
    r = random.Random(seed)
    words = ["acme", "star", "global", "blue", "north", "tea", "house", "the"]
    make = lambda p, n: [(f"{p}-{i:03d}", " ".join(r.choices(words, k=3)), f"{r.randint(10, 30)} main street town", r.choice(["US", "India", "", None])) for i in range(n)]
    return spark.createDataFrame(make("S1", 25), COLUMNS), spark.createDataFrame(make("S2", 120), COLUMNS)


def sequential(left, right, caps, cap):
    """The routes one after the other on plain rows."""
    L, R = [sorted({tuple(r) for r in v.collect()}) for v in (left, right)]
    cols = left.columns
    get = lambda r, c: r[cols.index(c)]
    from collections import Counter, defaultdict

    rows = [tuple(r) for r in right.collect() if r["country"]]
    stop = {k: {x for x, n in Counter((get(r, "country"), get(r, c)) for r in rows).items() if n > m} for k, c, m in (("token1", "tok1", caps.token1), ("token2", "tok2", caps.token2), ("token3", "tok3", caps.token3))}
    stop["address"] = {x for x, n in Counter((get(r, "country"), get(r, "addr9")) for r in rows if len(get(r, "clean_addr")) >= 9).items() if n > caps.address}
    spec = [(1, "name_norm", "name_norm", 3, None), (2, "tok1", "tok1", 3, "token1"), (3, "tok1", "tok2", 4, "token2"), (4, "tok2", "tok1", 4, "token1"), (5, "tok2", "tok2", 4, "token2"), (6, "tok3", "tok3", 4, "token3"), (7, "addr9", "addr9", 9, "address")]
    got = defaultdict(list)
    for n, a, b, least, s in [*spec, (8, None, None, 0, None)]:
        for l in L:
            c, i = get(l, "country"), get(l, "id")
            if not c or len(got[i]) >= cap:
                continue
            if n == 8:
                ok = get(l, "addr_num") and len(get(l, "clean_name")) >= 3
                hits = {get(r, "id") for r in R if get(r, "country") == c and (get(r, "addr_num"), get(r, "name3")) == (get(l, "addr_num"), get(l, "name3"))} if ok else set()
            else:
                k = get(l, a)
                ok = len(k) >= least and not (s and (c, k) in stop[s])
                hits = {get(r, "id") for r in R if get(r, "country") == c and get(r, b) == k} if ok else set()
            before = len(got[i])
            for rank, t in enumerate(sorted(hits), 1):
                if before + rank <= cap and t not in got[i]:
                    got[i].append(t)
    return {i: set(t) for i, t in got.items() if t}


def test_capped_fold_equals_sequential_routes(spark):
    caps = B.Caps(20, 15, 15, 30)
    for seed in (1, 2):
        l, r = map(B.blocking_view, tables(spark, seed))
        got = {x["s1_id"]: set(x["targets"]) for x in B.capped_lists(l, r, caps, cap=6).collect()}
        assert got == sequential(l, r, caps, 6)
        assert all(len(t) <= 6 for t in got.values())


def test_empty_tables(spark):
    l, r = map(B.blocking_view, tables(spark, 3))
    assert B.capped_lists(l.where("false"), r).count() == 0
    assert B.candidate_lists(l, r.where("false")).where("candidate_entity_ids <> ''").count() == 0
    truth = spark.createDataFrame([], "s1_id string, target_id string")
    assert B.recall(B.captured(truth, l, r)).first()["total_true_pairs"] == 0


def test_captured_is_the_ceiling_of_candidates(spark):
    l, r = map(B.blocking_view, tables(spark, 4))
    every = l.where("country <> ''").select(l["id"].alias("s1_id")).distinct().crossJoin(r.select(r["id"].alias("target_id")).distinct())
    got = {(x[0], x[1]) for x in B.captured(every, l, r, B.Caps()).where("captured").collect()}
    pairs = {(x[0], x[1]) for x in B.candidate_pairs(l, r).collect()}
    assert pairs <= got


def test_all_candidates_are_those_of_the_routes_without_caps(spark):
    left, right = tables(spark, 5)
    l, r = B.blocking_view(left), B.blocking_view(right)
    none = 10**9
    got = {tuple(x) for x in B.all_candidates(l, r).collect()}
    capless = {(x["s1_id"], x["target_id"]) for x in B.candidate_pairs(l, r, caps=B.Caps(none, none, none, none), cap=1000).collect()}
    assert got == capless and len(got) > 100
