import random

import pytest

from kithmark.llm.components import components, parse_links


def brute(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            p[y] = x
    return {x: find(x) for x in p}


r = random.Random(4)
GRAPHS = {
    "ring, chain and alone": [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [(f"c{i}", f"c{i + 1}") for i in range(20)] + [("z", "z"), ("q", None), (None, "w"), (None, None)],
    "core with a hub": [(f"v{r.randrange(25)}", f"v{r.randrange(25)}") for _ in range(70)] + [("hub", f"x{i}") for i in range(30)],
    "sparse": [(f"v{r.randrange(60)}", f"v{r.randrange(60)}") for _ in range(45)] * 2,
    "nothing": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    df = spark.createDataFrame([(a, b, 1) for a, b in GRAPHS[name]], "a string, b string, group_id int")
    got = components(df, "a", "b").collect()
    assert len(got) == len({x[0] for x in got})
    assert {x[0]: x[1] for x in got} == brute(GRAPHS[name])


def test_untidy_lists(spark):
    rows = [("S1-1", "['S2-1', 'S3-2']"), ("S1-1", "S2-1 ,S2-1,"), ("S1-2", None), ("S1-3", "nan"), ("S1-4", "[]"), (" S1-5", '["S3-9"]')]
    got = {tuple(x) for x in parse_links(spark.createDataFrame(rows, "k string, l string"), "k", "l").collect()}
    assert got == {("S1-1", "S2-1"), ("S1-1", "S3-2"), ("S1-2", None), ("S1-3", None), ("S1-4", None), ("S1-5", "S3-9")}
