import random

from pyspark.sql import functions as F

from kithmark.llm.addresses import key_hashes, may_be_town, same_word, town_bits
from kithmark.llm.linkage import _edges, _place_edges, _prune, _records, attributes_of, most_attributes

COLUMNS = ("entity_id", "business_name", "business_address", "country")


def records(spark, left, right):
    frame = lambda rows: spark.createDataFrame([(*r, "India") for r in rows], ", ".join(f"{c} string" for c in COLUMNS))
    return _records([("l", frame(left)), ("r", frame(right))], *COLUMNS)


def test_a_common_name_at_one_number_is_compared_in_like_towns_only(spark):
    left = [("S1-1", "Tapril Zorsa Footwear", "12 Grotrussar Road, Klaporgarh"), ("S1-2", "Tapril Zorsa Bakery", "7 Zijirfor Vihar, Stellargaon 394937")]
    right = [("S2-1", "Tapril Zorsa Footwear", "12 Gortrusar Road, Klapogarh"), ("S2-2", "Tapril Zorsa Footwear", "12 Munvik Lane, Stebidun"), ("S2-3", "Tapril Zorsa Footwear", "7 Zijirfor Vihar, Stellargaon 394937"), ("S2-4", "Tapril Zorsa", "7 Zijirfor Vihar, Sirud 394937")]
    got = {(r["a"], r["b"]): r["may"] for r in _place_edges(records(spark, left, right)).collect()}
    assert got == {("S1-1", "S2-1"): True, ("S1-1", "S2-2"): False, ("S1-2", "S2-3"): False, ("S1-2", "S2-4"): True}


def test_no_town_that_may_be_the_same_is_left_out(spark):
    r = random.Random(5)
    letters = "aeioubcdgklmnpqrstvxyzhw-"
    words = ["".join(r.choices(letters, k=r.randint(3, 12))) for _ in range(2000)]
    pairs = []
    for w in words:
        other = w
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(other))
            other = r.choice([other[:i] + other[i + 1 :] or "a", other[:i] + r.choice(letters) + other[i:], other[:i] + r.choice(letters) + other[i + 1 :], other[:i] + other[i : i + 2][::-1] + other[i + 2 :]])
        pairs += [(w, other), (w, r.choice(words))]
    rows = [(u, v, town_bits(u), town_bits(v)) for u, v in pairs] + [("a", "b", None, town_bits("b"))]
    got = spark.createDataFrame(rows, "u string, v string, x long, y long").select("u", "v", may_be_town(F.col("x"), F.col("y")).alias("may")).collect()
    assert got[-1]["may"] and sum(not g["may"] for g in got) > 1000 and sum(same_word(g["u"], g["v"]) for g in got) > 1000
    assert all(g["may"] for g in got if same_word(g["u"], g["v"]))


def test_hashes_are_those_of_spark(spark):
    keys = [[], ["p|12|298598", ""], ["s|12|grotrusar|kl", "é" * 50]]
    want = [[r[0] for r in spark.createDataFrame([(k,) for k in some], "k string").select(F.xxhash64("k")).collect()] for some in keys]
    assert key_hashes(keys).to_pylist() == want


def test_names_are_weighed_only_where_they_decide(spark):
    """The same matches stay as if all edges were weighed at both ends."""
    r = random.Random(6)
    street = lambda: r.choice(["Grotrussar Road", "Zijirfor Vihar"])
    name = lambda: " ".join(r.choices(["Hokla", "Dratro", "Zorsa", "Tapril", "Munda"], k=2)) + r.choice([" Bakery", " Footwear", ""])
    rows = lambda s, n: [(f"{s}-{i}", name(), f"{r.randint(1, 3)} {street()}, Klaporgarh, Grokenesh" + r.choice([" 298598", ""])) for i in range(n)]
    found = records(spark, rows("S1", 25), rows("S2", 30))
    edges, weights = _place_edges(found), {(x["a"], x["b"]): x["weight"] for x in _edges(found).collect()}
    form = {x["id"]: x["form"] for x in found.collect()}
    assert all(most_attributes(f) >= len(attributes_of(f)) for f in form.values())
    every = [(x["a"], x["b"], form[x["a"]], form[x["b"]], 1.0, x["place"], most_attributes(form[x["b"]])) for x in edges.collect()]
    matches = spark.createDataFrame(every, "a string, b string, fa string, fb string, s double, place double, most int")
    assert set(weights) == {x[:2] for x in every}
    for ratio in (0.4, 0.9, 1.3):
        mean = {}
        for end in (0, 1):
            for x in {p[end] for p in weights}:
                at = [w for p, w in weights.items() if p[end] == x]
                mean[x] = ratio * sum(at) / len(at)
        want = {p for p, w in weights.items() if w >= min(mean[p[0]], mean[p[1]]) + 1e-4}
        near = {p for p, w in weights.items() if abs(w - min(mean[p[0]], mean[p[1]])) < 1e-4}
        got = {(x["a"], x["b"]) for x in _prune(found, edges, matches, ratio).collect()}
        assert got - near == want and (ratio < 0.5 or len(got) < len(weights))
