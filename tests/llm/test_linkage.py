import random

from kithmark.llm.components import parse_links
from kithmark.llm.linkage import NAME_ALONE, _edges, _records, link, name_similarity, search_keys
from kithmark.runtime import table

COLUMNS = "entity_id string, business_name string, business_address string, country string, weight int, side string"
ARGS = {"record": "entity_id", "name": "business_name", "address": "business_address", "country": "country"}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], COLUMNS)


A = "12 Grotrussar Road, Klaporgarh, Grokenesh 298598"
B = "77 Zijirfor Vihar, Stellargaon, Grokenesh 394937"


def links(spark, left, right):
    got = link(frame(spark, left), [frame(spark, right)], **ARGS).collect()
    assert len({(r["left_id"], r["right_id"]) for r in got}) == len(got) and all(0 < r["confidence"] <= 1 for r in got)
    return {(r["left_id"], r["right_id"]) for r in got}


def test_firm_and_place_decide(spark):
    left = [("S1-1", "Hokla Dratro Industries", A, "India"), ("S1-2", "Suraya Mobile Point", A, "India"), ("S1-3", "Tapril Zorsa Footwear", None, "India"), ("S1-4", None, A, "India"), ("S1-1", "Hokla Dratro Industries", A, "India")]
    right = [("S2-1", "hoklaa dratro inds.", "#12 Grotrusar Rd, Klaporgarh 298598", "India"), ("S2-2", "Suraya Mobile Point", B, "India"), ("S2-3", "suraya mobile point", "12 Grotrussar Rd., Klaporgarh", "India"),
             ("S2-4", "Tapril Zorsa Ftwr", B, "India"), ("S2-5", "Tapril Zorsa Bakery", B, "India"), ("S2-6", None, None, None), ("S2-7", "Hokla Dratro Industries", "", "India"), ("S2-8", "x" * 30_000, "1 " * 9000, "")]
    assert links(spark, left, right) == {("S1-1", "S2-1"), ("S1-2", "S2-3"), ("S1-3", "S2-4"), ("S1-1", "S2-7")}


def test_empty_sides(spark):
    row = [("S1-1", "Hokla Dratro Industries", A, "India")]
    assert links(spark, row, []) == set() and links(spark, [], row) == set()


def test_recall_on_known_links(spark, sf_dir):
    matches = table(spark, sf_dir, "train_matches")
    truth = {tuple(r) for r in parse_links(matches, "source1_entity_id", "match_entity_ids").where("b is not null").distinct().collect()}
    got = link(table(spark, sf_dir, "train_source1_processed"), [table(spark, sf_dir, f"train_source{n}_processed") for n in (2, 3)], **ARGS).collect()
    found = {(r["left_id"], r["right_id"]) for r in got}
    assert len(truth & found) >= 0.95 * len(truth)


def test_many_exact_spellings_hide_no_misspelt_one(spark):
    name, wrong = "Klaporvenda Bakery", "Klaporvemda Bakery"
    place = lambda i: f"{i} Grotrussar Road, Klaporgarh, Grokenesh 298598"
    left = [(f"S1-{i}", name, place(i), "India") for i in range(1, 5)] + [("S1-9", wrong, place(9), "India")]
    right = [("S2-1", name, None, "India")] + [(f"S3-{i}", wrong, "null", "India") for i in range(15)]
    assert links(spark, left, right) == {(x[0], y[0]) for x in left for y in right}


def test_place_edges_weigh_shared_names(spark):
    place = "12 Grotrussar Road, Klaporgarh, Grokenesh 298598"
    left = [("S1-1", "Hokla Dratro Industries", place, "India"), ("S1-2", "Suraya Mobile Point", place, "India")]
    right = [("S2-1", "Hokla Dratra Industries", place, "India")]
    records = _records([("l", frame(spark, left)), ("r", frame(spark, right))], *ARGS.values())
    weight = {(r["a"], r["b"]): r["weight"] for r in _edges(records).collect()}
    assert weight["S1-1", "S2-1"] > weight["S1-2", "S2-1"]


def test_search_keys_hold_every_accepted_pair():
    r = random.Random(3)
    letters = "aeioubdgklmnprstvz"

    def wrong(w):
        for _ in range(r.randint(0, 2)):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
        return w

    accepted = 0
    for _ in range(4000):
        words = ["".join(r.choices(letters, k=r.randint(3, 9) if r.random() < 0.8 else r.randint(30, 60))) for _ in range(r.randint(1, 2))]
        turned = [wrong(w) for w in (words[::-1] if r.random() < 0.5 else words)]
        a, b = f"{' '.join(words)}|bakery|", f"{' '.join(turned)}|{r.choice(['bakery', ''])}|"
        if name_similarity(a, b) >= NAME_ALONE:
            accepted += 1
            assert set(search_keys(a, True)) & set(search_keys(b, False)) and set(search_keys(a, False)) & set(search_keys(b, True)), (a, b)
    assert accepted > 1000
    assert sum(map(len, search_keys("x" + "ab" * 15_000 + "|bakery|", True))) < 5_000_000
    native = "\u0938\u0941\u0930\u093e\u092f\u0924|?|"
    assert name_similarity("surayat|bakery|", native) >= NAME_ALONE and set(search_keys("surayat|bakery|", True)) & set(search_keys(native, False))


def test_names_without_address_meet_in_every_spelling(spark):
    left = [("S1-1", "Klaporvenda Bakery", None, "India"), ("S1-2", "Tapril Zorsa Footwear", "", "India"), ("S1-3", "Hokladratromunda Bakery", A, "India"), ("S1-4", "Munterviloka Footwear", A, "India")]
    right = [("S2-1", "Klaporvenda", B, "India"), ("S2-2", "Zorsa Tapril Footwear", A, "India"), ("S2-3", "Hoktadratromulda Bakery", None, "India"),
             ("S2-4", "Munterviloka Footwear", "Klaporgarh, Grokenesh 298598", "India"), ("S2-5", "Munterviloka Footwear", "Stellargaon, Grokenesh 394937", "India")]
    assert links(spark, left, right) == {(f"S1-{i}", f"S2-{i}") for i in range(1, 5)}
