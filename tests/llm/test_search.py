import itertools
import random

from kithmark.llm.forms import _USUAL, examine
from kithmark.llm.linkage import _name_weights, _records
from kithmark.llm.names import DELETED, meet, same_firm, search_hashes, search_keys, search_table

A, B = "12 Grotrussar Road, Klaporgarh, Grokenesh 298598", "77 Zijirfor Vihar, Stellargaon, Grokenesh 394937"


def test_hashes_are_those_of_the_search_keys():
    words = ["hokladratro", "hokla", "hok", "hokla dratro", "zorsa tapril munda", "ba" * 14, "x" + "ba" * 15, "xy" + "ba" * 15, "xyz" + "ba" * 15, "ba" * 40, "\U0001d4d0\ud800klador"]
    assert {len(w) for w in words} >= {DELETED - 1, DELETED, DELETED + 1}
    forms = [f"{w}|{t}|" for w in words for t in ("", "bakery", "garments~granite!munda garm")] + ["\u0938\u0941\u0930\u093e\u092f\u0924|?|"]
    places, keys = search_hashes(forms)
    hashed = [set(keys[places == i].tolist()) for i in range(len(forms))]
    spelt = [set(search_keys(f, True)) | set(search_keys(f, False)) for f in forms]
    for (h, k), (g, m) in itertools.combinations_with_replacement(list(zip(hashed, spelt)), 2):
        assert len(h & g) == len(k & m)


def test_search_finds_accepted_pairs_and_few_others(spark):
    r = random.Random(4)
    words = ["".join(r.choices(["bra", "kol", "rin", "tus", "mev", "lag", "dop", "sthe", "glu"], k=4)) for _ in range(600)]
    forms = sorted({f"{w}|{t}|" for w in words for t in r.choices(["bakery", "brewery", "hotel", ""], k=1)} | {f"{w[:5]}{w[6:]}|bakery|" for w in words[:60]})
    table = spark.createDataFrame([(f,) for f in forms], "form string")
    found = search_table(table)
    name = {r["h"]: r["form"] for r in table.selectExpr("form", "xxhash64(form) as h").collect()}
    got = {tuple(sorted((name[r["ha"]], name[r["hb"]]))) for r in meet(found, found).where("ha < hb").collect()}
    want = {(a, b) for a, b in itertools.combinations(forms, 2) if same_firm(a, b)}
    assert len(want) >= 60 and want <= got and len(got) < 20 * len(want)


def test_attributes_of_one_record_are_not_moved(spark):
    rows = [("S1-1", "Hokla Dratro Industries", A, "India"), ("S1-2", "Hokla Munterviloka Bakery", A, "India"), ("S1-3", "Suraya Mobile Point", A, "India"), ("S1-4", "Tapril Zorsa Footwear", A, "India"), ("S1-5", "Tapril Zorsa Footwear", B, "India")]
    columns = ("entity_id", "business_name", "business_address", "country")
    got = {r["form"].split("|")[0]: len(r["attrs"]) for r in _name_weights(_records([("l", spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)))], *columns)).collect()}
    assert got["hokla dratro"] == got["hokla munterviloka"] == 1 and got["tapril zorsa"] > 4 and len(got) == 3


def test_accented_letters_need_no_closer_look(monkeypatch):
    usual = [chr(c) for c in range(0x100) if _USUAL.fullmatch(chr(c))]
    assert {"a", "é", "ÿ"} <= set(usual) and not {"×", "÷", "ª", "µ", "\xa0", "\xad", "\t"} & set(usual)
    monkeypatch.setattr("kithmark.llm.forms._USUAL", __import__("re").compile("(?!)"))
    assert all(examine(t) == (False, t) for c in usual for t in (c, f"caf{c} br{c}nor", f"{c}-{c} 9"))
