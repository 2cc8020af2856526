import itertools

import pytest

from kithmark.llm.addresses import GUESS, pack, place_keys, read_address, same_place, same_place_pairs, unpack_place

COLUMNS = "entity_id string, business_address string, business_address_normalized string, country string, open int, addr string"


def rows(addresses):
    return [(f"S1-{i:03d}", a, (a or "").lower(), "India", 1, "clash") for i, a in enumerate(addresses)]


def pairs(spark, table):
    df = spark.createDataFrame(table, COLUMNS)
    got = same_place_pairs(df, record="entity_id", raw="business_address", normalized="business_address_normalized", country="country").collect()
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return {tuple(r) for r in got}


SAME = [
    "12 Grotrussar Road, Klaporgarh, Grokenesh 298598", "#12 Grotrussar Rd., Ward 4, Klaporgarh - 298598", "Klaporgarh, 298598, 12 Grotrusar Road", "12 GROTRUSSAR ROAD KLAPORGARH GROKENESH",
    "Flat 3, Door No. 12 Grotroossar Rd; near Water Tank; Klaporgarh; 298598, India", "Ground Floor, Grotrussar Road 12, 298598",
]
OTHER = ["12B Grotrussar Road, Klaporgarh, Grokenesh 298598", "14 Grotrussar Road, Klaporgarh 298598", "12 Zijirfor Vihar, Klaporgarh 298599", "12 Grotrussar Road, Stellargaon, Grokenesh 394937", "12 Grotrussar Lane, Klaporgarh, 298600"]


def test_same_and_other_places(spark):
    table = rows(SAME + OTHER)
    want = {tuple(sorted(p)) for p in itertools.combinations([r[0] for r in table[: len(SAME)]], 2)}
    want -= {("S1-003", "S1-005")}  # one has no postcode, the other no town, and the street is in two towns
    assert pairs(spark, table) == want


def test_every_pair_is_met_that_comparison_accepts(spark):
    """Against all pairs compared one by one, without the guesses of the corpus."""
    table = rows([f"{n} {s} {k}, {t}, {p}" for n in (1, 2) for s, k, p in (("Gorlam", "Road", 111111), ("Gorlaam", "Rd.", 111111), ("Pelnu", "Street", 222222)) for t in ("Vanmil", "Vanmill")])
    parsed = {r[0]: (read_address(r[1], r[3]), "", False) for r in table}
    want = {(a, b) for a, b in itertools.combinations(sorted(parsed), 2) if same_place(parsed[a], parsed[b])}
    assert want and pairs(spark, table) == want


def test_edges(spark):
    table = rows([None, "", " ", "null", "no number street"]) + [("S1-900", SAME[0], SAME[0].lower(), None, 0, None)] * 2
    table += [("S1-901", SAME[0], SAME[0].lower(), "India", 0, None), (None, SAME[1], SAME[1].lower(), "India", 0, None), ("S1-902", SAME[0] + " near old mill" * 4000, "long", "India", 0, "")]
    assert pairs(spark, table) == {("S1-900", "S1-902"), ("S1-901", "S1-902")}
    assert pairs(spark, []) == set()


@pytest.mark.parametrize("raw, number, street, kind, post, town", [
    ("H.No. 129 Kepumar Road, Trothuprilpur, 420082, India", "129", "kepumar", "road", "420082", "trothuprilpur"),
    ("2nd Floor, Near Water Tank, 125 allee Vsuajom, 11494 Tanecourt", "125", "vsuajom", "allee", "11494", "tanecourt"),
    ("126 R Sunketar, 15423", "126", "sunketar", "rue", "15423", ""), ("KH NO. -149 Tharmodrom Marg., Behind Grain Silo, Gunsten 344381", "149", "tharmodrom", "marg", "344381", "gunsten"),
    ("Tugeelsta Court No. 190, JB 76423", "190", "tugeelsta", "court", "76423", ""),
])
def test_parse(raw, number, street, kind, post, town):
    p = read_address(raw, "India")[0]
    assert (p["number"], p["street"], p["kind"], p["post"], p["town"]) == (number, street, kind, post, town)


def test_pack_keeps_fields():
    p = read_address(SAME[0], None)
    assert pack(p).split("\x1f")[0] == "12" and pack([]) is None
    assert unpack_place(pack(p) + GUESS + "298598" + GUESS) == (p, "298598", False)


@pytest.mark.parametrize("a, b, want", [
    ("120 Oak Road, Dallas 75201", "120 Oak Rd, Dallas 75210", True), ("120 Oak Road, Dallas 75201", "120 Oak Rd, Dallas 75999", False), ("12345 Oak Road, Dallas 75201", "12345 Oak Rd Dallas 75201", True),
    ("12345 Oak Road, Dallas", "12345 Oak Rd, Dallas", True), ("77 West Main Street, Dallas", "77 W Main St, Dallas", True), ("77 East Main Street, Dallas", "77 W Main St, Dallas", False), ("Bigtown, 12 Zorla", "12 Zorla Road, Bigtown", True),
    ("12 B Marg, Pune 411001", "12B Marg, Pune 411001", True), ("12 Oak Road, Dallas", "12B Oak Road, Dallas", False), ("5 Elm St, Springfield 62701", "5 Elm St, Shelbyville 62565", False), ("5 Elm St, Springfield", "5 Elm Lane, Springfield", False),
    ("120 Oak Road, Dallas 75201", "120 Oaak Road, Dallas 75210", True), ("120 Oak Road, Dalas 75201", "120 Oak Road, Dallas 75210", True),
])
def test_readings_agree_and_meet(a, b, want):
    x, y = read_address(a), read_address(b)
    assert same_place((x, "", False), (y, "", False)) is want
    if want:
        assert set(sum(place_keys(x), [])) & set(sum(place_keys(y), []))


def test_slips_in_postcodes_and_long_numbers(spark):
    """Also among many addresses that share number and street."""
    table = rows(["120 Oak Road, Dallas 75201", "120 Oak Rd, Dallas 75210", "12345 Elm Road, Austin 73301", "12345 Elm Rd Austin 73301", "77 West Main Street, Dallas", "77 W Main St, Dallas"] + [f"120 Oak Road, Townof{c}{d}ville {75300 + 97 * i}" for i, (c, d) in enumerate(itertools.product("bcdfghjklm", "rstvwxznpq"))])
    got = pairs(spark, table)
    assert {("S1-000", "S1-001"), ("S1-002", "S1-003"), ("S1-004", "S1-005")} == {p for p in got if int(p[0][3:]) < 6}
