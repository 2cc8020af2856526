import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from kithmark.llm.forms import LOOK_ALIKES, consistent_form, examine, read_confusables, text_forms

CASES = {
    "Ａｎｎｖｉｒａ　Ｔｅａ": "Annvira Tea", "Tea House": "Tea House", "Te​a": "Tea", "Café": "Café", "ﬁne": "fine",
    "Mоbile": "Mobile", "Ѕіӏо Lane": "Silo Lane", "Lɑne": "Lane", "A‑B": "A-B", "serviϲes": "services", "Ϲafé": "Cafe"[:3] + "é", "﻿X": "X", "so­ft": "soft",
}
PLAIN = ["Café Brénor", "होक्ल द्रत्रो मेडिकल", "two  spaces", "n° 98", "Сестра Мария", "", "plain", "ÀÉÎ", "Αθήνα", "tab\tbed", "ресурс", "осоку", "НОРА", "ТОО Восток"]


@pytest.mark.parametrize("raw", CASES)
def test_cases(raw):
    assert examine(raw) == (True, CASES[raw])


@pytest.mark.parametrize("raw", PLAIN)
def test_plain(raw):
    assert examine(raw) == (False, raw)


@pytest.mark.parametrize("raw, want", [("москвa", "москва"), ("Αθήνa", "Αθήνα"), ("Tесо Ltd", "Teco Ltd"), ("Ltd ТЕСО", "Ltd TECO"), ("ꓢuraya", "Suraya")])
def test_script_that_fits(raw, want):
    assert examine(raw) == (True, want)


def test_confusables_file(tmp_path):
    path = tmp_path / "table.txt"
    path.write_text("\ufeff# comment\n0430 ;\t0061 ;\tMA\t# a\n1D41A ; 0061 ; MA\n0133 ; 0069 006A ; MA\n", encoding="utf-8")
    assert read_confusables(str(path)) == {"а": "a", "𝐚": "a"}


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcXYZ é9-​ ｗａАеοɑΈ"), max_size=30))
def test_form_is_stable_and_composed(s):
    form = consistent_form(s)
    assert consistent_form(form) == form
    assert unicodedata.normalize("NFC", form) == form
    assert "​" not in form and " " not in form


@settings(max_examples=200, deadline=None)
@given(st.text("abcdehijklmnopstuxyz", min_size=3, max_size=10), st.data())
def test_disguise_is_undone(word, data):
    back = {}
    for k, v in LOOK_ALIKES.items():
        if k == "ı":  # a usual letter of Turkish
            continue
        back.setdefault(v, []).append(k)
    at = data.draw(st.integers(0, len(word) - 1))
    if word[at] in back:
        text = "plain " + word[:at] + data.draw(st.sampled_from(back[word[at]])) + word[at + 1 :]
        assert examine(text) == (True, "plain " + word)


def test_table(spark):
    rows = [("a", "Te​a", None, 1), ("a", "Te​a", None, 1), ("b", None, "", 2), ("c", "x" * 50_000 + "ｙ", "12 Main", 3), (None, "ok", "ok", 4)]
    df = spark.createDataFrame(rows, "entity_id string, name string, address string, affected int")
    out = text_forms(df, "entity_id", ["name", "address"]).collect()
    assert len(out) == 6
    hit = {(r["entity_id"], r["field_name"], r["consistent_value"]) for r in out if r["affected"]}
    assert hit == {("a", "name", "Tea"), ("c", "name", "x" * 50_000 + "y")}
    assert text_forms(df.where("false"), "entity_id", ["name"]).count() == 0
