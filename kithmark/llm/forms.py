"""One consistent spelling for text that looks alike but differs in its characters.

Follows the public rules for confusable detection (Unicode TS 39): the script sets of the letters of
a token are intersected; an empty intersection is a mixed-script token, a token of one foreign script
made of look-alikes only is a whole-script confusable if there is Latin writing beside it. A mixed token takes the spelling
in the script in which all of it can be written, Latin first; a whole-script confusable takes the Latin one. Words of
another script that stand alone are left as they are. Everything else is brought to composed compatibility form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

# Letters of other alphabets (and phonetic Latin letters) and the Latin letter they look like.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУѴԌԚԜаеѕіјорсухһӏԁԛԝѵгк" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϲοαινρυκγ" + "ɑɡıɩʟɢʀʏſ" + "ՕՏՍԼօսոհցզ" + "ᎪᏴᏟᎠᎬᎳᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᏃ",
        "ABESIJKMHOPCTXYVGQWaesijopcyxhldqwvrk" + "ABEZHIKMNOPTYXCcoaivpuky" + "agiilgrys" + "OSULounhgq" + "ABCDEWGHJKLMPRSTVZ",
    )
)
# Letters of Lisu that look like Latin capitals.
LOOK_ALIKES |= dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))


def read_confusables(path: str) -> dict[str, str]:
    """Single letters and the single Latin letters they look like, from a file in the format of the public confusables table.

    Lines are ``source ; target ; kind`` in code points; the result can stand in for, or be added to, LOOK_ALIKES.
    """
    out = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [x.strip().split() for x in line.split("#")[0].split(";")]
            if len(parts) >= 2 and len(parts[0]) == len(parts[1]) == 1:
                a, b = (chr(int(x[0], 16)) for x in parts[:2])
                if b.isalpha() and b.isascii() and not a.isascii():
                    out[a] = b
    return out


PHONETIC_LATIN = set("ɑɡɩʟɢʀʏſ")
#: Compatibility tags whose members stand for a usual character (super- and subscripts don't).
STANDS_FOR = {"<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<small>", "<square>"}
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee", "Lisu")
_SCRIPT_RE = [(s, regex.compile(rf"\p{{Scx={s}}}")) for s in _SCRIPTS]
ANY = frozenset(("any",))


@lru_cache(maxsize=65536)
def script_set(ch: str) -> frozenset[str]:
    """Scripts a character may belong to; marks and common characters belong to any."""
    if unicodedata.category(ch)[0] != "L":
        return ANY
    found = frozenset(s for s, r in _SCRIPT_RE if r.match(ch))
    return found or frozenset((unicodedata.name(ch, "?").split(" ")[0],))


@lru_cache(maxsize=16)
def _spellings(script: str) -> dict[str, str]:
    """Letters of any script and the letter of this script that looks the same."""
    to = dict(LOOK_ALIKES) if script == "Latin" else {}
    if script != "Latin":
        for a, b in reversed(LOOK_ALIKES.items()):
            if script_set(a) == {script}:
                to[b] = a
        to |= {a: to[b] for a, b in LOOK_ALIKES.items() if b in to and script_set(a) != {script}}
    return to


def _spelt_in(token: str, script: str) -> str | None:
    """The token with look-alikes replaced by letters of one script; None if it can't be written in that script."""
    to = _spellings(script)
    out = "".join(c if script in (s := script_set(c)) or s is ANY else to.get(c, c) for c in token) if script != "Latin" else "".join(to.get(c, c) for c in token)
    return out if all(script in s or s is ANY for s in map(script_set, out)) else None


@lru_cache(maxsize=65536)
def _kind(ch: str) -> str:
    """'' for an ordinary character, else why it isn't: unseen, space, hyphen, form or mark."""
    o, cat = ord(ch), unicodedata.category(ch)
    if o < 0x80:
        return "unseen" if (cat == "Cc" and ch not in "\t\n\r") else ""
    if cat in ("Cf", "Cc") or 0xFE00 <= o <= 0xFE0F or o in (0x115F, 0x1160, 0x3164, 0x034F, 0x2800):
        return "unseen"
    if cat in ("Zs", "Zl", "Zp"):
        return "space"
    if cat == "Pd" or o == 0x2212:
        return "hyphen"
    if 0x0300 <= o <= 0x036F:
        return "mark"
    d = unicodedata.decomposition(ch)
    if d.startswith("<") and d.split(" ", 1)[0] in STANDS_FOR:
        return "form"
    return ""


def resolve_tokens(text: str) -> tuple[str, bool]:
    """Replaces confusable tokens by their consistent spelling; second: whether there was one."""
    tokens = list(_TOKEN.finditer(text))
    sets = []
    for m in tokens:
        own = [script_set(c) for c in m.group()]
        own = [s for s in own if s is not ANY]
        inter = frozenset.intersection(*own) if own else ANY
        sets.append((inter, frozenset().union(*own) if own else ANY))
    latin_near = any("Latin" in u for _, u in sets) or any(len(u) > 1 and not i for i, u in sets)
    out, at, hit = [], 0, False
    for m, (inter, union) in zip(tokens, sets):
        tok = m.group()
        phonetic = any(c in PHONETIC_LATIN for c in tok)
        new = tok
        if phonetic or (union is not ANY and union != {"Latin"}):
            mixed = not inter and len(union) > 1
            whole = bool(inter) and "Latin" not in inter and latin_near
            scripts = ["Latin", *sorted(union - {"Latin"})] if mixed else ["Latin"]
            spelled = next((x for x in (_spelt_in(tok, s) for s in scripts) if x is not None), None)
            if spelled is not None and spelled != tok and (phonetic or mixed or whole):
                new, hit = spelled, True
        out += [text[at : m.start()], new]
        at = m.end()
    out.append(text[at:])
    return "".join(out), hit


#: Accented Latin letters beside ASCII: each is one character, of one script, and stands for itself.
_USUAL = regex.compile(r"[ -~À-ÖØ-öø-ÿ]*")


def examine(text: str | None) -> tuple[bool, str | None]:
    """(holds a character that can't be seen or stands for a usual one, consistent form).

    Null stays null, empty stays empty; ASCII text without control characters, with accented Latin letters or without, is its own form.
    """
    if text is None:
        return False, None
    if text.isascii() and text.isprintable() or _USUAL.fullmatch(text):
        return False, text
    kinds = {_kind(c) for c in text}
    case = len(kinds - {""}) > 0
    seen = "".join(c for c in text if _kind(c) != "unseen") if "unseen" in kinds else text
    if kinds & {"space", "hyphen"}:
        seen = "".join(" " if (k := _kind(c)) == "space" else "-" if k == "hyphen" else c for c in seen)
    # look-alikes first: compatibility forms would turn some of them into other letters
    form, hit = resolve_tokens(unicodedata.normalize("NFC", seen))
    if case:
        form, again = resolve_tokens(unicodedata.normalize("NFKC", form))
        hit = hit or again
    return case or hit, form


def consistent_form(text: str | None) -> str | None:
    return examine(text)[1]


def text_forms(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``id_col, field_name, raw_value, consistent_value, affected`` for every value of the fields.

    ASCII values never reach Python; only the others go through Arrow batches. Nulls are left out,
    empty and blank texts are unaffected, texts of any length are handled whole, repeated rows give
    one row, further columns are ignored.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw_value")) for f in fields]))
    long = df.select(F.col(id_col).alias("rid"), pairs.alias("p")).select("rid", "p.*").where("raw_value is not null").distinct()
    odd = F.col("raw_value").rlike(r"[^\x20-\x7E\t\n\r]")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [examine(v) for v in b["raw_value"]]
            yield b.assign(consistent_value=[g[1] for g in got], affected=[g[0] for g in got])

    done = long.where(odd).mapInPandas(resolve, "rid string, field_name string, raw_value string, consistent_value string, affected boolean")
    plain = long.where(~odd).withColumn("consistent_value", F.col("raw_value")).withColumn("affected", F.lit(False))
    return done.unionByName(plain).withColumnRenamed("rid", id_col)
