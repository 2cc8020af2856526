"""Which postal addresses denote the same place.

An address is brought to one spelling and read in every plausible way: a place word may be a town or a region, a
long number a house number or a postcode, a letter behind the number part of it or a direction, and where no street type
is given the street may stand at several places. Combinations of the components of every reading are hashed; addresses
that share any hash are compared once, rejected where house numbers conflict, and accepted where street and town agree in
some reading of each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kithmark.llm.forms import consistent_form
from kithmark.llm.strings import lcs_ratio, sounds, within
from kithmark.runtime import cut

# Written forms of street types.
STREET_TYPES = {
    "street": "street", "str": "street", "st": "street", "road": "road", "rd": "road", "avenue": "avenue", "ave": "avenue",
    "av": "avenue", "lane": "lane", "ln": "lane", "la": "lane", "gali": "lane", "nagar": "nagar", "ngr": "nagar",
    "vihar": "vihar", "vhr": "vihar", "colony": "colony", "clny": "colony", "col": "colony", "marg": "marg", "mg": "marg",
    "drive": "drive", "dr": "drive", "court": "court", "ct": "court", "crt": "court", "boulevard": "boulevard",
    "blvd": "boulevard", "bd": "boulevard", "boul": "boulevard", "square": "square", "sq": "square", "sqr": "square",
    "allee": "allee", "all": "allee", "rue": "rue", "r": "rue", "place": "place", "pl": "place", "plc": "place", "chemin": "chemin",
    "terrace": "terrace", "ter": "terrace", "way": "way", "parkway": "parkway", "pkwy": "parkway",
}
#: Types that stand before the name of the street.
LEADING = {"allee", "rue", "place", "boulevard", "avenue", "chemin"}
COUNTRY_WORDS = {"india", "us", "usa", "france", "germany", "brazil", "kenya", "portugal", "bharat", "deutschland"}
MISSING = {"", "null", "none", "nan", "n/a", "na", "-"}

_TOKEN = re.compile(r" - |\d+(?:/\d+)?[a-z]*|[a-z]+(?:-[a-z]+)*|[,;|#]")
_HOUSE = re.compile(r"\d{1,6}(?:/\d{1,4})?[a-z]?")
# Words that begin something other than street, town or number, and what they begin.
_BEGINS = (
    dict.fromkeys(("near", "nr", "behind", "opposite", "opp", "beside", "next", "adjacent"), "landmark")
    | dict.fromkeys(("unit", "flat", "suite", "apartment", "apt", "shop", "room", "phase", "sector", "block", "ward"), "unit")
    | dict.fromkeys(("door", "house", "plot", "bldg", "building", "kh", "h", "no", "number", "n"), "prefix")
    | dict.fromkeys(("ground", "first", "second", "third", "top"), "level")
    | {"floor": "floor", "fl": "floor", "flr": "floor", "null": "nothing"}
)
# Two words that tell where about, not which town.
_PHRASES = {"main": {"bazar", "bazaar", "market", "gate"}, "old": {"town", "market", "bazar"}} | dict.fromkeys(("rear", "front", "side", "back"), {"entrance", "gate", "door", "wing"})
_DIRECTIONS = {"n": "north", "s": "south", "e": "east", "w": "west", "north": "north", "south": "south", "east": "east", "west": "west"}
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*")
_FLOOR = {"floor", "fl", "flr"}
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)")


_TURNS = frozenset("nsew")


def plain(text: str | None) -> str:
    """Consistent form, lower case, without accents; '' for a missing value."""
    if text is None:
        return ""
    t = consistent_form(text).lower()
    if not t.isascii():
        t = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) <= 0x36F))
    t = " ".join(t.split())
    return "" if t in MISSING else t


@lru_cache(maxsize=10_000)
def _country_words(country: str | None) -> frozenset[str]:
    return frozenset(_WORD.findall(plain(country))) | COUNTRY_WORDS


def _scan(raw_toks: list[str], turn: bool) -> tuple[str, str, str, list[str]]:
    """(number, postcode, direction, words and marks) of an address; ``turn``: a letter behind the number is a direction."""
    toks: list[str] = []
    longs: list[int] = []
    number = direction = ""
    i, n = 0, len(raw_toks)
    while i < n:
        w = raw_toks[i]
        c = w[0]
        nxt = raw_toks[i + 1] if i + 1 < n else "|"
        i += 1
        if c.isdigit():
            if nxt in _FLOOR and (w.isdigit() or _ORDINAL.fullmatch(w)):
                i += 1
                toks.append("|")
            elif len(w) in (5, 6) and w.isdigit():
                longs.append(len(toks))
                toks.append(w)
            elif not number and _HOUSE.fullmatch(w):
                number = w
                if len(nxt) == 1 and nxt.isalpha() and nxt != "r" and w[-1].isdigit() and not turn:
                    number += nxt
                    i += 1
                toks.append("#")
            else:
                toks.append("|")
        elif c == "#":
            toks.append("|")
        elif not c.isalpha():
            toks.append("|")
        elif w in _DIRECTIONS and toks and toks[-1] == "#" and nxt[0].isalpha() and nxt not in STREET_TYPES:
            direction = _DIRECTIONS[w]
        elif nxt in _PHRASES.get(w, ()):
            i += 1
            toks.append("|")
        else:
            begins = _BEGINS.get(w)
            if begins is None:
                toks.append(w)
            elif begins == "prefix":
                continue
            elif begins == "landmark":
                if nxt == "to" and w in ("next", "adjacent"):
                    i += 1
                for _ in range(2):
                    if i < n and raw_toks[i][0].isalpha():
                        i += 1
                toks.append("|")
            elif begins == "unit":
                j = i
                while j < n and raw_toks[j] in ("#", "no"):
                    j += 1
                if j < n and (raw_toks[j][0].isdigit() or len(raw_toks[j]) == 1 and raw_toks[j].isalpha()):
                    i = j + 1
                    toks.append("|")
                else:
                    toks.append(w)
            elif begins == "level":
                if nxt in _FLOOR:
                    i += 1
                    toks.append("|")
                else:
                    toks.append(w)
            elif begins == "floor":
                if nxt.isdigit() and number:
                    i += 1
                toks.append("|")
            else:
                toks.append("|")
    # a long number is the postcode, unless there is no other for the house
    if not number and longs and (len(longs) > 1 or longs[0] == 0 or longs[0] + 1 < len(toks) and toks[longs[0] + 1] not in "|"):
        number, toks[longs[0]] = toks[longs[0]], "#"
        del longs[0]
    post = toks[longs[-1]] if longs else ""
    for k in longs:
        toks[k] = "|"
    return number, post, direction, toks


def read_address(raw: str | None, country: str | None = None) -> list[dict]:
    """Every plausible reading of an address, the likeliest first, as dicts of READING; [] if it is missing.

    Where only one place word is left, it may be the town or a region (then ``lone`` is set). Where no street type is given, the street is
    the first word, or the word behind or before the number.
    """
    t = plain(raw)
    if not t:
        return []
    raw_toks = _TOKEN.findall(t)
    skip = _country_words(country)
    turns = not _TURNS.isdisjoint(raw_toks) and any(x[0].isdigit() and y in _TURNS and z[0].isalpha() and z not in STREET_TYPES for x, y, z in zip(raw_toks, raw_toks[1:], raw_toks[2:]))
    out: list[dict] = []
    for turn in (False, True)[: 1 + turns]:
        number, post, direction, toks = _scan(raw_toks, turn)
        street = kind = ""
        for i, w in enumerate(toks):
            if w in STREET_TYPES:
                k = STREET_TYPES[w]
                before = toks[i - 1] if i else "|"
                after = toks[i + 1] if i + 1 < len(toks) else "|"
                if k in LEADING and after[0].isalpha() and after not in STREET_TYPES and not before[0].isalpha():
                    street, kind = after, k
                    toks[i] = toks[i + 1] = "|"
                    break
                if before[0].isalpha() and before not in STREET_TYPES and w != "r":
                    street, kind = before, k
                    toks[i] = toks[i - 1] = "|"
                    break
        full = [i for i, w in enumerate(toks) if w[0].isalpha() and len(w) > 2 and w not in skip]
        ways = [(street, full)]
        if not street and number and full:
            at = toks.index("#") if "#" in toks else -1
            ways = [(toks[i], [j for j in full if j != i]) for i in dict.fromkeys(i for i in (full[0], at + 1, at - 1) if i in full)]
        for s, places in ways:
            first, last = (toks[places[0]], toks[places[-1]]) if places else ("", "")
            out.append(dict(zip(READING, (number, direction, s, kind, post, first, last if len(places) > 1 else "", ""))))
            if len(places) == 1:
                out.append(dict(zip(READING, (number, direction, s, kind, post, "", first, "1"))))
    return [r for k, r in enumerate(out) if r not in out[:k]]


def same_word(a: str, b: str) -> bool:
    """Equal but for typing errors."""
    if a == b:
        return True
    x, y = sounds(a), sounds(b)
    if x == y:
        return True
    if min(len(a), len(b)) < 4:
        return False
    return within(x, y, 1 if min(len(x), len(y)) < 7 else 2) or within(a, b, 1 if min(len(a), len(b)) < 7 else 2)


def _same_reading(a: dict, b: dict, of_a: tuple, of_b: tuple) -> bool:
    if any(x["lone"] and not of[2] for x, of in ((a, of_a), (b, of_b))) and not (a["post"] and b["post"]):
        return False  # neither two postcodes nor the corpus say that the place word isn't the town
    if not a["number"] or a["number"] != b["number"]:
        return False
    if any(a[f] and b[f] and a[f] != b[f] for f in ("kind", "direction")):
        return False
    near = a["post"] and b["post"] and a["post"] != b["post"]  # a slip in a postcode neither supports nor refuses
    if near and not within(a["post"], b["post"], 1):
        return False
    pa, pb = a["post"] or of_a[1], b["post"] or of_b[1]
    both_posts = bool(pa) and pa == pb
    towns = None
    if a["town"] and b["town"]:
        towns = same_word(a["town"], b["town"]) or both_posts and lcs_ratio(a["town"], b["town"]) >= 0.7
    if towns is False or not (both_posts or towns):
        return False
    if a["street"] and b["street"]:
        return same_word(a["street"], b["street"]) or both_posts and bool(towns) and lcs_ratio(a["street"], b["street"]) >= 0.7
    return both_posts


def same_place(a: tuple, b: tuple) -> bool:
    """Whether number, street and town agree, as far as they are given, in some reading of either address.

    An address is (readings, guess, region). The guess is the postcode that the corpus knows for the street, and can support a match,
    never refuse it; region says that the corpus knows the only place word for a region.
    """
    return any(_same_reading(x, y, a, b) for x in a[0] for y in b[0])


def no_conflict(a: tuple, b: tuple) -> bool:
    """Whether in some reading no part that both give differs; said of addresses too poor for ``same_place``."""
    def differ(x: dict, y: dict) -> bool:
        return any(x[f] and y[f] and x[f] != y[f] for f in ("number", "kind", "post")) or not all(same_word(x[f], y[f]) for f in ("street", "town") if x[f] and y[f])

    return any(not differ(x, y) for x in a[0] for y in b[0])


#: Fields of a reading in their packed order.
READING = ("number", "direction", "street", "kind", "post", "town", "region", "lone")
#: Between fields, between readings, and before the guessed postcode and the mark of a region.
SEPARATOR, NEXT, GUESS = "\x1f", "\x1e", "\x1d"


def pack(readings: list[dict]) -> str | None:
    """Readings as one text; columns of texts cross to Python and back far quicker than structs."""
    return NEXT.join(SEPARATOR.join(r.values()) for r in readings) or None


@lru_cache(maxsize=10_000)
def unpack_place(text: str) -> tuple:
    """(readings, guess, region) of a packed place."""
    read, guess, region = text.split(GUESS)
    return [dict(zip(READING, r.split(SEPARATOR))) for r in read.split(NEXT)], guess, bool(region)


def place_keys(readings: list[dict]) -> tuple[list[str], list[str]]:
    """(strong, weak) keys of all readings; none without a house number.

    Strong: number and postcode. Weak: number, street and either end of the town; number, town and either end of the
    street. Addresses at one place share a strong key or, with up to one slip in street or town, a weak one.
    """
    strong, weak = set(), set()
    for r in readings:
        n, s, t = r["number"], sounds(r["street"]), sounds(r["town"])
        if not n:
            continue
        if r["post"]:
            strong.add(f"p|{n}|{r['post']}")
        if s and t:
            weak |= {f"s|{n}|{s}|{t[:2]}", f"e|{n}|{s}|{t[-2:]}", f"t|{n}|{t}|{s[:2]}", f"u|{n}|{t}|{s[-2:]}"}
    return sorted(strong), sorted(weak)


#: Letters a to z as bits, those of a town as it is written and, behind them, as it sounds.
LETTERS = (1 << 26) - 1


@lru_cache(maxsize=10_000)
def town_bits(town: str) -> int:
    """Which letters a town has, as it is written and as it sounds."""
    written, heard = (sum({1 << (ord(c) - 97) for c in w if "a" <= c <= "z"}) for w in (town, sounds(town)))
    return heard << 26 | written


def may_be_town(a: Column, b: Column) -> Column:
    """False only for ``town_bits`` of which ``same_word`` denies the towns: two errors, as it is written or as it sounds, change four letters at most. Null may be any."""
    other = a.bitwiseXOR(b)
    return F.coalesce((F.bit_count(other.bitwiseAND(F.lit(LETTERS))) <= 4) | (F.bit_count(F.shiftright(other, 26)) <= 4), F.lit(True))


def lone_town(readings: list[dict]) -> int | None:
    """``town_bits`` of the town, if all readings with town and street have the same one."""
    towns = {r["town"] for r in readings if r["town"] and r["street"]}
    return town_bits(towns.pop()) if len(towns) == 1 else None


def key_hashes(keys: list[Collection[str]]) -> pa.Array:
    """The hash of each key, the same that ``xxhash64`` gives."""
    flat = [k for some in keys for k in some]
    hashes = np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 42) for k in flat), dtype=np.uint64, count=len(flat)).view(np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)], dtype=np.int32), pa.array(hashes))


def places_of(df: DataFrame, keep: list[str], raw: str, country: str, where: str | None = None, add: Callable[[dict], dict] | None = None, more: str = "") -> DataFrame:
    """``keep, addr, strong, weak, open, town``: packed readings of the addresses and the hashes of their keys.

    ``open``: an address without a postcode of its own; if the corpus knows its street under one postcode only,
    that is guessed. Its only place word is a region if the corpus has it more often behind another place word than
    before one. ``town``: see ``lone_town``. ``where``: a column that must not be null for an address to be read. ``add`` gets the columns of a batch as
    lists and gives those that are kept instead of ``keep``, and may leave rows out; ``more`` is their schema.
    """
    kept = more or ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)
    schema = kept + ", addr string, numbers array<string>, street string, post string, first string, last string, town bigint, strong array<bigint>, weak array<bigint>"
    asked = list(dict.fromkeys([*keep, raw, country] if add is None else df.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if add is None:
                own = {c: b.column(c) for c in keep}
                texts = {c: b.column(c).to_pylist() for c in {raw, country, *([where] if where else [])}}
            else:
                texts = add(b.to_pydict())
                own = {c: v for c, v in texts.items() if c not in (raw, country)}
            wanted = [w is not None for w in texts[where]] if where else repeat(True)
            read = [read_address(r, c) if w else [] for r, c, w in zip(texts[raw], texts[country], wanted)]
            keys = [place_keys(r) for r in read]
            # the guess is asked for where a street has no postcode
            text = {
                "addr": list(map(pack, read)), "numbers": [sorted({x["number"] for x in r} - {""}) if r and r[0]["street"] and not r[0]["post"] else [] for r in read],
                "street": [f"{sounds(r[0]['street'])}|{r[0]['kind']}" if r and r[0]["street"] else None for r in read],
                "post": [r[0]["post"] or None if r else None for r in read], "first": [sounds(r[0]["town"]) or None if r else None for r in read],
                "last": [sounds(r[0]["region"]) or None if r else None for r in read],
            }
            text = {c: pa.array(v, pa.list_(pa.string()) if c == "numbers" else pa.string()) for c, v in text.items()}
            own = {c: v if isinstance(v, pa.Array) else pa.array(v, pa.string()) for c, v in own.items()}
            yield pa.RecordBatch.from_pydict(own | text | {"town": pa.array(map(lone_town, read), pa.int64()), "strong": key_hashes([k[0] for k in keys]), "weak": key_hashes([k[1] for k in keys])})

    parsed = cut(df.select(*asked).mapInArrow(run, schema))
    keep = [c for c in parsed.columns if c not in ("addr", "numbers", "street", "post", "first", "last", "town", "strong", "weak")]
    posts = parsed.where("post is not null and street is not null").groupBy("street").agg(F.min("post").alias("guess"), F.max("post").alias("hi")).where("guess = hi").drop("hi")
    where_about = lambda c, x, y: parsed.where(f"{c} is not null and last is not null").groupBy(F.col(c).alias("word")).agg(F.sum(F.lit(x)).alias("behind"), F.sum(F.lit(y)).alias("before"))
    regions = where_about("last", 1, 0).unionByName(where_about("first", 0, 1)).groupBy("word").agg(F.sum("behind").alias("behind"), F.sum("before").alias("before")).where("behind > before")
    lacking = F.expr("addr is not null and post is null and street is not null and size(numbers) > 0")
    both = parsed.where(lacking).join(posts, "street", "left").unionByName(parsed.where(~lacking).withColumn("guess", F.lit(None).cast("string")))
    # only a lone place word is asked for
    lone = F.expr("first is not null and last is null")
    alone = both.where(lone).join(regions.select(F.col("word").alias("first"), F.lit(True).alias("region")), "first", "left")
    both = alone.unionByName(both.where(~lone).withColumn("region", F.lit(False)))
    guessed = F.when(F.col("guess").isNotNull(), F.transform("numbers", lambda n: F.xxhash64(F.concat(F.lit("p|"), n, F.lit("|"), F.col("guess"))))).otherwise(F.col("strong"))
    return both.select(
        *keep, F.concat("addr", F.lit(GUESS), F.coalesce("guess", F.lit("")), F.lit(GUESS), F.when(F.col("region"), "1").otherwise("")).alias("addr"), guessed.alias("strong"), "weak",
        F.expr("addr is not null and post is null").alias("open"), "town",
    )


def with_places(df: DataFrame, keep: list[str], raw: str, country: str, where: str | None = None) -> DataFrame:
    """``places_of`` without towns, written to a table."""
    return cut(places_of(df, keep, raw, country, where).drop("town"))


def met(left: DataFrame, right: DataFrame, attrs: tuple[str, ...] = ()) -> DataFrame:
    """``a, b, k``: ids that share a key, once for each key; both sides have ``id, strong, weak, open``.

    With ``attrs``, these columns of either side come out too, with a and b behind their names, and ``by_weak``: whether the key is a weak one.
    Strong keys are asked everywhere, the weaker ones here where one side has no postcode; see ``met_in_spite`` for the rest.
    """
    ids = lambda d, x, k: d.select(F.explode(k).alias("k"), F.col("id").alias(x), *[F.col(c).alias(c + x) for c in attrs])
    of = lambda kind, d: d.withColumn("by_weak", F.lit(kind == "weak")) if attrs else d
    some = of("strong", ids(left, "a", "strong").join(ids(right, "b", "strong"), "k"))
    some = some.unionByName(of("weak", ids(left.where("open"), "a", "weak").join(ids(right, "b", "weak"), "k")))
    return some.unionByName(of("weak", ids(left.where("not open"), "a", "weak").join(ids(right.where("open"), "b", "weak"), "k")))


def met_in_spite(left: DataFrame, right: DataFrame) -> DataFrame:
    """``a, b``: ids with different postcodes (one may be a slip) that share a weaker key, each pair once."""
    ids = lambda d, x: d.where("not open").select(F.explode("weak").alias("k"), F.col("id").alias(x), F.col("strong").alias("s" + x))
    return ids(left, "a").join(ids(right, "b"), "k").where(~F.arrays_overlap("sa", "sb")).select("a", "b").distinct()


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ok = [same_place(unpack_place(x), unpack_place(y)) for x, y in zip(b["aa"], b["ab"])]
        yield b.loc[ok, ["a", "b"]]


def same_place_pairs(df: DataFrame, *, record: str, raw: str, normalized: str, country: str) -> DataFrame:
    """``entity_id_a, entity_id_b``: records at the same place whose normalised addresses differ.

    Records with the same normalised address are copies: only one of them is parsed and compared; the
    matches are given to all of them by equi-joins. Missing addresses (null, empty, blank, the word null) and
    addresses without a house number are never cases. Repeated rows count once, empty input gives no
    pairs, further columns are ignored, long texts are read whole.
    """
    rows = df.select(F.col(record).alias("id"), F.col(raw).alias("raw"), F.coalesce(F.col(normalized), F.lit("")).alias("norm"), F.col(country).alias("country"))
    rows = rows.where("norm <> '' and id is not null").dropDuplicates(["id", "norm"])
    texts = rows.groupBy(F.col("norm").alias("id")).agg(F.min(F.struct("raw", "country")).alias("m")).select("id", "m.raw", "m.country")
    placed = with_places(texts, ["id"], "raw", "country").where("size(strong) + size(weak) > 0")
    cand = met(placed, placed).select("a", "b").unionByName(met_in_spite(placed, placed)).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda x: placed.select(F.col("id").alias(x), F.col("addr").alias("a" + x))
    cand = cand.join(of("a"), "a").join(of("b"), "b")
    links = cand.select("a", "b", "aa", "ab").mapInPandas(_compare, "a string, b string")
    ids = rows.select("id", "norm")
    pairs = (
        links.join(ids.select(F.col("norm").alias("a"), F.col("id").alias("x")), "a")
        .join(ids.select(F.col("norm").alias("b"), F.col("id").alias("y")), "b")
        .where("x <> y")
    )
    return pairs.select(F.least("x", "y").alias("entity_id_a"), F.greatest("x", "y").alias("entity_id_b")).distinct()
