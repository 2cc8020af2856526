"""Which spellings of business names mean the same firm.

A name is brought to one spelling and parsed into given name, proper name, trades and legal form with a
lexicon: general word lists, to which trades, given names and nicknames are added that the corpus itself shows.
Candidate spellings come from suffix blocking: every suffix of every token above a minimum length is
an index key; a suffix that is too common is used only together with further fields (trade, then parts of the
name that stand typing errors), chosen so that no accepted pair is separated. Candidates are compared by the ratio of
their longest common subsequence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from kithmark.llm.addresses import plain
from kithmark.llm.components import components
from kithmark.llm.strings import NearLookup, _one_less, _two_less, lcs_ratio, sounds, within
from kithmark.operators.heavy_keys import skew_join
from kithmark.runtime import cut

# General words for kinds of business; a parameter of the lexicon.
TRADES = tuple("""
    academy accessories accountants advertising agencies appliances architects associates auctioneers automobiles bakery bank barbers beauty
    bicycles boats books boutique brewery bricks brothers builders butchers cabinets cables cafe carpets catering cement center ceramics
    chemicals chemists cleaners clinic clothing college computers confectionery construction consultants contractors cosmetics couriers creations
    crafts dairy decorators dental design diner distributors drugstore dyeing education electricals electronics embroidery energy engineering
    enterprises equipment estates events exporters fabrics farms fashions fertilizers finance fisheries fittings florists flowers foods footwear foundry
    freight furnishings furniture garage garments gifts glass gloves granite graphics groceries guesthouse hairdressers handicrafts hardware health
    hospital hosiery hotel imports industries institute instruments insurance interiors international investments ironworks jewellers kennels
    kitchens laboratories landscaping laundry lawyers learning leather lighting linen locksmiths logistics lumber machinery manufacturing marble
    market masonry media medicals merchants metals milling mining motors museum music nursery oils opticians optics paints paper partners pharmacy
    photography pizza plastics plumbing polymers ports pottery poultry printing products properties publishers pumps radios realty refrigeration
    restaurant retail roofing rubber salon school seafood security seeds services shipping shoes software solar solutions spices sports stationery
    steel studio supplies surveyors systems tailors tannery taxis technologies textiles theatre tiles timber tobacco tools tourism toys traders
    training transport travels tyres upholstery ventures veterinary watches weavers weddings welding wholesale wines wood works
""".split())  # fmt: skip
# Legal forms and words that say nothing of the firm; a parameter of the lexicon.
LEGAL = frozenset("""
    pvt private ltd limited llc llp lp inc incorporated corp corporation sarl sas sasu sa eurl snc gmbh ag kg ohg ug ev mbh co company cie compagnie plc pte pty
    bv nv srl spa sl ltda eireli oy ab as aps kk sdn bhd pllc pc and et und y e the la le les ms mr mrs dr shri sri shree of branch store outlet
""".split())  # fmt: skip
# Given names and short forms in use for them (English, French, Indian); a parameter of the lexicon.
NICKNAMES = tuple("""
    abigail abby gail; agnes aggie nessie; albert al bert bertie; alexander alex alec sandy; alfred alf fred freddie; amanda mandy; andrew andy drew;
    anthony tony; antoinette toni nettie toinette; arthur art artie; barbara barb babs; benjamin ben benny benji; bernard bernie; bridget biddy bridie;
    catherine cathy cat kitty kate; cecilia cissy celia; chandrika chandu chanda; charles charlie chuck chas; charlotte lottie lotte; christina tina chris;
    christopher chris kit topher; clarence clare; cornelius con neil; cynthia cindy; daniel dan danny; david dave davy; deborah deb debbie; donald don donnie;
    dorothy dot dottie dolly; douglas doug; edmund ed ned; edward ed ned eddie ted; edwin ed eddie; eleanor nell nellie ellie; elizabeth liz beth betty lizzie eliza bess;
    emily em millie; eugene gene; ezekiel zeke; florence flo flossie; frances fran fanny; francis frank; francois franck; frederic fred freddy; frederick fred freddy rick;
    gabriel gabe; genevieve gen ginette viv; geoffrey geoff jeff; gerald gerry jerry; gopalan gopal gopi; gregory greg; guillaume will; harold harry hal; henry harry hank hal;
    isabella bella izzy; jacob jake; jacqueline jackie; james jim jimmy jamie; janet jan; jennifer jen jenny; jeremy jerry; jessica jess jessie; john jack johnny;
    jonathan jon jonny; joseph joe joey; josephine josie jo; joshua josh; judith judy; katherine kate kathy kitty kat; kenneth ken kenny; krishnan krish kittu; lakshmi laxmi lachu;
    lawrence larry laurie; leonard len lenny; lillian lily; louis lou louie; louise lou lulu; madeleine maddie; madhavi madhu; margaret maggie meg peggy peg; martha marty patty;
    mary molly polly; matthew matt; maximilian max; michael mike mick mickey; nancy nan; nathaniel nat nate; nicholas nick nicky; pamela pam; patricia pat patty tricia;
    patrick pat paddy; peter pete; philip phil pip; rajendra raj raju; ramachandran ram ramu; raymond ray; rebecca becky; reginald reg reggie; richard rich rick dick;
    robert bob rob bobby; roger rodge; ronald ron ronnie; samuel sam sammy; sandra sandy; sarah sally sadie; sebastian seb bastian; stephen steve; subramaniam mani subbu;
    susan sue susie; theodore ted teddy theo; theresa terry tess; thomas tom tommy; timothy tim; venkatesh venky venkat; victoria vicky tori; vincent vince vinnie; virginia ginny;
    walter walt wally; wilhelm willi; william bill will billy; zachary zach
""".split(";"))  # fmt: skip
#: A word is common if this share of the names have it, and so many at least; more than half of its rows mustn't be one name.
COMMON_SHARE, COMMON_LEAST, TOP_NAME = 0.005, 20, 0.5
#: A word is a nickname if it replaces a given name beside so many proper names, and in this share of those that have a given name.
NICKNAME_LEAST, NICKNAME_SHARE, NICKNAME_NAMES = 3, 0.6, 0.0002


def _contracts(short: str, word: str) -> bool:
    """Whether ``short`` is a beginning of ``word`` and then consonants of it in their order (its last letter may be any)."""
    n = 0
    while n < len(short) and short[n] == word[n]:
        n += 1
    if not n:
        return False
    at = n
    for i in range(n, len(short)):
        c = short[i]
        if c in "aeiou" and not (i == len(short) - 1 and word[-1] == c):
            return False
        at = word.find(c, at) + 1
        if not at:
            return False
    return True


class Lexicon:
    """What the words of a name are: legal forms, trades with their contractions, given names with their short forms.

    ``given``: (short form, name) pairs; a short form of several names stands for any of them.
    """

    def __init__(self, trades=TRADES, nicknames=NICKNAMES, legal=LEGAL, more_trades=(), more_given=(), more_nicknames=()):
        self.legal, self.trades = frozenset(legal), frozenset(trades) | frozenset(more_trades)
        names: dict[str, set[str]] = {g: {g} for g in more_given}
        for line in nicknames:
            full, *short = line.split()
            for w in (full, *short):
                names.setdefault(w, set()).add(full)
        for short, full in more_nicknames:
            names.setdefault(short, set()).update(names.get(full, {full}))
        for full in [w for w in names if w in names[w]]:  # a name in its own right is no short form
            names[full] = {full}
        self.given = {w: "~".join(sorted(v)) for w, v in names.items() if w not in self.trades}
        reach = lambda w: 1 if len(w) < 8 else 2
        full = [w for w, v in self.given.items() if w == v and len(w) >= 6]
        self._near_trade, self._near_given = NearLookup([t for t in self.trades if len(t) >= 5], reach), NearLookup(full, lambda w: 1)
        self._near_four = NearLookup([t for t in self.trades if len(t) == 4], lambda w: 1)
        self._near_legal = NearLookup(["private", "limited", "company", "corporation", "incorporated"], lambda w: 1)
        self._trade_sounds, self._given_sounds = {sounds(t): t for t in sorted(self.trades, reverse=True)}, {sounds(n): n for n in full}
        self._starts: dict[str, list[str]] = {}
        for t in sorted(self.trades):
            self._starts.setdefault(t[0], []).append(t)
        self.trade_of, self.short_of, self.damaged_of, self.given_of = (lru_cache(maxsize=30_000)(f) for f in (self._trade_of, self._short_of, self._damaged_of, self._given_of))
        self.parse = lru_cache(maxsize=20_000)(self._parse)

    def _trade_of(self, token: str) -> str:
        """The trade a full word means, allowing for typing errors; '' if none."""
        if token in self.trades:
            return token
        if len(token) >= 4:
            near = self._near_trade.find(token) or self._trade_sounds.get(sounds(token), "")
            if near and (len(token) >= 5 or token[0] == near[0]):
                return near
            for t in self._starts.get(token[0], ()):
                if len(t) >= 5 and len(token) >= len(t) + 2 and token.startswith(t):
                    return t
        return ""

    def _short_of(self, token: str) -> str:
        """The trades that a contraction may mean, joined by ~."""
        if len(token) < 3:
            return ""
        near = [t for t in self._starts.get(token[0], ()) if len(t) >= len(token) + 2 and (_contracts(token, t) or t.endswith("ies") and _contracts(token, t[:-3] + "y"))]
        return "~".join(near)

    def _damaged_of(self, token: str) -> str:
        """The same for a short contraction with one letter too many, a wrong one, or two that changed places; or a short trade near it."""
        if not 3 <= len(token) <= 7:
            return ""
        if len(token) <= 5 and (short := self._near_four.find(token)):
            return short
        near = [token[:i] + token[i + 1] + token[i] + token[i + 2 :] for i in range(len(token) - 1)] + [token[:i] + token[i + 1 :] for i in range(len(token))]
        return "~".join(sorted({t for v in near for t in self.short_of(v).split("~") if t}))

    def _given_of(self, token: str) -> str:
        if token in self.given:
            return self.given[token]
        near = (self._near_given.find(token) or self._given_sounds.get(sounds(token), "")) if len(token) >= 6 else ""
        return near if near[:1] == token[0] else ""

    def words(self, raw: str | None) -> list[str]:
        """Words of the name in one spelling; [] if it is missing."""
        t = re.sub(r"^[^\w]+", "", plain(raw))
        t = re.sub(r"\bm/s\b", " ", t)
        t = re.sub(r"(?<![a-z])((?:[a-z]\.){2,})", lambda m: m.group().replace(".", ""), t)
        return _WORDS.findall(t)

    def _parse(self, raw: str | None) -> tuple[str, str, str] | None:
        """(words of the proper name joined by a blank, trades joined by +, given name or initial); None if missing.

        Trades of a native spelling aren't known: '?' stands for them, and its last words may be the trade. Behind a trade that
        is only guessed from a contraction stands, after !, the proper name if it is none.
        """
        words = self.words(raw)
        if not words:
            t = plain(raw).strip()
            return (t, "", "") if re.search(r"\w", t) else None
        if any(native(w) for w in words):
            return " ".join(words), "?", ""
        trades: list[str] = []
        core: list[tuple[int, str]] = []
        given = ""
        plainly = any(w in self.trades for w in words)  # then no word close to a trade is taken for one
        beside = {j for i, w in enumerate(words) if w in self.trades for j in (i - 1, i + 1)}
        for i, w in enumerate(words):
            if w in self.legal:
                continue
            if len(w) == 1:
                given = given or w
                continue
            t = w if w in self.trades else "" if plainly and i not in beside else self.trade_of(w)
            if not t and not plainly and not any(c in "aeiou" for c in w[1:]):
                t = self.short_of(w)
            if t:
                trades.append(t)
                continue
            g = self.given_of(w)
            if g and not (given and len(given) > 1):
                given = g
                continue
            if len(w) >= 6 and self._near_legal.find(w):
                continue
            core.append((i, w))
        # contractions with vowels: right behind a trade, or, damaged ones too, at either end of a name without a trade
        for i, w in [c for c in core if c[0] and words[c[0] - 1] in self.trades] or ([] if trades else [core[-1], core[0]] if core else []):
            t = "" if len(core) < 2 else self.short_of(w) if trades else self.short_of(w) or self.damaged_of(w)
            if t:
                other = "" if trades else "!" + " ".join(v for _, v in core)
                trades.append(t + other)
                core.remove((i, w))
                break
        kept = [w for _, w in core] or [given or (trades[0] if trades else words[0])]
        return " ".join(kept), "+".join(sorted(set(trades))), given

    def form(self, raw: str | None) -> str | None:
        """One text per spelling that matters: words|trades|given; None if the name is missing."""
        p = self.parse(raw)
        return None if p is None else "|".join(p)


_WORDS = re.compile(r"[^\W_](?:[^\W_]|[ऀ-෿])*|[ऀ-෿]+")


@lru_cache(maxsize=20_000)
def native(word: str) -> bool:
    """Whether a word is written in a script of India."""
    return any("ऀ" <= c <= "෿" for c in word)


@lru_cache(maxsize=10_000)
def _native_letter(c: str) -> str:
    """The consonant that a letter of an Indian script stands for, by its public name; '' for vowels."""
    name = unicodedata.name(c, "").split(" ")
    if name[-1] in ("ANUSVARA", "CANDRABINDU", "TIPPI", "BINDI"):
        return "n"
    if len(name) < 3 or name[1] != "LETTER":
        return ""
    w = name[-1].lower()
    return "" if w[0] in "aeiou" else "f" if w.startswith("pha") else "n" if w.startswith(("ng", "ny")) else w[0]


def skeleton(text: str) -> str:
    """Consonants of a Latin or Indian spelling, reduced so that both writings agree."""
    s = "".join(_native_letter(c) if "ऀ" <= c <= "෿" else c for c in text)
    s = re.sub(r"sh|z", lambda m: "s" if m.group() == "sh" else "j", s)
    return re.sub(r"[^bcdfgjklmnpqrstv]", "", re.sub(r"(.)\1", r"\1", s.replace("th", "t").replace("w", "v").replace("ph", "f").replace("c", "k")))


@lru_cache(maxsize=20_000)
def readings(form: str) -> list[tuple[str, str, str]]:
    """(proper name, trades, given name) of a form; two if a trade is guessed."""
    tokens, trades, given = form.split("|")
    guess, mark, whole = trades.partition("!")
    return [(tokens, guess, given), (whole, "", given)] if mark else [(tokens, trades, given)]


def skeletons(words: str, trade: str) -> list[str]:
    """Skeletons, of at least three letters, that a proper name may have; of a native spelling up to two last words may be the trade."""
    w = words.split()
    reads = [(skeleton("".join(w[: len(w) - k])), 3 + k // 2) for k in range(min(3, len(w)) if trade == "?" else 1)]
    return list(dict.fromkeys(s for s, least in reads if len(s) >= least))


@lru_cache(maxsize=4)
def lexicon_of(learnt: tuple = ((), (), ())) -> Lexicon:
    """One lexicon for each process and set of learnt words; without them that of the general lists."""
    return Lexicon(more_trades=learnt[0], more_given=learnt[1], more_nicknames=learnt[2])


def form_of(raw: str | None) -> str | None:
    """Form of a name by the general lists."""
    return lexicon_of().form(raw)


def learn_words(names: DataFrame, raw: str, rows: str) -> tuple:
    """(trades, given names, nickname pairs) that the names show beyond the general lists.

    ``names``: distinct names with their number of ``rows``. A word that many different names have is common: if it
    mostly begins the name, it is a given name, else a trade. A word of one frequent name isn't common. Words that
    stand in for a given name beside the same proper names are nicknames. At most about 5 / COMMON_SHARE words and
    1 / NICKNAME_NAMES pairs come out, whatever the size of the data. Counts are taken over all names.
    """
    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        general = lexicon_of()
        for b in batches:
            yield pd.DataFrame({"words": [" ".join(x for x in general.words(v) if len(x) > 1 and x not in general.legal) for v in b[raw]], "n": b[rows]})

    spelt = cut(names.mapInPandas(words, "words string, n long").where("words <> ''").groupBy("words").agg(F.sum("n").alias("n")))
    each = spelt.where("words like '% %'").select("n", F.split("words", " ")[0].alias("one"), F.explode(F.array_distinct(F.split("words", " "))).alias("w"))
    counts = each.where(r"length(w) > 2 and not w rlike '[\u0900-\u0dff]'").groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.sum(F.expr("cast(w = one as int)")).alias("first"), (F.max("n") / F.sum("n")).alias("top"))
    total = spelt.count()
    common = counts.where((F.col("df") >= max(COMMON_LEAST, COMMON_SHARE * total)) & (F.col("top") <= TOP_NAME)).collect()  # at most 5 / COMMON_SHARE
    general = lexicon_of()
    trades = tuple(sorted(r["w"] for r in common if r["first"] * 2 <= r["df"] and r["w"] not in general.given))
    given = tuple(sorted(r["w"] for r in common if r["first"] * 2 > r["df"] and r["w"] not in general.given and r["w"] not in general.trades))
    more = (trades, given, ())

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = lexicon_of(more)
        for b in batches:
            out = []
            for v in b["words"]:
                rest = [x for x in v.split(" ") if x not in lexicon.trades]
                if len(rest) > 1 and sum(map(len, rest[1:])) >= 5:
                    known = lexicon.given.get(rest[0], "")
                    out.append((" ".join(rest[1:]), rest[0], known if known == rest[0] else ""))
            yield pd.DataFrame(out, columns=["core", "u", "t"])

    beside = spelt.select("words").mapInPandas(firsts, "core string, u string, t string").distinct()
    full = beside.where("t <> ''").select("core", "t")
    found = beside.where("t = ''").select("core", "u").join(full, "core").groupBy("u", "t").agg(F.count_distinct("core").alias("n"))
    all_of = found.groupBy("u").agg(F.sum("n").alias("all"), F.max(F.struct("n", "t")).alias("m"))
    enough = all_of.where((F.col("m.n") >= max(NICKNAME_LEAST, NICKNAME_NAMES * total)) & (F.col("m.n") >= NICKNAME_SHARE * F.col("all")))
    pairs = tuple(sorted((r["u"], r["t"]) for r in enough.select("u", "m.t").collect() if r["u"] not in general.given))  # at most 1 / NICKNAME_NAMES
    return trades, given, pairs


def _orders(tokens: str) -> list[str]:
    """The proper name without spaces, as given and with the words turned round."""
    w = tokens.split()
    return ["".join(w)] if len(w) < 2 else ["".join(w), "".join(w[1:] + w[:1])] + (["".join(w[2:] + w[:2])] if len(w) == 3 else [])


@lru_cache(maxsize=30_000)
def _letters(word: str) -> int:
    """Which letters a word has, as bits."""
    return sum({1 << (ord(c) & 63) for c in word})


def _core_likeness(a: str, b: str) -> float:
    """Ratio of the longest common subsequence if the spellings differ by typing errors only, else 0."""
    if a == b:
        return 1.0
    x, y = sounds(a), sounds(b)
    if x == y:
        return 0.97
    n = min(len(x), len(y))
    if n < 5 or abs(len(x) - len(y)) > 2 and abs(len(a) - len(b)) > 2:
        return 0.0
    k = 1 if n < 8 else 2
    # an error changes two letters at most
    near = [(u, v) for u, v in ((x, y), (a, b)) if (_letters(u) ^ _letters(v)).bit_count() <= 2 * k]
    if not near or not any(within(u, v, k) for u, v in near):
        return 0.0
    r = max(lcs_ratio(x, y), lcs_ratio(a, b))
    return r if r >= 0.8 else 0.0


@lru_cache(maxsize=20_000)
def _alternatives(trades: str) -> tuple[frozenset[str], ...]:
    return tuple(frozenset(t.split("~")) for t in trades.split("+"))


def trades_agree(a: str, b: str) -> bool:
    """Whether the trades of one name are all among those of the other; a contraction agrees with any trade it may mean."""
    if not a or not b or a == b:
        return True
    x, y = _alternatives(a), _alternatives(b)
    if len(x) > len(y):
        x, y = y, x
    return all(any(u & v for v in y) for u in x)


def given_agree(a: str, b: str) -> bool:
    """Equal given names, one of them missing, or the initial of the other."""
    if not a or not b or a == b:
        return True
    x, y = a.split("~"), b.split("~")
    if len(a) == 1 or len(b) == 1:
        return any(u[0] == v[0] for u in x for v in y)
    return bool(set(x) & set(y))


def same_firm(a: str, b: str) -> float:
    """Confidence that two forms mean the same firm in any of their readings; 0 if they don't."""
    return max(_same(x, y) for x in readings(a) for y in readings(b))


def _same(a: tuple[str, str, str], b: tuple[str, str, str]) -> float:
    (ta, ra, ga), (tb, rb, gb) = a, b
    if ra == "?" or rb == "?":
        if ra == rb:
            return 1.0 if ta == tb or skeleton(ta) == skeleton(tb) else 0.0
        return 0.9 if set(skeletons(ta, ra)) & set(skeletons(tb, rb)) else 0.0
    if not trades_agree(ra, rb) or not given_agree(ga, gb):
        return 0.0
    x, y = _orders(ta), _orders(tb)  # to turn both round is to turn neither
    score = max(_core_likeness(x[0], v) for v in y) if len(x) <= len(y) else max(_core_likeness(u, y[0]) for u in x)
    return score if bool(ra) == bool(rb) else score * 0.9


#: Shortest suffix that is indexed; suffixes carried by more forms than this are refined.
MIN_SUFFIX, COMMON = 5, 60


def trade_keys(form: str) -> list[str]:
    """Every trade of a form, each of the possible ones; '' if it may be that none is known."""
    return sorted({t for _, trades, _ in readings(form) for u in _alternatives("" if trades == "?" else trades) for t in u})


def suffix_keys(form: str) -> list[str]:
    """Suffixes of the tokens of a form, its trades included; short tokens whole; the consonants are one more token."""
    out = {"+" + t for t in trade_keys(form) if t}
    for tokens, trade, _ in readings(form):
        out |= {"#" + s for s in skeletons(tokens, trade)}
        if trade == "?":
            continue
        s = sounds(tokens.replace(" ", ""))
        for w in {*(sounds(x) for x in tokens.split()), s}:
            if len(w) < MIN_SUFFIX:
                out.add("=" + w)
            out.update(w[i:] for i in range(max(0, len(w) - 12), len(w) - MIN_SUFFIX + 1))  # who shares a longer one shares these
    return sorted(out)


def _parts(text: str, errors: int) -> set[str]:
    """A text cut into one part more than the errors it must stand; each with its number and the length of the text."""
    n = len(text)
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return {f"{errors}{i}of{n} {_short(text[u:v])}" for i, (u, v) in enumerate(zip(cuts, cuts[1:]))}


def _probes(text: str, errors: int) -> set[str]:
    """Keys of which at least one is among the ``_parts`` of every text within so many errors.

    An insertion, deletion or replacement damages one part, and the others are found moved by at most the errors. A swap
    across a cut damages two parts, so it is also tried to undo it: then one of the two is whole.
    """
    out = set()
    for n in range(max(errors + 1, len(text) - errors), len(text) + errors + 1):
        cuts = [n * i // (errors + 1) for i in range(errors + 2)]
        for i, (u, v) in enumerate(zip(cuts, cuts[1:])):
            out |= {f"{errors}{i}of{n} {_short(text[u + d : v + d])}" for d in range(max(-errors, -u), errors + 1)}
        for j in range(1, errors + 1):
            for p in range(max(1, cuts[j] - errors + 1), min(len(text), cuts[j] + errors)):
                undone = text[: p - 1] + text[p] + text[p - 1] + text[p + 1 :]
                for i in (j - 1, j):
                    u, v = cuts[i], cuts[i + 1]
                    out |= {f"{errors}{i}of{n} {_short(undone[u + d : v + d])}" for d in range(max(1 - errors, -u), errors)}
    return out


def _short(text: str) -> str:
    """The text, or its digest if it is long."""
    return text if len(text) <= 40 else xxhash.xxh64_hexdigest(text)


#: Names up to this length meet by what is left of them without one or two letters, longer ones by their parts.
DELETED = 32


def search_keys(form: str, probe: bool) -> list[str]:
    """Keys by which names meet: two forms that ``same_firm`` accepts share one, if one of them probes.

    Trades aren't part of a key, as one side may lack it. Every order of the words has its keys: the proper name as it
    sounds, and what stands typing errors, two of them, or one in a short name: the name without one or two letters, or
    parts of a long one, where the side that probes has many more keys than the other. A native spelling is met by its skeleton.
    """
    plainly, spelt = _search_texts(form, (probe,))
    return sorted(plainly | {"d" + t for w, errors in spelt for t in {w, *_one_less(w), *(_two_less(w) if errors > 1 else ())}})


def _search_texts(form: str, probes: tuple[bool, ...]) -> tuple[set[str], set[tuple[str, int]]]:
    """(keys, texts whose keys are what is left of them without so many letters)."""
    out, spelt = set(), set()
    for tokens, trade, _ in readings(form):
        out |= {"#" + s for s in skeletons(tokens, trade)} | {"f" + _short(sounds(tokens.replace(" ", "")))}
        for w in _orders(tokens) if trade != "?" else ():
            heard = sounds(w)
            out.add("f" + _short(heard))
            for text in {w, heard} if len(heard) >= 5 else ():
                if len(text) <= DELETED + 2:
                    spelt.add((text, 1 if len(heard) < 8 else 2))
                if len(text) > DELETED:  # so any two texts within two errors have keys of one kind
                    out |= set().union(*((_probes if p else _parts)(text, 2) for p in probes))
    return out, spelt


_FACTOR, _BACK, _BACK2, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64), pow(0x9E3779B97F4A7C15, -2, 1 << 64), 0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def deletion_hashes(texts: list[str], errors: int) -> np.ndarray:
    """A row for each of the texts, all of one length: hashes of what is left without up to so many (one or two) letters.

    A text is a polynomial of its letters modulo 2 ** 64, so what is left is put together from sums of beginnings.
    """
    n = len(texts[0])
    letters = _mixed(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, n).astype(np.uint64) + _MIX)
    powers = np.cumprod(np.full(n, _FACTOR))
    at = np.zeros((len(texts), n + 1), dtype=np.uint64)
    np.cumsum(letters * powers, axis=1, out=at[:, 1:])
    i = np.arange(n)
    out = [at[:, n:], at[:, i] + (at[:, n:] - at[:, i + 1]) * _BACK]
    if errors > 1:
        i, j = np.triu_indices(n, 1)
        out.append(at[:, i] + (at[:, j] - at[:, i + 1]) * _BACK + (at[:, n:] - at[:, j + 1]) * _BACK2)
    return _mixed(np.concatenate(out, axis=1))


def search_hashes(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``forms``, hashes of the search keys of the form there, as one that is searched and that probes); some come twice."""
    at, texts = [], []
    spelt: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for i, f in enumerate(forms):
        plainly, near = _search_texts(f, (False, True))
        at += [i] * len(plainly)
        texts += [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in plainly]
        for w, errors in near:
            spelt.setdefault((len(w), errors), []).append((i, w))
    places, keys = [np.array(at, dtype=np.int64)], [np.array(texts, dtype=np.uint64)]
    for (_, errors), group in spelt.items():
        got = deletion_hashes([w for _, w in group], errors)
        places.append(np.repeat(np.array([i for i, _ in group], dtype=np.int64), got.shape[1]))
        keys.append(got.ravel())
    return np.concatenate(places), np.concatenate(keys)


def spelling_forms(df: DataFrame, keep: list[str], raw: str, learnt: tuple) -> DataFrame:
    """``keep`` and ``form``; null for a missing name."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + ", form string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = lexicon_of(learnt)
        for b in batches:
            yield b[keep].assign(form=[lexicon.form(v) for v in b[raw]])

    return df.select(*keep, *([raw] if raw not in keep else [])).mapInPandas(run, schema)


def _keyed(forms: DataFrame, keys, columns: str = "form string, k string", most: int = 50_000) -> DataFrame:
    """A row for every key of every form; passed on in parts, as a form may have hundreds of keys."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, found = [], []
        for b in batches:
            for f in b["form"]:
                found += keys(f)
                of += [f] * (len(found) - len(of))
                if len(found) > most:
                    yield pd.DataFrame({"form": of, "k": found}, dtype=object)
                    of, found = [], []
        yield pd.DataFrame({"form": of, "k": found}, dtype=object)

    return forms.select("form").mapInPandas(run, columns)


#: Bits of the filter of asked keys: its size is fixed (8 MB); when it fills up it lets more through and loses none.
ASKED = 1 << 26


def key_bits(keyed: DataFrame):
    """Broadcast bits of the keys ``k`` (arrays) of a table."""
    at = (F.col("k").bitwiseAND(F.lit(ASKED - 1)) + 1).alias("at")
    got = keyed.select(F.explode("k").alias("k")).select(at).groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()  # ASKED / 8 bytes
    bits = np.zeros(ASKED >> 3, dtype=np.uint8)
    for r in got:
        bits[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return keyed.sparkSession.sparkContext.broadcast(bits)


def _among(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys may be among those asked for."""
    at = (keys & np.uint64(ASKED - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def search_table(forms: DataFrame, asked=None) -> DataFrame:
    """``h`` (hash of the form) and ``k`` (hashes of its search keys), written to a table.

    ``asked``: broadcast bits of keys; only those among them are kept.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b["form"].iloc[at : at + 1000].tolist()
                places, keys = search_hashes(part)
                if asked is not None:
                    some = _among(keys, asked.value)
                    places, keys = places[some], keys[some]
                order = np.lexsort((keys, places))
                places, keys = places[order], keys[order]
                once = np.ones(len(keys), dtype=bool)
                once[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])
                places, keys = places[once], keys[once].view(np.int64)
                own, starts = np.unique(places, return_index=True)
                yield pd.DataFrame({"form": [part[i] for i in own], "k": np.split(keys, starts[1:]) if len(own) else []}, dtype=object)

    found = forms.select("form").mapInPandas(run, "form string, k array<long>")
    return cut(found.select(F.xxhash64("form").alias("h"), "k"))


def meet(x: DataFrame, y: DataFrame) -> DataFrame:
    """``ha, hb``: the names of either table that share a key, each pair once."""
    by_key = lambda d, name: d.select(F.explode("k").alias("k"), F.col("h").alias(name))
    return by_key(x, "ha").join(by_key(y, "hb"), "k").select("ha", "hb").distinct()


def form_links(forms: DataFrame) -> DataFrame:
    """``a, b, score``: linked pairs of distinct forms (column ``form``), each once.

    A suffix of more than COMMON forms is refined by trade. A form without known trade meets those of every trade, so
    it gets a key for each trade that the suffix has. What is still too common is refined by the
    keys that stand typing errors, of which every accepted pair shares one.
    """
    forms = cut(forms.select("form").distinct())
    keyed = cut(_keyed(forms, suffix_keys).select("form", F.xxhash64("k").alias("k")))
    size1 = keyed.groupBy("k").count()
    small1 = keyed.join(size1.where(f"count between 2 and {COMMON}").select("k"), "k", "left_semi")
    large1 = cut(keyed.join(size1.where(f"count > {COMMON}").select("k"), "k", "left_semi"))
    traded = cut(_keyed(forms, trade_keys, "form string, k string").withColumnRenamed("k", "trade"))
    by_trade = large1.join(traded, "form")
    has = by_trade.where("trade <> ''").select("k", "trade").distinct()
    # forms without trade come to all trades of the suffix, and to each other
    spread = by_trade.where("trade = ''").drop("trade").join(has, "k").unionByName(by_trade.where("trade = ''"))
    level2 = cut(by_trade.where("trade <> ''").unionByName(spread).select("form", F.xxhash64("k", "trade").alias("k")).distinct())
    size2 = level2.groupBy("k").count()
    small2 = level2.join(size2.where(f"count between 2 and {COMMON}").select("k"), "k", "left_semi")
    hot = cut(level2.join(size2.where(f"count > {COMMON}").select("k"), "k", "left_semi").select("form").distinct())
    # what the search finds holds every accepted pair of two common forms, so the suffixes are asked for the others only
    found = search_table(hot)
    met = meet(found, found).where("ha < hb")
    text = lambda h, f: hot.select(F.xxhash64("form").alias(h), F.col("form").alias(f))
    met = met.join(text("ha", "a"), "ha").join(text("hb", "b"), "hb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    small = cut(small1).unionByName(cut(small2))
    rare = small.join(hot, "form", "left_anti").select("k", F.col("form").alias("a"))
    cand = rare.join(small.select("k", F.col("form").alias("b")), "k").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cand = cut(cand).unionByName(cut(met)).distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(score=[same_firm(u, v) for u, v in zip(b["a"], b["b"])])
            yield b[b["score"] > 0]

    return cand.mapInPandas(compare, "a string, b string, score double")


def firm_classes(forms: DataFrame, links: DataFrame) -> DataFrame:
    """``form, firm``: forms linked directly or indirectly are one firm.

    A spelling that doesn't say its trade for certain (native, without trade, or with an ambiguous contraction) joins no
    two firms: such spellings are grouped among themselves, and a group is given to a firm only if all it resembles is one firm.
    """
    vague = lambda c: F.split_part(c, F.lit("|"), F.lit(2)).rlike(r"^$|[?~]")
    safe = links.where(vague(F.col("a")) == vague(F.col("b")))
    labels = components(safe.select("a", "b").unionByName(forms.select(F.col("form").alias("a"), F.lit(None).cast("string").alias("b"))), "a", "b")
    labels = cut(labels.select(F.col("entity_id").alias("form"), F.col("group_id").alias("firm")))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(vague(F.col("a")) & ~vague(F.col("b")))
    of = lambda x, name: labels.select(F.col("form").alias(x), F.col("firm").alias(name))
    single = both.join(of("a", "firm"), "a").join(of("b", "other"), "b").groupBy("firm").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo = hi").select("firm", "lo")
    return labels.join(single, "firm", "left").select("form", F.coalesce("lo", "firm").alias("firm"))


def same_firm_pairs(df: DataFrame, *, record: str, raw: str, normalized: str) -> DataFrame:
    """``entity_id_a, entity_id_b``: records of one firm whose normalised names differ.

    Records with the same normalised name are copies: one spelling is compared for all of them, and only
    pairs with different names come out. The records of either name are spread over salts before their
    pairs are formed. Missing names (null, empty, blank, the word null) are never cases; repeated rows
    count once; empty input gives no pairs; further columns are ignored.
    """
    rows = df.select(F.col(record).alias("id"), F.col(raw).alias("raw"), F.coalesce(F.col(normalized), F.lit("")).alias("norm")).where("id is not null and norm <> ''")
    names = cut(rows.groupBy("norm").agg(F.min("raw").alias("raw"), F.count_distinct("id").alias("n")))
    formed = cut(spelling_forms(names, ["norm", "n"], "raw", learn_words(names, "raw", "n")).where("form is not null"))
    forms = formed.select("form").distinct()
    classes = cut(firm_classes(forms, cut(form_links(forms))))  # links are asked several times
    named = cut(skew_join(formed, classes, "form").select("norm", "firm", "n"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / 1000).cast("int"))
    x, y = named.selectExpr("firm", "norm as a", "n as na"), named.selectExpr("firm", "norm as b", "n as nb")
    cells = x.join(y, "firm").where("a < b").select("a", "b", "nb", F.explode(F.sequence(F.lit(0), parts("na") - 1)).alias("sa"))
    cells = cells.select("a", "b", "sa", F.explode(F.sequence(F.lit(0), parts("nb") - 1)).alias("sb"))
    sized = cut(rows.select("id", "norm").distinct().join(names.select("norm", "n"), "norm").select("norm", "id", F.pmod(F.xxhash64("id"), parts("n")).cast("int").alias("salt")))
    ids = lambda k, s, v: sized.select(F.col("norm").alias(k), F.col("salt").alias(s), F.col("id").alias(v))
    pairs = cells.join(ids("a", "sa", "x"), ["a", "sa"]).join(ids("b", "sb", "y"), ["b", "sb"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias("entity_id_a"), F.greatest("x", "y").alias("entity_id_b")).distinct()
