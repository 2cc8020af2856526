"""Matching records of several sources without a common key: collective linkage on a candidate graph.

1. Every record gets attributes: hashes of address components and its name words. The weight of an
   attribute is the logarithm of its rarity over all records.
2. Records of the two sides that share a place attribute are candidate edges. The weight of an edge is the sum
   of its shared attributes. Where one side has no address, records that share a name key are compared by name.
3. Meta-blocking prunes the edges between places that are light for both of their records.
4. The remaining edges get a similarity of names, given that the places agree. Uncertain edges are
   raised by their neighbours: b is like c, and c matches a. This is repeated until no edge changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kithmark.llm.addresses import SEPARATOR, key_hashes, may_be_town, met, met_in_spite, no_conflict, places_of, same_place, unpack_place
from kithmark.llm.names import given_agree, key_bits, learn_words, lexicon_of, meet, readings, same_firm, search_keys, search_table, skeletons, trades_agree
from kithmark.llm.strings import lcs_ratio, sounds
from kithmark.operators.heavy_keys import skew_join
from kithmark.runtime import cut, free, phase

#: An edge is kept if its weight is at least this part of the mean weight at either end.
KEEP_RATIO = 0.4
#: Edges from STRONG on are matches; between MAYBE and STRONG neighbours decide.
MAYBE, STRONG = 0.45, 0.75
#: Without an address the name must be this certain; and the match is less certain by this factor.
NAME_ALONE, WITHOUT_PLACE = 0.85, 0.9


@lru_cache(maxsize=20_000)
def name_similarity(a: str, b: str) -> float:
    """``same_firm`` where it says yes, else part of the likeness of the proper names (0 in another trade)."""
    if a == b:
        return 1.0
    return same_firm(a, b) or max(_likeness(x, y) for x in readings(a) for y in readings(b))


def _likeness(a: tuple[str, str, str], b: tuple[str, str, str]) -> float:
    (ta, ra, ga), (tb, rb, gb) = a, b
    if "?" not in (ra, rb) and not trades_agree(ra, rb):
        return 0.0
    r = lcs_ratio(sounds(ta.replace(" ", "")), sounds(tb.replace(" ", "")))
    return r * (0.4 if "?" in (ra, rb) else 0.7 if given_agree(ga, gb) else 0.5)


def name_keys(form: str) -> tuple[str, str, str]:
    """Proper name as it sounds, its start and its end, each with the trade."""
    tokens, trade, _ = readings(form)[0]
    core, trade = sounds(tokens.replace(" ", "")), "" if trade == "?" else trade
    return f"f{core}|{trade}", f"h{core[:5]}|{trade}", f"t{core[-5:]}|{trade}"


def _records(sources: list[tuple[str, DataFrame]], record: str, name: str, address: str, country: str) -> DataFrame:
    """One row per record with a name: ``side, id, form, trade, addr, strong, weak, open, town, at``.

    ``trade``: a hash of the trade, null if it isn't known, is one of several or is guessed. ``at``: the name at its house number.
    """
    rows = None
    for side, df in sources:
        part = df.where(F.col(record).isNotNull()).select(F.col(record).alias("id"), F.lit(side).alias("side"), F.col(name).alias("n"), F.col(address).alias("a"), F.col(country).alias("c"))
        rows = part if rows is None else rows.unionByName(part)

    learnt = learn_words(cut(rows.groupBy("n").agg(F.count(F.lit(1)).alias("times"))), "n", "times")

    def parse(b: dict) -> dict:
        lexicon = lexicon_of(learnt)
        named = [(*x, f) for *x, n in zip(b["side"], b["id"], b["a"], b["c"], b["n"]) if (f := lexicon.form(n)) is not None]
        side, id, a, c, forms = zip(*named) if named else ((),) * 5
        return {"side": side, "id": id, "a": a, "c": c, "form": forms, "called": [name_keys(f)[0] for f in forms]}

    found = places_of(rows, ["side", "id"], "a", "c", add=parse, more="side string, id string, form string, called string")
    # a name at a house number is an attribute of its own: rare, and left when the street is damaged
    at = F.xxhash64(F.lit("x"), F.split_part("addr", F.lit(SEPARATOR), F.lit(1)), "called")
    trade = F.split_part("form", F.lit("|"), F.lit(2))
    trade = F.when(trade.rlike("^[^?~+!]+$"), F.hash(trade)).alias("trade")
    return cut(found.select("side", "id", "form", trade, "addr", "strong", "weak", "open", "town", at.alias("at")))


def attributes_of(form: str) -> set[str]:
    """Name keys, skeletons and words of a form."""
    out = set(name_keys(form))
    for tokens, trade, _ in readings(form):
        out |= {"#" + s for s in skeletons(tokens, trade)} | {"n" + sounds(w) for w in tokens.split()}
    return out


def most_attributes(form: str) -> int:
    """At least as many as ``attributes_of`` has, without looking for them."""
    return 3 + sum((3 if trade == "?" else 1) + len(tokens.split()) for tokens, trade, _ in readings(form))


def _counted(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``form, n, ks``: hashes of the name attributes of each form, and ``k, w``: the weight, in thousandths, of those that two records have.

    Attributes are the name keys, the skeleton and the words of the proper name as they sound; counts are taken by form, so that
    a name that many records have is one row.
    """

    def attributes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [attributes_of(f) for f in b.column("form").to_pylist()]
            yield pa.RecordBatch.from_pydict({"form": b.column("form"), "n": b.column("n"), "ks": key_hashes(found)})

    each = cut(records.groupBy("form").agg(F.count(F.lit(1)).alias("n")).mapInArrow(attributes, "form string, n bigint, ks array<bigint>"))
    rarity = F.round(F.log((F.lit(records.count()) + 1.0) / F.sum("n")) * 1000).cast("long")
    weight = each.select("n", F.explode("ks").alias("k")).groupBy("k").agg(rarity.alias("w"), F.sum("n").alias("times")).where("times > 1").drop("times")
    return each, cut(weight)


def _name_weights(records: DataFrame, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``form, attrs``: the name attributes of a form that another record has too, each as 32 bits of hash and its weight in thousandths.

    What only one record has no two can share; a form without shared attributes has no row. ``counted``: the attributes of all records, if these are some of them.
    """
    each, weight = counted or _counted(records)
    of = each if counted is None else each.join(records.select("form").distinct(), "form", "left_semi")
    packed = F.col("k").bitwiseAND(F.lit(-1 << 32)) + F.greatest("w", F.lit(0))
    return of.select("form", F.explode("ks").alias("k")).join(weight, "k").groupBy("form").agg(F.collect_list(packed).alias("attrs"))


def _place_edges(records: DataFrame) -> DataFrame:
    """``a, b, place, may``: records with addresses that share keys of a place, each pair once, and the weight of these keys: only keys, ids, trades and the letters of towns are moved.

    ``may``: whether names and places can agree. They can't where both trades are certain and differ, or where no strong key is shared, so that no postcode stands in for
    the town, and the towns have too many different letters, as nearly all records of a common name at one house number. A record delivered twice has its keys twice; the pairs are made distinct per key before they are weighed.
    """
    placed = records.where("size(strong) + size(weak) > 0").select("side", "id", "strong", F.array_append("weak", F.col("at")).alias("weak"), "open", "trade", "town")
    n = records.count()
    all_keys = placed.select(F.explode(F.concat("weak", "strong")).alias("k"))
    weight = all_keys.groupBy("k").count().select("k", F.log((F.lit(n) + 1.0) / F.col("count")).cast("float").alias("w"), "count").where("w > 0 and count > 1").drop("count")
    met_at = met(placed.where("side = 'l'"), placed.where("side = 'r'"), attrs=("trade", "town"))
    may = F.coalesce(F.col("tradea") == F.col("tradeb"), F.lit(True)) & (~F.col("by_weak") | may_be_town(F.col("towna"), F.col("townb")))
    met_at = met_at.select("a", "b", "k", may.alias("may")).join(weight, "k")
    each = met_at.groupBy("a", "b", "k").agg(F.max("w").alias("w"), F.max("may").alias("may"))
    return each.groupBy("a", "b").agg(F.sum("w").alias("place"), F.max("may").alias("may"))


def _weighed(records: DataFrame, edges: DataFrame, counted: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``a, b, weight``: the edges with the weight of all attributes their records share."""
    ends = edges.select(F.lit("l").alias("side"), F.col("a").alias("id")).unionByName(edges.select(F.lit("r").alias("side"), F.col("b").alias("id"))).distinct()
    placed = cut(records.where("size(strong) + size(weak) > 0").select("side", "id", "form").join(ends, ["side", "id"], "left_semi").distinct())
    attrs = F.coalesce("attrs", F.array().cast("array<long>"))
    named = skew_join(placed, cut(_name_weights(placed, counted)), "form", "left")
    of = lambda side, x: named.where(F.col("side") == side).select(F.col("id").alias(x), attrs.alias("n" + x))
    shared = F.aggregate(F.array_intersect("na", "nb"), F.lit(0).cast("long"), lambda t, x: t + x.bitwiseAND(F.lit(0xFFFFFFFF)))
    both = edges.join(of("l", "a"), "a").join(of("r", "b"), "b").select("a", "b", "place", (shared / 1000).cast("float").alias("names"))
    return both.groupBy("a", "b").agg((F.max("place") + F.max("names")).alias("weight"))


def _edges(records: DataFrame) -> DataFrame:
    """Candidate edges ``a, b, weight`` of records with addresses, each once."""
    return _weighed(records, cut(_place_edges(records)), _counted(records))


def _named(records: DataFrame) -> DataFrame:
    """``a, b, fa, fb, s``: pairs in which a record has no address, or none that can be searched, and the name decides.

    Names are compared by form, once for all records that have it, and none is pruned: how many records share
    the exact spelling says nothing about a misspelt one. Parts of an address that can't be searched mustn't conflict.
    """
    records = records.withColumn("bare", F.expr("addr is null or size(strong) + size(weak) = 0"))
    flag = lambda cond: F.max(F.expr(cond).cast("int")).alias
    forms = cut(records.groupBy("form").agg(flag("side = 'l'")("l"), flag("side = 'r'")("r"), flag("side = 'l' and bare")("bl"), flag("side = 'r' and bare")("br")))

    # only hashes of keys and forms are moved, and of the many forms only the keys that one of the few asks for; the texts come back for the candidates
    few_left, few_right = search_table(forms.where("bl = 1")), search_table(forms.where("br = 1"))
    def asked(few, forms):
        bits = key_bits(few)
        found = search_table(forms, bits)
        bits.destroy()
        return found

    by_left = meet(few_left, asked(few_left, forms.where("r = 1")))
    by_right = meet(asked(few_right, forms.where("l = 1")), few_right)
    text = lambda h, f: forms.select(F.xxhash64("form").alias(h), F.col("form").alias(f))
    cand = by_left.unionByName(by_right).distinct().join(text("ha", "fa"), "ha").join(text("hb", "fb"), "hb").select("fa", "fb")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(s=[1.0 if u == v else same_firm(u, v) if u <= v else same_firm(v, u) for u, v in zip(b["fa"], b["fb"])])
            yield b[b["s"] >= NAME_ALONE]

    same = cut(cand.mapInPandas(compare, "fa string, fb string, s double"))
    # addresses are moved only if there are some that can't be searched
    vague = not records.where("bare and addr is not null").isEmpty()
    addr = F.col("addr") if vague else F.lit(None).cast("string")
    of = lambda side, x: records.where(F.col("side") == side).select(F.col("id").alias(x), F.col("form").alias("f" + x), F.col("bare").alias("n" + x), addr.alias("a" + x))
    left, right = of("l", "a"), of("r", "b")
    # the few records without address first; repeated rows are made one when only those that meet are left
    no_left = same.join(left.where("na").distinct(), "fa").join(right, "fb")
    no_right = same.join(right.where("nb").distinct(), "fb").join(left.where("not na"), "fa")
    both = no_left.unionByName(no_right, allowMissingColumns=True).select("a", "b", "fa", "fb", "s", "aa", "ab").distinct()
    if not vague:
        return both.drop("aa", "ab")

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [x is None or y is None or no_conflict(unpack_place(x), unpack_place(y)) for x, y in zip(b["aa"], b["ab"])]
            yield b.loc[ok, ["a", "b", "fa", "fb", "s"]]

    return both.mapInPandas(agree, "a string, b string, fa string, fb string, s double")


def _in_spite(records: DataFrame) -> DataFrame:
    """``a, b``: records whose places agree but for the postcode. Places are compared once for all their records; the few pairs aren't pruned."""
    at = F.xxhash64("addr").alias("id")
    places = records.where("size(weak) > 0 and not open").groupBy(at).agg(*[F.first(c).alias(c) for c in ("strong", "weak", "open")], F.max(F.expr("side = 'l'")).alias("l"), F.max(F.expr("side = 'r'")).alias("r"))
    places = cut(places)
    pairs = met_in_spite(places.where("l"), places.where("r")).withColumnsRenamed({"a": "pa", "b": "pb"})
    of = lambda side, p, x: records.where(F.col("side") == side).select(F.xxhash64("addr").alias(p), F.col("id").alias(x))
    return pairs.join(of("l", "pa", "a"), "pa").join(of("r", "pb", "b"), "pb").select("a", "b")


def _prune(records: DataFrame, edges: DataFrame, matches: DataFrame, keep_ratio: float) -> DataFrame:
    """Weighted node pruning: ``a, b, fa, fb, s`` of the matches, but for those that are light at both of their ends among all ``edges``.

    A match is light at an end if its weight is less than ``keep_ratio`` of the mean there. Names are weighed only where they can decide. A match is kept
    if its place alone outweighs that, even if all other edges of the end shared every attribute its name can have, and each were as rare as can be;
    for the others the edges at one end are weighed, and those at the other end for what is light at the first.
    """
    columns = ["a", "b", "fa", "fb", "s"]
    own = edges.groupBy("b").agg(F.sum("place").alias("places"), F.count(F.lit(1)).alias("number"))
    others = F.expr("places - place") + F.expr("(number - 1) * most") * F.log((F.lit(records.count()) + 1.0) / 2)
    heavy = F.col("place") * (F.col("number") - keep_ratio) > others * keep_ratio + 1e-3  # weights are rounded to thousandths
    judged = cut(matches.join(own, "b").select(*columns, heavy.alias("kept")))
    kept, counted = [judged.where("kept")], None
    for x in ("b", "a"):
        unsure = judged.where("not kept").select(*columns)
        if unsure.isEmpty():
            break
        counted = counted or _counted(records)
        near = cut(edges.join(unsure.select(x).distinct(), x, "left_semi").select("a", "b", "place"))
        weighed = cut(_weighed(records, near, counted))
        mean = weighed.groupBy(x).agg(F.avg("weight").alias("mean"))
        judged = cut(unsure.join(weighed, ["a", "b"]).join(mean, x).select(*columns, (F.col("weight") >= F.col("mean") * keep_ratio).alias("kept")))
        kept.append(judged.where("kept"))
    return reduce(DataFrame.unionByName, kept).select(*columns)


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for fa, fb, aa, ab in zip(b["fa"], b["fb"], b["aa"], b["ab"]):
            s = name_similarity(fa, fb) if fa <= fb else name_similarity(fb, fa)
            if s < MAYBE:
                out.append(0.0)
            elif aa is None or ab is None:
                out.append(s if s >= NAME_ALONE else 0.0)
            else:
                out.append(s if aa == ab or same_place(unpack_place(aa), unpack_place(ab)) else 0.0)
        b = b[["a", "b", "fa", "fb", "place"]].assign(s=out)
        b = b[b["s"] > 0]
        yield b.assign(most=list(map(most_attributes, b["fb"])))


def _support(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [max(s0, s * (name_similarity(u, v) if u <= v else name_similarity(v, u))) for s0, s, u, v in zip(b["s0"], b["s"], b["u"], b["v"])]
        yield b[["a", "b"]].assign(s=got)


def _propagate(*tables: DataFrame) -> DataFrame:
    """Raises uncertain edges by their neighbours until nothing changes: ``a, b, s, placed``. Each round makes an edge strong for good, so there is an end.

    ``tables``: the edges, as written by ``cut``; they are freed when something changed.
    """
    while True:
        edges = reduce(DataFrame.unionByName, tables)
        grey, strong = edges.where(f"s < {STRONG}"), edges.where(f"s >= {STRONG}")
        g = grey.select("a", "b", "fa", "fb", F.col("s").alias("s0"))
        by_b = g.join(strong.select("a", F.col("fb").alias("v"), "s"), "a").select("a", "b", "s0", "s", F.col("fb").alias("u"), "v")
        by_a = g.join(strong.select("b", F.col("fa").alias("v"), "s"), "b").select("a", "b", "s0", "s", F.col("fa").alias("u"), "v")
        raised = by_b.unionByName(by_a).distinct().mapInPandas(_support, "a string, b string, s double").groupBy("a", "b").agg(F.max("s").alias("up"))
        raised = cut(raised.where(f"up >= {STRONG}"))
        if raised.isEmpty():
            free(raised)
            return edges.select("a", "b", "s", "placed")
        after = cut(edges.join(raised, ["a", "b"], "left").select("a", "b", "fa", "fb", F.coalesce("up", "s").alias("s"), "placed"))
        free(*tables, raised)
        tables = (after,)


def link(
    left: DataFrame, rights: list[DataFrame], *, record: str, name: str, address: str, country: str, keep_ratio: float = KEEP_RATIO
) -> DataFrame:
    """``left_id, right_id, confidence``: matching records of ``left`` and any of ``rights``.

    Records match if names mean the same firm and places agree; where an address is missing the name decides;
    a record without a name (null, empty, blank, the word null) matches nothing. Repeated rows are one record,
    an empty side gives no matches, further columns are ignored, long texts are read whole.
    """
    spark = left.sparkSession
    with phase(spark) as keep:
        records = keep(_records([("l", left), *[("r", r) for r in rights]], record, name, address, country))
    with phase(spark) as keep:
        edges = keep(cut(_place_edges(records)))
    with phase(spark) as keep:
        # the few pairs that come both ways are compared twice and are one in the end
        pairs = edges.where("may").drop("may").unionByName(_in_spite(records).withColumn("place", F.lit(None).cast("double")))
        of = lambda side, x: records.where(F.col("side") == side).select(F.col("id").alias(x), F.col("form").alias("f" + x), F.col("addr").alias("a" + x)).dropDuplicates([x])
        full = pairs.join(of("l", "a"), "a").join(of("r", "b"), "b")
        similar = full.select("a", "b", "fa", "fb", "aa", "ab", "place").mapInPandas(_similar, "a string, b string, fa string, fb string, place double, s double, most int")
        similar = keep(cut(similar))
    with phase(spark) as keep:
        # the weight of the edges is asked for matches only
        kept = _prune(records, edges, similar.where("place is not null"), keep_ratio)
        compared = kept.unionByName(similar.where("place is null").select(*kept.columns))
        compared = keep(cut(compared.withColumn("placed", F.lit(True))))
    free(edges, similar)
    with phase(spark) as keep:
        named = keep(cut(_named(records).withColumn("placed", F.lit(False))))
    free(records)
    # records delivered twice, with and without address, may meet in both ways
    final = _propagate(compared, named).where(f"s >= {STRONG}")
    final = final.groupBy("a", "b").agg(F.max(F.col("s") * F.when(F.col("placed"), 1.0).otherwise(WITHOUT_PLACE)).alias("s"))
    return final.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.round("s", 4).alias("confidence"))
