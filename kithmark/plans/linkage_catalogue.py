"""Queries of the linkage pipeline over the processed sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithmark.functions import similarity as S
from kithmark.functions.text import processed
from kithmark.operators import blocking as B, features as X, integrity as I, matching as M, profile as P
from kithmark.operators.tfidf import tfidf_cosine
from kithmark.runtime import cut, table
from kithmark.schema import PROCESSED_COLUMNS, RAW_COLUMNS
from kithmark.sources.files import explode_ids, hashed_sample

T1, T2, T3 = (f"train_source{n}_processed" for n in (1, 2, 3))
CAPS = B.Caps()
#: Lower caps for one more report of stop keys, so that there are some at every scale of the tests.
LOW_CAPS = B.Caps(200, 150, 150, 40)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark, d, n):
    return table(spark, d, f"train_source{n}_processed")


def _sources(spark, d):
    return {f"S{n}": _t(spark, d, n) for n in (1, 2, 3)}


def _targets(spark, d):
    return _t(spark, d, 2).unionByName(_t(spark, d, 3))


def _views(spark, d):
    return B.blocking_view(_t(spark, d, 1)), B.blocking_view(_targets(spark, d))


def _matches(spark, d):
    return table(spark, d, "train_matches")


def _truth(spark, d):
    lists = P.match_lists_of(_matches(spark, d), "source1_entity_id", "match_entity_ids")
    return lists.select(F.trim("s1_id").alias("s1_id"), F.explode("ids").alias("target_id")).distinct()


def _pairs(spark, d):
    left, right = _views(spark, d)
    return B.candidate_pairs(left, right, caps=CAPS).withColumnRenamed("target_id", "cand_id")


def _attributed(spark, d):
    return X.with_attributes(_pairs(spark, d), X.entity_attributes(*_sources(spark, d).values()))


# ---- text -----------------------------------------------------------------------------------------------

_RAW = f"SELECT DISTINCT entity_id, {{0}} FROM {T1}"


@query(f"SELECT DISTINCT entity_id, business_name_clean, business_name_normalized FROM {T1}")
def normalize_names(spark, d):
    return processed(_t(spark, d, 1).select(*RAW_COLUMNS)).select("entity_id", "business_name_clean", "business_name_normalized").distinct()


@query(f"SELECT DISTINCT entity_id, business_address_clean, business_address_normalized FROM {T1}")
def normalize_addresses(spark, d):
    return processed(_t(spark, d, 1).select(*RAW_COLUMNS)).select("entity_id", "business_address_clean", "business_address_normalized").distinct()


@query(f"SELECT DISTINCT entity_id, country_clean FROM {T1} UNION SELECT DISTINCT entity_id, country_clean FROM {T2} UNION SELECT DISTINCT entity_id, country_clean FROM {T3}")
def clean_country(spark, d):
    parts = [processed(t.select("entity_id", "country")).select("entity_id", "country_clean") for t in _sources(spark, d).values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query(f"SELECT DISTINCT entity_id, business_name_length, business_name_token_count, business_address_length, business_address_token_count FROM {T1}")
def text_sizes(spark, d):
    p = processed(_t(spark, d, 1).select(*RAW_COLUMNS), composed=True)
    return p.select("entity_id", "business_name_length", "business_name_token_count", "business_address_length", "business_address_token_count").distinct()


_NAME_LEAD = r"^(the|a|an|hotel|shree|sri|shri|dr|m/s|ms|pvt|private|ltd|limited|llc|inc|corp|co)\s+"
_ADDR_LEAD = r"^(h\.?number|flat number|door number|door no|plot no|flat no|house no|old number|new number|number|no\.?)\s*"


def _view_sql(t: str) -> str:
    return rf"""SELECT entity_id AS id, coalesce(country_clean, '') AS country, coalesce(business_name_normalized, '') AS name_norm,
        regexp_replace(regexp_replace(coalesce(business_name_normalized, ''), '^[.\-\s#/]+', ''), '{_NAME_LEAD}', '') AS clean_name,
        regexp_replace(regexp_replace(coalesce(business_address_normalized, ''), '^[.\-\s#/]+', ''), '{_ADDR_LEAD}', '') AS clean_addr,
        regexp_extract(coalesce(business_address_normalized, ''), '([0-9]{{2,6}})', 1) AS addr_num FROM {t}"""


def _tok_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT *, split_part(clean_name, ' ', 1) AS tok1, split_part(clean_name, ' ', 2) AS tok2, split_part(clean_name, ' ', 3) AS tok3,
        substring(clean_addr, 1, 9) AS addr9, substring(clean_name, 1, 3) AS name3, substring(clean_name, 1, 4) AS name4 FROM ({source}))"""


def _stops_sql(c: B.Caps) -> str:
    return f"""stops AS (
        SELECT country, 'token1' AS kind, tok1 AS key, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > {c.token1}
        UNION ALL SELECT country, 'token2', tok2, count(*) FROM r GROUP BY ALL HAVING count(*) > {c.token2}
        UNION ALL SELECT country, 'token3', tok3, count(*) FROM r GROUP BY ALL HAVING count(*) > {c.token3}
        UNION ALL SELECT country, 'address', addr9, count(*) FROM r WHERE length(clean_addr) >= 9 GROUP BY ALL HAVING count(*) > {c.address})"""


_ROUTE_SQL = [
    (1, "name_norm", "name_norm", "length(name_norm) >= 3", None), (2, "tok1", "tok1", "length(tok1) >= 3", "token1"),
    (3, "tok1", "tok2", "length(tok1) >= 4", "token2"), (4, "tok2", "tok1", "length(tok2) >= 4", "token1"),
    (5, "tok2", "tok2", "length(tok2) >= 4", "token2"), (6, "tok3", "tok3", "length(tok3) >= 4", "token3"),
    (7, "addr9", "addr9", "length(clean_addr) >= 9", "address"), (8, "addr_num || '|' || name3", "addr_num || '|' || name3", "addr_num <> '' AND length(clean_name) >= 3", None),
    (9, "name4", "name4", "length(clean_name) >= 4", None),
]


def _blocks_sql(caps: B.Caps, upto: int = 8) -> str:
    left = " UNION ALL ".join(
        f"SELECT id, country, {n} AS route, {l} AS key FROM l WHERE {g}" + (f" AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.kind = '{k}' AND s.country = l.country AND s.key = {l})" if k else "")
        for n, l, _, g, k in _ROUTE_SQL[:upto]
    )
    right = " UNION ".join(f"SELECT id, country, {n} AS route, {r} AS key FROM r" for n, _, r, _, _ in _ROUTE_SQL[:upto])
    return f"""WITH {_tok_sql("l", f"SELECT DISTINCT * FROM ({_view_sql(T1)}) WHERE country <> ''")},
        {_tok_sql("r", f"SELECT * FROM ({_view_sql(T2)} UNION ALL {_view_sql(T3)}) WHERE country <> ''")}, {_stops_sql(caps)},
        lk AS (SELECT DISTINCT * FROM ({left}) WHERE key <> ''), rk AS (SELECT DISTINCT * FROM ({right}) WHERE key <> '')"""


def _lists_sql(caps: B.Caps) -> str:
    fold = "SELECT id, []::VARCHAR[] AS acc FROM lists"
    steps, prev = [], "f0"
    for n in range(1, 9):
        steps.append(f"f{n} AS (SELECT {prev}.id, list_distinct(list_concat(acc, coalesce(t{n}, [])[1:15 - len(acc)])) AS acc FROM {prev} JOIN lists USING (id))")
        prev = f"f{n}"
    cols = ", ".join(f"max(ids) FILTER (route = {n}) AS t{n}" for n in range(1, 9))
    return f"""{_blocks_sql(caps)},
        blocks AS (SELECT country, route, key, list(id ORDER BY id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY country, route, key ORDER BY id) AS rn FROM rk) WHERE rn <= 15 GROUP BY ALL),
        lists AS (SELECT lk.id, {cols} FROM lk JOIN blocks USING (country, route, key) GROUP BY lk.id), f0 AS ({fold}), {", ".join(steps)}"""


@query(f"""WITH {_tok_sql("v", _view_sql(T1))} SELECT DISTINCT id, clean_name, clean_addr, addr_num, tok1, tok2, tok3 FROM v""")
def blocking_keys(spark, d):
    return _views(spark, d)[0].select("id", "clean_name", "clean_addr", "addr_num", "tok1", "tok2", "tok3").distinct()


@query(f"""WITH {_tok_sql("r", f"SELECT * FROM ({_view_sql(T2)} UNION ALL {_view_sql(T3)}) WHERE country <> ''")}, {_stops_sql(CAPS)} SELECT country, kind, key, n FROM stops""")
def stop_keys(spark, d):
    return B.stop_keys(_views(spark, d)[1], CAPS).withColumnRenamed("count", "n")


@query(f"""WITH {_tok_sql("r", f"SELECT * FROM ({_view_sql(T2)} UNION ALL {_view_sql(T3)}) WHERE country <> ''")}, {_stops_sql(LOW_CAPS)} SELECT country, kind, key, n FROM stops""")
def stop_keys_low_caps(spark, d):
    return B.stop_keys(_views(spark, d)[1], LOW_CAPS).withColumnRenamed("count", "n")


def _route_query(number: int):
    def run(spark, d):
        return B.route_sizes(*_views(spark, d), CAPS, [number]).select("s1_id", "n_targets")

    run.__name__ = f"route_{number}"
    run.__doc__ = f"Targets that route {number} alone brings for each primary record."
    sql = f"""{_blocks_sql(CAPS, 9)} SELECT lk.id AS s1_id, count(DISTINCT rk.id) AS n_targets FROM lk JOIN rk USING (country, route, key) WHERE route = {number} GROUP BY lk.id"""
    query(sql)(run)


for _n in range(1, 10):
    _route_query(_n)


@query(f"{_lists_sql(CAPS)} SELECT id AS s1_id, unnest(acc) AS target_id FROM f8")
def capped_candidates(spark, d):
    return B.candidate_pairs(*_views(spark, d), caps=CAPS)


@query(f"""{_lists_sql(CAPS)} SELECT s.id AS source1_entity_id, coalesce(array_to_string(list_sort(acc), ','), '') AS candidate_entity_ids
    FROM (SELECT DISTINCT entity_id AS id FROM {T1}) s LEFT JOIN f8 USING (id)""")
def candidate_lists(spark, d):
    return B.candidate_lists(*_views(spark, d), caps=CAPS)


@query(f"""{_lists_sql(CAPS)} SELECT count(*) AS n_records, count(acc) AS n_covered, coalesce(sum(len(acc)), 0)::BIGINT AS n_pairs, round(avg(coalesce(len(acc), 0)), 6) AS mean_candidates
    FROM (SELECT DISTINCT entity_id AS id FROM {T1}) s LEFT JOIN f8 USING (id)""")
def blocking_coverage(spark, d):
    left, right = _views(spark, d)
    lists = left.select(F.col("id").alias("s1_id")).distinct().join(B.capped_lists(left, right, caps=CAPS), "s1_id", "left")
    n = F.coalesce(F.size("targets"), F.lit(0))
    n = F.when(F.col("targets").isNull(), 0).otherwise(n)
    return lists.agg(F.count(F.lit(1)).alias("n_records"), F.count("targets").alias("n_covered"), F.sum(n).alias("n_pairs"), F.round(F.avg(n), 6).alias("mean_candidates"))


_TRUTH = r"""truth AS (SELECT DISTINCT trim(source1_entity_id) AS s1_id, trim(x) AS target_id FROM
    (SELECT source1_entity_id, unnest(string_split(regexp_replace(coalesce(match_entity_ids, ''), '[\[\]''"]', '', 'g'), ',')) AS x FROM train_matches)
    WHERE trim(x) <> '' AND lower(trim(x)) NOT IN ('nan', 'none', 'null'))"""


@query(f"""{_blocks_sql(B.Caps(1500, 1500, 1500, 500), 9)}, {_TRUTH},
    hit AS (SELECT DISTINCT s1_id, target_id FROM truth t JOIN lk ON lk.id = s1_id JOIN rk ON rk.id = target_id AND rk.country = lk.country AND rk.route = lk.route AND rk.key = lk.key)
    SELECT count(h.target_id) AS captured_true_pairs, count(*) AS total_true_pairs, round(100.0 * count(h.target_id) / count(*), 2) AS candidate_recall_pct
    FROM truth LEFT JOIN hit h USING (s1_id, target_id)""")
def blocking_recall(spark, d):
    """Ceiling of the routes: no cap per record."""
    left, right = _views(spark, d)
    return B.recall(B.captured(_truth(spark, d), left, right))


@query(f"""{_lists_sql(CAPS)}, {_TRUTH}, c AS (SELECT id AS s1_id, unnest(acc) AS target_id FROM f8)
    SELECT count(c.target_id) AS captured_true_pairs, count(*) AS total_true_pairs, round(100.0 * count(c.target_id) / count(*), 2) AS candidate_recall_pct
    FROM truth LEFT JOIN c USING (s1_id, target_id)""")
def blocking_recall_capped(spark, d):
    c = B.candidate_pairs(*_views(spark, d), caps=CAPS).withColumn("captured", F.lit(True))
    return B.recall(_truth(spark, d).join(c, ["s1_id", "target_id"], "left").na.fill(False, ["captured"]))


# ---- ground truth ----------------------------------------------------------------------------------------

_LISTS = r"""lists AS (SELECT source1_entity_id AS s1_id, list_filter(list_transform(string_split(regexp_replace(coalesce(match_entity_ids, ''), '[\[\]''"]', '', 'g'), ','), lambda x: trim(x)),
    lambda x: x <> '' AND lower(x) NOT IN ('nan', 'none', 'null')) AS ids FROM train_matches)"""


def _lists(spark, d):
    return P.match_lists_of(_matches(spark, d), "source1_entity_id", "match_entity_ids")


@query(f"WITH {_TRUTH} SELECT s1_id, target_id FROM truth")
def gt_explode(spark, d):
    return _truth(spark, d)


@query("""SELECT DISTINCT source1_entity_id AS s1_id, trim(x) AS target_id FROM (SELECT source1_entity_id, unnest(string_split(coalesce(match_entity_ids, ''), ',')) AS x FROM train_matches) WHERE trim(x) <> ''""")
def gt_explode_plain(spark, d):
    """The plain reader, which leaves brackets and words for nothing in place."""
    return explode_ids(_matches(spark, d), "source1_entity_id", "match_entity_ids").distinct()


@query(f"""WITH {_LISTS} SELECT count(*) AS n_rows, count(*) FILTER (len(ids) = 0) AS n0, count(*) FILTER (len(ids) = 1) AS n1, count(*) FILTER (len(ids) = 2) AS n2, count(*) FILTER (len(ids) = 3) AS n3,
    count(*) FILTER (len(ids) >= 2) AS n2_or_more, max(len(ids)) AS most, round(avg(len(ids)), 6) AS mean, round(avg((len(ids) = 0)::INT), 6) AS singleton_rate,
    count(*) FILTER (len(ids) <> len(list_distinct(ids))) AS rows_with_repeats FROM lists""")
def gt_stats(spark, d):
    return P.match_stats(_lists(spark, d))


@query(f"WITH {_LISTS} SELECT len(ids) AS n_matches, count(*) AS n_rows FROM lists GROUP BY 1")
def gt_histogram(spark, d):
    return P.match_histogram(_lists(spark, d))


@query(f"WITH {_LISTS} SELECT CASE WHEN split_part(id, '-', 1) IN ('S1', 'S2', 'S3') THEN split_part(id, '-', 1) ELSE 'other' END AS source, count(*) AS n FROM (SELECT unnest(ids) AS id FROM lists) GROUP BY 1")
def gt_by_source(spark, d):
    return P.match_sources(_lists(spark, d))


@query(f"""WITH {_LISTS}, c AS (SELECT len(ids)::DOUBLE AS n FROM lists) SELECT count(*) AS n_rows, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min_v,
    quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3, max(n) AS max_v FROM c""")
def match_count_summary(spark, d):
    n = _lists(spark, d).select(F.size("ids").cast("double").alias("n"))
    q = lambda p: F.percentile("n", F.lit(p))
    return n.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("min_v"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max("n").alias("max_v"))


# ---- integrity -------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT 'S{n}' AS source, count(*) AS n_rows, count(*) FILTER (NOT coalesce(starts_with(entity_id, 'S{n}-'), false)) AS n_bad FROM {t}" for n, t in ((1, T1), (2, T2), (3, T3))))
def integrity_prefix(spark, d):
    return I.prefix_violations(_sources(spark, d))


@query(" UNION ALL ".join(f"SELECT 'S{n}' AS source, count(entity_id) AS n_rows, count(DISTINCT entity_id) AS n_ids, count(entity_id) - count(DISTINCT entity_id) AS n_repeated FROM {t}" for n, t in ((1, T1), (2, T2), (3, T3))))
def integrity_unique(spark, d):
    return I.id_uniqueness(_sources(spark, d))


@query(f"""WITH t AS (SELECT DISTINCT trim(source1_entity_id) AS id FROM train_matches), s AS (SELECT DISTINCT entity_id AS id FROM {T1})
    SELECT count(*) FILTER (t.id IS NOT NULL AND s.id IS NOT NULL) AS in_both, count(*) FILTER (s.id IS NULL) AS only_truth, count(*) FILTER (t.id IS NULL) AS only_source FROM t FULL JOIN s ON t.id = s.id""")
def integrity_completeness(spark, d):
    return I.completeness(_matches(spark, d).select(F.trim("source1_entity_id").alias("s1_id")), _t(spark, d, 1))


@query(f"""WITH {_TRUTH}, known AS (SELECT entity_id AS id FROM {T2} UNION SELECT entity_id FROM {T3}) SELECT count(*) AS n_links, count(DISTINCT target_id) AS n_targets,
    count(DISTINCT target_id) FILTER (target_id NOT IN (SELECT id FROM known)) AS n_unknown FROM truth""")
def integrity_orphans(spark, d):
    return I.unknown_targets(_truth(spark, d), _t(spark, d, 2), _t(spark, d, 3))


@query(f"WITH {_TRUTH} SELECT count(*) FILTER (contains(target_id, 'S1-')) AS n_primary_targets FROM truth")
def integrity_primary_targets(spark, d):
    return I.primary_as_target(_truth(spark, d))


@query("""WITH a AS (SELECT column_name FROM (DESCRIBE train_source1_processed)), b AS (SELECT column_name FROM (DESCRIBE customer))
    SELECT coalesce(a.column_name, b.column_name) AS column_name, a.column_name IS NOT NULL AS in_a, b.column_name IS NOT NULL AS in_b
    FROM a FULL JOIN b ON a.column_name = b.column_name WHERE a.column_name IS NULL OR b.column_name IS NULL""")
def schema_diff(spark, d):
    return I.schema_difference(_t(spark, d, 1), table(spark, d, "customer"))


def _check_sql(raw: str, out: str) -> str:
    """The four figures of an output check, from the stored tables."""
    cols = ", ".join(RAW_COLUMNS)
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in RAW_COLUMNS)
    derived = " OR ".join(f"{c} IS NULL" for c in PROCESSED_COLUMNS if c.endswith(("_clean", "_normalized")))
    return f"""WITH a AS (SELECT {cols}, count(*) AS n FROM {raw} GROUP BY ALL), b AS (SELECT {cols}, count(*) AS n FROM {out} GROUP BY ALL),
        j AS (SELECT coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM a FULL JOIN b ON {on})
        SELECT 'rows_lost_or_changed' AS metric, coalesce(sum(greatest(na - nb, 0)), 0)::BIGINT AS n FROM j UNION ALL SELECT 'rows_gained_or_changed', coalesce(sum(greatest(nb - na, 0)), 0)::BIGINT FROM j
        UNION ALL SELECT 'nulls_in_derived', count(*) FILTER ({derived}) FROM {out}
        UNION ALL SELECT 'additional_duplicates', greatest((SELECT sum(n) - count(*) FROM b) - (SELECT sum(n) - count(*) FROM a), 0)::BIGINT"""


@query(_check_sql(T1, T1))
def validate_output(spark, d):
    raw = _t(spark, d, 1).select(*RAW_COLUMNS)
    return I.output_check(raw, processed(raw))


@query(_check_sql(T2, T3))
def validate_other_output(spark, d):
    """The same check where hardly a row agrees: the output of source 3 held against source 2."""
    return I.output_check(_t(spark, d, 2).select(*RAW_COLUMNS), processed(_t(spark, d, 3).select(*RAW_COLUMNS)))


@query(" UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS column_name, count(*) FILTER (coalesce({c}::VARCHAR, '') <> '') AS n_filled, count(DISTINCT {c}) AS n_distinct FROM {T1}" for i, c in enumerate(PROCESSED_COLUMNS)))
def readback_columns(spark, d):
    """Columns of the processed output in their order, each with how many rows have a value and how many values there are."""
    out = processed(_t(spark, d, 1).select(*RAW_COLUMNS))
    one = out.agg(*[F.sum((F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("long")).alias(f"f{i}") for i, c in enumerate(out.columns)], *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(out.columns)])
    return one.selectExpr(f"stack({len(out.columns)}, " + ", ".join(f"{i}, '{c}', f{i}, d{i}" for i, c in enumerate(out.columns)) + ") as (place, column_name, n_filled, n_distinct)")


# ---- profiles --------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS n_missing, round(100.0 * count(*) FILTER ({c} IS NULL OR trim({c}) = '') / count(*), 4) AS pct FROM {T1}" for c in RAW_COLUMNS))
def profile_missing(spark, d):
    return P.missing(_t(spark, d, 1), RAW_COLUMNS)


@query(" UNION ALL ".join(f"SELECT 'S{i}' AS source, '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR trim({c}) = '') AS n_missing, count(DISTINCT {c}) AS n_distinct FROM {t}" for i, t in ((1, T1), (2, T2), (3, T3)) for c in RAW_COLUMNS))
def profile_sources(spark, d):
    """Missing and distinct values of the raw columns of every source."""
    out = None
    for name, t in _sources(spark, d).items():
        part = P.missing(t, RAW_COLUMNS).join(P.distinct_values(t, RAW_COLUMNS), "column_name").select(F.lit(name).alias("source"), "column_name", "n_missing", "n_distinct")
        out = part if out is None else out.unionByName(part)
    return out


@query(" UNION ALL ".join(f"SELECT 'S{i}' AS source, count(*) AS n_names, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT business_name, count(*) AS n FROM {t} WHERE business_name <> '' GROUP BY 1 HAVING count(*) > 1)" for i, t in ((1, T1), (2, T2), (3, T3))))
def duplicate_names(spark, d):
    """How many names of each source occur more than once, and in how many rows."""
    out = None
    for name, t in _sources(spark, d).items():
        part = t.where("business_name <> ''").groupBy("business_name").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_names"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows")).select(F.lit(name).alias("source"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM {T1}" for c in RAW_COLUMNS))
def profile_unique(spark, d):
    return P.distinct_values(_t(spark, d, 1), RAW_COLUMNS)


@query(f"""SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT entity_id, business_name, business_address, country FROM {T1})) AS duplicate_rows,
    count(*) - count(DISTINCT entity_id) AS duplicate_ids FROM {T1}""")
def profile_duplicates(spark, d):
    return P.duplicates(_t(spark, d, 1), "entity_id", RAW_COLUMNS[1:])


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, min({c})::DOUBLE AS min_v, max({c})::DOUBLE AS max_v, round(avg({c}), 6) AS mean_v, median({c}::DOUBLE) AS median_v FROM {T1}" for c in PROCESSED_COLUMNS if c.endswith(("length", "count"))))
def length_stats(spark, d):
    return P.length_stats(_t(spark, d, 1), {c: F.col(c) for c in PROCESSED_COLUMNS if c.endswith(("length", "count"))})


@query(f"SELECT country AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM {T1}), 4) AS pct FROM {T1} GROUP BY 1")
def country_distribution(spark, d):
    return P.value_counts(_t(spark, d, 1), "country")


@query(rf"""SELECT country_clean, count(*) AS n, count(*) FILTER (regexp_matches(coalesce(business_name, ''), '[^\x00-\x7F]')) AS n_non_ascii,
    round(100.0 * count(*) FILTER (regexp_matches(coalesce(business_name, ''), '[^\x00-\x7F]')) / count(*), 4) AS pct FROM {T1} WHERE country_clean <> '' GROUP BY 1 ORDER BY n DESC, country_clean LIMIT 5""")
def nonascii_by_country(spark, d):
    return P.non_ascii_by_country(_t(spark, d, 1))


_CASE = r"""v AS (SELECT coalesce(business_name, '') AS v FROM train_source1_processed), c AS (SELECT v, regexp_matches(v, '[\p{Lu}\p{Ll}\p{Lt}]') AS cased FROM v),
    f AS (SELECT cased AND upper(v) = v AND NOT regexp_matches(v, '[\p{Ll}\p{Lt}]') AS u, cased AND lower(v) = v AND NOT regexp_matches(v, '[\p{Lu}\p{Lt}]') AS l,
    cased AND NOT regexp_matches(v, '[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]') AND NOT regexp_matches(v, '(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}') AS t, v <> '' AS a FROM c)"""


@query(f"""WITH {_CASE}, n AS (SELECT count(*) FILTER (u) AS u, count(*) FILTER (l) AS l, count(*) FILTER (t) AS t, count(*) FILTER (a) AS a FROM f)
    SELECT 'upper' AS metric, u AS n FROM n UNION ALL SELECT 'lower', l FROM n UNION ALL SELECT 'title', t FROM n UNION ALL SELECT 'mixed', a - u - l - t FROM n""")
def casing_counts(spark, d):
    return P.casing(_t(spark, d, 1), "business_name")


def _flags_sql(column: str, patterns: dict[str, str]) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER (regexp_matches(coalesce({column}, ''), '(?i){p}')) AS n FROM {T1}" for k, p in patterns.items())
    return each


def _marks_sql(column: str, tests: dict[str, str]) -> str:
    """Each test is written out here for itself, not taken from the patterns that are checked."""
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({t}) AS n FROM (SELECT coalesce({column}, '') AS v FROM {T1})" for k, t in tests.items())


@query(_marks_sql("business_name", {"ampersand": "contains(v, '&')", "slash": "contains(v, '/')", "period": "contains(v, '.')", "comma": "contains(v, ',')", "parenthesis": "contains(v, '(') OR contains(v, ')')",
    "non_ascii": "octet_length(encode(v)) > length(v)", "repeated_space": r"regexp_matches(v, '[\s\x0B\x1C-\x1F\x{85}\p{Z}][\s\x0B\x1C-\x1F\x{85}\p{Z}]')", "leading_dash": "starts_with(v, '-')", "leading_angle": "starts_with(v, '<')",
    "and_word": "list_contains(regexp_split_to_array(lower(v), '[^\\p{L}\\p{N}_]+'), 'and')"}))
def name_char_flags(spark, d):
    return P.flag_counts(_t(spark, d, 1), "business_name", P.NAME_FLAGS)


@query(_marks_sql("business_address", {"comma": "contains(v, ',')", "dash": "contains(v, '-')", "slash": "contains(v, '/')", "hash": "contains(v, '#')", "non_ascii": "octet_length(encode(v)) > length(v)",
    "repeated_space": r"regexp_matches(v, '[\s\x0B\x1C-\x1F\x{85}\p{Z}][\s\x0B\x1C-\x1F\x{85}\p{Z}]')", "null_word": "list_contains(regexp_split_to_array(lower(v), '[^\\p{L}\\p{N}_]+'), 'null')", "blank": r"regexp_matches(v, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]*$')"}))
def addr_char_flags(spark, d):
    return P.flag_counts(_t(spark, d, 1), "business_address", P.ADDRESS_FLAGS)


@query(_flags_sql("business_name", P.LEGAL_SUFFIXES))
def legal_suffixes(spark, d):
    return P.flag_counts(_t(spark, d, 1), "business_name", P.LEGAL_SUFFIXES)


@query(_flags_sql("business_address", P.POSTAL))
def postal_patterns(spark, d):
    return P.flag_counts(_t(spark, d, 1), "business_address", P.POSTAL)


@query(_flags_sql("business_address", P.COMPONENTS))
def addr_components(spark, d):
    return P.flag_counts(_t(spark, d, 1), "business_address", P.COMPONENTS)


@query(rf"""WITH w AS (SELECT list_filter(string_split_regex(coalesce(business_address, ''), '\s+'), lambda x: length(x) >= 2 AND regexp_matches(x, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]') AND upper(x) = x AND NOT regexp_matches(x, '[\p{{Ll}}\p{{Lt}}]')) AS caps FROM {T1})
    SELECT count(*) FILTER (len(caps) > 0) AS n_rows FROM w""")
def caps_tokens(spark, d):
    return _t(spark, d, 1).agg(F.sum(P.rows_with_capital_word(None, "business_address").cast("long")).alias("n_rows"))


@query(f"SELECT business_name AS value, count(*) AS n FROM {T1} WHERE business_name <> '' GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, value LIMIT 10")
def top_duplicate_names(spark, d):
    return P.top_values(_t(spark, d, 1), "business_name")


@query(f"SELECT count(*) AS n_ambiguous, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT lower(trim(business_name)) AS v, count(*) AS n FROM {T1} GROUP BY 1) WHERE v <> '' AND n > 1")
def ambiguous_names(spark, d):
    return P.ambiguous_values(_t(spark, d, 1), "business_name")


@query("SELECT count(*) AS n_ambiguous, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (SELECT lower(trim(p_name)) AS v, count(*) AS n FROM part GROUP BY 1) WHERE v <> '' AND n > 1")
def ambiguous_part_names(spark, d):
    return P.ambiguous_values(table(spark, d, "part"), "p_name")


_NAMES = ", ".join(f"n{n} AS (SELECT DISTINCT lower(trim(business_name)) AS v FROM {t} WHERE lower(trim(business_name)) <> '')" for n, t in ((1, T1), (2, T2), (3, T3)))


@query(f"""WITH {_NAMES} SELECT 'S1_S2' AS combination, count(*) AS n FROM n1 JOIN n2 USING (v) UNION ALL SELECT 'S1_S3', count(*) FROM n1 JOIN n3 USING (v)
    UNION ALL SELECT 'S2_S3', count(*) FROM n2 JOIN n3 USING (v) UNION ALL SELECT 'S1_S2_S3', count(*) FROM n1 JOIN n2 USING (v) JOIN n3 USING (v)""")
def name_overlap(spark, d):
    return P.name_overlap(_sources(spark, d))


@query(f"""SELECT 'name_cleaned' AS metric, count(*) FILTER (coalesce(business_name, '') <> business_name_clean) AS n FROM {T1}
    UNION ALL SELECT 'name_normalized', count(*) FILTER (lower(coalesce(business_name, '')) <> business_name_normalized) FROM {T1}
    UNION ALL SELECT 'address_cleaned', count(*) FILTER (coalesce(business_address, '') <> business_address_clean) FROM {T1}""")
def cleaning_effect(spark, d):
    return P.cleaning_effect(_t(spark, d, 1))


# ---- pair features ---------------------------------------------------------------------------------------

_ENT = f"""ent AS (SELECT entity_id AS id, max(coalesce(business_name_normalized, '')) AS n, max(coalesce(business_address_normalized, '')) AS a, max(coalesce(country_clean, '')) AS c
    FROM (SELECT * FROM {T1} UNION ALL SELECT * FROM {T2} UNION ALL SELECT * FROM {T3}) GROUP BY 1)"""
_PAIR = f"""{_lists_sql(CAPS)}, {_ENT}, cand AS (SELECT id AS s1_id, unnest(acc) AS cand_id FROM f8),
    p AS (SELECT s1_id, cand_id, x.n AS n1, y.n AS n2, x.a AS a1, y.a AS a2, x.c AS c1, y.c AS c2 FROM cand JOIN ent x ON x.id = s1_id JOIN ent y ON y.id = cand_id)"""
_toks = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> ''))"
_grams = lambda c, n: f"list_distinct(list_transform(range(1, greatest(length({c}) - {n} + 1, 1) + 1), lambda i: substring({c}, i, {n})))"
_jac = lambda x, y: f"CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0 WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"
_ovl = lambda x, y: f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})) END"
_rat = lambda x, y: f"CASE WHEN {x} = 0 AND {y} = 0 THEN 1.0 WHEN {x} = 0 OR {y} = 0 THEN 0.0 ELSE least({x}, {y})::DOUBLE / greatest({x}, {y}) END"
_gj = lambda a, b, n: f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE {_jac(_grams(a, n), _grams(b, n))} END"
_wc = lambda c: f"len(list_filter(string_split({c}, ' '), lambda w: w <> ''))"
_SET = {
    "f_name_jaccard": _jac("tn1", "tn2"), "f_name_overlap": _ovl("tn1", "tn2"), "f_addr_jaccard": _jac("ta1", "ta2"), "f_addr_overlap": _ovl("ta1", "ta2"),
    "f_name_in_addr_overlap": _ovl("tn1", "ta2"), "f_name_char3gram": _gj("n1", "n2", 3), "f_name_char4gram": _gj("n1", "n2", 4), "f_addr_char3gram": _gj("a1", "a2", 3),
    "f_name_len_ratio": _rat("length(n1)", "length(n2)"), "f_addr_len_ratio": _rat("length(a1)", "length(a2)"), "f_name_token_ratio": _rat(_wc("n1"), _wc("n2")),
    "f_name_exact_match": "(n1 = n2 AND n1 <> '')::INT", "f_addr_exact_match": "(a1 = a2 AND a1 <> '')::INT", "f_both_addr_empty": "(a1 = '' AND a2 = '')::INT",
    "f_addr_missing_one": "((a1 = '') <> (a2 = ''))::INT", "f_country_match": "(c1 = c2 AND c1 <> '')::INT", "f_both_country_missing": "(c1 = '' AND c2 = '')::INT",
}
_TOKP = f"t AS (SELECT *, {_toks('n1')} AS tn1, {_toks('n2')} AS tn2, {_toks('a1')} AS ta1, {_toks('a2')} AS ta2 FROM p)"


@query(f"{_PAIR}, {_TOKP} SELECT s1_id, cand_id, " + ", ".join(f"round({e}, 6)::DOUBLE AS {k}" for k, e in _SET.items()) + " FROM t")
def pair_features_set(spark, d):
    f = X.pair_features(_attributed(spark, d), jaro_winkler=False)
    return f.select("s1_id", "cand_id", *[F.round(c, 6).alias(c) for c in _SET])


@query()
def pair_features_jw(spark, d):
    f = X.pair_features(_attributed(spark, d))
    return f.select("s1_id", "cand_id", *[F.round(c, 6).alias(c) for c in X.FEATURES if "jaro" in c])


@query(f"{_PAIR} SELECT s1_id, cand_id, n1, n2, a1, a2, c1, c2 FROM p")
def entity_lookup_join(spark, d):
    return _attributed(spark, d).select("s1_id", "cand_id", "n1", "n2", "a1", "a2", "c1", "c2")


def _tfidf_sql(a: str, b: str, out: str) -> str:
    return rf"""{_PAIR}, texts AS (SELECT text, count(*) AS times FROM (SELECT {a} AS text FROM p UNION ALL SELECT {b} FROM p) GROUP BY 1),
        words AS (SELECT text, times, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM texts),
        each AS (SELECT text, times, term, count(*) AS tf FROM (SELECT text, times, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words) GROUP BY ALL),
        known AS (SELECT term, sum(times) AS df, sum(tf * times) AS total FROM each GROUP BY 1 HAVING sum(times) >= 2 ORDER BY total DESC, term LIMIT 50000),
        w AS (SELECT text, term, (1 + ln(tf)) * (ln((1.0 + (SELECT sum(times) FROM texts)) / (1.0 + df)) + 1) AS w FROM each JOIN known USING (term)),
        norm AS (SELECT text, sqrt(sum(w * w)) AS len FROM w GROUP BY 1),
        pairs AS (SELECT DISTINCT {a} AS x, {b} AS y FROM p), dots AS (SELECT x, y, sum(u.w * v.w) AS s FROM pairs JOIN w u ON u.text = x JOIN w v ON v.text = y AND v.term = u.term GROUP BY ALL),
        cos AS (SELECT x, y, s / (m.len * n.len) AS c FROM dots JOIN norm m ON m.text = x JOIN norm n ON n.text = y)
        SELECT s1_id, cand_id, round(coalesce(c, 0), 6) AS {out} FROM p LEFT JOIN cos ON x = {a} AND y = {b}"""


@query(_tfidf_sql("n1", "n2", "f_tfidf_name_cosine"))
def tfidf_name_cosine(spark, d):
    o = "f_tfidf_name_cosine"
    return tfidf_cosine(_attributed(spark, d), "n1", "n2", o).select("s1_id", "cand_id", F.round(o, 6).alias(o))


@query(_tfidf_sql("a1", "a2", "f_tfidf_addr_cosine"))
def tfidf_addr_cosine(spark, d):
    o = "f_tfidf_addr_cosine"
    return tfidf_cosine(_attributed(spark, d), "a1", "a2", o).select("s1_id", "cand_id", F.round(o, 6).alias(o))


def _labelled(spark, d):
    """Pairs of records that the ground truth covers."""
    covered = _matches(spark, d).select(F.trim("source1_entity_id").alias("s1_id")).distinct()
    return X.labelled(_attributed(spark, d).join(covered, "s1_id", "left_semi"), _truth(spark, d))


_LAB = f"""{_PAIR}, {_TRUTH}, lab AS (SELECT t.*, (g.target_id IS NOT NULL)::INT AS label FROM p t
    SEMI JOIN (SELECT DISTINCT trim(source1_entity_id) AS s1_id FROM train_matches) k USING (s1_id) LEFT JOIN truth g ON g.s1_id = t.s1_id AND g.target_id = t.cand_id)"""


@query(f"{_LAB} SELECT s1_id, cand_id, label FROM lab")
def pair_labels(spark, d):
    return _labelled(spark, d).select("s1_id", "cand_id", "label")


@query(f"{_LAB} SELECT label, count(*) AS n FROM lab GROUP BY 1")
def label_balance(spark, d):
    return _labelled(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_RANK = "row_number() OVER (PARTITION BY label ORDER BY md5(s1_id || '|' || cand_id || '|42'), s1_id, cand_id)"


@query(f"""{_LAB}, k AS (SELECT s1_id, cand_id, label, {_RANK} AS r FROM lab) SELECT s1_id, cand_id, label FROM k WHERE label = 1 OR r <= 2 * (SELECT count(*) FROM lab WHERE label = 1)""")
def downsampled_pairs(spark, d):
    return X.downsample(_labelled(spark, d), neg_pos_ratio=2).select("s1_id", "cand_id", "label")


@query(f"""{_LAB}, k AS (SELECT label, ({_RANK} - 1) % 5 AS fold FROM lab) SELECT label, fold::INT AS fold, count(*) AS n FROM k GROUP BY ALL""")
def stratified_folds(spark, d):
    return X.stratified_folds(_labelled(spark, d)).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT entity_id FROM (SELECT DISTINCT entity_id FROM {T1}) ORDER BY md5(entity_id || '|42'), entity_id LIMIT 100")
def sampled_records(spark, d):
    """A fixed sample of primary records in hash order."""
    return hashed_sample(_t(spark, d, 1).select("entity_id").distinct(), ["entity_id"], 100)


#: A plain score for the threshold reports: mean of the two set similarities.
_SCORE = f"{_LAB}, s0 AS (SELECT *, {_toks('n1')} AS tn1, {_toks('n2')} AS tn2, {_toks('a1')} AS ta1, {_toks('a2')} AS ta2 FROM lab), s AS (SELECT s1_id, cand_id, label, round((({_SET['f_name_jaccard']}) + ({_SET['f_addr_jaccard']})) / 2, 6) AS score FROM s0)"


def _scored(spark, d):
    f = X.pair_features(_labelled(spark, d), jaro_winkler=False)
    return f.select("s1_id", "cand_id", "label", F.round((F.col("f_name_jaccard") + F.col("f_addr_jaccard")) / 2, 6).alias("score"))


_PRF = """CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall"""
_F05 = "CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall) ELSE 0 END"


def _sweep_sql(grid: list[float]) -> str:
    g = ", ".join(f"{t}::DOUBLE" for t in grid)
    return f"""{_SCORE}, g AS (SELECT unnest([{g}]) AS threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
        count(*) FILTER (score < threshold AND label = 1) AS fn FROM g, s GROUP BY 1), m AS (SELECT *, {_PRF} FROM c), sweep AS (SELECT *, {_F05} AS f05 FROM m)"""


_ROUND = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f05, 6) AS f05"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f05")})


@query(f"{_sweep_sql([0.5])} SELECT tp, fp, fn, {_ROUND} FROM sweep")
def f05_metrics(spark, d):
    return _rounded(M.metrics_at(_scored(spark, d), 0.5))


@query(f"{_sweep_sql(M.SWEEP)} SELECT threshold, tp, fp, fn, {_ROUND} FROM sweep")
def threshold_sweep(spark, d):
    return _rounded(M.threshold_sweep(_scored(spark, d)))


@query(f"{_sweep_sql(M.GRID)} SELECT CASE WHEN f05 > 0 THEN threshold ELSE 0.5 END AS threshold, {_ROUND} FROM sweep ORDER BY round(sweep.f05, 12) DESC, sweep.threshold LIMIT 1")
def tune_threshold(spark, d):
    return _rounded(M.best_threshold(M.threshold_sweep(_scored(spark, d), M.GRID)))


_MATCH = f"{_SCORE}, m AS (SELECT s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id) FILTER (score >= 0.5), '') AS match_entity_ids FROM s GROUP BY 1)"


@query(f"{_MATCH} SELECT source1_entity_id, match_entity_ids FROM m")
def match_lists(spark, d):
    return M.match_lists(_scored(spark, d), 0.5)


_SUB = f"{_MATCH}, u AS (SELECT DISTINCT entity_id FROM {T1}), sub AS (SELECT entity_id AS source1_entity_id, coalesce(match_entity_ids, '') AS match_entity_ids FROM u LEFT JOIN m ON m.source1_entity_id = u.entity_id)"


@query(f"{_SUB} SELECT source1_entity_id, match_entity_ids FROM sub")
def submission(spark, d):
    """With records that have no candidates, as empty lists."""
    return M.match_lists(_scored(spark, d), 0.5, universe=_t(spark, d, 1).select(F.col("entity_id").alias("s1_id")))


@query(f"{_SUB} SELECT count(*) AS total, count(*) FILTER (match_entity_ids <> '') AS with_match, count(*) FILTER (match_entity_ids = '') AS singletons, round(avg((match_entity_ids <> '')::INT), 6) AS match_rate FROM sub")
def submission_summary(spark, d):
    return M.submission_summary(submission(spark, d))


@query(f"{_SUB} SELECT true AS columns_right, count(*) AS n_rows, count(*) FILTER (NOT starts_with(source1_entity_id, 'S1-')) AS n_bad_ids, count(*) FILTER (len(list_filter(string_split(match_entity_ids, ','), lambda x: x <> '' AND NOT regexp_matches(x, '^S[23]-'))) > 0) AS n_bad_targets FROM sub")
def submission_checks(spark, d):
    return I.submission_check(submission(spark, d))


_SOME = ["f_name_jaccard", "f_name_overlap", "f_addr_jaccard", "f_addr_overlap", "f_name_len_ratio", "f_addr_len_ratio"]
_FL = f"{_LAB}, s0 AS (SELECT *, {_toks('n1')} AS tn1, {_toks('n2')} AS tn2, {_toks('a1')} AS ta1, {_toks('a2')} AS ta2 FROM lab), fl AS (SELECT label, " + ", ".join(f"({_SET[f]})::DOUBLE AS {f}" for f in _SOME) + " FROM s0)"


def _feature_frame(spark, d):
    return X.pair_features(_labelled(spark, d), jaro_winkler=False).select("label", *_SOME)


@query(f"{_FL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}) FILTER (label = 1), 6) AS mean_match, round(avg({f}) FILTER (label = 0), 6) AS mean_other, round(avg({f}) FILTER (label = 1) - avg({f}) FILTER (label = 0), 6) AS delta FROM fl" for f in _SOME))
def feature_means_by_label(spark, d):
    df = _feature_frame(spark, d)
    m = lambda f, y: F.avg(F.when(F.col("label") == y, F.col(f)))
    one = df.agg(*[m(f, 1).alias(f"{f}_1") for f in _SOME], *[m(f, 0).alias(f"{f}_0") for f in _SOME])
    rows = ", ".join(f"'{f}', {f}_1, {f}_0" for f in _SOME)
    return one.selectExpr(f"stack({len(_SOME)}, {rows}) as (feature, x, y)").select("feature", F.round("x", 6).alias("mean_match"), F.round("y", 6).alias("mean_other"), F.round(F.col("x") - F.col("y"), 6).alias("delta"))


_CORR = [(a, b) for i, a in enumerate(_SOME) for b in _SOME[i + 1 :]]


@query(f"{_FL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS r FROM fl" for a, b in _CORR))
def feature_correlation(spark, d):
    one = _feature_frame(spark, d).agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(_CORR)])
    rows = ", ".join(f"'{a}', '{b}', c{i}" for i, (a, b) in enumerate(_CORR))
    return one.selectExpr(f"stack({len(_CORR)}, {rows}) as (a, b, r)").select("a", "b", F.round("r", 5).alias("r"))


@query(f"{_FL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, label, least(floor({f} * 30 + 1e-9), 29)::BIGINT AS bin, count(*) AS n FROM fl GROUP BY ALL" for f in _SOME))
def feature_histogram(spark, d):
    df = _feature_frame(spark, d)
    rows = ", ".join(f"'{f}', {f}" for f in _SOME)
    long = df.selectExpr("label", f"stack({len(_SOME)}, {rows}) as (feature, v)")
    return long.groupBy("feature", "label", F.least(F.floor(F.col("v") * 30 + F.lit(1e-9)), F.lit(29)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"), F.round(S.dot(F.col("embedding"), F.col("other")), 4).alias("dot"))


def _training(spark, d):
    return cut(X.downsample(X.pair_features(_labelled(spark, d), tfidf=True).select("s1_id", "cand_id", "label", *X.FEATURES)))


@query()
def gbt_cv(spark, d):
    """Cross-validated metrics of boosted trees over five stratified folds."""
    return M.Matcher().cross_validate(_training(spark, d))


@query()
def gbt_cv_by_record(spark, d):
    """The same with the pairs of a record in one fold."""
    return M.Matcher().cross_validate(_training(spark, d), by_record=True)


@query()
def forest_cv(spark, d):
    """Cross-validated metrics of the balanced forest over five stratified folds."""
    return M.Matcher("forest").cross_validate(_training(spark, d))


@query()
def cv_summary(spark, d):
    """Mean and deviation over folds."""
    cv = gbt_cv(spark, d)
    return cv.agg(*[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f05")], F.stddev_samp("f05").alias("std_f05"))


@query()
def gbt_predict(spark, d):
    """Trained on the covered records, applied to all pairs."""
    full = cut(X.pair_features(_attributed(spark, d), tfidf=True).select("s1_id", "cand_id", *X.FEATURES))
    covered = _matches(spark, d).select(F.trim("source1_entity_id").alias("s1_id")).distinct()
    m = M.Matcher().fit(cut(X.downsample(X.labelled(full.join(covered, "s1_id", "left_semi"), _truth(spark, d)))))
    return M.match_lists(m.score(full), m.threshold, universe=_t(spark, d, 1).select(F.col("entity_id").alias("s1_id")))
