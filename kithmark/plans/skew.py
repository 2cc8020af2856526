"""Queries of problem 1: a few keys holding most records."""

from __future__ import annotations

from kithmark.operators.heavy_keys import keys_above, per_key_figures
from kithmark.runtime import table

KEYS = ["country_clean", "business_name_normalized"]
T = "train_source1_processed"


def p1_found(spark, sf_dir):
    """Keys with at least 1 % of all rows."""
    return keys_above(table(spark, sf_dir, T), KEYS, 0.01).select(*KEYS)


def p1_key_figures(spark, sf_dir):
    """Rows, distinct records and latest arrival of every key."""
    return per_key_figures(table(spark, sf_dir, T), KEYS, record="entity_id", latest="received_at")


QUERIES = {"p1_found": p1_found, "p1_key_figures": p1_key_figures}
ORACLE = {
    "p1_found": f"""SELECT country_clean, business_name_normalized FROM {T}
        GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM {T})""",
    "p1_key_figures": f"""SELECT country_clean, business_name_normalized, count(*) AS n_rows,
        count(DISTINCT entity_id) AS n_records, max(received_at) AS latest FROM {T} GROUP BY 1, 2""",
}
