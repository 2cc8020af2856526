"""Queries of problems 2 to 9."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithmark.llm.addresses import same_place_pairs
from kithmark.llm.components import components, parse_links
from kithmark.llm.forms import text_forms
from kithmark.llm.leakage import leaked_passages
from kithmark.llm.linkage import link
from kithmark.llm.mixture import mix
from kithmark.llm.names import same_firm_pairs
from kithmark.llm.spam import spam_pages
from kithmark.runtime import table

S1 = "train_source1_processed"


def _forms(spark, sf_dir):
    return text_forms(table(spark, sf_dir, S1), "entity_id", ["business_name", "business_address"])


def p2_found(spark, sf_dir):
    return _forms(spark, sf_dir).where("affected").select("entity_id", "field_name").distinct()


def p2_forms(spark, sf_dir):
    """The consistent form of every value."""
    return _forms(spark, sf_dir)


def p3_found(spark, sf_dir):
    return same_place_pairs(
        table(spark, sf_dir, S1), record="entity_id", raw="business_address", normalized="business_address_normalized", country="country"
    )


def _links(spark, sf_dir):
    """Records of source 1 without a row in train_matches against sources 2 and 3."""
    known = table(spark, sf_dir, "train_matches").select(F.trim("source1_entity_id").alias("entity_id")).distinct()
    left = table(spark, sf_dir, S1).join(known, "entity_id", "left_anti")
    rights = [table(spark, sf_dir, f"train_source{n}_processed") for n in (2, 3)]
    return link(left, rights, record="entity_id", name="business_name", address="business_address", country="country")


def p4_found(spark, sf_dir):
    return _links(spark, sf_dir).select(F.col("left_id").alias("source1_entity_id"), F.col("right_id").alias("match_entity_id"))


def p4_confidence(spark, sf_dir):
    """The matches with their confidence."""
    return _links(spark, sf_dir).select(F.col("left_id").alias("source1_entity_id"), F.col("right_id").alias("match_entity_id"), "confidence")


def p5_found(spark, sf_dir):
    return same_firm_pairs(table(spark, sf_dir, S1), record="entity_id", raw="business_name", normalized="business_name_normalized")


def p6_found(spark, sf_dir):
    links = parse_links(table(spark, sf_dir, "train_matches"), "source1_entity_id", "match_entity_ids")
    return components(links, "a", "b")


def _leaks(spark, sf_dir):
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark, sf_dir):
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_item_report(spark, sf_dir):
    """For each leaked item: pages that hold it and most words held."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_pages"), F.max("n_words").alias("most_words"))


def _mix(spark, sf_dir, total=None):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), total_tokens=total)


def p8_mix(spark, sf_dir):
    """The largest mixture in which every source reaches its share."""
    return _mix(spark, sf_dir).schedule


def p8_blocks(spark, sf_dir):
    """The same mixture as blocks of equally many tokens: which part of which page stands in which slot."""
    return _mix(spark, sf_dir).blocks


def p8_shares(spark, sf_dir):
    return _mix(spark, sf_dir).shares


def p8_mix_corpus(spark, sf_dir):
    """A mixture of as many tokens as the corpus has; small sources can't reach their share."""
    return _mix(spark, sf_dir, "corpus").schedule


def p8_shares_corpus(spark, sf_dir):
    return _mix(spark, sf_dir, "corpus").shares


def p9_found(spark, sf_dir):
    return spam_pages(table(spark, sf_dir, "documents")).where("spam").select("doc_id")


def p9_line_report(spark, sf_dir):
    """Spam lines of every page."""
    return spam_pages(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_forms": p2_forms, "p3_found": p3_found, "p4_found": p4_found, "p4_confidence": p4_confidence, "p5_found": p5_found, "p6_found": p6_found,
    "p7_found": p7_found, "p7_item_report": p7_item_report,
    "p8_mix": p8_mix, "p8_blocks": p8_blocks, "p8_shares": p8_shares, "p8_mix_corpus": p8_mix_corpus, "p8_shares_corpus": p8_shares_corpus,
    "p9_found": p9_found, "p9_line_report": p9_line_report,
}
ORACLE: dict[str, str] = {
    "p6_found": r"""WITH RECURSIVE
        l AS (SELECT DISTINCT trim(source1_entity_id) AS a, unnest(regexp_extract_all(coalesce(match_entity_ids, ''), 'S[0-9]+-[0-9]+')) AS b FROM train_matches),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        v AS (SELECT trim(source1_entity_id) AS id FROM train_matches UNION SELECT b FROM l),
        r(id, g) AS (SELECT id, id FROM v UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
        SELECT id AS entity_id, min(g) AS group_id FROM r GROUP BY id""",
}
