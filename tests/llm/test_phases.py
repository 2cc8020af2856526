import os

from kithmark.llm.linkage import link
from kithmark.runtime import SHUFFLES_GO, cut, ensure_checkpoint_dir, phase

A, B = "12 Grotrussar Road, Klaporgarh, Grokenesh 298598", "77 Zijirfor Vihar, Stellargaon, Grokenesh 394937"


def tables(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {d for d, _, _ in os.walk(folder) if os.path.basename(d).startswith("table-")}


def test_a_phase_leaves_what_is_kept(spark):
    before, shuffles = tables(spark), spark.conf.get(SHUFFLES_GO)
    with phase(spark) as keep:
        lost = cut(spark.range(3))
        with phase(spark) as keep_inner:
            inner = keep_inner(cut(lost.selectExpr("id + 1 as id")))
        kept = keep(cut(inner.groupBy("id").count()))
        assert spark.conf.get(SHUFFLES_GO) == "true"
    assert sorted(r["id"] for r in kept.collect()) == sorted(r["id"] for r in inner.collect()) == [1, 2, 3]
    assert len(tables(spark) - before) == 2 and not os.path.exists(lost._table.removeprefix("file:"))
    assert spark.conf.get(SHUFFLES_GO) == shuffles


def test_a_failed_phase_puts_the_setting_back(spark):
    shuffles = spark.conf.get(SHUFFLES_GO)
    try:
        with phase(spark):
            raise ValueError
    except ValueError:
        pass
    before = tables(spark)
    table = cut(spark.range(1))
    assert spark.conf.get(SHUFFLES_GO) == shuffles and len(tables(spark) - before) == 1 and table.count() == 1


def test_links_leave_no_table_that_nothing_reads(spark):
    columns = "entity_id string, business_name string, business_address string, country string"
    rows = lambda *r: spark.createDataFrame([(*x, "India") for x in r], columns)
    left = rows(("S1-1", "Hokla Dratro Industries", A), ("S1-2", "Tapril Zorsa Footwear", None), ("S1-3", "Suraya Mobile Point", B))
    right = rows(("S2-1", "hoklaa dratro inds.", A), ("S2-2", "Tapril Zorsa Ftwr", B), ("S2-3", "Hokla Dratro Industries", ""))
    before = tables(spark)
    got = link(left, [right], record="entity_id", name="business_name", address="business_address", country="country")
    read = {os.path.dirname(f.removeprefix("file://").removeprefix("file:")) for f in got.inputFiles()}
    assert tables(spark) - before <= read
    assert {(r["left_id"], r["right_id"]) for r in got.collect()} == {("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-1", "S2-3")}
