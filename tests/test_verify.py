import pytest
from golden import CASES

from pyspark.sql import functions as F

from veriframe import schemas
from veriframe.plans.verify import Tables, dedup_facts, missing_points, table_suggestions, verdict_counts, verify_facts


def tables(spark, sources):
    """sources: [(title, unit, axis, [(label, year, month, col, value)])]"""
    meta = [(i, f"f{i}", "s", t, u, axis, "bi") for i, (t, u, axis, _) in enumerate(sources)]
    data = []
    for i, (_, _, _, rows) in enumerate(sources):
        labels = list(dict.fromkeys(r[0] for r in rows))
        cols = list(dict.fromkeys(r[3] for r in rows))
        data += [(i, labels.index(r[0]), r[0], r[1], r[2], cols.index(r[3]) if r[3] else None, r[3], float(r[4])) for r in rows]
    return Tables(spark.createDataFrame(meta, schemas.TABLE_META), spark.createDataFrame(data, schemas.TABLE_DATA))


def facts(spark, rows):
    """rows: [(operation, claimed, unit, [(label, year, month, col)])]"""
    return spark.createDataFrame([(i, op, v, u, "q", 1, [(k, *p) for k, p in enumerate(ps)]) for i, (op, v, u, ps) in enumerate(rows)], schemas.FACTS)


@pytest.fixture(scope="module")
def golden(spark):
    """All cases as one batch, each in a scope of its own."""
    t = tables(spark, [(*c[1], "temporal", [(*r[:3], None, r[3]) for r in c[2]]) for c in CASES])
    f = facts(spark, [(c[3], c[6], c[5], [(*p, None) for p in c[4]]) for c in CASES])
    scope = lambda df, key: df.withColumn("scope", F.col(key).cast("long"))
    rows = verify_facts(Tables(scope(t.meta, "source_ord"), scope(t.data, "source_ord")), scope(f, "fact_ord")).collect()
    return {CASES[r["fact_ord"]][0]: r for r in rows}


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_golden(golden, case):
    r = golden[case[0]]
    assert r["verdict"] == case[7]
    if case[8] is None:
        assert case[3].startswith("is_") or r["computed"] is None
    else:
        assert r["computed"] == pytest.approx(case[8], abs=1e-4)


def test_first_source_with_all_points_and_unit(spark):
    t = tables(spark, [
        ("A", "Juta USD", "temporal", [("X", 2026, "Jan", None, 5)]),
        ("B", "Miliar Rp", "temporal", [("X", 2026, "Jan", None, 7000)]),
        ("C", "Miliar Rp", "temporal", [("X", 2026, "Jan", None, 9000)]),
    ])
    r = verify_facts(t, facts(spark, [("value", 7.0, "triliun Rp", [("X", 2026, "Jan", None)]), ("is_stable", None, None, [("X", 2026, "Jan", None)])])).orderBy("fact_ord").collect()
    assert (r[0]["source_ord"], r[0]["verdict"], r[0]["matched_source"]) == (1, "Entailed", "f1 / s")
    assert (r[1]["source_ord"], r[1]["verdict"]) == (0, "Entailed")


def test_categorical_units(spark):
    named = ("Barang", "", "categorical", [("Laptop", None, None, "Harga (juta Rp)", 7.5)])
    bare = ("Barang", "", "categorical", [("Laptop", None, None, "Harga", 7500000)])
    point = [("laptop", None, None, "harga")]
    assert verify_facts(tables(spark, [named]), facts(spark, [("value", 7500000.0, "Rp", point)])).first()["verdict"] == "Entailed"
    assert verify_facts(tables(spark, [bare]), facts(spark, [("value", 7.5, "juta Rp", point)])).first()["verdict"] == "Entailed"
    gate = verify_facts(tables(spark, [bare]), facts(spark, [("yoy_growth", 1.0, "persen", point)])).first()
    assert (gate["verdict"], gate["reason"]) == ("Inconclusive", "gate")


def test_wrong_number_of_points_hurts_only_that_fact(spark):
    t = tables(spark, [("A", "Miliar Rp", "temporal", [("X", 2026, "Jan", None, 5), ("X", 2026, "Feb", None, 6)])])
    two = [("X", 2026, "Jan", None), ("X", 2026, "Feb", None)]
    r = verify_facts(t, facts(spark, [("value", 5.0, "miliar Rp", two), ("ratio", 5.0, "x", two[:1]), ("sum", 11.0, "miliar Rp", two)])).orderBy("fact_ord").collect()
    assert [x["verdict"] for x in r] == ["Inconclusive", "Inconclusive", "Entailed"]
    assert [x["reason"] for x in r] == ["points", "points", "ok"]


def test_dedup_missing_suggestions_counts(spark):
    p = [("Kredit UMKM", 2026, "Jan", None)]
    f = facts(spark, [("value", 1.0, "Rp", p), ("value", 2.0, "Rp", p), ("value", 3.0, "Rp", [("Posisi DPK", 2026, "Jan", None)])])
    assert [r["fact_ord"] for r in dedup_facts(f).orderBy("fact_ord").collect()] == [0, 2]
    assert dedup_facts(f, strict=True).count() == 3
    t = tables(spark, [("A", "Rp", "temporal", [("X", 2026, "Jan", None, 5)])])
    res = verify_facts(t, dedup_facts(f))
    assert {tuple(r["metrics"]) for r in table_suggestions(res).collect()} == {("Kredit UMKM",), ("Posisi DPK",)}
    assert {r["reasoning"] for r in res.collect()} == {"no source holds all points"}
    assert verdict_counts(res).first()["inconclusive"] == 2
    m = missing_points(t, f).orderBy("fact_ord").collect()
    assert m[0]["missing"][0]["metric_label"] == "Kredit UMKM"


def test_empty(spark):
    t = tables(spark, [("A", "Rp", "temporal", [("X", 2026, "Jan", None, 5)])])
    none = spark.createDataFrame([], schemas.FACTS)
    assert verify_facts(t, none).count() == 0
    bare = facts(spark, [("sum", 1.0, "Rp", [])])
    assert verify_facts(t, bare).first()["verdict"] == "Inconclusive"
