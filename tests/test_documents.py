import json

import pytest
from golden import CASES, M2, M2_APR
from test_verify import tables

from pyspark.sql import functions as F

from veriframe import catalog, schemas
from veriframe.plans.document import ask_chunks, check_typos, chunk_facts, chunk_texts, in_chunks, paired_run, verify_reports
from veriframe.sources import cases as C
from veriframe.sources import pages as P


def test_report_to_verdicts(spark):
    text = (
        "[== Halaman 1 ==]\nUang Beredar Luas pada April 2026 tercatat sebesar Rp10.253,7 triliun menurut laporan ini.\n"
        "Uang Beredar Luas pada April 2026 tumbuh 10,8% (yoy) dibanding tahun lalu.\n"
    )
    docs = spark.createDataFrame([(7, text), (8, "")], "doc_id long, text string")
    t = tables(spark, [("Uang Beredar", "Miliar Rp", "temporal", [(*r[:3], None, r[3]) for r in M2_APR])])
    rows = {r["operation"]: r for r in verify_reports(docs, t).collect()}
    assert (rows["value"]["verdict"], rows["yoy_growth"]["verdict"]) == ("Entailed", "Refuted")
    assert rows["value"]["page_number"] == 1 and rows["value"]["doc_id"] == 7 and rows["value"]["context_quote"].endswith("laporan ini.")


def extractor():
    """A function of this module would have to be imported by the workers, one made here goes by value."""

    def raw(text):
        if "rusak" in text:
            raise ValueError("rusak")
        point = {"ord": 0, "metric_label": "Uang Beredar Luas", "year": 2026, "month": "April", "col_label": None}
        return [{"operation": "value", "periods": [point], "claimed_value_raw": "10.253,7", "unit": "triliun Rp", "anchor_quote": "Uang Beredar Luas pada April 2026"}] * text.count("tercatat")

    return raw


def test_failed_chunks_hurt_no_others(spark):
    _raw = extractor()
    said = "Uang Beredar Luas pada April 2026 tercatat sebesar Rp10.253,7 triliun menurut laporan ini."
    text = f"awal\n[== Halaman 1 ==]\n{said}\n[== Halaman 2 ==]\n{said} rusak\n[== Halaman 3 ==]\n{said}\n{said}"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    chunks = chunk_texts(docs, 50)
    assert "".join(r["text"] for r in chunks.orderBy("chunk_no").collect()) == text
    one = ask_chunks(chunks, _raw).orderBy("chunk_no").collect()
    assert [len(r["facts"]) for r in one] == [0, 1, 0, 2] and [r["error"] for r in one] == [None, None, "ValueError: rusak", None]
    both = ask_chunks(chunks, _raw, lambda t: _raw(t.replace("rusak", ""))).orderBy("chunk_no").collect()
    assert [len(r["facts"]) for r in both] == [0, 1, 1, 2] and not any(r["error"] for r in both)
    assert "; " in ask_chunks(chunks, _raw, _raw).where("chunk_no = 2").first()["error"]
    numbers = [r["fact_ord"] for r in chunk_facts(ask_chunks(chunks, _raw)).orderBy("fact_ord").collect()]
    assert len(set(numbers)) == 3 and all(n >> 32 == 1 for n in numbers)
    assert ask_chunks(chunks.where("false"), _raw).count() == 0
    t = tables(spark, [("Uang Beredar", "Miliar Rp", "temporal", [(*r[:3], None, r[3]) for r in M2_APR])])
    rows = verify_reports(docs, t, in_chunks(_raw, max_chars=50)).collect()
    assert [r["verdict"] for r in rows] == ["Entailed"] and rows[0]["reasoning"].startswith("claimed 10253.7000, computed 10253.6519 from f0 / s: a difference of 0.0481, within")


def test_paired_run(spark):
    m = spark.createDataFrame([(k, n, k % 2, 1999, mo, 1000.0 * (k + mo)) for k, n in ((4, "EGYPT"), (5, "PERU")) for mo in (1, 2, 3)], "k int, label string, g int, y int, mo int, v double")
    empty = catalog.generic_cells(m).where("source_ord = 0").limit(1).withColumn("source_ord", F.lit(9))
    pages = catalog.report_texts(m).unionByName(spark.createDataFrame([(99, "tanpa klaim")], "doc_id long, text string"))
    words = spark.createDataFrame([("tanpa",)], "word string")
    run = paired_run(pages, catalog.generic_cells(m).unionByName(empty), dictionary=words)
    assert {r["source_ord"]: (r["parser"], r["error"] is None) for r in run.sources.collect()} == {0: ("generic", True), 1: ("generic", True), 9: (None, False)}
    counts = {r["doc_id"]: (r["entailed"], r["refuted"], r["total"]) for r in run.counts.collect()}
    assert counts == {4: (2, 1, 3), 5: (2, 1, 3), 99: (0, 0, 0)}
    assert {r["reason"] for r in run.results.collect()} == {"ok"} and run.suggestions.count() == 0 and run.issues.count() == 0
    run.close()
    scopes = spark.createDataFrame([(0, 5), (1, 4)], "source_ord int, scope long")
    crossed = paired_run(pages, catalog.generic_cells(m), scopes=scopes).counts.collect()
    assert {r["doc_id"]: r["inconclusive"] for r in crossed} == {4: 3, 5: 3, 99: 0}
    none = paired_run(pages.where("false"), catalog.generic_cells(m).where("false"))
    assert none.results.count() == 0 and none.counts.count() == 0 and none.issues is None


def test_transcription_is_tried_again(spark):
    images = spark.createDataFrame([(1, n, bytes([64 + n])) for n in range(1, 5)], "doc_id long, page_no int, image binary")

    def broken(xs):
        raise OSError("no answer")

    def odd(xs):
        if xs[0] == b"A":
            raise OSError("no answer")
        return xs[0].decode()

    both = P.transcribe(images, odd, 2, wait=0, at_once=1, second=lambda xs: "second").orderBy("page_nums").collect()
    assert [(r["text"], r["error"]) for r in both] == [("second", None), ("C", None)]
    assert {(r["text"], r["error"]) for r in P.transcribe(images, broken, 4, wait=0).collect()} == {("", "OSError: no answer")}


def test_pdf_without_its_package_gives_error_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"not a pdf")
    row = P.read_pages(spark, f"file://{tmp_path}/*.pdf").first()
    assert row["page_no"] is None and row["error"]


def test_check_typos(spark):
    docs = spark.createDataFrame([(1, "[== Halaman 3 ==]\nResiko naik naik")], "doc_id long, text string")
    out = check_typos(docs, spark.createDataFrame([("naik",)], "word string")).collect()
    assert [(r["text"], r["page_no"]) for r in out] == [("Resiko", 3), ("naik naik", 3)]


def test_yaml_cases(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    items = [
        {"id": c[0], "table": {"title": c[1][0], "unit": c[1][1], "data": [dict(zip(("label", "year", "month", "value"), r)) for r in c[2]]},
         "fact": {"operation": c[3], "unit": c[5], "claimed_value": c[6], "periods": [dict(zip(("metric_label", "year", "month"), p)) for p in c[4]]},
         "expected": {"verdict": c[7], "computed_value": c[8]}}
        for c in CASES if c[8] is not None or not c[3].startswith("is_")
    ]
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(items))
    loaded = C.load_cases([tmp_path / "a.yaml"])
    assert C.run_cases(spark, loaded).where("NOT verdict_ok").isEmpty()
    with pytest.raises(ValueError):
        C.load_cases([tmp_path / "a.yaml", tmp_path / "a.yaml"])


def test_pages_and_events(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"satu\r\nbaris\x0cdua")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    p = P.read_pages(spark, f"file://{tmp_path}/*.txt", lambda data: data.decode().split("\x0c"))
    assert sorted((r["page_no"], r["text"]) for r in p.where("error IS NULL").collect()) == [(1, "satu\nbaris"), (2, "dua")]
    assert p.where("error IS NOT NULL").count() == 1 and {r["pages"] for r in P.page_counts(p).collect()} == {0, 2}
    images = spark.createDataFrame([(1, n, bytes([64 + n])) for n in range(1, 6)], "doc_id long, page_no int, image binary")
    t = P.transcribe(images, lambda xs: b"".join(xs).decode(), 3)
    assert sorted((r["page_nums"], r["text"]) for r in t.collect()) == [([1, 2, 3], "ABC"), ([4, 5], "DE")]
    lines = [json.loads(x) for x in C.ndjson([("a", lambda: None), ("b", lambda: spark.range(2))])]
    assert [x["type"] for x in lines] == ["stage"] * 4 + ["result"] and len(lines[-1]["data"]) == 2
    assert json.loads(list(C.ndjson([("x", lambda: 1 / 0)]))[-1])["type"] == "error"
    assert M2 in C.label_context(spark.createDataFrame([(0, 0, M2)], "source_ord int, row_ord int, row_label string"), spark.createDataFrame([(0, "T")], "source_ord int, title string")).first()["context"]
