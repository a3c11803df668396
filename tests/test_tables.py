import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veriframe import schemas
from veriframe.operators import evaluation as E
from veriframe.operators import grids as G
from veriframe.operators import ingest as I
from veriframe.operators import lookup as L
from veriframe.operators import sqlcheck as Q
from veriframe.sources import workbook as W

WIDE = [
    ["Uang Beredar"], ["(Miliar Rp)"], [], [None, None, None, 2023, None, None, 2024], [None, None, None, "Jan", "Feb*", "Mar", "Jan", "Feb", "Mar"],
    [1, None, ("Total", {"indent": 2}), 100, 110, 120, 200, 210, 220], [2, None, ("Simpanan", {"indent": 2}), 1, 2, 3, 4, 5, 6],
    [3, None, ("Rupiah", {"indent": 3}), 50, 55, 60, 90, 95, 100], [4, None, ("Tabungan", {"indent": 2}), 1, 1, 1, 1, 1, 1], [5, None, ("Rupiah", {"indent": 3}), 7, 7, 7, 7, 7, 7],
    [None, None, "1) catatan"], [6, None, "Sesudah", 9, 9, 9, 9, 9, 9],
]
DECEMBER = [["T"], ["(x)"], [None] * 14 + [2023], [None, None, None, "Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"], [None, None, "A", *range(100, 112)]]
ITEMS = [["Daftar Barang"], [], ["No", "Nama Barang", "Kategori", "Harga", "Harga"], [1, "Laptop", "IT", 7500000, 1], [2, "Mouse", "IT", 250000, 2], [3, "Kosong", "IT"]]
MONTHLY = [["Penjualan"], ["(juta Rp)"], ["Wilayah", "Jan 2026", "Feb 2026", dt.date(2026, 3, 31)], ["Utara", 1, 2, 3], ["Selatan", 4, 5, 6], ["Utara", 9, 9, 9]]


def test_parsers(spark):
    cells = W.cells_from_rows(spark, [("w", "s", WIDE), ("d", "s", DECEMBER), ("i", "s", ITEMS), ("m", "s", MONTHLY)])
    p = G.parse_tables(cells)
    meta = {r["source_ord"]: r for r in p.meta.collect()}
    assert [(meta[i]["parser"], meta[i]["axis_type"]) for i in range(4)] == [("bi", "temporal"), ("bi", "temporal"), ("generic", "categorical"), ("generic", "temporal")]
    assert (meta[0]["title"], meta[0]["unit"], meta[3]["unit"], meta[2]["title"]) == ("Uang Beredar", "Miliar Rp", "juta Rp", "Daftar Barang")
    assert [(r["parser"], r["error"]) for r in G.source_status(cells, p).orderBy("source_ord").collect()] == [("bi", None), ("bi", None), ("generic", None), ("generic", None)]
    data = {(r["source_ord"], r["row_label"], r["year"], r["month"], r["col_label"]): r["value"] for r in p.data.collect()}
    assert data[0, "Total", 2024, "Mar", None] == 220 and data[0, "Total", 2023, "Feb", None] == 110
    assert data[0, "Simpanan > Rupiah", 2023, "Jan", None] == 50 and data[0, "Tabungan > Rupiah", 2023, "Jan", None] == 7
    assert not any(k[1] == "Sesudah" for k in data)
    assert data[1, "A", 2023, "Jan", None] == 100 and data[1, "A", 2023, "Dec", None] == 111
    assert data[2, "Laptop", None, None, "Harga"] == 7500000 and not any(k[1] == "Kosong" for k in data)
    assert data[3, "Utara", 2026, "Jan", None] == 1 and data[3, "Selatan", 2026, "Mar", None] == 6
    assert [r["row_label"] for r in p.rows.where("source_ord = 3").orderBy("row_ord").collect()] == ["Utara", "Selatan"]


def test_fingerprint_and_spec(spark):
    messy = [["Stok"], [], ["K", "Nama", None, "Jml"], ["A1", "Beras", None, 5], ["A2", "Gula", None, 7]]
    other = [["Lain"], [], ["X", "Y", None, "Z"], ["B1", "Kopi", None, 50], ["B2", "Teh", None, 70]]
    cells = W.cells_from_rows(spark, [("a", "s", messy), ("b", "s", other)])
    f = {r["source_ord"]: r["fingerprint"] for r in G.fingerprints(cells).collect()}
    assert f[0] == f[1]
    spec = lambda label: spark.createDataFrame([(f[0], 2, label, 3, "categorical", "T", "kg", [(3, "attribute", None, None, "Jumlah")])], schemas.TABLE_SPECS)
    got = G.parse_by_spec(cells, G.fingerprints(cells).join(spec(1), "fingerprint"))
    assert {(r["source_ord"], r["row_label"]): r["value"] for r in got.data.collect()} == {(0, "Beras"): 5, (0, "Gula"): 7, (1, "Kopi"): 50, (1, "Teh"): 70}
    assert G.parse_by_spec(cells, G.fingerprints(cells).join(spec(3), "fingerprint")).data.isEmpty()
    assert "[1]='Nama'" in G.snapshots(cells).where("source_ord = 0").first()["snapshot"]


SHEET = [
    ["Penjualan", "Penjualan", "Penjualan", "Penjualan"], ["Produk", "S1", "S1", "Total"], [None, "Q1", "Q2", None],
    ["A", 10, 20, 30], ["B", 1, 2, 3], [("Jumlah", {"is_bold": True}), 11, 22, 33],
]


def test_ingest(spark, tmp_path):
    cells = W.cells_from_rows(spark, [("f.xlsx", "S", SHEET), ("g.xlsx", "S", [["Item", "Nilai"], ["A", 10], ["B", 20], ["Subtotal", 99]])])
    rows = {(r["source_file"], r["row_label"], r["col_label"]): r for r in I.extract_facts(cells).collect()}
    assert rows["f.xlsx", "A", "S1 > Q1"]["value"] == 10 and not rows["f.xlsx", "A", "S1 > Q1"]["is_aggregate"]
    assert rows["f.xlsx", "Jumlah", "S1 > Q2"]["is_aggregate"] and rows["f.xlsx", "A", "Total"]["is_aggregate"]
    assert rows["f.xlsx", "B", "Total"]["source_cell_ref"] == "S!D5" and len(rows) == 12
    assert not rows["g.xlsx", "Subtotal", "Nilai"]["is_aggregate"]
    s = I.ingest_summary(cells).first()
    assert s["sheets"] == 2 and s["defaulted"] >= 1
    v = spark.createDataFrame([(1, "row", 4, True)], "source_ord int, axis string, idx int, is_aggregate boolean")
    assert any(r["is_aggregate"] for r in I.extract_facts(cells, v).where("row_label = 'Subtotal'").collect())
    path = f"file://{tmp_path}/facts"
    files = spark.createDataFrame([("f.xlsx",), ("g.xlsx",)], "source_file string")
    I.write_facts(I.extract_facts(cells), files, path)
    assert spark.read.parquet(path).count() == 9 + 3  # values of the two files
    I.write_facts(I.extract_facts(cells.where("file = 'f.xlsx'")), files, path)
    assert {r["source_file"] for r in spark.read.parquet(path).select("source_file").distinct().collect()} == {"f.xlsx"}


def test_column_letters(spark):
    df = spark.createDataFrame([(1,), (26,), (27,), (52,), (702,), (703,), (16384,)], "c int").select(I.column_letters(F.col("c")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]


def xlsx() -> bytes:
    out, main = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="I.1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Judul</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><fonts><font/><font><b/></font></fonts><fills><fill><patternFill patternType="none"/></fill></fills><borders><border/></borders><cellXfs><xf/><xf fontId="1"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s" s="1"><v>0</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" s="2"><v>45000</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx())
    (tmp_path / "b.xlsx").write_bytes(b"PK\x03\x04broken")
    (tmp_path / "c.xls").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1 old")
    rows = W.read_workbooks(spark, f"file://{tmp_path}")
    assert rows.where("kind = 'error'").count() == 2
    cells = W.propagate_merges(W.number_sources(rows))
    got = {(r["r"], r["c"]): r for r in cells.collect()}
    assert got[1, 1]["v_str"] == got[1, 2]["v_str"] == "Judul" and got[1, 2]["is_bold"]
    assert got[2, 1]["v_num"] == 1.5 and got[2, 2]["v_ts"] == dt.datetime(2023, 3, 15) and got[2, 3]["kind"] == "bool"
    assert W.number_sources(rows, "I.1").count() > 0
    with pytest.raises(ValueError, match="its sheets: I.1"):
        W.number_sources(rows, "I.2")
    assert [r["sheet"] for r in W.list_sheets(spark, f"file://{tmp_path}/a.xlsx").collect()] == ["I.1"]


def test_lookup(spark):
    rows = [(0, i, n, 2026, "Jan", None, None, float(i)) for i, n in enumerate(["Simpanan", "Simpanan Berjangka (Rupiah)", "Giro", "Berjangka > Rupiah", "Total"])]
    data = spark.createDataFrame(rows, schemas.TABLE_DATA)
    meta = spark.createDataFrame([(0, "f", "s", "Posisi Simpanan Masyarakat", "Rp", "temporal", "bi")], schemas.TABLE_META)
    names = ["simpanan berjangka", "GIRO", "giro bank", "berjangka rupiah", "Penghimpunan DPK", "DPK korporasi", "xyz"]
    q = spark.createDataFrame([(n, 2026, "Jan") for n in names], "q string, year int, month string")
    got = {r["q"]: r["matched_label"] for r in L.resolve_temporal(q, meta, data).collect()}
    assert got == {"simpanan berjangka": "Simpanan Berjangka (Rupiah)", "GIRO": "Giro", "giro bank": "Giro", "berjangka rupiah": "Berjangka > Rupiah", "Penghimpunan DPK": "Total"}
    labels = spark.createDataFrame([(0, i, r[2]) for i, r in enumerate(rows)], schemas.TABLE_ROWS)
    assert L.available_periods(q.where("q = 'GIRO'"), meta, labels, data).count() == 1
    shop = [("Laptop ASUS", "Harga", 7.5e6), ("Laptop HP", "Harga", 6.2e6), ("Laptop HP", "Stok", 12.0), ("Mouse Logitech", "Stok", 45.0)]
    cat = spark.createDataFrame([(0, i, a, None, None, 0 if b == "Harga" else 1, b, v) for i, (a, b, v) in enumerate(shop)], schemas.TABLE_DATA)
    r = L.resolve_categorical(spark.createDataFrame([("laptop", "stok")], "q string, cq string"), cat).first()
    assert (r["matched_label"], r["value"]) == ("Laptop HP", 12.0)


def test_sqlcheck(spark):
    spark.createDataFrame([("Q1", 1.0), ("Q2", 2.0)], "kuartal string, v double").createOrReplaceTempView("indikator")
    for bad in ("DROP TABLE indikator", "INSERT INTO indikator VALUES ('x', 1)", "CREATE TABLE t AS SELECT 1"):
        assert Q.execute(spark, bad)[1]
    for refused in ("SELECT reflect('java.lang.Math', 'abs', -1)", "SELECT v FROM indikator WHERE v > (SELECT java_method('java.lang.Math', 'abs', -1))", "SELECT * FROM csv.`/etc/hostname`", "BEGIN SELECT 1; END", "SELECT * FROM other.indikator"):
        assert Q.execute(spark, refused)[0] is None, refused
    for fine in ("SELECT count(*) FROM indikator", "WITH a AS (SELECT * FROM indikator) SELECT kuartal, avg(v) FROM a GROUP BY 1 HAVING avg(v) > 0 ORDER BY 2", "SELECT a.v - b.v FROM indikator a CROSS JOIN indikator b WHERE a.kuartal = 'Q1'"):
        assert Q.execute(spark, fine)[1] is None, fine
    spark.range(2000).createOrReplaceTempView("panjang")
    assert "more than" in Q.execute(spark, "SELECT id FROM panjang")[1] and Q.execute(spark, "SELECT sum(id) FROM panjang")[0] == [["1999000"]]
    calls = []

    def generate(asked):
        calls.append(len(asked))
        if len(calls) == 1:
            return [(0, "SELECT v FROM indikator WHERE kuartal = 'Q1'"), (1, "SELECT nope"), (2, "SELECT v FROM indikator LIMIT 1"), (9, "SELECT 1")]
        return [(1, "SELECT still nope"), (2, "SELECT v FROM indikator")]

    claims = ["nilai Q1 adalah 1", "salah", "Q2 tertinggi"]
    out = Q.verify_document(spark, "teks", lambda _: [" " + c for c in claims] + [" "], generate, lambda good: [(i, "Entailed", "ok") for i, *_ in good])
    got = [(r["status"], r["sql_query"] is None) for r in out.collect()]
    assert got == [("Entailed", False), ("Error", True), ("Entailed", False)] and calls == [3, 2]
    assert Q.summary(out).first()["entailed"] == 2
    assert Q.verify_document(spark, "", lambda _: [], None, None).count() == 0
    hints = Q.distinct_value_hints(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], "k string, l string, n int"), "t").collect()
    assert [r["columns"] for r in hints] == [["k"], ["l"], ["k", "l"]]
    res = spark.createDataFrame([(0, [["5"]]), (1, [["1", "2"]]), (2, [[None, None]]), (3, []), (4, [["1"], ["2"]])], "i int, r array<array<string>>")
    assert [r["x"] for r in res.orderBy("i").select(Q.insufficient(F.col("r")).alias("x")).collect()] == [True, False, True, True, False]
    assert Q.browse(spark.range(10), "id", 3, 2).collect()[0]["id"] == 2


def test_evaluation(spark):
    pairs = spark.createDataFrame([("E", "E"), ("E", "R"), ("R", "R"), ("I", "Bogus"), ("I", "I")], "expected string, predicted string")
    assert E.overall(pairs).first()["accuracy"] == pytest.approx(0.6)
    per = {r["label"]: r for r in E.per_label(pairs).collect()}
    assert per["E"]["recall"] == 0.5 and per["Bogus"]["precision"] == 0.0
    assert E.confusion_matrix(pairs, ["E", "R"]).where("expected = 'E'").first()["R"] == 1
    p = "array<struct<year:int,month:string>>"
    claims = spark.createDataFrame([(1, 0, "value", "M2", [(2026, "Apr")]), (1, 1, "value", "m2 luas", [(2026, "Apr")]), (1, 2, "sum", "x", [(2026, "Jan")])], f"case_id int, claim_ord int, operation string, metric string, periods {p}")
    results = spark.createDataFrame([(1, 0, "value", "Uang M2 Luas", [(2026, "Apr")]), (1, 1, "value", "M2", [(2026, "Apr")]), (1, 2, "diff", "x", [(2026, "Jan")])], f"case_id int, result_ord int, operation string, metric_label string, result_periods {p}")
    m = E.match_claims(claims, results)
    assert sorted(tuple(r) for r in m.collect()) == [(1, 0, 0), (1, 1, 1)]
    assert E.unmatched(claims, m, "claim_ord").first()["claim_ord"] == 2 and E.unmatched(results, m, "result_ord").first()["result_ord"] == 2
    cases = E.passed(spark.createDataFrame([("E", "E", 1.0, 1.04), ("E", "E", None, None)], "expected_verdict string, verdict string, expected_value double, computed double"))
    E.gate(cases)


def test_streams(spark, tmp_path):
    from golden import CASES
    from test_verify import facts, tables

    from veriframe.streaming.claims import daily_events, event_sessions, verify_stream

    ev = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 1), 1, "a", 2.0), (2, dt.datetime(2026, 1, 1, 2), 1, "a", 3.0), (3, dt.datetime(2026, 1, 9), 1, "b", 1.0)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    ev.write.parquet(f"{tmp_path}/ev")
    q = daily_events(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/ev")).writeStream.outputMode("append").format("memory").queryName("days").trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").first()["total"] == 5.0
    assert daily_events(ev).count() == 2 and event_sessions(ev).count() == 3
    c = CASES[0]
    t = tables(spark, [(*c[1], "temporal", [(*r[:3], None, r[3]) for r in c[2]])])
    facts(spark, [(c[3], c[6], c[5], [(*p, None) for p in c[4]])]).write.parquet(f"{tmp_path}/facts")
    s = verify_stream(spark.readStream.schema(schemas.FACTS).parquet(f"{tmp_path}/facts"), t, f"{tmp_path}/out", f"{tmp_path}/cp")
    s.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").first()["verdict"] == "Entailed"
