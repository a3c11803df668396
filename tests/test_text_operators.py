import re

from pyspark.sql import functions as F

from veriframe.operators import narrative as N
from veriframe.operators import typo as T

TABULAR = [
    "6,2 Mar 6,1 Apr 5,2 Mei 4,9 Jun 6,4 Jul", "Uang Beredar Sempit (M1) 6.033,8 5.936,1 14,4 13,6", "Surat Berharga Selain Saham ** 53,6 64,0 (49,8) (38,2)",
    "| a | b |", "Tagi han    El ektroni k", "53,6 64,0 (49,8)",
]
PROSE = ["Uang Beredar tumbuh sebesar 9,7% (yoy) pada Maret 2026", "tahun 2025 2026", "Kredit pada April 2026 naik.", ""]


def test_tabular_lines(spark):
    df = spark.createDataFrame([(x, True) for x in TABULAR] + [(x, False) for x in PROSE], "line string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", N.is_tabular(F.col("line"))).collect())


def test_strip_collapses_blank_lines(spark):
    pages = spark.createDataFrame([(1, 1, "satu dua\n\n| x |\n\ntiga"), (2, 1, None)], "doc_id long, page_no int, text string")
    out = N.strip_tabular(N.explode_lines(pages), ["doc_id", "page_no"]).orderBy("line_no").collect()
    assert [r["line"] for r in out] == ["satu dua", "", "tiga"]


def test_narrative_filter(spark):
    text = (
        "[== Halaman 1 ==]\nUang Beredar pada April 2026 tumbuh positif sekali\n*Angka sementara\n* M2 tumbuh sebesar 9,7% (yoy) pada Maret\nJudul\n"
        "[== Halaman 2 ==]\nLampiran 1. Tabel uang\nIni kalimat panjang yang tidak akan dibaca lagi\n"
        "[== Halaman 3 ==]\n1 2 3 4 5 6 7\n1,5 2 3 4 5 6 kata\n9 9 9 9 9 9\n"
    )
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    kept = N.filter_narrative(N.split_pages(docs))
    assert [(r["page_no"], r["line"][:4]) for r in kept.orderBy("line_no").collect()] == [(1, "Uang"), (1, "* M2")]
    assert N.narrative_text(kept).first()["text"].startswith("[== Halaman 1 ==]\nUang")


def test_chunks(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((40, 50, 30, 10, 200, 5))], "doc_id long, block_no int, text string")
    assert [r["chunk_no"] for r in N.chunk_pages(df, max_chars=100).orderBy("block_no").collect()] == [0, 0, 1, 1, 2, 3]


def test_finalise(spark):
    from veriframe import schemas

    texts = spark.createDataFrame([(1, "[== Halaman 4 ==]\nUang Beredar April 2026 tumbuh 9,7% (yoy). Lain.")], "doc_id long, text string")
    p = lambda m, y=2026, c=None: [(0, "M2", y, m, c)]
    raw = [(0, "yoy_growth", p("April"), "9,7", "persen_yoy", "Uang Beredar April 2026"), (1, "value", p("Foo"), "1", "Rp", "x"), (2, "value", p("Apr"), "abc", "Rp", "x"), (3, "is_stable", p("Des"), None, None, "tidak ada"), (4, "value", p(None, None, " Harga "), "1,5", "Rp", "x")]
    df = spark.createDataFrame(raw, schemas.RAW_FACTS).withColumn("doc_id", F.lit(1).cast("long"))
    out = {r["fact_ord"]: r for r in N.finalise_facts(df, texts).collect()}
    assert set(out) == {0, 3, 4}
    assert (out[0]["claimed_value"], out[0]["page_number"], out[0]["periods"][0]["month"]) == (9.7, 4, "Apr")
    assert out[0]["context_quote"] == "Uang Beredar April 2026 tumbuh 9,7% (yoy)."
    assert out[3]["context_quote"] == "tidak ada" and out[3]["periods"][0]["month"] == "Dec"
    assert out[4]["periods"][0]["col_label"] == "Harga"


def test_pages_join_and_renumber(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, "  "), (1, 3, "c")], "doc_id long, page_no int, text string")
    assert N.join_pages(pages).first()["text"] == "[== Halaman 1 ==]\na\n\n[== Halaman 3 ==]\nc"
    two = spark.createDataFrame([(1, "[== Halaman 1 ==] x [== Halaman 2 ==] y", [7, 9]), (2, "z", [4, 5])], "doc_id long, text string, page_nums array<int>")
    got = sorted(tuple(r) for r in N.renumber_markers(two).collect())
    assert got == [(1, 7, "x"), (1, 9, "y"), (2, 4, "z"), (2, 5, "")]


def test_fallback(spark):
    pages = spark.createDataFrame([(1, 1, "kalimat " * 40), (2, 1, "pendek")], "doc_id long, page_no int, text string")
    ocr = spark.createDataFrame([(2, 1, "dari gambar")], "doc_id long, page_no int, text string")
    assert {r["doc_id"]: r["text"][:4] for r in N.narrative_or_fallback(pages, ocr).collect()} == {1: "kali", 2: "dari"}


def scan(spark, *texts, words=("rumah", "rumah-rumah", "diterbitkan", "kredit", "dirumah", "tagihan", "yang")):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, T.scan(docs, spark.createDataFrame([(w,) for w in words], "word string"))


def test_typos(spark):
    _, f = scan(
        spark, "Resiko aktifitas yang", "Rumah rumah rumah", "KREDIT\nKredit yang", "di rumah yang", "k redit di terbi tkan lz xyzw", "a a a", "rumah-rumah rumah", "", None,
        "rumah rumah rumah rumah",
    )
    got = {}
    for r in f.orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["text"], r["suggestion"]))
    assert got[0] == [("nonstandard", "Resiko", "risiko"), ("nonstandard", "aktifitas", "aktivitas")]
    assert got[1] == [("reduplication", "Rumah rumah", "Rumah-rumah")]
    assert 2 not in got and 5 not in got and 6 not in got
    assert got[3] == [("di_ke_prefix", "di rumah", "dirumah")]
    assert got[4] == [("unknown_word", "xyzw", None)]
    assert len(got[9]) == 2


def test_candidates_and_issues(spark):
    docs, f = scan(spark, "[x] abcd lalu abcd rumah rumah abcd", words=("lalu", "rumah", "x"))
    c = T.candidates(f, docs)
    row = c.collect()
    assert len(row) == 1 and len(row[0]["occurrences"]) == 3 and row[0]["context"].startswith("[x] abcd")
    clean, spans = T.strip_markers(spark.createDataFrame([(0, "[== Halaman 5 ==]halo [== Halaman 6 ==]dunia")], "doc_id long, text string"))
    assert clean.first()["text"] == "halo dunia"
    assert sorted((r["start"], r["end"], r["page_no"]) for r in spans.where("end > start").collect()) == [(0, 5, 5), (5, 10, 6)]
    v = spark.createDataFrame([(0, "word:abcd", True, "ejaan", "abad")], "doc_id long, key string, is_issue boolean, category string, suggestion string")
    none = spark.createDataFrame([], "doc_id long, start int, end int, page_no int")
    out = T.issues(f, c, v, none)
    assert [r["category"] for r in out.collect()] == ["ejaan", "ejaan", "grammar", "ejaan"]
    assert T.issue_counts(out).first()["ejaan"] == 3


def test_tokens_against_the_text(spark, monkeypatch):
    monkeypatch.setattr(T, "BATCH_TOKENS", 3)
    texts = [(1, "Rumah rumah, di-jual 12 ke"), (2, None), (3, ""), (4, " 1 , 2"), (5, "é satu😀dua -a-b-- c"), (5, "dua"), (6, "kata " * 5000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, word string").coalesce(1)
    got = sorted((tuple(r) for r in T.tokenise(df, around=list(T.AROUND)).collect()), key=str)
    want = []
    for i, t in texts:
        places = [(m.start(), m.end()) for m in re.finditer(T.WORD, t or "")]
        words = [t[a:b] for a, b in places]
        behind = [t[b:a] for (_, b), (a, _) in zip(places, [*places[1:], (len(t or ""), 0)])]
        near = lambda of, j: of[j] if 0 <= j < len(of) else None
        for p, (a, b) in enumerate(places):
            want.append((i, p, words[p], a, b, behind[p], *(near(words if n[0] == "w" else behind, p + d) for n, d in T.AROUND.items())))
    assert got == sorted(want, key=str)
