"""The golden comparison cases as rows: series values and claims are fixed values."""

M2, M1, K = "Uang Beredar Luas(M2)", "Uang Beredar Sempit (M1)", "Uang Kartal di Luar Bank Umum dan BPR"
SB, SIM = "Simpanan Berjangka (Rupiah dan Valas)", "Simpanan"
TL = "Tabungan Lainnya (Rupiah dan Valas)"
GOLD, RESERVES = "Emas Moneter", "Cadangan Devisa Lainnya"
TITLE = "Uang Beredar dan faktor-faktor yang mempengaruhinya"
DPK_TITLE = "I.19 POSISI SIMPANAN MASYARAKAT RUPIAH DAN VALAS BANK UMUM DAN BPR MENURUT PROVINSI"
M2_JAN_APR = [(M2, 2026, "Jan", 10116181.856), (M2, 2026, "Feb", 10088126.602), (M2, 2026, "Mar", 10355718.157), (M2, 2026, "Apr", 10253651.888)]
M2_APR = [(M2, 2025, "Apr", 9387895.1895), (M2, 2026, "Apr", 10253651.888)]
BASE = (TITLE, "Miliar Rp")


def _p(label, *months):
    return [(label, 2026, m) for m in months]


#: (id, (title, unit), data rows, operation, points, unit, claimed, verdict, computed)
CASES = [
    ("value_m2_apr_triliun_entailed", BASE, M2_APR, "value", _p(M2, "Apr"), "triliun Rp", 10253.7, "Entailed", 10253.6519),
    ("value_m2_apr_triliun_refuted", BASE, M2_APR, "value", _p(M2, "Apr"), "triliun Rp", 10250.0, "Refuted", 10253.6519),
    ("value_m2_apr_miliar_entailed", BASE, M2_APR, "value", _p(M2, "Apr"), "miliar Rp", 10253651.9, "Entailed", 10253651.888),
    ("value_metric_not_found", BASE, M2_APR, "value", _p("Kredit Perbankan", "Apr"), "triliun Rp", 500.0, "Inconclusive", None),
    ("value_prefix_collision", BASE, M2_APR, "value", _p("Uang Beredar Digital", "Apr"), "triliun Rp", 500.0, "Inconclusive", None),
    ("value_unit_incompatible", ("Cadangan Devisa", "Juta USD"), [(GOLD, 2026, "Apr", 12872.75)], "value", _p(GOLD, "Apr"), "triliun Rp", 200.0, "Inconclusive", None),
    ("yoy_m2_apr_entailed", BASE, M2_APR, "yoy_growth", _p(M2, "Apr"), "persen_yoy", 9.2, "Entailed", 9.2221),
    ("yoy_m2_apr_refuted", BASE, M2_APR, "yoy_growth", _p(M2, "Apr"), "persen_yoy", 10.8, "Refuted", 9.2221),
    ("yoy_not_shadowed_by_generic_row", BASE, [(SIM, 2025, "Apr", -482476.0102), (SIM, 2026, "Apr", -560955.7467), (SB, 2025, "Apr", 3019897.8733), (SB, 2026, "Apr", 3158896.8825)],
     "yoy_growth", _p("simpanan berjangka", "Apr"), "persen_yoy", 4.6, "Entailed", 4.6028),
    ("yoy_qualified_subrow", BASE, [(f"{SB} > Rupiah", 2025, "Apr", 2676099.9896), (f"{SB} > Rupiah", 2026, "Apr", 2748250.167), (f"{TL} > Rupiah", 2025, "Apr", 2518681.1564), (f"{TL} > Rupiah", 2026, "Apr", 2696896.651)],
     "yoy_growth", _p("tabungan lainnya rupiah", "Apr"), "persen_yoy", 7.1, "Entailed", 7.0757),
    ("yoy_dpk_binds_to_jumlah", (DPK_TITLE, "Miliar Rp"), [("Jumlah", 2025, "Apr", 8737690.5627), ("Jumlah", 2026, "Apr", 9566972.7347)], "yoy_growth", _p("Penghimpunan DPK", "Apr"), "persen_yoy", 9.5, "Entailed", 9.4909),
    ("yoy_prior_year_missing", BASE, [(M2, 2026, "Apr", 10253651.888)], "yoy_growth", _p(M2, "Apr"), "persen_yoy", 9.2, "Inconclusive", None),
    ("average_m2_jan_apr_entailed", BASE, M2_JAN_APR, "average", _p(M2, "Jan", "Feb", "Mar", "Apr"), "triliun Rp", 10203.4, "Entailed", 10203.4196),
    ("average_one_month_missing", BASE, M2_JAN_APR[:3], "average", _p(M2, "Jan", "Feb", "Mar", "Apr"), "triliun Rp", 10203.4, "Inconclusive", None),
    ("sum_m2_jan_feb_entailed", BASE, M2_JAN_APR, "sum", _p(M2, "Jan", "Feb"), "triliun Rp", 20204.3, "Entailed", 20204.3085),
    ("diff_m2_mar_apr_entailed", BASE, M2_JAN_APR, "diff", _p(M2, "Mar", "Apr"), "triliun Rp", -102.1, "Entailed", -102.0663),
    ("ratio_m1_to_m2_entailed", BASE, [(M1, 2026, "Apr", 3342386.4215), (M2, 2026, "Apr", 10253651.888)], "ratio", _p(M1, "Apr") + _p(M2, "Apr"), "persen", 32.6, "Entailed", 32.597),
    ("ratio_denominator_zero", BASE, [(M1, 2026, "Apr", 3342386.4215), ("Dana Pihak Ketiga", 2026, "Apr", 0.0)], "ratio", _p(M1, "Apr") + _p("Dana Pihak Ketiga", "Apr"), "persen", 40.0, "Inconclusive", None),
    ("is_increasing_kartal_entailed", BASE, [(K, 2026, "Jan", 1156846.7184), (K, 2026, "Feb", 1159800.0482), (K, 2026, "Mar", 1206116.3638)], "is_increasing", _p(K, "Jan", "Feb", "Mar"), None, None, "Entailed", None),
    ("is_increasing_m2_refuted", BASE, M2_JAN_APR[:3], "is_increasing", _p(M2, "Jan", "Feb", "Mar"), None, None, "Refuted", None),
    ("is_decreasing_reserves_entailed", ("Cadangan Devisa", "Juta USD"), [(RESERVES, 2026, "Mar", 126772.28), (RESERVES, 2026, "Apr", 124650.04)], "is_decreasing", _p(RESERVES, "Mar", "Apr"), None, None, "Entailed", None),
    ("is_stable_rate_entailed", ("BI-Rate", "persen"), [("BI-Rate", 2026, m, 6.0) for m in ("Jan", "Feb", "Mar")], "is_stable", _p("BI-Rate", "Jan", "Feb", "Mar"), None, None, "Entailed", None),
    ("is_stable_rate_refuted", ("BI-Rate", "persen"), [("BI-Rate", 2026, m, v) for m, v in (("Jan", 6.0), ("Feb", 5.5), ("Mar", 5.0))], "is_stable", _p("BI-Rate", "Jan", "Feb", "Mar"), None, None, "Refuted", None),
]
