"""Registered queries of the claim-verification operators and their oracle SQL.

Most run over a table derived from the star schema: order totals by nation and month, read as a
statistical table whose rows are nations. Sums are exact decimals, so both engines agree to the last digit.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import units
from .functions.periods import MONTHS, month_abbreviation, parse_period
from .functions.text import expand_sentence, indonesian_number, locate_anchor, normalise_ws, strip
from .operators import evaluation, grids, ingest, lookup, narrative, sqlcheck, typo
from .plans import verify
from .plans.document import ask_chunks, check_typos, chunk_texts, paired_run
from .streaming import claims as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# -- the statistical table ---------------------------------------------------------------------

M = """m AS (
  SELECT n_nationkey AS k, n_name AS label, n_regionkey AS g, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4, 5)"""
ABBR = "list_extract(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], mo)"
DELTA = "round(abs(claimed - computed), 4)"
VERDICT = f"CASE WHEN computed IS NULL THEN 'Inconclusive' WHEN {DELTA} <= 0.05 THEN 'Entailed' ELSE 'Refuted' END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, label, g, y, mo, v): order totals by nation and month."""
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return joined.groupBy(
        F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("g"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo")
    ).agg(total.alias("v"))


def as_table(m: DataFrame, unit: str = "Rp", source: int = 0, title: str = "Penjualan menurut negara") -> verify.Tables:
    meta = m.sparkSession.createDataFrame([(source, "orders", "s", title, unit, "temporal", "bi")], "source_ord int, file string, sheet string, title string, unit string, axis_type string, parser string")
    data = m.select(
        F.lit(source).alias("source_ord"), F.col("k").alias("row_ord"), F.col("label").alias("row_label"), F.col("y").alias("year"), month_abbreviation(F.col("mo")).alias("month"),
        F.lit(None).cast("int").alias("col_ord"), F.lit(None).cast("string").alias("col_label"), F.col("v").alias("value"),
    )
    return verify.Tables(meta, data)


def point(i: int, label, year, month, col=None):
    null = F.lit(None).cast("string")
    return F.struct(F.lit(i).alias("ord"), label.alias("metric_label"), year.cast("int").alias("year"), month.alias("month"), (col if col is not None else null).alias("col_label"))


def facts(rows: DataFrame, operation: str, claimed, unit: str | None, *points) -> DataFrame:
    """Facts from rows with fact_ord."""
    return rows.select(
        F.col("fact_ord").cast("long").alias("fact_ord"), F.lit(operation).alias("operation"), claimed.cast("double").alias("claimed_value"), F.lit(unit).cast("string").alias("unit"),
        F.lit("").alias("context_quote"), F.lit(1).alias("page_number"), F.array(*points).alias("periods"),
    )


def judged(spark: SparkSession, sf_dir: str, operation: str, claimed, unit: str | None, months: tuple[int, ...], cols=("fact_ord", "computed", "delta", "verdict")) -> DataFrame:
    m = monthly(spark, sf_dir)
    if months == (0,):
        rows = m.withColumn("fact_ord", F.col("k") * 1000000 + F.col("y") * 100 + F.col("mo"))
        points = [point(0, F.col("label"), F.col("y"), month_abbreviation(F.col("mo")))]
    else:
        rows = m.select("k", "label", "y").distinct().withColumn("fact_ord", F.col("k") * 1000000 + F.col("y") * 100)
        points = [point(i, F.col("label"), F.col("y"), F.lit(MONTHS[x - 1])) for i, x in enumerate(months)]
    return verify.verify_facts(as_table(m), facts(rows, operation, claimed, unit, *points)).select(*cols)


def _single(computed: str, claimed: str, extra: str = "") -> str:
    return f"WITH {M}, x AS (SELECT CAST(a.k * 1000000 + a.y * 100 + a.mo AS BIGINT) AS fact_ord, {computed} AS computed, {claimed} AS claimed FROM m a {extra}) SELECT fact_ord, computed, CASE WHEN computed IS NOT NULL THEN {DELTA} END AS delta, {VERDICT} AS verdict FROM x"


def _quarter(computed: str, claimed: str) -> str:
    return f"""WITH {M}, q AS (SELECT k, y, max(CASE WHEN mo = 1 THEN v END) AS a, max(CASE WHEN mo = 2 THEN v END) AS b, max(CASE WHEN mo = 3 THEN v END) AS c FROM m GROUP BY k, y),
x AS (SELECT CAST(k * 1000000 + y * 100 AS BIGINT) AS fact_ord, {computed} AS computed, {claimed} AS claimed FROM q)
SELECT fact_ord, computed, CASE WHEN computed IS NOT NULL THEN {DELTA} END AS delta, {VERDICT} AS verdict FROM x"""


def _trend(holds: str) -> str:
    return f"""WITH {M}, q AS (SELECT k, y, max(CASE WHEN mo = 1 THEN v END) AS a, max(CASE WHEN mo = 2 THEN v END) AS b, max(CASE WHEN mo = 3 THEN v END) AS c FROM m GROUP BY k, y)
SELECT CAST(k * 1000000 + y * 100 AS BIGINT) AS fact_ord, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'Inconclusive' WHEN {holds} THEN 'Entailed' ELSE 'Refuted' END AS verdict FROM q"""


def claim():
    return F.round(F.col("v") * (1 + ((F.col("k") + F.col("mo")) % 3 - 1) * 0.01), 1)


@query(_single("round(v, 4)", "round(v * (1 + ((k + mo) % 3 - 1) * 0.01), 1)"))
def claim_value(spark, sf_dir):
    return judged(spark, sf_dir, "value", claim(), "Rp", (0,))


@query(_single("round((a.v - p.v) / nullif(abs(p.v), 0) * 100, 4)", "CAST((a.k + a.mo) % 7 AS DOUBLE)", "LEFT JOIN m p ON p.k = a.k AND p.y = a.y - 1 AND p.mo = a.mo"))
def claim_yoy_growth(spark, sf_dir):
    return judged(spark, sf_dir, "yoy_growth", (F.col("k") + F.col("mo")) % 7, "persen_yoy", (0,))


@query(_quarter("round((a + b + c) / 3, 4)", "CAST(k * 1000 AS DOUBLE)"))
def claim_average(spark, sf_dir):
    return judged(spark, sf_dir, "average", F.col("k") * 1000, "Rp", (1, 2, 3))


@query(_quarter("round(a + b + c, 4)", "CAST(k * 1000 AS DOUBLE)"))
def claim_sum(spark, sf_dir):
    return judged(spark, sf_dir, "sum", F.col("k") * 1000, "Rp", (1, 2, 3))


@query(_quarter("CASE WHEN b IS NOT NULL THEN round(c - a, 4) END", "CAST(k * 1000 AS DOUBLE)"))
def claim_diff(spark, sf_dir):
    return judged(spark, sf_dir, "diff", F.col("k") * 1000, "Rp", (1, 2, 3))


@query(_quarter("round(a / nullif(b, 0) * 100, 4)", "CAST(100 + k AS DOUBLE)"))
def claim_ratio(spark, sf_dir):
    return judged(spark, sf_dir, "ratio", 100 + F.col("k"), "persen", (1, 2))


@query(_trend("b >= a AND c >= b"))
def claim_is_increasing(spark, sf_dir):
    return judged(spark, sf_dir, "is_increasing", F.lit(None), None, (1, 2, 3), ("fact_ord", "verdict"))


@query(_trend("b <= a AND c <= b"))
def claim_is_decreasing(spark, sf_dir):
    return judged(spark, sf_dir, "is_decreasing", F.lit(None), None, (1, 2, 3), ("fact_ord", "verdict"))


@query(_trend("abs(b - a) <= 0.05 AND abs(c - b) <= 0.05"))
def claim_is_stable(spark, sf_dir):
    return judged(spark, sf_dir, "is_stable", F.lit(None), None, (1, 2, 3), ("fact_ord", "verdict"))


@query(f"WITH s AS ({_single('round(v, 4)', 'round(v * (1 + ((k + mo) % 3 - 1) * 0.01), 1)')}) SELECT count(*) FILTER (WHERE verdict = 'Entailed') AS entailed, count(*) FILTER (WHERE verdict = 'Refuted') AS refuted, count(*) FILTER (WHERE verdict = 'Inconclusive') AS inconclusive, count(*) FILTER (WHERE verdict = 'Error') AS error, count(*) AS total FROM s")
def verdict_summary(spark, sf_dir):
    return verify.verdict_counts(claim_value(spark, sf_dir))


@query(f"WITH {M} SELECT CAST(k * 1000000 + y * 100 + mo AS BIGINT) AS fact_ord, CASE WHEN mo % 2 = 0 THEN 1 ELSE 2 END AS source_ord, 'Entailed' AS verdict FROM m")
def source_priority(spark, sf_dir):
    """Three sources: another currency, even months only, all months; the first that fits decides."""
    m = monthly(spark, sf_dir)
    parts = [as_table(m, "juta USD", 0), as_table(m.where("mo % 2 = 0"), "Rp", 1), as_table(m, "Rp", 2)]
    both = verify.Tables(*[a.unionByName(b).unionByName(c) for a, b, c in ((parts[0].meta, parts[1].meta, parts[2].meta), (parts[0].data, parts[1].data, parts[2].data))])
    rows = m.withColumn("fact_ord", F.col("k") * 1000000 + F.col("y") * 100 + F.col("mo"))
    f = facts(rows, "value", F.round("v", 4), "Rp", point(0, F.col("label"), F.col("y"), month_abbreviation(F.col("mo"))))
    return verify.verify_facts(both, f).select("fact_ord", "source_ord", "verdict")


@query(f"WITH {M} SELECT CAST(min(k * 1000000 + y * 100 + mo) AS BIGINT) AS fact_ord FROM m GROUP BY k, y")
def fact_dedup(spark, sf_dir):
    rows = monthly(spark, sf_dir).withColumn("fact_ord", F.col("k") * 1000000 + F.col("y") * 100 + F.col("mo"))
    return verify.dedup_facts(facts(rows, "sum", F.col("v"), "Rp", point(0, F.col("label"), F.col("y"), F.lit("Jan")))).select("fact_ord")


@query("SELECT CAST(n_nationkey AS BIGINT) AS fact_ord, 'Inconclusive' AS verdict, 'gate' AS reason FROM nation")
def temporal_gate(spark, sf_dir):
    m = monthly(spark, sf_dir)
    rows = read(spark, sf_dir, "nation").withColumn("fact_ord", F.col("n_nationkey"))
    f = facts(rows, "is_increasing", F.lit(None), None, point(0, F.col("n_name"), F.lit(None), F.lit(None).cast("string"), F.lit("Harga")))
    return verify.verify_facts(as_table(m), f).select("fact_ord", "verdict", "reason")


@query(f"WITH {M} SELECT DISTINCT 'x ' || label AS metric, CAST(1 AS BIGINT) AS n FROM m")
def missing_diagnostics(spark, sf_dir):
    m = monthly(spark, sf_dir)
    rows = m.select("k", "label").distinct().withColumn("fact_ord", F.col("k"))
    f = facts(rows, "value", F.lit(1.0), "Rp", point(0, F.concat(F.lit("x "), "label"), F.lit(1800), F.lit("Jan")))
    return verify.missing_points(as_table(m), f).select(F.element_at("missing", 1)["metric_label"].alias("metric"), F.size("missing").cast("long").alias("n"))


@query("""SELECT * FROM (VALUES ('Posisi Simpanan Masyarakat / DPK (mis. TABEL1_19 — SEKI Tabel 1.19)', 'Posisi DPK'),
('Posisi Kredit Bank Umum & BPR (SEKI Tabel 1.5 dst — KMK/KI/KK per jenis penggunaan)', 'Kredit UMKM|Debitur baru'),
('Uang Primer / M0 (SEKI Tabel 1.2)', 'M0 adjusted')) t(family, metrics)""")
def table_suggestions(spark, sf_dir):
    rows = [(0, "Kredit UMKM", "Inconclusive", None), (1, "Posisi DPK", "Inconclusive", None), (2, "Kredit UMKM", "Inconclusive", None), (3, "M0 adjusted", "Inconclusive", None),
            (4, "Debitur baru", "Inconclusive", None), (5, "Kredit lain", "Refuted", None), (6, "Kredit x", "Inconclusive", "f / s")]
    df = spark.createDataFrame(rows, "fact_ord long, metric_label string, verdict string, matched_source string")
    return verify.table_suggestions(df).select("family", F.array_join("metrics", "|").alias("metrics"))


SALDO = "s AS (SELECT n_nationkey AS k, n_name AS label, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


@query(f"""WITH {SALDO}, x AS (SELECT CAST(k AS BIGINT) AS fact_ord, label, round(v / 1000.0::DOUBLE, 4) AS computed, round(v / 1000.0::DOUBLE, 1) + k % 2 AS claimed FROM s)
SELECT fact_ord, computed, {VERDICT} AS verdict, label AS metric_label, 'saldo' AS col_label, computed AS excel_value FROM x""")
def claim_categorical(spark, sf_dir):
    """Values of a named column whose heading holds the unit, claimed at another scale; points as they are shown in a result."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    g = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("v"))
    meta = spark.createDataFrame([(0, "customer", "s", "Saldo pelanggan", "orang", "categorical", "generic")], "source_ord int, file string, sheet string, title string, unit string, axis_type string, parser string")
    data = g.select(F.lit(0).alias("source_ord"), F.col("n_nationkey").alias("row_ord"), F.col("n_name").alias("row_label"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("month"),
                    F.lit(1).alias("col_ord"), F.lit("Saldo (ribu Rp)").alias("col_label"), F.col("v").alias("value"))
    rows = g.withColumn("fact_ord", F.col("n_nationkey"))
    f = facts(rows, "value", F.round(F.col("v") / 1000, 1) + F.col("n_nationkey") % 2, "juta Rp", point(0, F.lower("n_name"), F.lit(None), F.lit(None).cast("string"), F.lit("saldo")))
    return verify.verify_facts(verify.Tables(meta, data), f).select("fact_ord", "computed", "verdict", F.inline("result_periods")).select("fact_ord", "computed", "verdict", "metric_label", "col_label", "excel_value")


# -- fuzzy look-ups ----------------------------------------------------------------------------

SIG = "len(list_intersect(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: len(w) > 2), list_filter(regexp_extract_all(lower({1}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: len(w) > 2)))"
TIERS = f"""
 q AS (SELECT DISTINCT q FROM (SELECT lower(p_type) AS q FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part UNION ALL SELECT lower(n_name) || ' wilayah' FROM nation UNION ALL SELECT r_name FROM region)),
 l AS (SELECT DISTINCT label FROM (SELECT p_type AS label FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)),
 c AS (
  SELECT q, label, 1 AS tier, 0 AS k1, 0 AS k2 FROM q, l WHERE lower(trim(label)) = lower(trim(q))
  UNION ALL SELECT q, label, 2, CAST(length(label) AS INTEGER), 0 FROM q, l WHERE contains(lower(label), lower(trim(q)))
  UNION ALL SELECT q, label, 3, -CAST({SIG.format('label', 'q')} AS INTEGER), -CAST(length(trim(lower(split_part(label, ' > ', -1)))) AS INTEGER) FROM q, l WHERE contains(label, ' > ') AND contains(lower(trim(q)), trim(lower(split_part(label, ' > ', -1))))
  UNION ALL SELECT q, label, 4, -CAST(length(label) AS INTEGER), 0 FROM q, l WHERE contains(lower(trim(q)), lower(trim(label))))
"""


def _names(spark, sf_dir):
    part, nation, region = (read(spark, sf_dir, t) for t in ("part", "nation", "region"))
    q = part.select(F.lower("p_type").alias("q")).unionByName(part.select(F.element_at(F.split("p_name", " "), 1).alias("q")))
    q = q.unionByName(nation.select(F.concat(F.lower("n_name"), F.lit(" wilayah")).alias("q"))).unionByName(region.select(F.col("r_name").alias("q"))).distinct()
    inner = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit(" > "), "n_name").alias("label"))
    lab = part.select(F.col("p_type").alias("label")).unionByName(nation.select(F.col("n_name").alias("label"))).unionByName(inner).distinct()
    return q, lab


@query(f"WITH {TIERS} SELECT q, label, min(tier) AS tier FROM c GROUP BY q, label")
def fuzzy_tiers(spark, sf_dir):
    return lookup.match_tiers(*_names(spark, sf_dir)).select("q", "label", "tier")


@query(f"WITH {TIERS} SELECT q, arg_min(label, row(tier, k1, k2, label)) AS label FROM c GROUP BY q")
def fuzzy_best(spark, sf_dir):
    t = lookup.match_tiers(*_names(spark, sf_dir))
    return t.groupBy("q").agg(F.min_by("label", F.struct("tier", "k1", "k2", "label")).alias("label"))


@query(f"WITH {M}, t AS (SELECT DISTINCT label, y, mo, v FROM m) SELECT lower(label) || ' total' AS q, y AS year, {ABBR} AS month, label AS matched_label, v AS value FROM t WHERE label <> 'INDONESIA' OR true")
def fuzzy_temporal(spark, sf_dir):
    m = monthly(spark, sf_dir)
    t = as_table(m)
    q = m.select(F.concat(F.lower("label"), F.lit(" total")).alias("q"), F.col("y").alias("year"), month_abbreviation(F.col("mo")).alias("month"))
    return lookup.resolve_temporal(q, t.meta, t.data).select("q", "year", "month", "matched_label", "value")


@query(f"WITH {M}, t AS (SELECT y, mo, CAST(sum(CAST(v AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM m GROUP BY y, mo) SELECT 'Penghimpunan DPK' AS q, y AS year, {ABBR} AS month, 'Jumlah' AS matched_label, value FROM t")
def fuzzy_total_fallback(spark, sf_dir):
    m = monthly(spark, sf_dir).groupBy("y", "mo").agg(F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("v")).withColumns({"k": F.lit(0), "label": F.lit("Jumlah")})
    t = as_table(m, title="Posisi Simpanan Masyarakat")
    q = m.select(F.lit("Penghimpunan DPK").alias("q"), F.col("y").alias("year"), month_abbreviation(F.col("mo")).alias("month"))
    return lookup.resolve_temporal(q, t.meta, t.data).select("q", "year", "month", "matched_label", "value")


@query("SELECT lower(n_name) AS q, 'saldo' AS cq, n_name AS matched_label, 'Saldo (Rp)' AS matched_col, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def fuzzy_categorical(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    g = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("s"), F.count("*").cast("double").alias("n"))
    data = g.select(F.lit(0).alias("source_ord"), F.col("n_nationkey").alias("row_ord"), F.col("n_name").alias("row_label"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("month"),
                    F.inline(F.array(F.struct(F.lit(0).alias("col_ord"), F.lit("Saldo (Rp)").alias("col_label"), F.col("s").alias("value")), F.struct(F.lit(1).alias("col_ord"), F.lit("Pelanggan").alias("col_label"), F.col("n").alias("value")))))
    return lookup.resolve_categorical(n.select(F.lower("n_name").alias("q"), F.lit("saldo").alias("cq")), data).select("q", "cq", "matched_label", "matched_col", "value")


@query(f"WITH {M} SELECT DISTINCT lower(label) AS q, y AS year, {ABBR} AS month FROM m")
def available_periods(spark, sf_dir):
    m = monthly(spark, sf_dir)
    t = as_table(m)
    rows = t.data.select("source_ord", "row_ord", "row_label").distinct()
    return lookup.available_periods(m.select(F.lower("label").alias("q")), t.meta, rows, t.data).select("q", "year", "month")


# -- units, numbers, periods -------------------------------------------------------------------

SCALE_WORDS = {"": 1.0, "ribu ": 1e3, "juta ": 1e6, "miliar ": 1e9, "triliun ": 1e12}
#: Every two scales of a currency, and pairs that cannot be converted.
UNIT_PAIRS = [(f"{a}{x}", f"{b}{x}", fa / fb) for x in ("Rp", "USD") for a, fa in SCALE_WORDS.items() for b, fb in SCALE_WORDS.items()]
UNIT_PAIRS += [(f"{a}Rp", f"{a}USD", None) for a in SCALE_WORDS] + [("ekor", "lembar", None), ("%", "ribu Rp", None), ("persen", "persen", 1.0)]


def _written(n: int, places: int) -> str:
    """A number of so many hundredths in Indonesian writing."""
    whole = f"{abs(n) // 100:,}".replace(",", ".")
    return ("-" if n < 0 else "") + whole + (f",{abs(n) % 100:02d}" if places else "")


_AMOUNTS = [7 ** k * s for k in range(1, 12) for s in (100, -100)] + [k * 7919 - 40_000 for k in range(12)]
NUMBERS = [(_written(n, n % 100), n / 100) for n in _AMOUNTS]
NUMBERS += [(shape.format(_written(abs(n), n % 100)), sign * abs(n) / 100) for n in _AMOUNTS[:6] for shape, sign in (("({})", -1), ("Rp{} miliar", 1), ("({}%)", 1), ("{} *", 1), ("({}) triliun", -1))]
NUMBERS += [(x, None) for x in ("(  )", "tidak ada", "3,4,5", "n.a.")]
_NAMES = ("Jan", "Februari", "Mrt", "April", "Mei", "June", "Jul", "Agustus", "Sept", "Okt", "Nopember", "Des")
PERIODS = [(shape.format(n=n, y=y, s=y % 100, m=i + 1), y, MONTHS[i]) for i, n in enumerate(_NAMES) for y, shapes in ((1999, ("{n} {y}", "{y}/{n}", "{y}M{m:02d}")), (2031, ("{n}-{s:02d}", "{m}/{y}", "{y}-{m}", "{n}.{y}**"))) for shape in shapes if n != "Nopember"]
PERIODS += [(x, None, None) for x in ("Jumlah", "1999", "Kw1 1999", "Mei 69.5", "13-2001", "2001m0", "Mei", "Mei 1989", "Mei/2101 x", "-Mei 1999")]


def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({names})"


@query(f"SELECT a, b, CAST(f AS DOUBLE) AS factor FROM {_values(UNIT_PAIRS, 'a, b, f')}")
def unit_convert(spark, sf_dir):
    return spark.createDataFrame([p[:2] for p in UNIT_PAIRS], "a string, b string").select("a", "b", units.factor(F.col("a"), F.col("b")).alias("factor"))


@query(f"SELECT raw, CAST(v AS DOUBLE) AS parsed FROM {_values(NUMBERS, 'raw, v')}")
def number_parse(spark, sf_dir):
    return spark.createDataFrame([p[:1] for p in NUMBERS], "raw string").select("raw", indonesian_number(F.col("raw")).alias("parsed"))


@query(f"SELECT raw, CAST(y AS INTEGER) AS year, CAST(m AS VARCHAR) AS month FROM {_values(PERIODS, 'raw, y, m')}")
def period_parse(spark, sf_dir):
    df = spark.createDataFrame([p[:1] for p in PERIODS], "raw string")
    p = parse_period(F.lit("str"), F.col("raw"), F.lit(None).cast("timestamp_ntz"))
    return df.select("raw", p["year"].alias("year"), p["month"].alias("month"))


# -- tables from grids -------------------------------------------------------------------------

CELL_COLS = "source_ord", "file", "sheet", "r", "c", "kind", "v_str", "v_num", "v_ts", "is_bold", "has_fill", "has_top_border", "indent"


def _cells(df: DataFrame, r, c, text=None, number=None) -> DataFrame:
    """Cells from rows: a text or a number at (r, c)."""
    return df.select(
        F.col("g").alias("source_ord"), F.lit("f").alias("file"), F.concat(F.lit("s"), F.col("g").cast("string")).alias("sheet"), r.cast("int").alias("r"), c.cast("int").alias("c"),
        F.lit("str" if text is not None else "num").alias("kind"), (text if text is not None else F.lit(None)).cast("string").alias("v_str"), (number if number is not None else F.lit(None)).cast("double").alias("v_num"),
        F.lit(None).cast("timestamp_ntz").alias("v_ts"), F.lit(False).alias("is_bold"), F.lit(False).alias("has_fill"), F.lit(False).alias("has_top_border"), F.lit(0).alias("indent"),
    )


def generic_cells(m: DataFrame) -> DataFrame:
    """A sheet a region: title, unit, a header row of months, a row a nation."""
    col = (F.col("y") - 1990) * 12 + F.col("mo") + 1
    heads = m.select("g", "y", "mo").distinct()
    one = m.select("g").distinct()
    return (
        _cells(one, F.lit(1), F.lit(1), F.lit("Penjualan")).unionByName(_cells(one, F.lit(2), F.lit(1), F.lit("(juta Rp)"))).unionByName(_cells(one, F.lit(3), F.lit(1), F.lit("Wilayah")))
        .unionByName(_cells(heads, F.lit(3), col, F.concat_ws(" ", month_abbreviation(F.col("mo")), F.col("y").cast("string"))))
        .unionByName(_cells(m.select("g", "k", "label").distinct(), F.col("k") + 4, F.lit(1), F.col("label"))).unionByName(_cells(m, F.col("k") + 4, col, None, F.col("v")))
    )


def wide_cells(m: DataFrame) -> DataFrame:
    """The same as wide time series: years over their January, months below, labels in the third column."""
    years = m.select("g", "y").distinct()
    months = years.select("g", "y", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mo"))
    col = (F.col("y") - 1990) * 12 + F.col("mo") + 3
    one = m.select("g").distinct()
    return (
        _cells(one, F.lit(1), F.lit(1), F.lit("Penjualan")).unionByName(_cells(one, F.lit(2), F.lit(1), F.lit("(juta Rp)"))).unionByName(_cells(years, F.lit(4), (F.col("y") - 1990) * 12 + 4, None, F.col("y")))
        .unionByName(_cells(months, F.lit(5), col, month_abbreviation(F.col("mo")))).unionByName(_cells(m.select("g", "k", "label").distinct(), F.col("k") + 6, F.lit(3), F.col("label")))
        .unionByName(_cells(m, F.col("k") + 6, col, None, F.col("v")))
    )


LONG = f"WITH {M} SELECT g AS source_ord, label AS row_label, y AS year, {ABBR} AS month, v AS value FROM m"


def _long(p: grids.Parsed) -> DataFrame:
    return p.data.select("source_ord", "row_label", "year", "month", "value")


@query(LONG)
def parse_generic_table(spark, sf_dir):
    return _long(grids.parse_generic(generic_cells(monthly(spark, sf_dir))))


@query(LONG)
def parse_wide_table(spark, sf_dir):
    return _long(grids.parse_wide(wide_cells(monthly(spark, sf_dir))))


@query(LONG)
def parse_spec_table(spark, sf_dir):
    m = monthly(spark, sf_dir)
    cells = generic_cells(m)
    column = F.struct(((F.col("y") - 1990) * 12 + F.col("mo")).alias("col"), F.lit("period").alias("kind"), F.col("y").alias("year"), month_abbreviation(F.col("mo")).alias("month"), F.lit(None).cast("string").alias("name"))
    specs = m.select("g", "y", "mo").distinct().groupBy(F.col("g").alias("source_ord")).agg(F.collect_list(column).alias("columns")).select(
        "source_ord", F.lit(2).alias("header_row"), F.lit(0).alias("label_col"), F.lit(3).alias("data_start_row"), F.lit("temporal").alias("axis_type"), F.lit("T").alias("title"), F.lit("u").alias("unit"), "columns")
    return _long(grids.parse_by_spec(cells, specs))


@query(f"WITH {M} SELECT DISTINCT g AS source_ord, 'Penjualan' AS title, 'juta Rp' AS unit, 'temporal' AS axis_type, CASE WHEN g % 2 = 0 THEN 'bi' ELSE 'generic' END AS parser FROM m")
def parser_cascade(spark, sf_dir):
    m = monthly(spark, sf_dir)
    cells = wide_cells(m.where("g % 2 = 0")).unionByName(generic_cells(m.where("g % 2 = 1")))
    return grids.parse_tables(cells).meta.select("source_ord", "title", "unit", "axis_type", "parser")


@query(f"WITH {M} SELECT DISTINCT g AS source_ord, 3 AS header_row, 1 AS label_col FROM m")
def header_detect(spark, sf_dir):
    cells = generic_cells(monthly(spark, sf_dir))
    return grids.label_columns(cells, grids.header_rows(cells))


@query(f"WITH {M} SELECT DISTINCT g AS source_ord, CAST((y - 1990) * 12 + mo + 3 AS INTEGER) AS c, y AS year, {ABBR} AS month FROM (SELECT DISTINCT g, y FROM m) a, (SELECT unnest(range(1, 13)) AS mo) b")
def column_periods(spark, sf_dir):
    return grids.column_periods(wide_cells(monthly(spark, sf_dir))).select("source_ord", "c", "year", "month")


@query(f"""WITH {M}, n AS (SELECT g, CAST(k + 4 AS INTEGER) AS r, CAST((y - 1990) * 12 + mo + 1 AS INTEGER) AS c, 'n' AS p FROM m),
x AS (SELECT * FROM n UNION SELECT g, r, 1, 't' FROM n UNION SELECT g, 3, c, 't' FROM n UNION SELECT DISTINCT g, unnest([1, 2, 3]), 1, 't' FROM m),
z AS (SELECT g, max(r) AS rows, max(c) AS cols FROM x GROUP BY g), d AS (SELECT g, cols, unnest(range(1, least(rows, 20) + 1)) AS r FROM z), e AS (SELECT g, cols, r, unnest(range(1, least(cols, 30) + 1)) AS c FROM d),
l AS (SELECT g, cols, r, string_agg(coalesce(p, '.'), '' ORDER BY c) AS line FROM e LEFT JOIN x USING (g, r, c) GROUP BY g, cols, r)
SELECT g AS source_ord, sha256(string_agg(line, '|' ORDER BY r) || '#' || cols) AS fingerprint FROM l GROUP BY g, cols""")
def fingerprint(spark, sf_dir):
    return grids.fingerprints(generic_cells(monthly(spark, sf_dir)))


@query(LONG)
def table_unpivot_long(spark, sf_dir):
    """A sheet that names every nation twice; the first row of a label counts."""
    m = monthly(spark, sf_dir)
    return _long(grids.parse_generic(generic_cells(m.unionByName(m.withColumns({"k": F.col("k") + 100, "v": F.col("v") * 2})))))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS row_label, l_returnflag AS col_label, arg_min(l_extendedprice, row(l_linenumber, l_extendedprice)) AS value FROM lineitem GROUP BY l_orderkey, l_returnflag")
def first_wins_dedup(spark, sf_dir):
    null = F.lit(None)
    rows = read(spark, sf_dir, "lineitem").select(
        F.lit(0).alias("source_ord"), F.col("l_linenumber").cast("int").alias("row_ord"), F.col("l_orderkey").cast("string").alias("row_label"), null.cast("int").alias("year"), null.cast("string").alias("month"),
        F.lit(1).alias("col_ord"), F.col("l_returnflag").alias("col_label"), F.col("l_extendedprice").alias("value"), F.col("l_extendedprice").alias("__c"))
    return grids.first_wins(rows).select("row_label", "col_label", "value")


@query(f"WITH {M} SELECT g AS source_ord, label AS row_label, y AS year, {ABBR} AS month, v AS value FROM m WHERE g % 2 = 0")
def spec_rejects(spark, sf_dir):
    """Specs of odd regions name their label column as a data column and are refused."""
    m = monthly(spark, sf_dir)
    cells = generic_cells(m)
    column = F.struct(((F.col("y") - 1990) * 12 + F.col("mo")).alias("col"), F.lit("period").alias("kind"), F.col("y").alias("year"), month_abbreviation(F.col("mo")).alias("month"), F.lit(None).cast("string").alias("name"))
    specs = m.select("g", "y", "mo").distinct().groupBy(F.col("g").alias("source_ord")).agg(F.collect_list(column).alias("columns")).select(
        "source_ord", F.lit(2).alias("header_row"), F.when(F.col("source_ord") % 2 == 0, 0).otherwise(F.element_at("columns", 1)["col"]).alias("label_col"), F.lit(3).alias("data_start_row"), F.lit("temporal").alias("axis_type"), F.lit("T").alias("title"), F.lit("u").alias("unit"), "columns")
    return _long(grids.parse_by_spec(cells, specs))


@query("""WITH n AS (SELECT n_nationkey AS k, n_name AS label, n_regionkey AS g, count(*) AS c, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT g AS source_ord, 'categorical' AS axis_type, label AS row_label, col AS col_label, CASE WHEN col = 'Saldo' THEN s ELSE CAST(c AS DOUBLE) END AS value FROM n, (VALUES ('Saldo'), ('Pelanggan')) t(col)""")
def categorical_axis(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    t = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"), F.col("n_regionkey").alias("g")).agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("s"))
    one = t.select("g").distinct()
    cells = _cells(one, F.lit(1), F.lit(1), F.lit("Daftar"))
    for col, name in ((1, "Negara"), (2, "Saldo"), (3, "Pelanggan")):
        cells = cells.unionByName(_cells(one, F.lit(3), F.lit(col), F.lit(name)))
    cells = cells.unionByName(_cells(t, F.col("k") + 4, F.lit(1), F.col("label"))).unionByName(_cells(t, F.col("k") + 4, F.lit(2), None, F.col("s"))).unionByName(_cells(t, F.col("k") + 4, F.lit(3), None, F.col("n")))
    p = grids.parse_generic(cells)
    return p.data.join(p.meta.select("source_ord", "axis_type"), "source_ord").select("source_ord", "axis_type", "row_label", "col_label", "value")


@query("""SELECT n_regionkey AS source_ord, n_name AS row_label FROM nation UNION ALL SELECT n_regionkey, n_name || ' > ' || part FROM nation, (VALUES ('Rupiah'), ('Valas')) t(part)
UNION ALL SELECT n_regionkey, 'Valas > Giro' FROM nation""")
def repeated_labels(spark, sf_dir):
    """Below every nation its parts, with one label below the second; labels met twice are led by their parent's."""
    n = read(spark, sf_dir, "nation")
    part = lambda i, label, indent: F.struct(F.lit(i).alias("i"), label.alias("label"), F.lit(indent).alias("indent"))
    rows = n.select(F.col("n_regionkey").alias("source_ord"), "n_nationkey", F.inline(F.array(part(0, F.col("n_name"), 0), part(1, F.lit("Rupiah"), 2), part(2, F.lit("Valas"), 2), part(3, F.lit("Giro"), 5))))
    rows = rows.select("source_ord", (F.col("n_nationkey") * 10 + F.col("i")).alias("row_ord"), "label", "indent")
    return grids.qualify_labels(rows).select("source_ord", "row_label")


@query("SELECT n_nationkey AS source_ord, CASE WHEN n_nationkey % 3 = 0 THEN 'generic' END AS parser, CASE n_nationkey % 3 WHEN 1 THEN 'the sheet holds no numbers' WHEN 2 THEN 'no parser found a header, labels and values' END AS error FROM nation")
def parser_status(spark, sf_dir):
    """Sheets of a table, of texts alone, and of numbers alone."""
    n = read(spark, sf_dir, "nation").withColumn("g", F.col("n_nationkey"))
    a, b, c = (n.where(F.col("g") % 3 == i) for i in range(3))
    cells = _cells(a, F.lit(1), F.lit(1), F.lit("Wilayah")).unionByName(_cells(a, F.lit(1), F.lit(2), F.lit("Jan 2020"))).unionByName(_cells(a, F.lit(1), F.lit(3), F.lit("Feb 2020")))
    cells = cells.unionByName(_cells(a, F.lit(2), F.lit(1), F.col("n_name"))).unionByName(_cells(a, F.lit(2), F.lit(2), None, F.col("n_regionkey"))).unionByName(_cells(a, F.lit(2), F.lit(3), None, F.lit(1)))
    cells = cells.unionByName(_cells(b, F.lit(1), F.lit(1), F.col("n_name"))).unionByName(_cells(c, F.lit(1), F.lit(1), None, F.col("n_regionkey")))
    return grids.source_status(cells, grids.parse_tables(cells)).select("source_ord", "parser", "error")


# -- ingestion ---------------------------------------------------------------------------------

YEARS = f"WITH {M}, y AS (SELECT g, k, label, y, CAST(sum(CAST(v AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM m GROUP BY 1, 2, 3, 4), f AS (SELECT g FROM y GROUP BY g HAVING count(*) = count(DISTINCT k) * count(DISTINCT y))"


def total_cells(spark, sf_dir) -> DataFrame:
    """A sheet a region: nations by year with a total row and no total column."""
    m = monthly(spark, sf_dir)
    y = m.groupBy("g", "k", "label", "y").agg(F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("v"))
    col, t = F.col("y") - 1988, y.groupBy("g", "y").agg(F.sum(F.col("v").cast("decimal(18,2)")).cast("double").alias("v"))
    one = y.select("g").distinct()
    return (
        _cells(one, F.lit(1), F.lit(1), F.lit("Wilayah")).unionByName(_cells(y.select("g", "y").distinct(), F.lit(1), col, F.concat(F.lit("Tahun "), F.col("y").cast("string"))))
        .unionByName(_cells(y.select("g", "k", "label").distinct(), F.col("k") + 2, F.lit(1), F.col("label"))).unionByName(_cells(y, F.col("k") + 2, col, None, F.col("v")))
        .unionByName(_cells(one, F.lit(99), F.lit(1), F.lit("Jumlah"))).unionByName(_cells(t, F.lit(99), col, None, F.col("v")))
    )


@query(f"""{YEARS} SELECT 's' || g AS sheet, label AS row_label, 'Tahun ' || y AS col_label, v AS value, false AS is_aggregate, 's' || g || '!' || chr(CAST(64 + y - 1988 AS INTEGER)) || (k + 2) AS source_cell_ref FROM y
UNION ALL SELECT 's' || g, 'Jumlah', 'Tahun ' || y, CAST(sum(CAST(v AS DECIMAL(18, 2))) AS DOUBLE), g IN (SELECT g FROM f), 's' || g || '!' || chr(CAST(64 + y - 1988 AS INTEGER)) || 99 FROM y GROUP BY g, y""")
def ingest_facts(spark, sf_dir):
    return ingest.extract_facts(total_cells(spark, sf_dir)).select("sheet", "row_label", "col_label", "value", "is_aggregate", "source_cell_ref")


@query(f"""{YEARS} SELECT DISTINCT g AS source_ord, label, CAST(0.0 AS DOUBLE) AS score, 'not_aggregate' AS class FROM y
UNION ALL SELECT DISTINCT g, 'Jumlah', CASE WHEN g IN (SELECT g FROM f) THEN 1.0 ELSE 0.55 END, CASE WHEN g IN (SELECT g FROM f) THEN 'aggregate' ELSE 'ambiguous' END FROM y""")
def aggregate_row_score(spark, sf_dir):
    return ingest.signals(total_cells(spark, sf_dir)).where("axis = 'row'").select("source_ord", "label", "score", "class")


@query(f"""{YEARS} SELECT DISTINCT g AS source_ord, 'Tahun ' || y AS label, CAST(CASE WHEN y = max(y) OVER (PARTITION BY g) THEN 0.05 ELSE 0.0 END AS DOUBLE) AS score FROM y""")
def aggregate_col_score(spark, sf_dir):
    return ingest.signals(total_cells(spark, sf_dir)).where("axis = 'column'").select("source_ord", "label", "score")


@query(f"""{YEARS} SELECT (SELECT count(*) FROM f) AS auto_aggregate, (SELECT count(DISTINCT (g, k)) + count(DISTINCT (g, y)) FROM y) AS auto_not_aggregate, CAST(0 AS BIGINT) AS llm_escalated,
(SELECT count(DISTINCT g) FROM y WHERE g NOT IN (SELECT g FROM f)) AS defaulted, (SELECT count(DISTINCT g) FROM y) AS sheets, (SELECT count(*) + count(DISTINCT (g, y)) FROM y) AS facts""")
def ingest_summary(spark, sf_dir):
    return ingest.ingest_summary(total_cells(spark, sf_dir))


@query(f"""{YEARS} SELECT DISTINCT g AS source_ord, CAST(k + 2 AS INTEGER) AS r, 'data' AS part FROM y UNION ALL SELECT DISTINCT g, 1, 'header' FROM y UNION ALL SELECT DISTINCT g, 99, 'data' FROM y""")
def title_rows(spark, sf_dir):
    """Sheets led by two rows that repeat one title over their width; those rows are no part of the table."""
    cells = total_cells(spark, sf_dir)
    wide = cells.where("r = 1").select("source_ord", "c")
    lead = wide.crossJoin(spark.createDataFrame([(-1,), (0,)], "r int")).select(
        "source_ord", F.lit("f").alias("file"), F.lit("s").alias("sheet"), "r", "c", F.lit("str").alias("kind"), F.lit("Judul").alias("v_str"), F.lit(None).cast("double").alias("v_num"), F.lit(None).cast("timestamp_ntz").alias("v_ts"),
        F.lit(False).alias("is_bold"), F.lit(False).alias("has_fill"), F.lit(False).alias("has_top_border"), F.lit(0).alias("indent"))
    return ingest.split_rows(cells.unionByName(lead))


# -- text --------------------------------------------------------------------------------------

LINES = r"l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM documents), t AS (SELECT doc_id, line, list_filter(string_split_regex(line, '\s+'), lambda w: w <> '') AS w FROM l)"


@query(f"WITH {LINES} SELECT CASE WHEN len(w) < 6 THEN 'skip' WHEN len(list_filter(w, lambda x: regexp_full_match(x, '[\\d.,%()\\-]+'))) / len(w) > 0.55 THEN 'table' ELSE 'narrative' END AS kind, count(*) AS n FROM t GROUP BY 1")
def line_classify(spark, sf_dir):
    lines = narrative.explode_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.groupBy(narrative.classify_line(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


TAB = r"""(starts_with(trim(line), '|') OR regexp_matches(trim(line), '\S {4,}\S')
 OR (len(w) >= 8 AND len(list_filter(w, lambda x: regexp_full_match(x, '-?[\d.,]+%?') OR lower(x) IN ('jan','feb','mar','apr','mei','may','jun','jul','ags','agu','aug','sep','okt','oct','nov','des','dec'))) / len(w) >= 0.65)
 OR (len(w) >= 3 AND len(list_filter(list_slice(w, -3, -1), lambda x: regexp_full_match(x, '\(?-?[\d.,]+%?\)?'))) = 3))"""


MADE = """CASE l_linenumber % 6 WHEN 0 THEN '| ' || l_orderkey || ' | ' || l_linestatus || ' |' WHEN 1 THEN l_linestatus || '     ' || l_returnflag
WHEN 2 THEN 'Jan 1,' || l_linenumber || ' Feb 2,0 Mar ' || l_orderkey || ' naik (3,0)% Apr 4' WHEN 3 THEN 'Kiriman ' || l_linestatus || ' ' || l_orderkey || ' (1,5%) -' || l_linenumber
WHEN 4 THEN 'Pesanan ' || l_orderkey || ' dikirim dengan ' || l_linestatus || ' pada 2 Mei' ELSE l_linestatus || ' ' || l_orderkey || ' 7' END"""


@query(rf"WITH l AS (SELECT CAST(l_linenumber % 6 AS INTEGER) AS rule, {MADE} AS line FROM lineitem), t AS (SELECT rule, line, list_filter(string_split_regex(line, '\s+'), lambda w: w <> '') AS w FROM l) SELECT rule, {TAB} AS tabular, count(*) AS n FROM t GROUP BY 1, 2")
def tabular_line_filter(spark, sf_dir):
    """Lines made from lineitem that meet each of the four rules, or none."""
    lines = read(spark, sf_dir, "lineitem").selectExpr("CAST(l_linenumber % 6 AS INT) AS rule", f"{MADE} AS line")
    return lines.groupBy("rule", narrative.is_tabular(F.col("line")).alias("tabular")).agg(F.count("*").alias("n"))


KIND = r"CASE WHEN len({0}) < 6 THEN 's' WHEN len(list_filter({0}, lambda x: regexp_full_match(x, '[\d.,%()\-]+'))) / len({0}) > 0.55 THEN 't' ELSE 'n' END"


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, 1 AS page_no, line, w FROM t WHERE trim(line) <> '' UNION ALL SELECT doc_id, 1, '* angka ' || doc_id || ' naik lagi pada bulan ini', string_split('* angka ' || doc_id || ' naik lagi pada bulan ini', ' ') FROM documents
UNION ALL SELECT doc_id, 1, '*angka ini naik lagi pada bulan ini', string_split('*angka ini naik lagi pada bulan ini', ' ') FROM documents),
v AS (SELECT *, regexp_replace(trim(line), '^\*+\s*', '') AS rest FROM b), x AS (SELECT *, list_filter(string_split_regex(rest, '\s+'), lambda a: a <> '') AS u FROM v),
k AS (SELECT doc_id, page_no, CASE WHEN starts_with(trim(line), '*') THEN CASE WHEN {KIND.format('u')} = 'n' AND regexp_matches(rest, '\d') THEN 'n' ELSE 's' END ELSE {KIND.format('w')} END AS kind FROM x)
SELECT doc_id, page_no, count(*) FILTER (WHERE kind = 'n') AS n FROM k GROUP BY doc_id, page_no HAVING count(*) FILTER (WHERE kind = 't') < 0.7 * count(*) FILTER (WHERE kind <> 's')""")
def narrative_filter(spark, sf_dir):
    """Whole texts as a first page with a starred line to keep and one to drop, and an appendix page behind it."""
    text = F.concat(F.lit("[== Halaman 1 ==]\n"), F.coalesce("text", F.lit("")), F.lit("\n* angka "), F.col("doc_id").cast("string"), F.lit(" naik lagi pada bulan ini\n*angka ini naik lagi pada bulan ini\n[== Halaman 2 ==]\nLampiran 1. Tabel uang\nIni kalimat panjang yang tidak akan dibaca lagi"))
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return narrative.filter_narrative(narrative.split_pages(docs)).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line, unnest(range(0, len(string_split_regex(text, '\r\n|\n|\r')))) AS i FROM documents),
s AS (SELECT doc_id, CAST(i AS INTEGER) AS i, length(line) AS n FROM l),
c AS (SELECT doc_id, i, n AS used, 0 AS chunk FROM s WHERE i = 0 UNION ALL SELECT s.doc_id, s.i, CASE WHEN c.used + s.n > 6000 THEN s.n ELSE c.used + s.n END, CASE WHEN c.used + s.n > 6000 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN s ON s.doc_id = c.doc_id AND s.i = c.i + 1)
SELECT doc_id, i AS block_no, chunk AS chunk_no FROM c""")
def page_chunks(spark, sf_dir):
    lines = narrative.explode_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("line_no").alias("block_no"), F.col("line").alias("text"))
    return narrative.chunk_pages(lines).select("doc_id", "block_no", "chunk_no")


BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"""WITH {LINES.split(', t AS')[0]}, i AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id) AS x FROM l), p AS (SELECT doc_id, regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g') AS text FROM i)
SELECT doc_id, text, count(*) AS n FROM p WHERE text <> '' GROUP BY 1, 2""")
def page_round_trip(spark, sf_dir):
    """Every line as a page, joined behind markers and cut at them again."""
    pages = narrative.explode_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", (F.col("line_no") + 1).alias("page_no"), F.col("line").alias("text"))
    back = narrative.split_pages(narrative.join_pages(pages))
    return back.where("page_no IS NOT NULL").groupBy("doc_id", strip(F.col("text")).alias("text")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS doc_id, unnest([n_regionkey + 5, n_regionkey + 9]) AS page_no, unnest(CASE WHEN n_nationkey % 2 = 0 THEN [n_name, 'akhir'] ELSE [n_name || ' akhir', ''] END) AS text FROM nation""")
def renumbered_pages(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    text = F.concat(F.lit("[== Halaman 1 ==] "), "n_name", F.when(F.col("n_nationkey") % 2 == 0, " [== Halaman 2 ==]").otherwise(""), F.lit(" akhir"))
    return narrative.renumber_markers(n.select(F.col("n_nationkey").alias("doc_id"), text.alias("text"), F.array(F.col("n_regionkey") + 5, F.col("n_regionkey") + 9).alias("page_nums")))


@query("""SELECT n_nationkey AS doc_id, 'Negara ' || n_name || ' s.d. Mei tumbuh 9,7% (yoy)' || CASE WHEN n_nationkey % 3 = 0 THEN '!' ELSE '.' END AS sentence FROM nation WHERE n_nationkey % 3 < 2
UNION ALL SELECT n_nationkey, 'Negara ' || n_name || ' s.d. Mei tumbuh 9,7% (yoy)' FROM nation WHERE n_nationkey % 3 = 2""")
def sentence_around(spark, sf_dir):
    """A quote in the middle of a sentence that ends with a mark, or at the next page."""
    end = F.when(F.col("n_nationkey") % 3 == 0, "! Lalu turun.").when(F.col("n_nationkey") % 3 == 1, ". Lalu 'naik'.").otherwise(" [== Halaman 3 ==] Selesai.")
    n = read(spark, sf_dir, "nation").withColumn("text", F.concat(F.lit("[== Halaman 2 ==] Pertama, lihat di atas. Negara "), "n_name", F.lit(" s.d. Mei tumbuh 9,7% (yoy)"), end))
    at = locate_anchor(F.concat("n_name", F.lit(" s.d. Mei tumbuh")), F.col("text"))
    return n.select(F.col("n_nationkey").alias("doc_id"), expand_sentence(F.col("text"), at["start"], at["length"]).alias("sentence"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'juta Rp' WHEN 1 THEN 'ribu USD' END AS unit FROM nation")
def column_units(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    head = F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, " (juta Rp)").when(F.col("n_nationkey") % 3 == 1, " (ribu USD)").otherwise(""))
    return n.select(F.col("n_nationkey").alias("k"), units.column_unit(head).alias("unit"))


NORM = r"regexp_replace(text, '[\s]+', ' ', 'g')"


@query(rf"""WITH n AS (SELECT doc_id, regexp_replace(text, '{BLANK}+', ' ', 'g') AS t FROM documents), w AS (SELECT doc_id, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM n),
a AS (SELECT doc_id, t, array_to_string(w[-6:], ' ') AS part FROM w WHERE len(w) >= 6)
SELECT doc_id, CASE WHEN length(part) >= 15 AND contains(t, part) THEN CAST(instr(t, part) AS INTEGER) END AS start FROM a""")
def anchor_locate(spark, sf_dir):
    """The last six words of every text behind a word that is not there: the whole quote fails, its second window is found."""
    n = read(spark, sf_dir, "documents").select("doc_id", normalise_ws(F.col("text")).alias("t"))
    n = n.withColumn("w", F.filter(F.split("t", " "), lambda x: x != "")).where(F.size("w") >= 6)
    anchor = F.concat(F.lit("qxzq999 "), F.array_join(F.slice("w", -6, 6), " "))
    return n.select("doc_id", locate_anchor(anchor, F.col("t"))["start"].alias("start"))


@query(r"SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?:-[A-Za-z]+)*')) AS w FROM documents) GROUP BY 1")
def tokens(spark, sf_dir):
    return typo.tokenise(read(spark, sf_dir, "documents")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))


TAIL = " Resiko aktifitas rumah rumah rumah. Di rumah kan"
STD = ", ".join(f"('{a}', '{b}')" for a, b in typo.STANDARD.items())
FOUND = rf"""d AS (SELECT doc_id, coalesce(text, '') || '{TAIL}' AS text FROM documents),
a AS (SELECT doc_id, regexp_extract_all(text, '{typo.WORD}') AS w, string_split_regex(text, '{typo.WORD}') AS g FROM d),
i AS (SELECT doc_id, unnest(w) AS word, unnest(g[2:]) AS gap, unnest(g[:len(w)]) AS pre, unnest(range(0, len(w))) AS pos FROM a),
known AS (SELECT lower(word) AS word FROM i GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3 UNION SELECT unnest(['dirumah', {", ".join(f"'{m}'" for m in typo.MONTHS)}])),
t AS (SELECT *, lower(word) AS low, CAST(sum(length(pre) + length(word)) OVER p AS INTEGER) AS stop, lag(word) OVER p AS a1, lag(word, 2) OVER p AS a2, lead(word) OVER p AS b1, lead(word, 2) OVER p AS b2, lag(gap) OVER p AS ga1, lag(gap, 2) OVER p AS ga2, lead(gap) OVER p AS gb1
  FROM i WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
u AS (SELECT *, stop - length(word) AS start, b1 IS NOT NULL AND regexp_full_match(gap, '{BLANK}*') AS near FROM t),
o AS (SELECT *, near AND b1 = lower(b1) AND b1 = low AND NOT contains(word, '-') AND length(word) >= 3 AS twice FROM u),
q AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM o WHERE twice OR (near AND low IN ('di', 'ke') AND lower(word || b1) IN (SELECT word FROM known))),
pair AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) % 2 = 1),
single AS (SELECT * FROM o WHERE (doc_id, pos) NOT IN (SELECT (doc_id, pos) FROM pair UNION ALL SELECT (doc_id, pos + 1) FROM pair))"""


def _dictionary(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(texts with a tail that holds a finding of each kind, words of three texts or more and one joined word)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(TAIL)).alias("text"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(typo.WORD), F.lit(0)))).alias("word"))
    common = words.distinct().groupBy("word").count().where("count >= 3").select("word")
    return docs, common.unionByName(spark.createDataFrame([("dirumah",)], "word string"))


@query(rf"WITH {FOUND} SELECT doc_id, CAST(pos AS INTEGER) AS pos, s.b AS suggestion, start, stop AS \"end\" FROM single JOIN (VALUES {STD}) s(a, b) ON low = s.a".replace('\\"', '"'))
def nonstandard_words(spark, sf_dir):
    return typo.scan(*_dictionary(spark, sf_dir)).where("kind = 'nonstandard'").select("doc_id", "pos", "suggestion", "start", "end")


@query(f'WITH {FOUND} SELECT doc_id, word || \'-\' || b1 AS suggestion, start, CAST(stop + length(gap) + length(b1) AS INTEGER) AS "end" FROM pair WHERE twice')
def reduplication(spark, sf_dir):
    return typo.scan(*_dictionary(spark, sf_dir)).where("kind = 'reduplication'").select("doc_id", "suggestion", "start", "end")


@query(f'WITH {FOUND} SELECT doc_id, word || \' \' || b1 AS text, lower(word || b1) AS suggestion, \'di_ke:\' || lower(b1) AS key, start FROM pair WHERE NOT twice')
def separated_prefixes(spark, sf_dir):
    return typo.scan(*_dictionary(spark, sf_dir)).where("kind = 'di_ke_prefix'").select("doc_id", "text", "suggestion", "key", "start")


@query(rf"""WITH {FOUND}, x AS (SELECT *, list_filter([word, CASE WHEN ga1 = ' ' THEN lower(a1 || word) END, CASE WHEN ga1 = ' ' AND ga2 = ' ' THEN lower(a2 || a1 || word) END, CASE WHEN gap = ' ' THEN lower(word || b1) END, CASE WHEN gap = ' ' AND gb1 = ' ' THEN lower(word || b1 || b2) END,
  CASE WHEN ga1 = ' ' AND gap = ' ' THEN lower(a1 || word || b1) END], lambda e: e IS NOT NULL) AS e FROM single WHERE word = low AND length(word) >= 2 AND NOT (length(word) = 2 AND NOT regexp_matches(word, '[aiueo]')) AND low NOT IN (SELECT a FROM (VALUES {STD}) s(a, b))),
y AS (SELECT doc_id, pos, unnest(e) AS e FROM x), hit AS (SELECT DISTINCT doc_id, pos FROM y WHERE e IN (SELECT word FROM known))
SELECT doc_id, word AS text, CAST(min(start) AS INTEGER) AS first, count(*) AS n FROM x ANTI JOIN hit USING (doc_id, pos) GROUP BY 1, 2""")
def unknown_words(spark, sf_dir):
    docs, words = _dictionary(spark, sf_dir)
    found = typo.candidates(typo.scan(docs, words).where("kind = 'unknown_word'"), docs)
    return found.select("doc_id", "text", F.element_at("occurrences", 1)["start"].alias("first"), F.size("occurrences").cast("long").alias("n"))


@query(rf"""WITH {FOUND}, s AS (SELECT doc_id, 'grammar' AS c FROM pair WHERE twice UNION ALL SELECT doc_id, 'tidak_baku' FROM single WHERE low IN (SELECT a FROM (VALUES {STD}) s(a, b)))
SELECT doc_id, CAST(0 AS BIGINT) AS ejaan, count(*) FILTER (WHERE c = 'tidak_baku') AS tidak_baku, count(*) FILTER (WHERE c = 'grammar') AS grammar, count(*) AS total FROM s GROUP BY 1""")
def typo_issue_counts(spark, sf_dir):
    """Certain findings of every text behind a page marker, on the page where they stand."""
    docs, words = _dictionary(spark, sf_dir)
    marked = docs.select("doc_id", F.concat(F.lit("[== Halaman 1 ==]"), "text").alias("text"))
    return typo.issue_counts(check_typos(marked, words))


# -- whole runs --------------------------------------------------------------------------------


def report_texts(m: DataFrame) -> DataFrame:
    """(doc_id, text): a report a nation, a page a year, a sentence a month; every third claim is a hundredth too high."""
    names = F.array(*map(F.lit, ("Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember")))
    value = F.translate(F.format_number(F.col("v") / 1000 * F.when((F.col("k") + F.col("mo")) % 3 == 0, 1.01).otherwise(1.0), 4), ",.", ".,")
    said = F.format_string("%s pada %s %d tercatat sebesar Rp%s miliar menurut laporan resmi yang terbit tahun itu.", "label", F.element_at(names, F.col("mo")), "y", value)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"])
    pages = m.groupBy("k", "y").agg(F.array_join(in_order(F.struct("mo", said.alias("t"))), "\n").alias("t"))
    page = F.concat(F.lit("[== Halaman "), (F.col("y") - 1990).cast("string"), F.lit(" ==]\n"), "t")
    return pages.groupBy("k").agg(F.array_join(in_order(F.struct("y", page.alias("t"))), "\n").alias("text")).select(F.col("k").cast("long").alias("doc_id"), "text")


def _sentences(text: str) -> list[dict]:
    import re

    found = re.finditer(r"([A-Z]\w+) pada (\w+) (\d{4}) tercatat sebesar Rp([\d.,]+) miliar", text)
    return [{"operation": "value", "periods": [{"ord": 0, "metric_label": m[1], "year": int(m[3]), "month": m[2], "col_label": None}], "claimed_value_raw": m[4], "unit": "miliar Rp", "anchor_quote": m[0]} for m in found]


def _refusing(*years: int) -> Callable[[str], list[dict]]:
    def call(text: str) -> list[dict]:
        found = _sentences(text)
        if any(f["periods"][0]["year"] in years for f in found):
            raise ValueError("refused")
        return found

    return call


@query(f"""WITH {M}, y AS (SELECT k, y, count(*) AS n, dense_rank() OVER (PARTITION BY k ORDER BY y) - 1 AS c FROM m GROUP BY k, y)
SELECT CAST(k AS BIGINT) AS doc_id, CAST(c AS INTEGER) AS chunk_no, CASE WHEN y = 1995 THEN 0 ELSE n END AS facts, CASE WHEN y = 1995 THEN 2 ELSE 0 END AS errors FROM y""")
def chunked_extraction(spark, sf_dir):
    """A chunk a page; the first extractor refuses 1994 and 1995, the second 1995 only, whose chunks have no facts and both errors."""
    answers = ask_chunks(chunk_texts(report_texts(monthly(spark, sf_dir)), 1), _refusing(1994, 1995), _refusing(1995))
    errors = F.coalesce(F.size(F.split("error", "; ")), F.lit(0))
    return answers.select("doc_id", "chunk_no", F.size("facts").cast("long").alias("facts"), F.when(F.col("error").isNull(), 0).otherwise(errors).alias("errors"))


@query(f"""WITH {M} SELECT CAST(k AS BIGINT) AS doc_id, count(*) FILTER (WHERE (k + mo) % 3 > 0) AS entailed, count(*) FILTER (WHERE (k + mo) % 3 = 0) AS refuted,
CAST(0 AS BIGINT) AS inconclusive, CAST(0 AS BIGINT) AS error, count(*) AS total FROM m GROUP BY k""")
def paired_run_counts(spark, sf_dir):
    """Reports against the sheets of all regions: parsed, extracted, compared and counted in one run. No name lies in another."""
    m = monthly(spark, sf_dir).withColumn("label", F.concat("label", F.lit(" total")))
    return paired_run(report_texts(m), generic_cells(m)).counts


# -- SQL checks, evaluation, streams -----------------------------------------------------------


@query("SELECT 'orders' AS table_name, c AS column_name, v FROM (SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION SELECT 'o_orderpriority', o_orderpriority FROM orders UNION SELECT 'o_orderstatus+o_orderpriority', o_orderstatus || '|' || o_orderpriority FROM orders)")
def distinct_value_hints(spark, sf_dir):
    hints = sqlcheck.distinct_value_hints(read(spark, sf_dir, "orders"), "orders")
    return hints.select("table_name", F.array_join("columns", "+").alias("column_name"), F.explode("vals").alias("x")).select("table_name", "column_name", F.array_join("x", "|").alias("v"))


@query("SELECT * FROM (VALUES (0, true, true), (1, false, true), (2, true, false), (3, true, true), (4, false, false)) t(i, comparison, insufficient)")
def comparison_sufficiency(spark, sf_dir):
    rows = [(0, "Inflasi tertinggi", [["5.47"]]), (1, "Inflasi 5", [[None, None]]), (2, "naik dari 5 ke 6", [["1", "2"]]), (3, "tren", []), (4, "nilai", [["1"], ["2"]])]
    df = spark.createDataFrame(rows, "i int, claim string, r array<array<string>>")
    return df.select("i", sqlcheck.is_comparison(F.col("claim")).alias("comparison"), sqlcheck.insufficient(F.col("r")).alias("insufficient"))


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 5")
def table_browse(spark, sf_dir):
    return sqlcheck.browse(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", 7, 5)


GUARDED = (
    ("SELECT count(*) AS n FROM guarded_nation", False), ("WITH a AS (SELECT n_name FROM guarded_nation) SELECT * FROM a WHERE n_name IN (SELECT n_name FROM a) LIMIT 3", False),
    ("SELECT upper(n_name), sum(n_nationkey) OVER (PARTITION BY n_regionkey) FROM guarded_nation ORDER BY 1", False), ("SELECT 1 UNION ALL SELECT 2", False), ("SELECT reflect('java.lang.System', 'nanoTime')", True),
    ("SELECT java_method('java.lang.System', 'nanoTime') FROM guarded_nation", True), ("SELECT try_reflect('java.lang.System', 'nanoTime')", True), ("SELECT * FROM parquet.`/tmp`", True),
    ("SELECT n_name FROM guarded_nation WHERE n_nationkey IN (SELECT reflect('java.lang.System', 'nanoTime'))", True), ("WITH a AS (SELECT * FROM text.`/etc`) SELECT * FROM a", True), ("DROP VIEW guarded_nation", True), ("SET a=b", True),
    ("CREATE TEMPORARY VIEW v AS SELECT 1", True), ("SELECT * FROM not_there", True), ("SELECT TRANSFORM (n_name) USING 'cat' FROM guarded_nation", True), ("SELECT * FROM read_files('/tmp')", True), ("SELECT * FROM range(5)", True),
    ("SELECT a.id FROM guarded_nation a JOIN guarded_nation b ON a.n_name = b.n_name", True), ("BEGIN SELECT 1; END", True),
)


@query(f"SELECT * FROM {_values([(i, b) for i, (_, b) in enumerate(GUARDED)], 'i, refused')}")
def guarded_sql(spark, sf_dir):
    """Queries, and statements that are none or reach beyond the listed tables; the last join is refused for a column that is not there."""
    read(spark, sf_dir, "nation").createOrReplaceTempView("guarded_nation")
    return spark.createDataFrame([(i, sqlcheck.execute(spark, q)[1] is not None) for i, (q, _) in enumerate(GUARDED)], "i int, refused boolean")


PAIRS = "p AS (SELECT CAST(quality AS VARCHAR) AS expected, CAST(toxic AS VARCHAR) AS predicted FROM labels)"
PRF = f"""WITH {PAIRS}, x AS (SELECT DISTINCT label FROM (SELECT expected AS label FROM p UNION SELECT predicted FROM p)),
s AS (SELECT label, count(*) FILTER (WHERE expected = label AND predicted = label) AS tp, count(*) FILTER (WHERE expected <> label AND predicted = label) AS fp, count(*) FILTER (WHERE expected = label AND predicted <> label) AS fn FROM x, p GROUP BY label),
r AS (SELECT label, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM s),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


def _pairs(spark, sf_dir):
    return read(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("expected"), F.col("toxic").cast("string").alias("predicted"))


@query(f"WITH {PAIRS} SELECT expected, predicted, count(*) AS n FROM p GROUP BY 1, 2")
def eval_confusion(spark, sf_dir):
    return evaluation.confusion(_pairs(spark, sf_dir))


@query(f"{PRF} SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f")
def eval_prf(spark, sf_dir):
    return evaluation.per_label(_pairs(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"{PRF}, a AS (SELECT count(*) AS n, round(avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM p) SELECT n, CAST(accuracy AS DOUBLE) AS accuracy, round((SELECT avg(f1) FROM f), 9) AS macro_f1 FROM a")
def eval_macro_f1(spark, sf_dir):
    return evaluation.overall(_pairs(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("accuracy", "macro_f1")})


E2E = """x AS (SELECT *, n_nationkey % 5 > 0 AS found, CASE WHEN n_nationkey % 3 = 0 THEN 'Refuted' ELSE 'Entailed' END AS e, CASE WHEN n_nationkey % 2 = 0 THEN 'Refuted' ELSE 'Entailed' END AS p FROM nation),
l AS (SELECT l, 2.0 * count(*) FILTER (WHERE e = l AND p = l) / (count(*) FILTER (WHERE e = l) + count(*) FILTER (WHERE p = l)) AS f1 FROM x, (VALUES ('Refuted'), ('Entailed')) t(l) WHERE found GROUP BY l)"""


@query(f"""WITH {E2E} SELECT count(*) AS expected_claims, count(*) FILTER (WHERE found) AS matched, count(*) FILTER (WHERE NOT found) AS missing, count(*) FILTER (WHERE NOT found) AS spurious,
round(CAST(avg(found::INT) AS DOUBLE), 9) AS extraction_recall, round(CAST(avg((e = p)::INT) FILTER (WHERE found) AS DOUBLE), 9) AS verdict_accuracy, round(CAST((SELECT avg(f1) FROM l) AS DOUBLE), 9) AS verdict_macro_f1 FROM x""")
def eval_end_to_end(spark, sf_dir):
    """A case a region, a claim a nation; the results of every fifth nation go by another name."""
    key, verdict = F.col("n_nationkey"), lambda n: F.when(F.col("n_nationkey") % n == 0, "Refuted").otherwise("Entailed")
    n = read(spark, sf_dir, "nation").withColumn("p", F.array(F.struct(F.lit(1995).alias("year"), F.lit("Jan").alias("month"))))
    claims = n.select(F.col("n_regionkey").alias("case_id"), key.alias("claim_ord"), F.lit("value").alias("operation"), F.concat("n_name", F.lit(" total")).alias("metric"), F.col("p").alias("periods"), verdict(3).alias("expected_verdict"))
    name = F.when(key % 5 > 0, F.concat(F.lit("Ekspor "), "n_name", F.lit(" total"))).otherwise("?")
    results = n.select(F.col("n_regionkey").alias("case_id"), key.alias("result_ord"), F.lit("value").alias("operation"), name.alias("metric_label"), F.col("p").alias("result_periods"), verdict(2).alias("verdict"))
    shares = ("extraction_recall", "verdict_accuracy", "verdict_macro_f1")
    return evaluation.end_to_end(claims, results).withColumns({c: F.round(c, 9) for c in shares})


@query("SELECT quality AS q, quality = toxic AS verdict_ok, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 3) * 0.04 <= 0.05 END AS value_ok, count(*) AS n FROM labels GROUP BY 1, 2, 3")
def eval_passed(spark, sf_dir):
    expected = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3) * 0.04)
    rows = read(spark, sf_dir, "labels").select(F.col("quality").alias("q"), F.col("quality").cast("string").alias("expected_verdict"), F.col("toxic").cast("string").alias("verdict"), expected.alias("expected_value"), F.lit(0.0).alias("computed"))
    return evaluation.passed(rows).groupBy("q", "verdict_ok", "value_ok").agg(F.count("*").alias("n"))


def _events(spark, sf_dir) -> tuple[DataFrame, str]:
    """The events as a stream, and a folder for what it gives."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="veriframe-")
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]"), f"{base}/stream-{uuid.uuid4().hex}"


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2")
def stream_events_daily(spark, sf_dir):
    events, path = _events(spark, sf_dir)
    return streams.run_available(streams.daily_events(events), path).withColumn("day", F.col("day").cast("string"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, id""")
def stream_event_sessions(spark, sf_dir):
    events, path = _events(spark, sf_dir)
    return streams.run_available(streams.event_sessions(events), path).select("user_id", "n")


ENTRY = claim_yoy_growth
