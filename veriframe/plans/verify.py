"""Verification of structured claims against tables, as one declarative plan.

points = facts.posexplode(periods), resolved by fuzzy joins, gathered by (fact, source), the first
source in order that has all points (and a unit factor where one is needed) decides, and the
operation is computed by expressions over the ordered points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units
from ..functions.text import let
from ..operators.lookup import resolve_categorical, resolve_temporal, scoped

TOLERANCE = 0.05
LEVEL_OPS = ("value", "average", "sum", "diff")
TREND_OPS = ("is_increasing", "is_decreasing", "is_stable")
TEMPORAL_ONLY = ("yoy_growth", *TREND_OPS)


@dataclass
class Tables:
    """Parsed tables: meta has a row a source, data a row a cell (schemas TABLE_META, TABLE_DATA).

    With a `scope` column in meta, data and facts, facts only meet the tables of their scope, so the
    claims of many documents are verified in one job.
    """

    meta: DataFrame
    data: DataFrame


def dedup_facts(facts: DataFrame, strict: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """First fact of each (operation, ordered points), by the columns within; strict also tells claimed values apart."""
    key = ["operation", F.transform("periods", lambda p: F.struct(p["metric_label"], p["year"], p["month"], p["col_label"]))]
    key += [*within, "claimed_value"] if strict else within
    keyed = facts.withColumn("__key", F.to_json(F.struct(*[F.col(k).alias(f"k{i}") if isinstance(k, str) else k.alias(f"k{i}") for i, k in enumerate(key)])))
    firsts = keyed.groupBy("__key").agg(F.min("fact_ord").alias("fact_ord"))
    return facts.join(firsts.select("fact_ord"), "fact_ord", "left_semi")


def display_label(periods: Column) -> Column:
    return F.array_join(F.array_distinct(F.transform(periods, lambda p: p["metric_label"])), " / ")


def resolve_points(points: DataFrame, tables: Tables) -> DataFrame:
    """(fact_ord, ord, source_ord, matched_label, matched_col, value) for points with data."""
    points = scoped(points)
    when = points.where("col_label IS NULL").withColumnRenamed("metric_label", "q")
    temporal = resolve_temporal(when, tables.meta, tables.data)
    a = when.join(temporal, ["scope", "q", "year", "month"]).select("fact_ord", "ord", "source_ord", "matched_label", F.lit(None).cast("string").alias("matched_col"), "value")
    what = points.where("col_label IS NOT NULL").withColumnRenamed("metric_label", "q").withColumnRenamed("col_label", "cq")
    b = what.join(resolve_categorical(what, tables.data), ["scope", "q", "cq"]).select("fact_ord", "ord", "source_ord", "matched_label", "matched_col", "value")
    return a.unionByName(b)


def _steps(values: Column, good) -> Column:
    """Whether every value and the one before stand in the relation `good`."""
    pairs = F.arrays_zip(F.slice(values, F.lit(2), F.size(values)), F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))))
    return F.forall(pairs, lambda p: good(p["0"], p["1"]))


def numeric_verdict(claimed: Column, computed: Column) -> tuple[Column, Column]:
    """(delta, verdict): delta to four places, Entailed up to the tolerance."""
    delta = F.round(F.abs(claimed - computed), 4)
    return delta, F.when(delta <= TOLERANCE, "Entailed").when(delta.isNotNull(), "Refuted").otherwise("Inconclusive")


def verify_facts(tables: Tables, facts: DataFrame) -> DataFrame:
    """One row per fact, in fact_ord: what was found, computed and decided.

    A `value` or `ratio` fact with another number of points than one or two is Inconclusive, for
    itself alone. A trend over a single point is Entailed. reason: a code (ok, gate, unit, missing,
    no_source, points, prior_missing, zero). Facts without points are Inconclusive.
    """
    axis = tables.meta.select("source_ord", "axis_type", "unit", F.concat("file", F.lit(" / "), "sheet").alias("source"))
    facts = scoped(facts)
    gated = F.col("operation").isin(*TEMPORAL_ONLY) & F.exists("periods", lambda p: p["col_label"].isNotNull())
    base = facts.withColumns({"gate": F.coalesce(gated, F.lit(False)), "metric_label": display_label(F.col("periods"))})
    points = base.where("NOT gate").select("scope", "fact_ord", F.explode("periods").alias("p")).select("scope", "fact_ord", "p.*")
    resolved = resolve_points(points, tables).join(axis, "source_ord")
    per_source = resolved.groupBy("fact_ord", "source_ord").agg(
        F.array_sort(F.collect_list(F.struct("ord", "matched_label", "matched_col", "value"))).alias("found"),
        F.first("axis_type").alias("axis_type"), F.first("unit").alias("table_unit"), F.first("source").alias("source"),
    )
    claims = base.where("NOT gate").select("fact_ord", "operation", "unit", F.size("periods").alias("n_points"))
    tried = per_source.join(claims, "fact_ord").withColumn("missing", F.col("n_points") - F.size("found"))
    col_unit = F.try_element_at(F.filter(F.transform("found", lambda p: units.column_unit(p["matched_col"])), lambda u: u.isNotNull()), F.lit(1))
    tried = tried.withColumn("source_unit", F.when(F.col("axis_type") == "categorical", F.coalesce(col_unit, F.col("table_unit"))).otherwise(F.col("table_unit")))
    unstated = (F.col("axis_type") == "categorical") & (F.coalesce("source_unit", F.lit("")) == "")
    needs = F.col("operation").isin(*LEVEL_OPS)
    factor = F.coalesce(units.factor(F.col("unit"), F.col("source_unit")), F.when(unstated, units.scale_only(F.col("unit"))))
    tried = tried.withColumn("factor", F.when(needs, factor).otherwise(F.lit(1.0)))
    whole = F.col("missing") == 0
    ok = whole & F.col("factor").isNotNull()
    picked = tried.groupBy("fact_ord").agg(
        F.min_by(F.struct("source_ord", "source", "found", "factor", "table_unit"), F.when(ok, F.col("source_ord"))).alias("s"),
        F.max(whole & ~ok).alias("bad_unit"),
    )
    own = ["scope", "fact_ord", "operation", "claimed_value", "unit", "context_quote", "page_number", "periods", "gate", "metric_label"]
    out = base.select(*own).join(picked, "fact_ord", "left").select(*own, "bad_unit", "s.source_ord", "s.source", "s.found", "s.factor")
    out = _with_prior(out, tables)
    return _judged(out)


def _with_prior(out: DataFrame, tables: Tables) -> DataFrame:
    """The value a year before, by a fuzzy lookup of the matched label in the chosen source."""
    point, first = F.element_at("periods", 1), F.element_at("found", 1)
    asks = out.where("operation = 'yoy_growth' AND source_ord IS NOT NULL").select(
        "scope", "fact_ord", "source_ord", first["matched_label"].alias("q"), (point["year"] - 1).alias("year"), point["month"].alias("month")
    )
    prior = asks.join(resolve_temporal(asks, tables.meta, tables.data), ["scope", "q", "year", "month", "source_ord"]).select(
        "fact_ord", F.col("matched_label").alias("prior_label"), F.col("value").alias("prior")
    )
    return out.join(prior, "fact_ord", "left")


def _judged(out: DataFrame) -> DataFrame:
    op, n = F.col("operation"), F.size("periods")
    found = F.col("source_ord").isNotNull()
    raw = F.transform("found", lambda p: p["value"])
    first, last = F.element_at(raw, 1), F.element_at(raw, -1)
    level = F.transform(raw, lambda v: v / F.col("factor"))
    total = F.aggregate(level, F.lit(0.0), lambda a, v: a + v)
    percent = F.contains(F.lower(F.coalesce("unit", F.lit(""))), F.lit("persen"))
    ratio = F.when(n == 2, F.try_divide(F.try_element_at(raw, F.lit(1)), F.nullif(F.try_element_at(raw, F.lit(2)), F.lit(0.0))) * F.when(percent, 100.0).otherwise(1.0))
    growth = F.try_divide(first - F.col("prior"), F.nullif(F.abs("prior"), F.lit(0.0))) * 100
    value = F.when(n == 1, F.element_at(level, 1))
    computed = F.round(
        F.when(op == "value", value).when(op == "yoy_growth", growth).when(op == "average", F.try_divide(total, n)).when(op == "sum", total)
        .when(op == "diff", F.element_at(level, -1) - F.element_at(level, 1)).when(op == "ratio", ratio),
        4,
    )
    trend = (
        F.when(op == "is_increasing", _steps(raw, lambda b, a: b >= a)).when(op == "is_decreasing", _steps(raw, lambda b, a: b <= a))
        .when(op == "is_stable", _steps(raw, lambda b, a: F.abs(b - a) <= TOLERANCE))
    )
    is_trend = op.isin(*TREND_OPS)
    rows = out.withColumns({"computed": F.when(found & ~is_trend, computed), "holds": F.when(found & is_trend, trend)})
    delta, verdict = numeric_verdict(F.col("claimed_value"), F.col("computed"))
    reason = (
        F.when(F.col("gate"), "gate").when(~found & F.coalesce("bad_unit", F.lit(False)), "unit").when(~found & (n > 0), "missing").when(~found, "no_source")
        .when((op == "value") & (n != 1) | (op == "ratio") & (n != 2), "points").when((op == "yoy_growth") & F.col("prior").isNull(), "prior_missing")
        .when(op.isin("yoy_growth", "ratio") & F.col("computed").isNull(), "zero").otherwise("ok")
    )
    shown = F.when(op.isin(*LEVEL_OPS), level).otherwise(raw)
    period = lambda p, i: F.struct(
        F.col("found")[i]["matched_label"].alias("metric_label"), p["year"].alias("year"), p["month"].alias("month"),
        F.when(op != "ratio", p["col_label"]).alias("col_label"), F.round(shown[i], 4).alias("excel_value"),
    )
    before = F.struct(
        F.col("prior_label").alias("metric_label"), (F.element_at("periods", 1)["year"] - 1).alias("year"), F.element_at("periods", 1)["month"].alias("month"),
        F.lit(None).cast("string").alias("col_label"), F.round("prior", 4).alias("excel_value"),
    )
    periods = F.when(found, F.when((op == "yoy_growth") & F.col("prior").isNotNull() & (F.col("prior") != 0), F.array(period(F.element_at("periods", 1), F.lit(0)), before)).otherwise(F.transform("periods", period)))
    unit = F.when(op == "yoy_growth", F.when(found, "persen_yoy").otherwise(F.col("unit"))).otherwise(F.col("unit"))
    judged = rows.select(
        "fact_ord", "operation", "metric_label", F.when(found, F.col("source_ord")).alias("source_ord"), F.col("source").alias("matched_source"),
        periods.alias("result_periods"), F.when(~(found & is_trend), F.col("claimed_value")).alias("claimed_value"), unit.alias("claimed_unit"), "computed",
        F.when(F.col("computed").isNotNull(), delta).alias("delta"),
        F.when(is_trend & found, F.when(F.col("holds"), "Entailed").otherwise("Refuted")).when(F.col("computed").isNotNull(), verdict).otherwise("Inconclusive").alias("verdict"),
        reason.alias("reason"), "context_quote", "page_number",
    )
    return judged.withColumn("reasoning", reasoning())


def reasoning() -> Column:
    """A sentence on how a result came about, from its columns."""
    op, source = F.col("operation"), F.coalesce("matched_source", F.lit("?"))
    number = lambda c: F.format_string("%.4f", c)
    held = F.when(F.col("verdict") == "Entailed", "holds").otherwise("does not hold")
    values = F.array_join(F.transform("result_periods", lambda p: number(p["excel_value"])), ", ")
    trend = F.when(F.size("result_periods") < 2, F.concat(F.lit("a single point shows no change in "), source)).otherwise(F.concat(op, F.lit(" "), held, F.lit(" for "), values, F.lit(" in "), source))
    side = F.when(F.col("verdict") == "Entailed", "within").otherwise("over")
    compared = F.concat(
        F.lit("claimed "), number(F.col("claimed_value")), F.lit(", computed "), number(F.col("computed")), F.lit(" from "), source,
        F.lit(": a difference of "), number(F.col("delta")), F.lit(", "), side, F.lit(f" the tolerance of {TOLERANCE}"),
    )
    said = {
        "gate": F.concat(op, F.lit(" needs months, but a point names a column")), "unit": F.lit("no source with all points has a unit that the claimed one converts to"),
        "missing": F.lit("no source holds all points"), "no_source": F.lit("the claim has no points"), "points": F.concat(op, F.lit(" has the wrong number of points")),
        "prior_missing": F.concat(F.lit("the value of the year before is missing in "), source), "zero": F.concat(F.lit("the value to divide by is zero in "), source),
    }
    codes = F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)])
    plain = F.when(op.isin(*TREND_OPS), trend).otherwise(F.coalesce(compared, F.lit("no claimed value to compare")))
    return F.when(F.col("reason") == "ok", plain).otherwise(F.try_element_at(codes, F.col("reason")))


def missing_points(tables: Tables, facts: DataFrame) -> DataFrame:
    """(fact_ord, source_ord, missing): the shortest list of points without data, for diagnostics; ties: first source."""
    points = scoped(facts).select("scope", "fact_ord", F.explode("periods").alias("p")).select("scope", "fact_ord", "p.*")
    have = resolve_points(points, tables).select("fact_ord", "ord", "source_ord")
    # Sources without any of a fact's points lack them all: the first source stands for those.
    touched = have.select("fact_ord", "source_ord").distinct()
    first = scoped(tables.meta).groupBy("scope").agg(F.min("source_ord").alias("source_ord"))
    untouched = points.select("scope", "fact_ord").distinct().join(touched.select("fact_ord").distinct(), "fact_ord", "left_anti").join(first, "scope").select("fact_ord", "source_ord")
    lists = touched.unionByName(untouched).join(points.drop("scope"), "fact_ord").join(have, ["fact_ord", "ord", "source_ord"], "left_anti")
    short = lists.groupBy("fact_ord", "source_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "metric_label", "year", "month", "col_label"))).alias("missing"))
    return short.groupBy("fact_ord").agg(F.min_by(F.struct("source_ord", "missing"), F.struct(F.size("missing").alias("n"), "source_ord")).alias("m")).select("fact_ord", "m.*")


def verdict_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Number of results by verdict: one row, or one for each value of the keys."""
    return results.groupBy(*keys).agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("Entailed", "Refuted", "Inconclusive", "Error")], F.count("*").alias("total"))


# Families of tables and the words of metrics that point to them, specific ones first.
FAMILIES = (
    ("Uang Primer / M0 (SEKI Tabel 1.2)", ("m0", "uang primer", "uang kartal yang diedarkan", "uyd", "giro bank umum")),
    ("Posisi Simpanan Masyarakat / DPK (mis. TABEL1_19 — SEKI Tabel 1.19)", ("dpk", "dana pihak ketiga", "deposito", "tabungan masyarakat")),
    (
        "Posisi Kredit Bank Umum & BPR (SEKI Tabel 1.5 dst — KMK/KI/KK per jenis penggunaan)",
        ("kredit", "kmk", "kredit modal kerja", "kredit investasi", "kredit konsumsi", "kepemilikan rumah", "kendaraan bermotor", "multiguna", "debitur"),
    ),
)


def table_suggestions(results: DataFrame) -> DataFrame:
    """(family, first_ord, metrics): tables that would hold the metrics no source had, in order of first sight."""
    low = F.lower("metric_label")
    family = F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)) for name, words in FAMILIES])
    lost = results.where("verdict = 'Inconclusive' AND matched_source IS NULL").select("fact_ord", "metric_label", family.alias("family")).where("family IS NOT NULL")
    firsts = lost.groupBy("family", "metric_label").agg(F.min("fact_ord").alias("fact_ord"))
    ordered = F.array_sort(F.collect_list(F.struct("fact_ord", "metric_label")))
    return firsts.groupBy("family").agg(F.min("fact_ord").alias("first_ord"), F.transform(ordered, lambda x: x["metric_label"]).alias("metrics"))
