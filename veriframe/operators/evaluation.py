"""Accuracy of verdicts and alignment of expected claims with results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    """(expected, predicted, n) of pairs (expected, predicted)."""
    return pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each expected label with a count column for each predicted one."""
    return pairs.groupBy("expected").pivot("predicted", labels).agg(F.count(F.lit(1))).na.fill(0)


def per_label(pairs: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1); labels only predicted are there too; 0 where undefined."""
    c = confusion(pairs)
    sides = c.select(F.col("expected").alias("label"), F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("expected") != F.col("predicted"), F.col("n")).otherwise(0).alias("fn"))
    other = c.where("expected <> predicted").select(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    t = sides.unionByName(other).groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t = t.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return t.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall(pairs: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro_f1."""
    a = pairs.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("expected") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))
    return a.crossJoin(per_label(pairs).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1")))


def passed(results: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Cases (expected_verdict, verdict, expected_value, computed) with verdict_ok, value_ok and passed."""
    value = F.when(F.col("expected_value").isNotNull(), F.coalesce(F.abs(F.col("computed") - F.col("expected_value")) <= tolerance, F.lit(False)))
    out = results.withColumns({"verdict_ok": F.col("expected_verdict") == F.col("verdict"), "value_ok": value})
    return out.withColumn("passed", F.col("verdict_ok") & F.coalesce("value_ok", F.lit(True)))


def gate(cases: DataFrame, accuracy: float = 1.0) -> None:
    """Raise AssertionError if a case failed or too few verdicts are right."""
    r = cases.agg(F.count_if(~F.col("passed")).alias("failed"), F.avg(F.col("verdict_ok").cast("double")).alias("accuracy")).first()
    if r["failed"] or (r["accuracy"] is not None and r["accuracy"] < accuracy):
        raise AssertionError(f"{r['failed']} cases failed, accuracy {r['accuracy']}")


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def match_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, claim_ord, result_ord): claims in order take the first free result that fits.

    claims (case_id, claim_ord, operation, metric, periods), results (case_id, result_ord, operation, metric_label,
    result_periods); periods are arrays of structs with year and month. A result fits if the operation is the same, it has all
    months of the claim, and one plain name contains the other. The candidates come from an equi join on case and operation;
    the assignment folds over each case's candidates in claim order.
    """
    months = lambda c: F.transform(c, lambda p: F.struct(p["year"].alias("year"), p["month"].alias("month")))
    c = claims.select("case_id", "claim_ord", "operation", _plain(F.col("metric")).alias("e"), months("periods").alias("want"))
    r = results.select("case_id", "result_ord", "operation", _plain(F.col("metric_label")).alias("m"), months("result_periods").alias("have"))
    near = (F.col("e") != "") & (F.col("m") != "") & (F.contains("e", F.col("m")) | F.contains("m", F.col("e")))
    fits = c.join(r, ["case_id", "operation"]).where(near & (F.size("want") > 0) & (F.size(F.array_except("want", "have")) == 0))
    options = fits.groupBy("case_id", "claim_ord").agg(F.array_sort(F.collect_list("result_ord")).alias("options"))
    lists = options.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("claim_ord", "options"))).alias("l"))
    zero = F.array().cast("array<struct<claim_ord:int,result_ord:int>>")

    def step(taken: Column, x: Column) -> Column:
        free = F.array_except(x["options"].cast("array<int>"), F.transform(taken, lambda t: t["result_ord"]))
        pick = F.struct(x["claim_ord"].cast("int").alias("claim_ord"), F.try_element_at(free, F.lit(1)).alias("result_ord"))
        return F.when(F.size(free) > 0, F.array_append(taken, pick)).otherwise(taken)

    return lists.select("case_id", F.inline(F.aggregate("l", zero, step)))


def unmatched(rows: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Missing claims (key claim_ord) or spurious results (key result_ord)."""
    return rows.join(matched.select("case_id", key), ["case_id", key], "left_anti")


def matched_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, claim_ord, result_ord, expected, predicted) of the claims (with expected_verdict) that a result (with verdict) was found for."""
    pairs = match_claims(claims, results).join(claims.select("case_id", "claim_ord", F.col("expected_verdict").alias("expected")), ["case_id", "claim_ord"])
    return pairs.join(results.select("case_id", "result_ord", F.col("verdict").alias("predicted")), ["case_id", "result_ord"]).select("case_id", "claim_ord", "result_ord", "expected", "predicted")


def end_to_end(claims: DataFrame, results: DataFrame) -> DataFrame:
    """One row on a whole run: how many expected claims were found, how many results nobody expected, and the verdicts of those found.

    Recall, accuracy and macro F1 are 0 where there is nothing to divide by. unmatched() lists the missing and the spurious ones.
    """
    pairs = matched_claims(claims, results)
    n = claims.agg(F.count("*").alias("expected_claims")).crossJoin(results.agg(F.count("*").alias("found")))
    verdicts = overall(pairs).select(F.col("n").alias("matched"), F.col("accuracy").alias("verdict_accuracy"), F.col("macro_f1").alias("verdict_macro_f1"))
    return n.crossJoin(verdicts).select(
        "expected_claims", "matched", (F.col("expected_claims") - F.col("matched")).alias("missing"), (F.col("found") - F.col("matched")).alias("spurious"),
        F.coalesce(F.try_divide("matched", "expected_claims"), F.lit(0.0)).alias("extraction_recall"), "verdict_accuracy", "verdict_macro_f1",
    )
