"""Evaluation cases from YAML, reports as JSON, progress as JSON lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.evaluation import passed
from ..plans.verify import Tables, verify_facts


def load_cases(paths: Iterable[str | Path]) -> list[dict]:
    """Cases of YAML files; an id that occurs twice is an error."""
    import yaml

    cases, seen = [], set()
    for p in paths:
        for case in yaml.safe_load(Path(p).read_text(encoding="utf-8")) or []:
            if case["id"] in seen:
                raise ValueError(f"case {case['id']} occurs twice")
            seen.add(case["id"])
            cases.append(case)
    return cases


def cases_to_frames(spark: SparkSession, cases: list[dict]) -> tuple[Tables, DataFrame, DataFrame]:
    """(tables, facts, expected): every case in a scope of its own, so all are judged in one job."""
    meta, data, facts, expected = [], [], [], []
    for i, c in enumerate(cases):
        t, f, e = c["table"], c["fact"], c["expected"]
        meta.append((i, t.get("filename", "case"), t.get("sheet", ""), t.get("title", ""), t.get("unit", ""), "temporal", "bi", i))
        labels = list(dict.fromkeys(r["label"] for r in t["data"]))
        data += [(i, labels.index(r["label"]), r["label"], r["year"], r["month"], None, None, float(r["value"]), i) for r in t["data"]]
        points = [(k, p["metric_label"], p.get("year"), p.get("month"), p.get("col_label")) for k, p in enumerate(f["periods"])]
        value = f.get("claimed_value")
        facts.append((i, f["operation"], None if value is None else float(value), f.get("unit"), f.get("context_quote", ""), None, points, i))
        expected.append((i, c["id"], e["verdict"], None if e.get("computed_value") is None else float(e["computed_value"])))
    scoped = lambda s: s.__class__(list(s.fields)).add("scope", "long")
    tables = Tables(spark.createDataFrame(meta, scoped(schemas.TABLE_META)), spark.createDataFrame(data, scoped(schemas.TABLE_DATA)))
    return tables, spark.createDataFrame(facts, scoped(schemas.FACTS)), spark.createDataFrame(expected, "fact_ord long, case_id string, expected_verdict string, expected_value double")


def run_cases(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """One row a case with expected and found verdict and value, and whether it passed."""
    tables, facts, expected = cases_to_frames(spark, cases)
    return passed(expected.join(verify_facts(tables, facts).select("fact_ord", "verdict", "computed", "reason"), "fact_ord"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def ndjson(stages: Iterable[tuple[str, Callable[[], object]]]) -> Iterator[str]:
    """JSON lines of a run: a line before and after each stage, then one result (of the last stage) or error."""
    result: object = None
    try:
        for name, work in stages:
            yield json.dumps({"type": "stage", "stage": name, "status": "start"}) + "\n"
            result = work()
            yield json.dumps({"type": "stage", "stage": name, "status": "done"}) + "\n"
        rows = [r.asDict(True) for r in result.toLocalIterator()] if isinstance(result, DataFrame) else result
        yield json.dumps({"type": "result", "data": rows}, default=str) + "\n"
    except Exception as e:
        yield json.dumps({"type": "error", "detail": str(e).split("\n")[0]}) + "\n"


def label_context(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """(source_ord, context): a source's title and its row labels in order, as text for an extractor."""
    labels = rows.groupBy("source_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "row_label"))), lambda x: F.concat(F.lit("- "), x["row_label"])), "\n").alias("l"))
    return meta.join(labels, "source_ord").select("source_ord", F.concat_ws("\n", "title", "l").alias("context"))
