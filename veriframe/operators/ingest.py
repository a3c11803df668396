"""Style-aware ingestion of sheets into tidy facts with aggregate rows and columns marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EXCEL_FACTS
from .grids import cell_text

# Words of totals and averages, and the weights and limits of the score.
KEYWORDS = r"(?i)jumlah|grand\s*total|sub\s*-?\s*total|\btotal\b|rata-?rata|rata\s*2|average|\bmean\b"
KEYWORD, STYLE, CONSISTENT, LAST = 0.5, 0.2, 0.6, 0.05
AGGREGATE, DATA = 0.7, 0.3


def numeric() -> Column:
    return F.col("kind").isin("num", "bool")


def column_letters(c: Column) -> Column:
    """Spreadsheet letters of a column number up to 18278."""
    letter = lambda n: F.char(F.lit(65) + n)
    one, two = c - 1, F.floor((c - 27) / 26)
    three = F.floor((c - 703) / 676)
    low, mid = letter(F.pmod(one, F.lit(26))), letter(F.pmod(two, F.lit(26)))
    return F.when(c <= 26, low).when(c <= 702, F.concat(mid, low)).otherwise(F.concat(letter(three), mid, low))


def split_rows(cells: DataFrame) -> DataFrame:
    """(source_ord, r, part): header or data. Leading title rows (one value over half the width) are left out.

    Rows with more than half of their cells text are header until the first other row; all rows from it on are data.
    """
    value = F.coalesce(cell_text(), F.lit(""))
    box = cells.groupBy("source_ord").agg((F.max("c") - F.min("c") + 1).alias("span"))
    rows = cells.groupBy("source_ord", "r").agg(F.count("*").alias("n"), F.count_distinct(value, "kind").alias("k"), F.avg((F.col("kind") == "str").cast("double")).alias("text")).join(box, "source_ord")
    banner = (F.col("n") >= 2) & (F.col("k") == 1) & (F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("span") * 0.5)))
    w = Window.partitionBy("source_ord")
    started = rows.withColumn("first", F.min(F.when(~banner, F.col("r"))).over(w)).where("r >= first")
    return started.withColumn("body", F.min(F.when(F.col("text") <= 0.5, F.col("r"))).over(w)).select("source_ord", "r", F.when(F.coalesce(F.col("r") >= F.col("body"), F.lit(False)), "data").otherwise("header").alias("part"))


def split_columns(data: DataFrame) -> DataFrame:
    """(source_ord, c, role): value if half of the data cells are numeric, else label."""
    return data.groupBy("source_ord", "c").agg(F.avg(numeric().cast("double")).alias("share")).select("source_ord", "c", F.when(F.col("share") >= 0.5, "value").otherwise("label").alias("role"))


def _joined(key: str, sep: str, distinct: bool) -> Column:
    texts = F.transform(F.array_sort(F.collect_list(F.struct(key, F.col("t").alias("t")))), lambda x: x["t"])
    return F.array_join(F.array_distinct(texts) if distinct else texts, sep)


def matches_sum(values: DataFrame, members: DataFrame, by: str, across: str, entry: str = "v_num") -> DataFrame:
    """(source_ord, by, consistent): whether every checkable value is the sum of all others of its line.

    values: the numeric cells of the data block; members (source_ord, by): all rows or columns that take
    part. A line counts only where all of them have numbers; there must be two others.
    """
    n = members.groupBy("source_ord").agg(F.count("*").alias("n"))
    line = Window.partitionBy("source_ord", across)
    full = values.join(n, "source_ord").withColumns({"total": F.sum(entry).over(line), "have": F.count("*").over(line)})
    check = full.where((F.col("have") == F.col("n")) & (F.col("n") >= 3))
    hit = F.abs(F.col("total") - 2 * F.col(entry)) <= F.greatest(F.lit(0.01), F.abs(entry) * 0.005)
    return check.groupBy("source_ord", by).agg(F.bool_and(hit).alias("consistent"))


def score(label: Column, style: Column, consistent: Column, last: Column) -> Column:
    points = F.when(label.rlike(KEYWORDS), KEYWORD).otherwise(0.0) + F.when(style, STYLE).otherwise(0.0) + F.when(consistent, CONSISTENT).otherwise(0.0) + F.when(last, LAST).otherwise(0.0)
    return F.least(F.round(points, 6), F.lit(1.0))


def classify(points: Column) -> Column:
    return F.when(points >= AGGREGATE, "aggregate").when(points < DATA, "not_aggregate").otherwise("ambiguous")


def signals(cells: DataFrame) -> DataFrame:
    """(source_ord, axis, idx, label, consistent, styled, score, class) of every data row and value column."""
    return _layout(cells)[0]


def _layout(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = split_rows(cells)
    here = cells.join(parts, ["source_ord", "r"])
    data = here.where("part = 'data'")
    roles = split_columns(data)
    values = data.join(roles.where("role = 'value'").select("source_ord", "c"), ["source_ord", "c"])
    heads = here.where("part = 'header'").select("source_ord", "c", "r", cell_text().alias("t")).groupBy("source_ord", "c").agg(_joined("r", " > ", True).alias("path"))
    cols = roles.where("role = 'value'").join(heads, ["source_ord", "c"], "left").select("source_ord", "c", F.coalesce("path", column_letters(F.col("c"))).alias("col_label"))
    names = data.join(roles.where("role = 'label'").select("source_ord", "c"), ["source_ord", "c"]).select("source_ord", "r", "c", cell_text().alias("t")).groupBy("source_ord", "r").agg(_joined("c", " - ", False).alias("row_label"))
    rows = data.select("source_ord", "r").distinct().join(names, ["source_ord", "r"], "left").select("source_ord", "r", F.coalesce("row_label", F.lit("")).alias("row_label"))
    style = values.groupBy("source_ord", "r").agg((F.bool_and("is_bold") | F.bool_and("has_top_border") | F.bool_and("has_fill")).alias("styled"))
    numbers = values.where(numeric())
    w = Window.partitionBy("source_ord")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    by_row = rows.join(style, ["source_ord", "r"], "left").join(matches_sum(numbers, rows, "r", "c"), ["source_ord", "r"], "left")
    row_score = score(F.col("row_label"), yes("styled"), yes("consistent"), F.col("r") == F.max("r").over(w))
    by_row = by_row.select("source_ord", F.lit("row").alias("axis"), F.col("r").alias("idx"), F.col("row_label").alias("label"), yes("consistent").alias("consistent"), yes("styled").alias("styled"), row_score.alias("score"))
    by_col = cols.join(matches_sum(numbers, cols, "c", "r"), ["source_ord", "c"], "left")
    col_score = score(F.col("col_label"), F.lit(False), yes("consistent"), F.col("c") == F.max("c").over(w))
    by_col = by_col.select("source_ord", F.lit("column").alias("axis"), F.col("c").alias("idx"), F.col("col_label").alias("label"), yes("consistent").alias("consistent"), F.lit(False).alias("styled"), col_score.alias("score"))
    found = by_row.unionByName(by_col).withColumn("class", classify(F.col("score")))
    tidy = numbers.select("source_ord", "file", "sheet", "r", "c", F.col("v_num").alias("value")).join(rows, ["source_ord", "r"]).join(cols, ["source_ord", "c"])
    return found, tidy


def resolve(found: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """signals with is_aggregate and how it was decided; verdicts (source_ord, axis, idx, is_aggregate) for ambiguous ones."""
    open_ = F.col("class") == "ambiguous"
    if verdicts is None:
        return found.withColumns({"is_aggregate": F.col("class") == "aggregate", "how": F.when(open_, "defaulted").otherwise(F.concat(F.lit("auto_"), "class"))})
    told = found.join(verdicts.select("source_ord", "axis", "idx", F.col("is_aggregate").alias("__v")), ["source_ord", "axis", "idx"], "left")
    return told.withColumns({"is_aggregate": F.when(open_, F.coalesce("__v", F.lit(False))).otherwise(F.col("class") == "aggregate"), "how": F.when(open_, "llm_escalated").otherwise(F.concat(F.lit("auto_"), "class"))}).drop("__v")


def extract_facts(cells: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Tidy facts (EXCEL_FACTS) of all sheets; a value is an aggregate if its row or its column is one."""
    found, tidy = _layout(cells)
    marked = resolve(found, verdicts).where("is_aggregate")
    rows = marked.where("axis = 'row'").select("source_ord", F.col("idx").alias("r"), F.lit(True).alias("ra"))
    cols = marked.where("axis = 'column'").select("source_ord", F.col("idx").alias("c"), F.lit(True).alias("ca"))
    return tidy.join(rows, ["source_ord", "r"], "left").join(cols, ["source_ord", "c"], "left").select(
        F.col("file").alias("source_file"), "sheet", "row_label", "col_label", "value", F.coalesce("ra", "ca", F.lit(False)).alias("is_aggregate"),
        F.concat("sheet", F.lit("!"), column_letters(F.col("c")), F.col("r").cast("string")).alias("source_cell_ref"),
    )


def ingest_summary(cells: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """One row: sheets with data, facts, and how rows and columns were decided."""
    found, tidy = _layout(cells)
    how = resolve(found, verdicts).agg(*[F.count_if(F.col("how") == h).alias(h) for h in ("auto_aggregate", "auto_not_aggregate", "llm_escalated", "defaulted")])
    return how.crossJoin(tidy.agg(F.count_distinct("source_ord").alias("sheets"), F.count("*").alias("facts")))


def write_facts(facts: DataFrame, files: DataFrame, path: str) -> None:
    """Replace the partitions of the ingested files (source_file) in a Parquet table, also of those without facts now."""
    spark = facts.sparkSession
    out = facts.select(*[f.name for f in EXCEL_FACTS])
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(path)
    gone = files.select("source_file").distinct().join(facts.select("source_file").distinct(), "source_file", "left_anti")
    for r in gone.toLocalIterator():  # names of files just ingested that now hold nothing
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r["source_file"])
        store.delete(jvm.org.apache.hadoop.fs.Path(place, f"source_file={escaped}"), True)
