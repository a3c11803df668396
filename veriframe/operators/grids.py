"""Parsing of cell grids into two-axis tables, all sources at once: wide time series, generic, by spec."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import MONTHS, month_abbreviation, month_name, month_number, parse_period
from ..functions.text import strip
from ..staging import drop, staged

#: First possible data column and the label column of wide time series (from 1).
FIRST_DATA, LABEL = 4, 3
HEADER_ROWS, PROBE_ROWS = 20, 6
#: Indents told apart (a sheet knows no more).
INDENTS = 16
SNAPSHOT_ROWS, SNAPSHOT_COLS, SNAPSHOT_TEXT = 20, 30, 40


@dataclass
class Parsed:
    """meta (TABLE_META), rows (TABLE_ROWS) and data (TABLE_DATA) of the sources a parser took.

    parse_tables writes them; close() removes what it wrote, once nothing reads it any more.
    """

    meta: DataFrame
    rows: DataFrame
    data: DataFrame
    written: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        drop(*self.written)
        self.written.clear()


def is_empty() -> Column:
    return (F.col("kind") == "str") & (strip(F.col("v_str")) == "")


def cell_text() -> Column:
    """The text of a cell as a label: whole numbers without a fraction."""
    whole = (F.col("v_num") == F.floor("v_num")) & (F.abs("v_num") < 1e15)
    return F.when(F.col("kind") == "num", F.when(whole, F.col("v_num").cast("long").cast("string")).otherwise(F.col("v_num").cast("string"))).when(F.col("kind") == "date", F.col("v_ts").cast("string")).otherwise(F.col("v_str"))


def first_wins(data: DataFrame) -> DataFrame:
    """The first value of each key in row and column order."""
    key = ["source_ord", "row_label", "year", "month", "col_label"]
    return data.groupBy(*key).agg(F.min_by(F.struct("row_ord", "col_ord", "value"), F.struct("row_ord", "__c")).alias("b")).select(
        "source_ord", "b.row_ord", "row_label", "year", "month", "b.col_ord", "col_label", "b.value"
    )


def _meta(df: DataFrame, cells: DataFrame, parser: str) -> DataFrame:
    names = cells.groupBy("source_ord").agg(F.first("file").alias("file"), F.first("sheet").alias("sheet"))
    return df.join(names, "source_ord").select("source_ord", "file", "sheet", "title", "unit", "axis_type", F.lit(parser).alias("parser"))


def column_periods(cells: DataFrame) -> DataFrame:
    """(source_ord, c, year, month, month_row) of wide time series.

    The year row is the first of ten rows with a number from 1990 to 2100, the next row names months. A year's January
    lies as many month columns before its anchor as the anchor's month says; the leftmost
    anchor of a year counts, and a year owns the month columns up to the next one's January. After the last
    year's December its columns end, so that a repeated section gives no false months.
    """
    numbers = cells.where((F.col("r") <= 10) & F.col("kind").isin("num", "bool") & F.col("v_num").between(1990, 2100))
    head = numbers.groupBy("source_ord").agg(F.min("r").alias("year_row"))
    here = cells.join(head, "source_ord")
    named = here.where((F.col("r") == F.col("year_row") + 1) & (F.col("c") >= FIRST_DATA)).withColumn("month", month_name(F.regexp_replace(strip(F.col("v_str")), r"\*+$", ""))).where("month IS NOT NULL")
    w = Window.partitionBy("source_ord").orderBy("c")
    months = named.select("source_ord", "c", "month", (F.col("year_row") + 1).alias("month_row"), F.row_number().over(w).alias("pos"))
    anchors = here.where((F.col("r") == F.col("year_row")) & F.col("kind").isin("num", "bool") & F.col("v_num").between(1990, 2100)).select("source_ord", "c", F.col("v_num").cast("int").alias("year"))
    january = anchors.join(months, ["source_ord", "c"]).withColumn("pos", F.col("pos") - month_number(F.col("month")) + 1).where("pos >= 1")
    january = january.groupBy("source_ord", "year").agg(F.min_by("pos", "c").alias("pos")).groupBy("source_ord", "pos").agg(F.max("year").alias("year"))
    filled = months.join(january, ["source_ord", "pos"], "left").withColumns({
        "start": F.last(F.when(F.col("year").isNotNull(), F.col("pos")), True).over(w), "year": F.last("year", True).over(w),
    })
    return filled.where(F.col("year").isNotNull() & (F.col("pos") - F.col("start") < 12)).select("source_ord", "c", "year", "month", "month_row")


def qualify_labels(rows: DataFrame) -> DataFrame:
    """rows (source_ord, row_ord, label, indent) with row_label: labels met twice are led by their parent's.

    The parent is the nearest row above with a smaller indent: the latest of the last rows of every smaller indent.
    """
    up = Window.partitionBy("source_ord").orderBy("row_ord").rowsBetween(Window.unboundedPreceding, -1)
    level = F.least(F.col("indent"), F.lit(INDENTS - 1))
    last = [F.last(F.when(level == k, F.struct("row_ord", "label")), True).over(up) for k in range(INDENTS)]
    above = F.slice(F.array(*last), F.lit(1), level)
    parent = F.array_max(F.array_compact(above))["label"]
    many = F.count("*").over(Window.partitionBy("source_ord", "label")) > 1
    return rows.withColumn("row_label", F.when(many & parent.isNotNull(), F.concat(parent, F.lit(" > "), "label")).otherwise(F.col("label")))


def parse_wide(cells: DataFrame) -> Parsed:
    """Wide time series: labels in the third column, periods from two heading rows, title and unit in the first two rows."""
    periods = column_periods(cells)
    top = periods.groupBy("source_ord").agg(F.max("month_row").alias("month_row"))
    body = cells.join(top, "source_ord").where("r > month_row")
    labels = body.where(F.col("c") == LABEL).select("source_ord", "r", "indent", strip(cell_text()).alias("label")).where("label <> ''")
    stop = labels.where(F.col("label").rlike(r"^\d+\)") | (F.length("label") > 120)).groupBy("source_ord").agg(F.min("r").alias("stop"))
    kept = labels.join(stop, "source_ord", "left").where("stop IS NULL OR r < stop").select("source_ord", F.col("r").alias("row_ord"), "label", F.coalesce("indent", F.lit(0)).alias("indent"))
    rows = qualify_labels(kept).select("source_ord", "row_ord", "row_label")
    numbers = body.where(F.col("kind").isin("num", "bool")).select("source_ord", F.col("r").alias("row_ord"), "c", F.col("v_num").alias("value"))
    data = numbers.join(rows, ["source_ord", "row_ord"]).join(periods.drop("month_row"), ["source_ord", "c"]).select(
        "source_ord", "row_ord", "row_label", "year", "month", F.lit(None).cast("int").alias("col_ord"), F.lit(None).cast("string").alias("col_label"), "value", F.col("c").alias("__c")
    )
    first = lambda r: F.max(F.when((F.col("r") == r) & (F.col("c") == 1), strip(cell_text())))
    heads = cells.join(top.select("source_ord"), "source_ord", "left_semi").groupBy("source_ord").agg(
        F.coalesce(first(1), F.lit("")).alias("title"), F.regexp_replace(F.coalesce(first(2), F.lit("")), r"^[()\s]+|[()\s]+$", "").alias("unit")
    ).withColumn("axis_type", F.lit("temporal"))
    return Parsed(_meta(heads, cells, "bi"), rows, first_wins(data))


def header_rows(cells: DataFrame) -> DataFrame:
    """(source_ord, header_row): the first of twenty rows with two filled cells, 80 % text or months, and a number in the six rows below."""
    filled = cells.where(~is_empty())
    period = parse_period(F.col("kind"), F.col("v_str"), F.col("v_ts")).isNotNull()
    heads = filled.where(F.col("r") <= HEADER_ROWS).groupBy("source_ord", "r").agg(F.count("*").alias("n"), F.avg(((F.col("kind") == "str") | period).cast("double")).alias("share")).where("n >= 2 AND share >= 0.8")
    numeric = filled.where("kind = 'num'").select("source_ord", F.col("r").alias("below")).distinct()
    probes = heads.select("source_ord", "r", F.explode(F.sequence(F.col("r") + 1, F.col("r") + PROBE_ROWS)).alias("below"))
    return probes.join(numeric, ["source_ord", "below"]).groupBy("source_ord").agg(F.min("r").alias("header_row"))


def label_columns(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """(source_ord, header_row, label_col): the leftmost column that is 60 % text below the header."""
    below = cells.where(~is_empty()).join(heads, "source_ord").where("r > header_row")
    share = below.groupBy("source_ord", "header_row", "c").agg(F.avg((F.col("kind") == "str").cast("double")).alias("share")).where("share >= 0.6")
    return share.groupBy("source_ord", "header_row").agg(F.min("c").alias("label_col"))


def titles(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """(source_ord, title, unit): of the rows above the header the first bracketed one is the unit, the first other one the title."""
    above = cells.where(~is_empty()).join(heads, "source_ord").where("r < header_row")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", strip(cell_text()).alias("t")))), lambda x: x["t"]), " ")
    lines = above.groupBy("source_ord", "r").agg(text.alias("line")).withColumn("bracketed", F.col("line").rlike(r"(?s)^\(.+\)$"))
    unit_row = F.min(F.when(F.col("bracketed"), F.col("r"))).over(Window.partitionBy("source_ord"))
    lines = lines.withColumn("unit_row", unit_row)
    found = lines.groupBy("source_ord").agg(
        F.min_by(strip(F.regexp_replace("line", r"^\(|\)$", "")), F.when(F.col("r") == F.col("unit_row"), F.col("r"))).alias("unit"),
        F.min_by("line", F.when(F.col("unit_row").isNull() | (F.col("r") != F.col("unit_row")), F.col("r"))).alias("title"),
    )
    return heads.select("source_ord").join(found, "source_ord", "left").select("source_ord", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("unit", F.lit("")).alias("unit"))


def parse_generic(cells: DataFrame) -> Parsed:
    """Tables with one header row: temporal if two headings and 60 % of them are months, else categorical."""
    heads = header_rows(cells)
    spots = label_columns(cells, heads)
    filled = cells.where(~is_empty()).join(spots, "source_ord")
    headings = filled.where("r = header_row AND c > label_col").select("source_ord", "c", strip(cell_text()).alias("name"), parse_period(F.col("kind"), F.col("v_str"), F.col("v_ts")).alias("p"))
    axis = headings.groupBy("source_ord").agg(F.count("p").alias("n"), F.count("*").alias("m")).select("source_ord", F.when((F.col("n") >= 2) & (F.col("n") >= 0.6 * F.col("m")), "temporal").otherwise("categorical").alias("axis_type"))
    keyed = headings.join(axis, "source_ord")
    months = keyed.where("axis_type = 'temporal' AND p IS NOT NULL").select("source_ord", "c", "p.year", "p.month", F.lit(None).cast("int").alias("col_ord"), F.lit(None).cast("string").alias("col_label"))
    firsts = keyed.where("axis_type = 'categorical'").groupBy("source_ord", "name").agg(F.min("c").alias("c"))
    names = firsts.select("source_ord", "c", F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("month"), F.col("c").alias("col_ord"), F.col("name").alias("col_label"))
    labels = filled.where("r > header_row AND c = label_col").select("source_ord", F.col("r").alias("row_ord"), strip(cell_text()).alias("row_label"))
    numbers = filled.where("r > header_row AND kind = 'num'").select("source_ord", F.col("r").alias("row_ord"), "c", F.col("v_num").alias("value"))
    data = first_wins(numbers.join(labels, ["source_ord", "row_ord"]).join(months.unionByName(names), ["source_ord", "c"]).withColumn("__c", F.col("c")))
    rows = data.groupBy("source_ord", "row_label").agg(F.min("row_ord").alias("row_ord")).select("source_ord", "row_ord", "row_label")
    meta = titles(cells, heads).join(axis, "source_ord").join(data.select("source_ord").distinct(), "source_ord", "left_semi")
    return Parsed(_meta(meta, cells, "generic"), rows, data)


def fingerprints(cells: DataFrame) -> DataFrame:
    """(source_ord, fingerprint): SHA-256 of the pattern of numbers, texts and gaps of the top rows, and the width."""
    size = cells.groupBy("source_ord").agg(F.max("r").alias("rows"), F.max("c").alias("cols"))
    mark = F.when(F.col("kind") == "num", "n").when(is_empty(), ".").otherwise("t")
    marks = cells.where((F.col("r") <= SNAPSHOT_ROWS) & (F.col("c") <= SNAPSHOT_COLS)).groupBy("source_ord").agg(F.map_from_entries(F.collect_list(F.struct(F.col("r") * 1000 + F.col("c"), mark))).alias("m"))
    dense = size.join(marks, "source_ord", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<int,string>")))
    width = F.least(F.col("cols"), F.lit(SNAPSHOT_COLS))
    line = lambda r: F.array_join(F.transform(F.sequence(F.lit(1), width), lambda c: F.coalesce(F.try_element_at("m", r * 1000 + c), F.lit("."))), "")
    lines = F.transform(F.sequence(F.lit(1), F.least(F.col("rows"), F.lit(SNAPSHOT_ROWS))), line)
    return dense.select("source_ord", F.sha2(F.concat(F.array_join(lines, "|"), F.lit("#"), F.col("cols").cast("string")), 256).alias("fingerprint"))


def snapshots(cells: DataFrame) -> DataFrame:
    """(source_ord, snapshot): the top rows as text for a mapper, columns counted from 0, long texts cut."""
    text = F.when(F.length(cell_text()) > SNAPSHOT_TEXT, F.concat(F.substring(cell_text(), 1, SNAPSHOT_TEXT), F.lit("…"))).otherwise(cell_text())
    top = cells.where(~is_empty() & (F.col("r") <= SNAPSHOT_ROWS) & (F.col("c") <= SNAPSHOT_COLS)).select("source_ord", "r", "c", F.concat(F.lit("["), (F.col("c") - 1).cast("string"), F.lit("]='"), text, F.lit("'")).alias("t"))
    lines = top.groupBy("source_ord", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "t"))), lambda x: x["t"]), " ").alias("t"))
    line = F.concat(F.lit("row "), (F.col("r") - 1).cast("string"), F.lit(": "), F.col("t"))
    return lines.groupBy("source_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("t")))), lambda x: x["t"]), "\n").alias("snapshot"))


def valid_specs(cells: DataFrame, specs: DataFrame) -> DataFrame:
    """Specs (TABLE_SPECS, with source_ord; rows and columns from 0) that can be right for their source's grid."""
    size = cells.groupBy("source_ord").agg(F.max("r").alias("rows"), F.max("c").alias("cols"))
    col = lambda f: F.forall("columns", f)
    numbers = F.transform("columns", lambda x: x["col"])
    period = lambda x: (F.col("axis_type") == "temporal") & x["year"].between(1990, 2100) & x["month"].isin(*MONTHS)
    named = lambda x: (F.col("axis_type") == "categorical") & (strip(F.coalesce(x["name"], F.lit(""))) != "")
    shape = (
        (F.col("header_row") >= 0) & (F.col("header_row") < F.col("data_start_row")) & (F.col("data_start_row") <= F.col("rows") - 1)
        & (F.col("label_col") >= 0) & (F.col("label_col") < F.col("cols")) & (F.size("columns") > 0) & col(lambda x: (x["col"] >= 0) & (x["col"] < F.col("cols")) & (x["col"] != F.col("label_col")))
        & (F.size(F.array_distinct(numbers)) == F.size("columns")) & col(lambda x: F.when(x["kind"] == "period", period(x)).otherwise(named(x)))
    )
    sound = specs.join(size, "source_ord").where(F.coalesce(shape, F.lit(False)))
    body = cells.where(~is_empty()).join(sound.select("source_ord", "data_start_row", "label_col", numbers.alias("cs")), "source_ord").where("r > data_start_row")
    filled = body.groupBy("source_ord").agg(F.max(F.col("c") == F.col("label_col") + 1).alias("a"), F.max(F.array_contains("cs", F.col("c") - 1) & (F.col("kind") == "num")).alias("b")).where("a AND b")
    return sound.join(filled.select("source_ord"), "source_ord", "left_semi").drop("rows", "cols")


def parse_by_spec(cells: DataFrame, specs: DataFrame) -> Parsed:
    """Tables read as their specs say; invalid specs give nothing."""
    good = valid_specs(cells, specs)
    here = cells.where(~is_empty()).join(good.select("source_ord", "label_col", "data_start_row"), "source_ord").where("r > data_start_row")
    columns = good.select("source_ord", F.posexplode("columns").alias("n", "x")).select(
        "source_ord", (F.col("x.col") + 1).alias("c"), "x.year", "x.month", F.when(F.col("x.kind") != "period", F.col("x.col") + 1).alias("col_ord"), F.when(F.col("x.kind") != "period", strip(F.col("x.name"))).alias("col_label")
    )
    labels = here.where("c = label_col + 1").select("source_ord", F.col("r").alias("row_ord"), strip(cell_text()).alias("row_label"))
    numbers = here.where("kind = 'num'").select("source_ord", F.col("r").alias("row_ord"), "c", F.col("v_num").alias("value"))
    data = first_wins(numbers.join(labels, ["source_ord", "row_ord"]).join(columns, ["source_ord", "c"]).withColumn("__c", F.col("c")))
    rows = data.groupBy("source_ord", "row_label").agg(F.min("row_ord").alias("row_ord")).select("source_ord", "row_ord", "row_label")
    return Parsed(_meta(good.select("source_ord", "title", "unit", "axis_type"), cells, "llm"), rows, data)


def parse_tables(cells: DataFrame, specs: DataFrame | None = None) -> Parsed:
    """Every source by the first parser that gives data for it: wide, generic, spec (TABLE_SPECS by fingerprint).

    Cells are read from their files once and written; so is what each parser finds, and the next one sees only the sources left.
    """
    parsers = [parse_wide, parse_generic]
    if specs is not None:
        parsers.append(lambda left: parse_by_spec(left, fingerprints(left).join(specs, "fingerprint")))
    left = staged(cells, "cells")
    done = [left]
    found: list[Parsed] = []
    for parse in parsers:
        p = parse(left)
        data = staged(p.data, "table-data")
        took = data.select("source_ord").distinct()
        meta, rows = (staged(df.join(took, "source_ord", "left_semi"), tag) for df, tag in ((p.meta, "table-meta"), (p.rows, "table-rows")))
        found.append(Parsed(meta, rows, data))
        done += [data, meta, rows]
        left = left.join(took, "source_ord", "left_anti")
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return Parsed(union([p.meta for p in found]), union([p.rows for p in found]), union([p.data for p in found]), done)


def source_status(cells: DataFrame, parsed: Parsed) -> DataFrame:
    """(source_ord, file, sheet, parser, error) of every source: which parser took it, or why none did."""
    sources = cells.groupBy("source_ord").agg(F.first("file").alias("file"), F.first("sheet").alias("sheet"), F.count_if(F.col("kind") == "num").alias("numbers"), F.count_if(~is_empty()).alias("filled"))
    took = sources.join(parsed.meta.select("source_ord", "parser"), "source_ord", "left")
    why = F.when(F.col("filled") == 0, "the sheet is empty").when(F.col("numbers") == 0, "the sheet holds no numbers").otherwise("no parser found a header, labels and values")
    return took.select("source_ord", "file", "sheet", "parser", F.when(F.col("parser").isNull(), why).alias("error"))


def month_of(ts: Column) -> Column:
    return month_abbreviation(F.month(ts))
