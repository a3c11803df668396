"""Relational schemas of the engine. Order is data: every ordered list has an *_ord column."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


I, L, D, S, B = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()

#: One spreadsheet cell; kind is str, num, bool or date.
CELLS = _s(
    ("source_ord", I), ("file", S), ("sheet", S), ("r", I), ("c", I), ("kind", S), ("v_str", S), ("v_num", D), ("v_ts", T.TimestampNTZType()),
    ("is_bold", B), ("has_fill", B), ("has_top_border", B), ("indent", I),
)
TABLE_META = _s(("source_ord", I), ("file", S), ("sheet", S), ("title", S), ("unit", S), ("axis_type", S), ("parser", S))
TABLE_ROWS = _s(("source_ord", I), ("row_ord", I), ("row_label", S))
#: year and month are null on a categorical axis, col_ord and col_label on a temporal one.
TABLE_DATA = _s(("source_ord", I), ("row_ord", I), ("row_label", S), ("year", I), ("month", S), ("col_ord", I), ("col_label", S), ("value", D))
POINT = _s(("ord", I), ("metric_label", S), ("year", I), ("month", S), ("col_label", S))
FACTS = _s(
    ("fact_ord", L), ("operation", S), ("claimed_value", D), ("unit", S), ("context_quote", S), ("page_number", I), ("periods", T.ArrayType(POINT)),
)
#: What an extractor hands over; values are still text, parsed by code.
RAW_FACTS = _s(("fact_ord", L), ("operation", S), ("periods", T.ArrayType(POINT)), ("claimed_value_raw", S), ("unit", S), ("anchor_quote", S))
EXCEL_FACTS = _s(("source_file", S), ("sheet", S), ("row_label", S), ("col_label", S), ("value", D), ("is_aggregate", B), ("source_cell_ref", S))
#: Table layout found by a mapper: columns hold kind (period or attribute) and its key.
TABLE_SPECS = _s(
    ("fingerprint", S), ("header_row", I), ("label_col", I), ("data_start_row", I), ("axis_type", S), ("title", S), ("unit", S),
    ("columns", T.ArrayType(_s(("col", I), ("kind", S), ("year", I), ("month", S), ("name", S)))),
)
DOC_PAGES = _s(("doc_id", L), ("page_no", I), ("text", S))

OPERATIONS = ("value", "yoy_growth", "average", "sum", "diff", "ratio", "is_increasing", "is_decreasing", "is_stable")
VERDICTS = ("Entailed", "Refuted", "Inconclusive")
