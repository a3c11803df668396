"""Line, page and chunk operators over report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import month_name
from ..functions.text import expand_sentence, indonesian_number, let, locate_anchor, normalise_ws, scan_array, strip, tokens

MARKER = r"\[== Halaman (\d+) ==\]"
MAX_CHUNK = 6000
# Month abbreviations in tabular rows, title pattern of appendix pages.
MONTH_TOKENS = ("jan", "feb", "mar", "apr", "mei", "may", "jun", "jul", "ags", "agu", "aug", "sep", "okt", "oct", "nov", "des", "dec")
APPENDIX = r"(?i)^(Lampiran|Tabel\s+[IVX]+\.)"
CELL = r"^\(?-?[\d.,]+%?\)?$"


def trailing_numeric_run(line: Column) -> Column:
    """Number of numeric cells in a row at the end of a line."""
    def run(t: Column) -> Column:
        last_word = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))), F.lit(0), lambda a, i: F.when(F.try_element_at(t, i).rlike(CELL), a).otherwise(i))
        return F.when(F.size(t) == 0, 0).otherwise(F.size(t) - last_word)

    return let(tokens(line), run)


def is_tabular(line: Column) -> Column:
    """A table row: led by a pipe, with a gap of four blanks, mostly numbers and months, or three numbers at its end."""
    s = strip(line)

    def by_tokens(t: Column) -> Column:
        dense = F.size(F.filter(t, lambda w: w.rlike(r"^-?[\d.,]+%?$") | F.lower(w).isin(*MONTH_TOKENS)))
        return (F.size(t) >= 8) & (dense / F.greatest(F.size(t), F.lit(1)) >= 0.65)

    return s.startswith("|") | s.rlike(r"\S {4,}\S") | let(tokens(s), by_tokens) | (trailing_numeric_run(s) >= 3)


def classify_line(line: Column) -> Column:
    """skip below six tokens, table if over 55 % of them are numbers, else narrative."""
    def of(t: Column) -> Column:
        numeric = F.size(F.filter(t, lambda w: w.rlike(r"^[\d.,%()\-]+$")))
        return F.when(F.size(t) < 6, "skip").when(numeric / F.size(t) > 0.55, "table").otherwise("narrative")

    return let(tokens(line), of)


def explode_lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages without their text, with line_no (from 0) and line; columns of those names are replaced."""
    return pages.select(*[c for c in pages.columns if c not in (text, "line", "line_no")], F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line_no", "line"))


def strip_tabular(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines without tabular ones, runs of blank lines among the rest cut to one; keys name a text."""
    kept = lines.where(~is_tabular(F.col("line")))
    blank = strip(F.col("line")) == ""
    before = F.lag(blank).over(Window.partitionBy(*keys).orderBy("line_no"))
    return kept.withColumn("__skip", blank & F.coalesce(before, F.lit(False))).where("NOT __skip").drop("__skip")


def split_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_no, page_no, text): page-marked text cut at its markers; page_no null before the first."""
    blocks = docs.select(key, F.posexplode(F.split(text, r"(?=\[== Halaman \d+ ==\])")).alias("block_no", "block"))
    page = F.regexp_extract("block", "^" + MARKER, 1)
    return blocks.where(strip(F.col("block")) != "").select(key, "block_no", F.nullif(page, F.lit("")).cast("int").alias("page_no"), F.regexp_replace("block", "^" + MARKER, "").alias("text"))


def join_pages(pages: DataFrame, key: str = "doc_id", order: str = "page_no") -> DataFrame:
    """(key, text): non-blank pages behind their markers, two line ends between them."""
    marked = pages.where(strip(F.col("text")) != "").select(key, order, F.concat(F.coalesce(F.concat(F.lit("[== Halaman "), F.col("page_no").cast("string"), F.lit(" ==]\n")), F.lit("")), F.col("text")).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "t"))), lambda x: x["t"])
    return marked.groupBy(key).agg(F.array_join(parts, "\n\n").alias("text"))


def filter_narrative(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "block_no", "page_no")) -> DataFrame:
    """(keys…, line_no, line): narrative lines of pages worth reading.

    Appendix pages (first line of three tokens or more has an appendix title), pages with 70 % or more table
    lines and pages without narrative go. Starred lines stay only if they read as narrative and hold a digit.
    """
    keys = tuple(k for k in keys if k in pages.columns)
    stars = F.regexp_replace("line", r"^\*+\s*", "")
    starred = F.col("line").startswith("*")
    lines = explode_lines(pages.select(*keys, "text")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    kind = F.when(starred, F.when((classify_line(stars) == "narrative") & stars.rlike(r"\d"), "narrative").otherwise("skip")).otherwise(classify_line(F.col("line")))
    lines = lines.withColumns({"kind": kind, "long": F.size(tokens(F.col("line"))) >= 3})
    page = Window.partitionBy(*[F.coalesce(F.col(k), F.lit(-1)) for k in keys])
    title = F.min(F.when(F.col("long"), F.struct("line_no", "line"))).over(page)["line"]
    n, t = F.count_if(F.col("kind") == "narrative").over(page), F.count_if(F.col("kind") == "table").over(page)
    kept = lines.withColumns({"__title": title, "__n": n, "__t": t})
    return kept.where((F.col("kind") == "narrative") & ~F.coalesce(F.col("__title").rlike(APPENDIX), F.lit(False)) & (F.col("__t") < 0.7 * (F.col("__n") + F.col("__t")))).select(*keys, "line_no", "line")


def narrative_text(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the kept lines again as page-marked text."""
    per_page = lines.groupBy(key, "block_no", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("t"))
    marked = F.concat_ws("\n", F.when(F.col("page_no").isNotNull(), F.concat(F.lit("[== Halaman "), F.col("page_no").cast("string"), F.lit(" ==]"))), "t")
    return per_page.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", marked.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def chunk_pages(blocks: DataFrame, key: str = "doc_id", order: str = "block_no", max_chars: int = MAX_CHUNK) -> DataFrame:
    """(key, order, chunk_no): blocks of a text packed in order; a chunk is closed when the next block would not fit.

    Sizes alone are folded, an array of numbers a document; a block over the limit is a chunk by itself.
    """
    sizes = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("int").alias("o"), F.coalesce(F.length("text"), F.lit(0)).alias("n")))).alias("b"))
    zero = F.struct(F.lit(0).alias("used"), F.lit(-1).alias("chunk"))

    def step(a: Column, b: Column) -> Column:
        new = (a["chunk"] < 0) | (a["used"] + b["n"] > max_chars)
        return F.struct(F.when(new, b["n"]).otherwise(a["used"] + b["n"]).alias("used"), F.when(new, a["chunk"] + 1).otherwise(a["chunk"]).alias("chunk"))

    chunks = scan_array(F.col("b"), zero, step, lambda a: a["chunk"], "int")
    placed = sizes.withColumn("c", chunks).select(key, F.inline(F.arrays_zip("b", "c")))
    return placed.select(key, F.col("b.o").alias(order), F.col("c").alias("chunk_no"))


def finalise_facts(raw: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Facts from raw extractions (RAW_FACTS with a key column) and texts (key, text).

    Months are normalised; a month and year beat a column name; facts with an unusable period, without
    points, or with a missing or unreadable value go, but trends need none. Page and sentence come from the
    place of the anchor quote in the text; where it is not found the anchor itself is the quote.
    """
    trend = F.col("operation").isin("is_increasing", "is_decreasing", "is_stable")
    point = lambda p: let(month_name(p["month"]), lambda m: let(
        F.nullif(strip(F.coalesce(p["col_label"], F.lit(""))), F.lit("")),
        lambda c: F.when(p["year"].isNotNull() & m.isNotNull(), F.struct(p["ord"].alias("ord"), p["metric_label"].alias("metric_label"), p["year"].alias("year"), m.alias("month"), F.lit(None).cast("string").alias("col_label")))
        .when(c.isNotNull(), F.struct(p["ord"].alias("ord"), p["metric_label"].alias("metric_label"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("month"), c.alias("col_label"))),
    ))
    usable = raw.withColumn("periods", F.transform("periods", point)).where((F.size("periods") > 0) & F.forall("periods", lambda p: p.isNotNull()))
    valued = usable.withColumn("claimed_value", F.when(~trend, indonesian_number(F.col("claimed_value_raw")))).where(trend | F.col("claimed_value").isNotNull())
    placed = valued.join(texts.select(key, normalise_ws(F.col("text")).alias("__text")), key, "left").withColumn("__at", locate_anchor(F.col("anchor_quote"), F.col("__text")))
    at, text = F.col("__at"), F.col("__text")
    page = F.try_element_at(F.regexp_extract_all(F.substring(text, F.lit(1), at["start"] - 1), F.lit(MARKER), F.lit(1)), F.lit(-1)).cast("int")
    quote = F.coalesce(expand_sentence(text, at["start"], at["length"]), F.col("anchor_quote"))
    return placed.select(key, "fact_ord", "operation", "claimed_value", "unit", quote.alias("context_quote"), page.alias("page_number"), "periods")


def renumber_markers(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_no, text) for docs (key, text, page_nums): the k-th marker is the k-th expected page.

    Where the numbers of markers and pages differ, all text goes to the first page and the rest are empty.
    """
    body = F.filter(F.split("text", MARKER.replace("(", "").replace(")", "")), lambda _: F.lit(True))
    parts = docs.select(key, "page_nums", "text", F.slice(body, 2, F.greatest(F.size(body), F.lit(1))).alias("parts"))
    fits = F.size("parts") == F.size("page_nums")
    plain = F.regexp_replace("text", MARKER + r"\s*", "")
    rows = F.when(fits, F.arrays_zip("page_nums", "parts")).otherwise(F.transform("page_nums", lambda p, i: F.struct(p.alias("page_nums"), F.when(i == 0, plain).otherwise("").alias("parts"))))
    return parts.select(key, F.inline(rows)).select(key, F.col("page_nums").alias("page_no"), strip(F.col("parts")).alias("text"))


def narrative_or_fallback(pages: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, text): text-layer pages without tabular lines, or the fallback's pages.

    A document falls back if it has fewer than 200 characters or less than half of its pages hold text.
    """
    full = strip(F.col("text")) != ""
    weak = pages.groupBy("doc_id").agg(F.sum(F.length(strip(F.col("text")))).alias("chars"), F.avg(full.cast("double")).alias("share")).where("chars < 200 OR share < 0.5").select("doc_id")
    lines = strip_tabular(explode_lines(pages.join(weak, "doc_id", "left_anti").select("doc_id", "page_no", "text")), ["doc_id", "page_no"])
    good = lines.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    if fallback is None:
        return good
    return good.unionByName(fallback.join(weak, "doc_id", "left_semi").select("doc_id", "page_no", "text"))
