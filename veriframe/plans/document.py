"""A report and its workbooks from files to verdicts, with rule-based extraction as the default."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grids, narrative, typo
from ..staging import drop, staged
from .verify import Tables, dedup_facts, table_suggestions, verdict_counts, verify_facts

MONTH = r"(Januari|Februari|Maret|April|Mei|Juni|Juli|Agustus|September|Oktober|November|Desember)\s+(\d{4})"
LEVEL = rf"([A-Z][\w ()]+?) pada {MONTH} (?:tercatat |sebesar |mencapai )+Rp([\d.,]+) (triliun|miliar)"
GROWTH = rf"([A-Z][\w ()]+?) pada {MONTH} tumbuh (?:sebesar )?([\d.,]+)% \(yoy\)"


def extract_by_rules(texts: DataFrame) -> DataFrame:
    """Raw facts (RAW_FACTS with doc_id) of two fixed phrases: a level in rupiah, a growth (yoy)."""

    def found(pattern: str, operation: str, unit) -> DataFrame:
        quotes = texts.select("doc_id", F.explode(F.regexp_extract_all(F.regexp_replace("text", r"\s+", " "), F.lit(pattern), F.lit(0))).alias("anchor_quote"))
        g = lambda i: F.regexp_extract("anchor_quote", pattern, i)
        point = F.struct(F.lit(0).alias("ord"), g(1).alias("metric_label"), g(3).cast("int").alias("year"), g(2).alias("month"), F.lit(None).cast("string").alias("col_label"))
        return quotes.select("doc_id", F.lit(operation).alias("operation"), F.array(point).alias("periods"), g(4).alias("claimed_value_raw"), unit(g).alias("unit"), "anchor_quote")

    both = found(LEVEL, "value", lambda g: F.concat(g(5), F.lit(" Rp"))).unionByName(found(GROWTH, "yoy_growth", lambda g: F.lit("persen_yoy")))
    # A number that does not depend on how rows are dealt to tasks.
    return both.withColumn("fact_ord", F.xxhash64("doc_id", "operation", "anchor_quote")).dropDuplicates(["fact_ord"])


#: Gives the raw facts of a text: dicts with operation, periods, claimed_value_raw, unit and anchor_quote.
Extractor = Callable[[str], list[dict]]
_POINT = pa.struct([("ord", pa.int32()), ("metric_label", pa.string()), ("year", pa.int32()), ("month", pa.string()), ("col_label", pa.string())])
_FACT = pa.struct([("operation", pa.string()), ("periods", pa.list_(_POINT)), ("claimed_value_raw", pa.string()), ("unit", pa.string()), ("anchor_quote", pa.string())])
_ANSWER = (
    "doc_id long, chunk_no int, error string, facts array<struct<operation string, periods array<struct<ord int, metric_label string, year int, month string,"
    " col_label string>>, claimed_value_raw string, unit string, anchor_quote string>>"
)


def chunk_texts(texts: DataFrame, max_chars: int = narrative.MAX_CHUNK) -> DataFrame:
    """(doc_id, chunk_no, text): page-marked texts cut between pages into parts of up to max_chars characters of page text."""
    blocks = narrative.split_pages(texts)
    marker = F.when(F.col("page_no").isNull(), "").otherwise(F.concat(F.lit("[== Halaman "), F.col("page_no").cast("string"), F.lit(" ==]")))
    part = F.struct("block_no", F.concat(marker, F.col("text")).alias("t"))
    placed = blocks.join(narrative.chunk_pages(blocks, max_chars=max_chars), ["doc_id", "block_no"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "")
    return placed.groupBy("doc_id", "chunk_no").agg(joined.alias("text"))


def ask_chunks(chunks: DataFrame, first: Extractor, second: Extractor | None = None) -> DataFrame:
    """(doc_id, chunk_no, error, facts): every chunk is handed to first, and to second where first raises.

    A chunk that both fail has no facts and the errors of both; the others are not touched by it.
    """
    calls = [c for c in (first, second) if c is not None]

    def ask(text: str) -> tuple[str | None, list[dict]]:
        errors = []
        for call in calls:
            try:
                return None, pa.array([call(text)], pa.list_(_FACT)).to_pylist()[0]
            except Exception as e:
                errors.append(f"{type(e).__name__}: {e}")
        return "; ".join(errors), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors, facts = zip(*map(ask, batch.column("text").to_pylist())) if batch.num_rows else ((), ())
            columns = [batch.column("doc_id"), batch.column("chunk_no"), pa.array(errors, pa.string()), pa.array(facts, pa.list_(_FACT))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk_no", "error", "facts"])

    return chunks.select(F.col("doc_id").cast("long"), F.col("chunk_no").cast("int"), "text").mapInArrow(run, _ANSWER)


def chunk_facts(answers: DataFrame) -> DataFrame:
    """Raw facts (RAW_FACTS with doc_id) of answered chunks, numbered in the order of the text.

    A number holds the doc_id (below 2**31), 20 bits of the chunk and 12 of the fact; what does not fit is an error.
    """
    each = answers.select("doc_id", "chunk_no", F.posexplode("facts").alias("n", "f"))
    fits = F.col("doc_id").between(0, (1 << 31) - 1) & (F.col("chunk_no") < 1 << 20) & (F.col("n") < 1 << 12)
    number = F.shiftleft("doc_id", 32) + F.shiftleft(F.col("chunk_no").cast("long"), 12) + F.col("n")
    return each.select("doc_id", F.when(fits, number).otherwise(F.raise_error(F.lit("too many facts to number"))).alias("fact_ord"), "f.*")


def in_chunks(first: Extractor, second: Extractor | None = None, max_chars: int = narrative.MAX_CHUNK):
    """An extract for verify_reports that asks first, then second, chunk by chunk."""
    return lambda texts: chunk_facts(ask_chunks(chunk_texts(texts, max_chars), first, second))


def verify_reports(pages: DataFrame, tables: Tables, extract=extract_by_rules) -> DataFrame:
    """Results of the claims in page-marked reports (doc_id, text); extract(texts) gives raw facts.

    With a scope column in tables, a report (scope: doc_id) meets its own tables only. A claim that a report repeats counts once.
    The extraction is run once and its facts are written to the shared folder.
    """
    return _verified(_facts(pages, extract), tables)


def _facts(pages: DataFrame, extract) -> DataFrame:
    """Facts with doc_id of page-marked reports, as a written table."""
    texts = narrative.narrative_text(narrative.filter_narrative(narrative.split_pages(pages)))
    return staged(narrative.finalise_facts(extract(texts), texts), "facts")


def _verified(facts: DataFrame, tables: Tables) -> DataFrame:
    if "scope" in tables.meta.columns:
        facts = facts.withColumn("scope", F.col("doc_id"))
    return verify_facts(tables, dedup_facts(facts, within=("doc_id",))).join(facts.select("fact_ord", "doc_id"), "fact_ord")


@dataclass
class PairedRun:
    """What a run over reports and workbooks gives. Tables, facts and results are written to the shared folder; close() removes them.

    sources: parser or error of every sheet; results: a row a claim; counts: verdicts by doc_id, also of reports without claims;
    suggestions: tables that would hold what none did; issues: spelling, None without a dictionary.
    """

    sources: DataFrame
    results: DataFrame
    counts: DataFrame
    suggestions: DataFrame
    issues: DataFrame | None
    written: list[DataFrame] = field(default_factory=list)

    def close(self) -> None:
        drop(*self.written)
        self.written.clear()


def paired_run(
    pages: DataFrame, cells: DataFrame, extract=extract_by_rules, specs: DataFrame | None = None, scopes: DataFrame | None = None,
    dictionary: DataFrame | None = None, typo_verdicts: DataFrame | None = None,
) -> PairedRun:
    """Page-marked reports (doc_id, text) against the sheets of cells (CELLS).

    scopes (source_ord, scope) deals sheets to reports, by doc_id; without it every report meets every sheet. specs are
    layouts by fingerprint for sheets that no parser reads. A sheet that nothing reads has its error in sources and hurts no other.
    """
    parsed = grids.parse_tables(cells, specs)
    meta, data = parsed.meta, parsed.data
    if scopes is not None:
        own = scopes.select("source_ord", F.col("scope").cast("long"))
        meta, data = meta.join(own, "source_ord"), data.join(own, "source_ord")
    facts = _facts(pages, extract)
    results = staged(_verified(facts, Tables(meta, data)), "results")
    counted = pages.select("doc_id").distinct().join(verdict_counts(results, "doc_id"), "doc_id", "left").na.fill(0)
    issues = None if dictionary is None else check_typos(pages, dictionary, typo_verdicts)
    return PairedRun(grids.source_status(parsed.written[0], parsed), results, counted, table_suggestions(results), issues, [*parsed.written, facts, results])


def check_typos(docs: DataFrame, dictionary: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Issues of page-marked texts (doc_id, text); verdicts judge the candidates, without them only certain issues come."""
    clean, spans = typo.strip_markers(docs)
    found = typo.scan(clean, dictionary)
    if verdicts is None:
        verdicts = docs.sparkSession.createDataFrame([], "doc_id long, key string, is_issue boolean, category string, suggestion string")
    return typo.issues(found, typo.candidates(found, clean), verdicts, spans)
