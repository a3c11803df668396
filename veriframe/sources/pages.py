"""Pages of reports: text layers and page images, by callables that know the file format."""

from __future__ import annotations

import io
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pdf_texts(data: bytes) -> list[str]:
    """The text layer of each page of a PDF. Needs the optional package pypdf."""
    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] = pdf_texts) -> DataFrame:
    """(file, page_no, text, error): extract gives the page texts of a file; a failing file gives an error row.

    The default reads PDF files; where its package is missing every file gives an error row that says so.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows += [(name, n, t.replace("\r\n", "\n"), None) for n, t in enumerate(extract(data), 1)]
                except Exception as e:
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["file", "page_no", "text", "error"])

    return files.mapInArrow(run, "file string, page_no int, text string, error string")


def page_counts(pages: DataFrame, key: str = "file") -> DataFrame:
    return pages.groupBy(key).agg(F.count("page_no").alias("pages"))


def transcribe(
    images: DataFrame, call: Callable[[list[bytes]], str], per_call: int = 3, attempts: int = 2, wait: float = 1.0, at_once: int | None = None,
    second: Callable[[list[bytes]], str] | None = None,
) -> DataFrame:
    """(doc_id, page_nums, text, error) of page images (doc_id, page_no, image): per_call pages go to one call.

    A call that raises is made again, up to `attempts` times, after `wait` seconds, twice as many each time; then second is asked the
    same way. Pages that none reads have an empty text and the last error. at_once limits the calls made at a time, over all executors.
    The answers hold page markers; operators.narrative.renumber_markers gives them their page numbers.
    """
    grouped = images.withColumn("__g", F.floor((F.col("page_no") - 1) / per_call)).groupBy("doc_id", "__g").agg(F.array_sort(F.collect_list(F.struct("page_no", "image"))).alias("p"))
    calls = [c for c in (call, second) if c is not None]

    def ask(pages: list[bytes]) -> tuple[str, str | None]:
        error = None
        for c in calls:
            for n in range(attempts):
                try:
                    return c(pages), None
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                    if n + 1 < attempts:
                        time.sleep(wait * 2**n)
        return "", error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column("p").to_pylist()
            nums = [[x["page_no"] for x in p] for p in pages]
            texts, errors = zip(*[ask([x["image"] for x in p]) for p in pages]) if pages else ((), ())
            columns = [batch.column("doc_id"), pa.array(nums, pa.list_(pa.int32())), pa.array(texts, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "page_nums", "text", "error"])

    dealt = grouped.select("doc_id", "p")
    return (dealt if at_once is None else dealt.repartition(at_once)).mapInArrow(run, "doc_id long, page_nums array<int>, text string, error string")
