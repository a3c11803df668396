"""Operator 4: WARC writing, normalising of monolithic gzip files, sidecar offset index."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shared_dir, stage, table

#: Payloads from this size on are recorded once; equal ones revisit that record.
DEDUP_BYTES = 1000
#: An archive is closed once it holds so many bytes of records.
ARCHIVE_BYTES = 64 << 20
_CHUNK = 1 << 20
_END = b"\r\n\r\n"


def _clean(value: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC record. Revisits have no block; digest and length of the full payload stay in headers."""
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    else:
        head.append("Content-Type: text/html")
    block = b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _END + block + _END


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in raw.decode("utf-8").split("\r\n")[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, raw record) of a gzip file of one or many members, inflated once as a stream."""
    inflate, data = zlib.decompressobj(31), bytearray()
    ended = False
    head: tuple[dict[str, str], int] | None = None
    while True:
        if head is None and (cut := data.find(_END)) >= 0:
            got = _headers(bytes(data[:cut]))
            head = got, cut + 4 + int(got["content-length"]) + 4
        if head is not None and len(data) >= head[1]:
            yield head[0], bytes(data[: head[1]])
            del data[: head[1]]
            head = None
            continue
        if ended:
            if data:
                raise ValueError("the archive ends inside a record")
            return
        chunk = source.read(_CHUNK)
        if not chunk:
            ended = True
            if not inflate.eof:
                data += inflate.flush()
            continue
        while chunk:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            data += inflate.decompress(chunk)
            chunk = inflate.unused_data


def normalise(store: fs.FileSystem, mono: str, target: str) -> tuple[str, str, int]:
    """Rewrite a whole-file gzip WARC with one member per record; write the offset index beside it.

    Memory is bounded by one chunk and one record. Index: a JSON line for each record.
    """
    index, n, at = f"{target}.idx", 0, 0
    with store.open_input_stream(mono, compression=None) as source, store.open_output_stream(target, compression=None) as out, store.open_output_stream(index, compression=None) as side:
        for headers, raw in read_records(source):
            member = gzip.compress(raw, 4, mtime=0)
            out.write(member)
            line = {"id": headers["warc-record-id"], "type": headers["warc-type"], "offset": at, "length": len(member)}
            side.write((json.dumps(line) + "\n").encode())
            at += len(member)
            n += 1
    return target, index, n


def _write_archives(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        mono = out = deflate = None
        done: list[tuple[str, str, int]] = []
        size = 0

        def close():
            nonlocal out
            out.write(deflate.flush())
            out.close()
            out = None
            done.append(normalise(store, mono, mono.removesuffix(".mono")))
            store.delete_file(mono)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    # Names are new for every attempt of a task; only committed ones are listed.
                    mono, size = f"{root}/{uuid.uuid4().hex}.warc.gz.mono", 0
                    out, deflate = store.open_output_stream(mono, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                raw = record_bytes(row["page_id"], row["url"], payload, row["digest"], row["winner"], row["winner"] is not None)
                out.write(deflate.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"archive": [d[0] for d in done], "index": [d[1] for d in done], "records": pa.array([d[2] for d in done], pa.int64())})

    return run


def write_archives(pages: DataFrame, to: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) as record-compressed WARC files with indexes; list the files.

    Null html is an empty payload. Among payloads of DEDUP_BYTES or more that are equal, the one
    with the largest page_id is the response, others revisit it; repeated rows of that page_id are
    all responses, and rows without an id revisit it. Other columns are not read. An empty table
    gives no archive. Each task first writes a monolithic gzip stream and then normalises it.
    """
    base = to or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    twice = (
        hashed.where(F.col("size") >= DEDUP_BYTES)
        .groupBy("digest")
        .agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    revisit = F.when((F.col("size") >= DEDUP_BYTES) & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    rows = hashed.join(twice, "digest", "left").select("page_id", "url", "html", "digest", revisit.alias("winner"))
    return stage(rows.mapInArrow(_write_archives(base), "archive string, index string, records long"), "warc-list").withColumn("base", F.lit(base))


def _read_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(name: str):
        name = name.removeprefix("<urn:page:").removesuffix(">")
        return None if name == "null" else int(name)

    for batch in batches:
        for row in batch.to_pylist():
            store, _ = fs.FileSystem.from_uri(row["base"])
            with store.open_input_stream(row["index"], compression=None) as f:
                entries = [json.loads(x) for x in f.read().splitlines()]
            out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
            with store.open_input_file(row["archive"]) as f:
                for e in entries:
                    f.seek(e["offset"])
                    raw = gzip.decompress(f.read(e["length"]))
                    cut = raw.index(_END)
                    h = _headers(raw[:cut])
                    payload = raw[cut + 4 : cut + 4 + int(h["content-length"])]
                    seen = e["type"] == "response"
                    out["page_id"].append(number(h["warc-record-id"]))
                    out["payload_bytes"].append(len(payload) if seen else int(h["x-payload-length"]))
                    out["payload_digest"].append(hashlib.sha1(payload).hexdigest() if seen else h["warc-payload-digest"].removeprefix("sha1:"))
                    out["record_type"].append(e["type"])
                    out["refers_to"].append(None if seen else number(h["warc-refers-to"]))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})


def read_archives(files: DataFrame) -> DataFrame:
    """The records of listed archives, each found through the index and inflated by itself."""
    spread = files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 2), "archive")
    return spread.mapInArrow(
        _read_archives,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages")))


ORACLE_OP4 = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n
  FROM pages),
w AS (SELECT d, max(page_id) AS winner FROM p WHERE n >= {DEDUP_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= {DEDUP_BYTES} AND winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {DEDUP_BYTES} AND winner <> page_id THEN winner END AS refers_to
FROM p LEFT JOIN w ON p.d = w.d
"""
