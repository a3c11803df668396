"""Operator 5: byte-level BPE by folding ranked merges in Spark higher-order functions."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, only, remember, stage, table

#: Words of the table that workers hold: the most frequent ones of the corpus, at most so many.
TABLE_WORDS = 400_000
#: Other words that a worker remembers.
TAIL_WORDS = 200_000
_NONE = 1 << 40
#: Longer matches are merged by a heap: the fold's time grows with the square of the length.
FOLD_BYTES = 256
_BUCKETS = 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# -- the fold ----------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rank_table(ranks: dict[bytes, int]) -> Column:
    """A literal: small maps from piece (hex) to rank, dealt into an array by the piece's CRC-32."""
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        buckets[zlib.crc32(name.encode()) % _BUCKETS][name] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def encode_match(word: Column, ranks: Column) -> Column:
    """Ids of one match of the pattern: a match that is a piece is its rank; others are folded.

    The state holds the pieces and the rank of every adjacent pair (null: no merge). A step merges
    the leftmost pair of least rank and looks up the two pairs that it touches.
    """

    def rank(piece: Column) -> Column:
        at = F.pmod(F.crc32(piece.cast("binary")), F.lit(_BUCKETS)).cast("int") + 1
        return F.try_element_at(F.element_at(ranks, at), piece)

    def merge(s: Column, at: Column) -> Column:
        p, r = s["p"], s["r"]
        n = F.size(p)

        def with_new(new: Column) -> Column:
            left = F.when(at > 1, F.array(rank(F.concat(F.element_at(p, at - 1), new)))).otherwise(F.array().cast("array<int>"))
            right = F.when(at + 2 <= n, F.array(rank(F.concat(new, F.element_at(p, at + 2))))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(new), F.slice(p, at + 2, n)).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, n)).alias("r"),
            )

        return _let(F.concat(F.element_at(p, at), F.element_at(p, at + 1)), with_new)

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s["r"]), lambda low: F.when(low.isNull(), s).otherwise(_let(F.array_position(s["r"], low).cast("int"), lambda at: merge(s, at))))

    def fold(p: Column) -> Column:
        pairs = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: rank(F.concat(F.element_at(p, i), F.element_at(p, i + 1))))).otherwise(F.array().cast("array<int>"))
        steps = F.when(F.size(p) > 1, F.sequence(F.lit(2), F.size(p))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.struct(p.alias("p"), pairs.alias("r")), step, lambda s: F.transform(s["p"], rank))

    data = F.hex(word.cast("binary"))
    split = F.transform(F.sequence(F.lit(0), F.octet_length(word) - 1), lambda i: F.substring(data, i * 2 + 1, F.lit(2)))
    return _let(rank(data), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(_let(split, fold)))


def encode_matches(words: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of an array of matches, one after another; the literal table stands once in the plan."""
    return _let(rank_table(ranks), lambda t: F.flatten(F.transform(words, lambda w: encode_match(w, t))))


# -- whole texts -------------------------------------------------------------------------------

#: White space as the tokenizer library sees it (the Unicode property of that name).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def plain_pattern(pattern: str) -> str:
    """The pattern with its classes of white space written out, outside of and inside brackets."""
    return pattern.replace("[^\\s", f"[^{_WS}").replace("\\s", f"[{_WS}]").replace("\\S", f"[^{_WS}]")


def merge(match: bytes, ranks: dict[bytes, int]) -> bytes:
    """Ids (little-endian) of one match, merged with a heap of adjacent pairs: n log n steps however long it is."""
    if match in ranks:
        return np.array([ranks[match]], "<u4").tobytes()
    parts: list[bytes] = [match[i : i + 1] for i in range(len(match))]
    n = len(parts)
    if n <= FOLD_BYTES:
        at = [ranks.get(match[i : i + 2], _NONE) for i in range(n - 1)]
        while at:
            low = min(at)
            if low == _NONE:
                break
            i = at.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del at[i]
            if i < len(at):
                at[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
            if i:
                at[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        return array("I", [ranks[p] for p in parts]).tobytes()
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, len(parts[i]), len(parts[j])))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, size, behind = heapq.heappop(heap)
        j = after[i]
        if alive[i] and j < n and len(parts[i]) == size and len(parts[j]) == behind:
            parts[i] += parts[j]
            alive[j], after[i] = False, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
    return array("I", [ranks[parts[i]] for i in range(n) if alive[i]]).tobytes()


_SPACES = regex.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: What plain splitting on blanks and line ends does not treat alike: runs of them, other white space.
_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_WIDE = regex.compile(f"[{_WS}--\\x00-\\xff]", regex.V1)


def is_plain(text: str) -> bool:
    """Whether white space is single blanks and line ends between marks; told by quick tests."""
    if text.endswith((" ", "\n")) or any(m in text for m in _ODD):
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _WIDE.search(text)


def units(text: str) -> list[str]:
    """The text cut before every white space that follows another mark.

    No match of the pattern goes on over such a cut and none looks across it, so the matches of a
    text are those of its units, one after another.
    """
    if not is_plain(text):
        return _SPACES.findall(text)
    out: list[str] = []
    for i, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        if i or first:
            out.append("\n" + first if i else first)
        out += [" " + w for w in rest]
    return out


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, n): counts of a part of the corpus, handed on before they outgrow the task."""

    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"unit": pa.array(list(c.keys()), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            counts.update(units(text.as_py() or ""))
            if len(counts) > 500_000:
                yield out(counts)
                counts = Counter()
    yield out(counts)


def frequent_units(docs: DataFrame, most: int = TABLE_WORDS) -> DataFrame:
    """(unit, n): the corpus's units by count, down to the least count at which at most `most` remain."""
    counts = docs.select("text").mapInArrow(_count_units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stage(counts, "units")
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = {r["b"]: r["k"] for r in counts.groupBy(level.alias("b")).agg(F.count("*").alias("k")).collect()}
    total, least = 0, 1 << 30
    for b in sorted(levels, reverse=True):
        total += levels[b]
        if total > most:
            break
        least = b
    return counts.where(level >= least)


def _short(match: str) -> bool:
    return len(match) <= FOLD_BYTES // 4 or len(match.encode()) <= FOLD_BYTES


class Table:
    """Unit -> id bytes of the frequent units, pieces by id, and ranks; made once in a worker process that asks."""

    _known: dict[str, dict[str, bytes]] = {}
    _pieces: dict[str, list[bytes]] = {}

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], rows: pa.Table):
        ids = rows.column("ids").combine_chunks()
        flat = ids.flatten().cast(pa.int32())
        sizes = np.diff(np.asarray(ids.offsets)) if len(ids) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
        code = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.asarray(flat).astype("<u4"))])
        packed = pa.table({"unit": rows.column("unit"), "ids": code})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, packed.schema) as w:
            w.write_table(packed)
        self.name = uuid.uuid4().hex
        self.data = spark.sparkContext.broadcast((sink.getvalue().to_pybytes(), ranks))

    def known(self) -> dict[str, bytes]:
        """Unit -> id bytes."""
        if self.name not in Table._known:
            Table._known.clear()
            found: dict[str, bytes] = {}
            for batch in pa.ipc.open_stream(self.data.value[0]):
                for at in range(0, len(batch), 65536):
                    part = batch.slice(at, 65536)
                    found.update(zip(part.column("unit").to_pylist(), part.column("ids").to_pylist()))
            Table._known[self.name] = found
        return Table._known[self.name]

    def ranks(self) -> dict[bytes, int]:
        return self.data.value[1]

    def pieces(self) -> list[bytes]:
        """Pieces by id; what decodes needs no more of the table."""
        if self.name not in Table._pieces:
            Table._pieces.clear()
            pieces = [b""] * (max(self.ranks().values(), default=-1) + 1)
            for piece, rank in self.ranks().items():
                pieces[rank] = piece
            Table._pieces[self.name] = pieces
        return Table._pieces[self.name]


class Encoder:
    """Ids of whole texts: frequent units from the table, the long tail merged by the same ranks and remembered."""

    def __init__(self, words: Table, pattern: str):
        self.words, self.pattern, self.tail = words, pattern, None

    def __getstate__(self):
        return {"words": self.words, "pattern": self.pattern, "tail": None}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.tail is None:
            self.tail, self.find = {}, regex.compile(self.pattern).findall
        parts = units(text)
        got = list(map(self.words.known().get, parts))
        if None in got:
            tail, ranks = self.tail, self.words.ranks()
            if len(tail) > TAIL_WORDS:
                tail.clear()
            for i in [i for i, code in enumerate(got) if code is None]:
                unit = parts[i]
                code = tail.get(unit)
                if code is None:
                    code = tail[unit] = b"".join([merge(m.encode(), ranks) for m in self.find(unit)])
                got[i] = code
        return b"".join(got)

    def decode(self, ids: bytes) -> bytes:
        """The pieces of the ids, one after another."""
        return b"".join(map(self.words.pieces().__getitem__, array("I", ids)))


_ENCODERS: dict[str, Encoder] = {}
remember("bpe", _ENCODERS, Table._known, Table._pieces)


def _worker(encoder: Encoder) -> Encoder:
    """The encoder of this table in this worker process, with what it remembers."""
    only("bpe")
    if encoder.words.name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[encoder.words.name] = encoder
    return _ENCODERS[encoder.words.name]


def make_encoder(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = TABLE_WORDS) -> Encoder:
    """An encoder for the corpus docs.

    The merges of its frequent units, at most `most` whatever its size, are folded in the JVM over
    distinct units; the table of their ids goes to the workers by broadcast. The other units, a few
    hundredths of a text, are merged by the workers, as are matches of over FOLD_BYTES bytes: a fold costs some 50
    microseconds a word, and the tail's words would have to be folded anew for every document.
    """
    pattern = plain_pattern(pattern)

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for batch in batches:
            rows = [(u, found) for u in batch.column("unit").to_pylist() if all(map(_short, found := find(u)))]
            yield pa.RecordBatch.from_pydict({"unit": pa.array([u for u, _ in rows], pa.string()), "m": pa.array([m for _, m in rows], pa.list_(pa.string()))})

    spark = docs.sparkSession
    units_of = frequent_units(docs, most).select("unit").repartition(spark.sparkContext.defaultParallelism * 2)
    coded = units_of.mapInArrow(matches, "unit string, m array<string>").select("unit", encode_matches(F.col("m"), ranks).alias("ids"))
    return Encoder(Table(spark, ranks, coded.toArrow()), pattern)


def encode_texts(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """(doc_id, ids) of every row; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _worker(encoder)
        for batch in batches:
            ids = [array("I", e.encode(t.as_py() or "")).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, most: int = TABLE_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: whole texts encoded, the ids decoded.

    Null and empty texts have no ids. Repeated rows are encoded alike; an empty table gives an empty
    result. Only doc_id and text are read.
    """
    bounded_batches(docs.sparkSession, 4)
    encoder = make_encoder(docs, ranks, pattern, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _worker(encoder)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                ids = e.encode(text.as_py() or "")
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()))
            n, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
