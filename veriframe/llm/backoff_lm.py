"""Operator 10: stupid-backoff scores from n-gram count tables partitioned by hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, stage, table
from .near_dedup import groups_of
from .shingles import mix, word_hashes, words

ALPHA = 0.4
#: Words of a block of documents, the unit in which n-grams are exploded, counted once and looked up.
BLOCK_WORDS = 3 << 19
#: Distinct n-grams (of blocks) that a bucket of the count tables holds on average.
BUCKET_ENTRIES = 1 << 21
_MUL = np.uint64(0x9E3779B97F4A7C15)


def number_words(flat: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(vocabulary by falling count, packed place of every word in it).

    Frequent words get small numbers; the bytes of the numbers are laid out plane by plane and compressed.
    """
    vocabulary, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), "<u4")
    rank[order] = np.arange(len(order), dtype="<u4")
    planes = rank[at].view(np.uint8).reshape(-1, 4).T.tobytes()
    return vocabulary[order], pa.compress(planes, codec="zstd", asbytes=True)


def unpack_numbers(packed: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as words numbered within their block: (block, ids, sizes, vocabulary, numbers)."""

    def out() -> pa.RecordBatch:
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        vocabulary, numbers = number_words(flat)
        seen = xxhash.xxh3_64_intdigest(repr((ids, part)).encode() + numbers) >> 1
        return pa.RecordBatch.from_arrays(
            [pa.array([seen], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(h) for h in hashes]], pa.list_(pa.int32())),
             pa.array([vocabulary.tobytes()], pa.binary()), pa.array([numbers], pa.binary())],
            ["block", "ids", "sizes", "vocabulary", "numbers"],
        )

    ids, hashes, n, part = [], [], 0, 0
    for batch in batches:
        for doc_id, salt, text in zip(batch.column("doc_id").to_pylist(), batch.column("salt").to_pylist(), batch.column("text")):
            if not ids:
                part = salt
            h = word_hashes(words(text.as_py()))
            ids.append(doc_id)
            hashes.append(h)
            n += len(h)
            if n >= BLOCK_WORDS or len(ids) >= BLOCK_WORDS // 16:
                yield out()
                ids, hashes, n = [], [], 0
    if ids:
        yield out()


class Grams:
    """The n-grams of a block: sorted distinct keys of words and of pairs, and where each occurs."""

    def __init__(self, sizes: np.ndarray, vocabulary: np.ndarray, numbers: np.ndarray):
        flat = vocabulary[numbers]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        follows = np.flatnonzero(doc[1:] == doc[:-1]) + 1 if len(doc) else np.zeros(0, np.int64)
        self.doc, self.follows = doc, follows
        keys, at = np.unique(mix(vocabulary + np.uint64(1)), return_inverse=True)
        self.words, self.word_at = keys, at[numbers] if len(numbers) else np.zeros(0, np.int64)
        pair = mix(mix(flat[follows - 1] * _MUL + np.uint64(2)) + flat[follows]) if len(follows) else np.zeros(0, np.uint64)
        self.pairs, self.pair_at = np.unique(pair, return_inverse=True)

    def keys(self) -> np.ndarray:
        return np.concatenate([self.words, self.pairs])

    def counts(self) -> np.ndarray:
        return np.concatenate([np.bincount(self.word_at, minlength=len(self.words)), np.bincount(self.pair_at, minlength=len(self.pairs))])

    def order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys, by bucket; first place of each bucket and the end)."""
        b = bucket_of(self.keys(), buckets)
        order = np.argsort(b, kind="stable")
        return order, np.searchsorted(b[order], np.arange(buckets + 1))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _grams(row: dict) -> Grams:
    sizes = np.array(row["sizes"], np.int64)
    return Grams(sizes, np.frombuffer(row["vocabulary"], np.uint64), unpack_numbers(row["numbers"], int(sizes.sum())))


def _explode(buckets: int):
    """A row for each block and bucket: the block's distinct n-grams there (low 48 bits) and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = _grams(row)
                order, cuts = g.order(buckets)
                low = g.keys()[order].view(np.uint8).reshape(-1, 8)[:, :6]
                counts = g.counts()[order].astype("<u4")
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(np.full(len(some), row["block"]), pa.int64()),
                     pa.array([low[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary()),
                     pa.array([counts[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary())],
                    ["bucket", "block", "keys", "counts"],
                )

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count table of each bucket, joined back to the rows it was made of."""
    for t in groups_of(batches, "bucket"):
        raw = t.column("keys").to_pylist()
        low = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
        keys = np.zeros((len(low), 8), np.uint8)
        keys[:, :6] = low
        counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), "<u4")
        _, at = np.unique(keys.view("<u8").ravel(), return_inverse=True)
        total = np.bincount(at, weights=counts)[at].astype("<u8")
        ends = np.cumsum([len(r) // 6 for r in raw])
        parts = [p.tobytes() for p in np.split(np.minimum(total, 255).astype(np.uint8), ends[:-1])]
        large = [p[p >= 255].tobytes() for p in np.split(total, ends[:-1])]
        yield pa.RecordBatch.from_arrays([t.column("block").combine_chunks(), t.column("bucket").combine_chunks(), pa.array(parts, pa.binary()), pa.array(large, pa.binary())], ["block", "bucket", "small", "large"])


def _widen(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.float64)
    out[out == 255] = np.frombuffer(large, "<u8")
    return out


def score_block(g: Grams, n_docs: int, total: np.ndarray, corpus_words: int, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log10 scores, number of pairs found elsewhere) by document; counts leave out the document itself."""

    def elsewhere(at: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
        _, own, n = np.unique(doc.astype(np.int64) * len(totals) + at, return_inverse=True, return_counts=True)
        return totals[at] - n[own]

    if not len(g.doc):
        return np.zeros(n_docs), np.zeros(n_docs, np.int64)
    word = elsewhere(g.word_at, g.doc, total[: len(g.words)])
    size = np.bincount(g.doc, minlength=n_docs)
    rest = np.maximum(corpus_words - size, 1)[g.doc]
    alone = np.where(word > 0, np.maximum(word, 1) / rest, alpha / rest)
    value = alone.copy()
    f, found = g.follows, np.zeros(len(g.doc), bool)
    if len(f):
        pair = elsewhere(g.pair_at, g.doc[f], total[len(g.words) :])
        found[f] = pair > 0
        value[f] = np.where(pair > 0, np.maximum(pair, 1) / np.maximum(word[f - 1], 1), alpha * alone[f])
    return np.bincount(g.doc, weights=np.log10(value), minlength=n_docs), np.bincount(g.doc, weights=found, minlength=n_docs).astype(np.int64)


def _score(buckets: int, corpus_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, "block"):
            rows = t.to_pylist()
            block = next(r for r in rows if r["bucket"] < 0)
            g = _grams(block)
            order, cuts = g.order(buckets)
            total = np.zeros(len(order))
            for r in rows:
                if r["bucket"] >= 0:
                    total[order[cuts[r["bucket"]] : cuts[r["bucket"] + 1]]] = _widen(r["small"], r["large"])
            logs, found = score_block(g, len(block["ids"]), total, corpus_words)
            n = np.array(block["sizes"], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block["ids"], pa.int64()), pa.array(n), pa.array(found), pa.array(logs), pa.array(logs / np.maximum(n, 1), mask=n == 0)],
                ["doc_id", "n_words", "pairs_found", "log10_score", "mean_log10"],
            )

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, pairs_found, log10_score, mean_log10 of every row by a bigram model of all rows.

    S(w | v) = c(vw) / c(v) where the pair occurs in another row, else ALPHA * c(w) / N, and
    ALPHA / N for words that occur nowhere else; counts leave out the scored row itself, which would
    otherwise vouch for itself. Words are those between white space, with A-Z lower-cased.

    Documents go into blocks of about BLOCK_WORDS words, staged as word numbers. A block's distinct
    n-grams are exploded by hash bucket with their counts, so a frequent n-gram is one entry a
    block; a bucket's count table is made and joined to its entries in one task of bounded size;
    the totals go back to their block, where they are summed by document. There are as many buckets as the words
    ask for, so a bucket does not grow with the table.

    Null, empty and blank texts have no words, score 0 and a null mean. Repeated rows count as rows
    of their own. Only doc_id and text are read. Keys are 48 bits beside the bucket.
    """
    bounded_batches(docs.sparkSession)
    blocks = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("salt"), "text")
    blocks = stage(blocks.mapInArrow(_blocks, "block long, ids array<long>, sizes array<int>, vocabulary binary, numbers binary"), "blocks")
    n = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism * 4, -(-n // BUCKET_ENTRIES))
    entries = blocks.select("block", "sizes", "vocabulary", "numbers").mapInArrow(_explode(buckets), "bucket int, block long, keys binary, counts binary")
    totals = entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_totals, "block long, bucket int, small binary, large binary")
    gone = {c: F.lit(None) for c in ("ids", "sizes", "vocabulary", "numbers")}
    whole = blocks.withColumns({"bucket": F.lit(-1), "small": F.lit(None).cast("binary"), "large": F.lit(None).cast("binary")})
    met = whole.unionByName(totals.withColumns(gone))
    return met.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(
        _score(buckets, n), "doc_id long, n_words long, pairs_found long, log10_score double, mean_log10 double"
    )


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"))
    return scored.withColumns({"log10_score": F.round("log10_score", 4), "mean_log10": F.round("mean_log10", 6)})
