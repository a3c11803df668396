"""Operator 9: quality classifier by importance resampling over hashed n-gram models."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import only, remember, stage, table

#: Words and runs of other marks; n-grams of tokens and of their shapes are hashed into BUCKETS.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BUCKETS = 1 << 15
#: Labelled rows of either class that take part in fitting (a documented bound).
SAMPLE = 10_000
_CACHE: dict[str, tuple[int, int]] = {}
_CACHE_LIMIT = 400_000
remember("quality", _CACHE)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _shape(token: str) -> str:
    if token.isalpha():
        return "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"
    return "9" if token.isdigit() else token[:4]


def _codes(token: str) -> tuple[int, int]:
    got = _CACHE.get(token)
    if got is None:
        if len(_CACHE) >= _CACHE_LIMIT:
            _CACHE.clear()
        got = _CACHE[token] = (
            xxhash.xxh64_intdigest(token.lower().encode("utf-8", "replace")),
            xxhash.xxh64_intdigest(_shape(token).encode("utf-8", "replace"), 7),
        )
    return got


def features(text: str | None) -> np.ndarray:
    """Bucket of every n-gram of the whole text: words, shape pairs, shape triples, repeats."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64)
    codes = np.array([_codes(t) for t in tokens], np.uint64)
    word, shape = codes[:, 0], codes[:, 1]
    pair = shape[:-1] * _M1 + shape[1:] * _M2
    triple = pair[:-1] * _M2 + shape[2:] * _M3
    again = (word[:-1] == word[1:]).astype(np.uint64) + np.uint64(2)
    mixed = np.concatenate([word, pair, triple, again * _M3])
    mixed ^= mixed >> np.uint64(29)
    mixed *= _M1
    return (mixed >> np.uint64(49)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("quality")
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, quality in zip(batch.column("text").to_pylist(), batch.column("__quality").to_pylist()):
            counts = np.bincount(features(text), minlength=BUCKETS)
            raw += counts
            if quality == 1:
                target += counts
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "raw": raw[some], "target": target[some]})


def _log_ratio(weights: np.ndarray, text: str | None) -> tuple[float, int]:
    f = features(text)
    return float(weights[f].sum()), len(f)


class Model:
    """Log ratio of target to raw probability by bucket, and the mean ratio below which text is rejected."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold

    def accepts(self, total: float, n: int) -> bool:
        """Documents without any n-gram are kept: there is no evidence against them."""
        return n == 0 or total / n >= self.threshold


def _sample(labels: DataFrame, per_class: int) -> DataFrame:
    """At most per_class labelled ids of either class, chosen by hash: a bounded table."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("__quality"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    return known.where("__quality = 1").orderBy(*order).limit(per_class).unionByName(known.where("__quality = 0").orderBy(*order).limit(per_class))


def best_threshold(ratios: np.ndarray, good: np.ndarray, keep: float = 20.0) -> float:
    """The cut of least error when rejecting a good text weighs `keep` times keeping a bad one."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(ratios)
    r, g = ratios[order], good[order]
    cost = np.concatenate([[0], np.cumsum(np.where(g, keep, -1.0))])
    at = len(cost) - 1 - int(np.argmin(cost[::-1]))
    if at == 0:
        return -np.inf
    return float(r[-1] + 1e-9 if at == len(r) else (r[at - 1] + r[at]) / 2)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model:
    """Raw model over all documents, target model over sampled rows of quality 1.

    One scan counts hashed n-grams (at most BUCKETS rows a task are shuffled and BUCKETS reach the
    driver); a second one rates the sampled labelled rows to place the threshold. Without
    labels, or with one class only, nothing is rejected.
    """
    picked = F.broadcast(_sample(labels, per_class))
    rows = docs.select("doc_id", "text").join(picked, "doc_id", "left").select("text", "__quality")
    counts = rows.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    # The target's counts are few where the corpus is large: smooth it towards the raw model.
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    weights = np.log((target + 50 * p_raw) / (target.sum() + 50) / p_raw)
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_log_ratio(weights, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"q": batch.column("__quality"), "m": [s / n if n else 0.0 for s, n in got]})

    # One row an id, so that the rows that come to the driver are as many as the sample, however often an id is repeated.
    once = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "__quality").agg(F.min("text").alias("text"))
    rated = once.select("text", "__quality").mapInArrow(rate, "q int, m double").collect()
    return Model(weights, best_threshold(np.array([r["m"] for r in rated]), np.array([r["q"] == 1 for r in rated], bool)))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model accepts, all columns as they are; no shuffle.

    Null, empty and blank texts hold no n-gram and are kept. Texts are rated whole. Equal texts share their fate; an empty table
    gives an empty one. Only text is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.accepts(*_log_ratio(model.weights, t)) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def rate(docs: DataFrame, model: Model, seed: int = 0) -> DataFrame:
    """doc_id, n_features, log_weight (sum of log ratios), mean_ratio, accepted, gumbel of every row; one scan, no shuffle.

    gumbel is Gumbel noise made of a hash of the doc_id, or of the text where there is none. Null, empty and
    blank texts have no n-grams, weigh 0 and are accepted. Texts are rated whole. Repeated rows are rated alike; an empty table gives
    an empty result. Only doc_id and text are read.
    """

    def noise(doc_id: int | None, text: str | None) -> float:
        h = xxhash.xxh64_intdigest(f"{doc_id}", seed) if doc_id is not None else xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace"), seed + 1)
        return -np.log(-np.log(((h >> 11) + 0.5) / 2**53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("quality")
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            got = [_log_ratio(model.weights, t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_features": pa.array([n for _, n in got], pa.int64()),
                "log_weight": pa.array([s for s, _ in got], pa.float64()),
                "mean_ratio": pa.array([s / n if n else 0.0 for s, n in got], pa.float64()),
                "accepted": pa.array([model.accepts(s, n) for s, n in got], pa.bool_()),
                "gumbel": pa.array([noise(i, t) for i, t in zip(ids, texts)], pa.float64()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_features long, log_weight double, mean_ratio double, accepted boolean, gumbel double"
    )


def kth_largest(rows: DataFrame, key: str, k: int, bins: int = 1024, rounds: int = 6) -> float:
    """The k-th largest value of a double column (to 1e-18 of its range), by repeated histograms.

    Each round moves at most `bins` counts to the driver; no sort and no single-task limit.
    """
    lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k >= n:
        return -np.inf
    rank = k
    for _ in range(rounds):
        if not hi > lo:
            break
        width = (hi - lo) / bins
        at = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in rows.where(F.col(key).between(lo, hi)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            got, lo_b, hi_b = counts[b]
            if rank <= got:
                lo, hi = lo_b, hi_b
                break
            rank -= got
    return float(lo)


def resample(rated: DataFrame, fraction: float = 0.5, scale: float = 1.0) -> DataFrame:
    """Gumbel top-k: rows whose log importance plus Gumbel noise is among the `fraction` largest.

    Equals sampling without replacement in proportion to the weights. The weight of a document is
    its mean log ratio times `scale` times the square root of its n-grams, so that long documents do not decide alone.
    Rows of one key, which repeated rows are, are sampled together: all rows of the k-th key are in, even if
    that makes more than k. An empty table gives an empty result; other columns are carried along.
    """
    weight = F.col("mean_ratio") * F.sqrt(F.col("n_features").cast("double")) * F.lit(scale)
    keyed = rated.withColumn("gumbel_key", weight + F.col("gumbel")).drop("gumbel")
    k = int(np.ceil(keyed.count() * fraction))
    return keyed.withColumn("sampled", F.col("gumbel_key") >= F.lit(kth_largest(keyed, "gumbel_key", k)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return resample(stage(rate(docs, model), "quality"))
