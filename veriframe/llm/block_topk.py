"""Operator 7: exact top-k by block-at-a-time pruning over integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .vectors import best, grid_topk, usable

#: Rows of a document-range block.
BLOCK_ROWS = 64
#: Below this product of magnitudes float64 sums of integers are exact.
_EXACT = float(1 << 52)


def make_search(k: int, block_rows: int = BLOCK_ROWS):
    def search(qid, q, ids, x):
        out_q, out_v, out_s = [], [], []
        if len(ids) and len(qid):
            big = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
            if big >= _EXACT:  # Python integers: slow, whole
                x, q = (np.array([[int(c) for c in row] for row in m], object) for m in (x, q))
            # Rows that share their largest term lie together, so the maxima of a block are tight.
            lead = np.argmax(np.abs(x), axis=1)
            order = np.lexsort((ids, -x[np.arange(len(x)), lead].astype(float), lead))
            ids, x = ids[order], x[order]
            cuts = np.arange(0, len(ids), block_rows)
            most, least = np.maximum.reduceat(x, cuts, axis=0), np.minimum.reduceat(x, cuts, axis=0)
            bounds = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
            for own, query, bound in zip(qid, q, bounds):
                queue = np.argsort(-bound.astype(float), kind="stable")
                top_i, top_s, at, step = ids[:0], x[:0, 0], 0, 4
                while at < len(queue) and (len(top_i) < k or bound[queue[at]] >= top_s[-1]):
                    blocks = queue[at : at + step]
                    at, step = at + step, min(step * 2, 64)
                    if len(top_i) >= k:
                        blocks = blocks[bound[blocks] >= top_s[-1]]
                    rows = (cuts[blocks][:, None] + np.arange(block_rows)).ravel()
                    rows = rows[rows < len(ids)]
                    rows = rows[ids[rows] != own]
                    score = x[rows] @ query
                    top_i, top_s = np.concatenate([top_i, ids[rows]]), np.concatenate([top_s, score])
                    keep = best(top_i, top_s, k)
                    top_i, top_s = top_i[keep], top_s[keep]
                out_q += [int(own)] * len(top_i)
                out_v += top_i.tolist()
                out_s += [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in top_s]
        return out_q, None, out_v, out_s

    return search


def exact_topk(embeddings: DataFrame, every: int = 100, k: int = 10, factor: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): exact top k by inner product of floor(factor * component).

    A candidate block is cut into document ranges of BLOCK_ROWS rows with the largest and smallest
    value of every term. For a query the ranges are visited by descending summed term maxima
    (term minima where the query's term is negative) and scored through their forward rows until
    no remaining bound reaches the k-th score, so the result is exact, ties to the smaller vec_id.

    Vectors null, empty or with null or non-finite components take no part (zero vectors do), nor
    do rows without an id. Repeated rows count once; different lengths are not compared. Scaled components and scores
    beyond a 64-bit integer are held at its limits. Other columns are not read.
    """
    rows = usable(embeddings, True).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * factor).cast("double")))
    return grid_topk(rows, every, k, make_search(k), pa.int64())


def op7_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


ORACLE_OP7 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
