"""Operator 2: nearest neighbours by randomly rotated one-bit codes and reranking by error bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table
from .vectors import best, grid_topk, usable

SEED = 20240731
#: Components over this take no part in a centroid.
HUGE = 1e100


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    a = np.random.default_rng(seed + dim).standard_normal((dim, dim))
    q, r = np.linalg.qr(a)
    return q * np.sign(np.diag(r))


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms of rows; large components are scaled before they are squared."""
    most = np.abs(x).max(axis=1, initial=0)
    safe = np.where((most > 0) & np.isfinite(most), most, 1)
    return safe * np.sqrt(((x / safe[:, None]) ** 2).sum(1))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, packed sign bits, residual norms, alignments) of the rows of x.

    The code of a row is the signs of its rotated residual. Its alignment is the inner product of
    the unit residual with the unit vector of the code, the scalar that makes the estimate unbiased. The
    centroid is that of rows without components over HUGE, which would move it away from all others.
    """
    plain = np.abs(x).max(axis=1, initial=0) <= HUGE
    centre = x[plain].mean(0) if plain.any() else np.zeros(x.shape[1])
    r = x - centre
    norm = lengths(r)
    u = (r / np.where(norm > 0, norm, 1)[:, None]) @ turn
    align = np.abs(u).sum(1) / np.sqrt(x.shape[1])
    return centre, np.packbits(u > 0, axis=1), norm, np.where(norm > 0, align, 1)


def make_search(k: int, eps: float, chunk: int = 256):
    """search(query ids, queries, ids, vectors): k nearest of each query by estimate, bound and rerank.

    Where an estimate overflows nothing is known of the row, so it is reranked. Scores that overflow count as infinite.
    """

    def search(qid, q, ids, x):
        out_q, out_v, out_s = [], [], []
        if len(ids) and len(qid):
            dim = x.shape[1]
            turn = rotation(dim)
            with np.errstate(over="ignore", invalid="ignore"):
                centre, codes, norm, align = encode(x, turn)
                signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
                spread = norm * np.sqrt(np.maximum(1 - align**2, 0)) / align * (eps / np.sqrt(max(dim - 1, 1)))
                scale = norm / align
                rounding = 1e-12 * float(lengths(x).max(initial=0))
                for at in range(0, len(qid), chunk):
                    part = q[at : at + chunk]
                    size = lengths(part)
                    unit = part / np.where(size > 0, size, 1)[:, None]
                    guess = ((unit @ turn).astype(np.float32) @ signs.T).astype(np.float64) * scale * size[:, None] + (part @ centre)[:, None]
                    plain = np.isfinite(guess).all() and np.isfinite(spread.max(initial=0) * size.max(initial=0)) and np.isfinite(rounding * size.max(initial=0))
                    for i, (query, own) in enumerate(zip(part, qid[at : at + chunk])):
                        bound = spread * size[i] + 1e-5 * (np.abs(guess[i]) + 1)
                        low, high = guess[i] - bound, guess[i] + bound
                        if not plain:
                            low, high = np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)
                        mine = ids == own
                        low[mine], high[mine] = -np.inf, -np.inf
                        kth = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                        near = np.flatnonzero((high >= kth) & ~mine)
                        if plain and len(near) > 4 * k:  # a product tells what cannot be among the k; the rest is summed row by row, so that equal rows score alike
                            rough = x[near] @ query
                            near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - rounding * size[i]]
                        exact = (x[near] * query).sum(1)
                        if not plain:
                            exact = np.nan_to_num(exact, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                        top = near[b := best(ids[near], exact, k)]
                        out_q.append(np.full(len(top), own))
                        out_v.append(ids[top])
                        out_s.append(exact[b])
        cat = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        return cat(out_q, np.int64), None, cat(out_v, np.int64), cat(out_s, np.float64)

    return search


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, eps: float = 3.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for every query row.

    Each candidate block holds packed one-bit codes and two scalars a row. A query's inner products
    are estimated from the codes; rows whose upper bound reaches the k-th largest lower bound are
    reranked in double precision on the original vectors. `eps` is the bound in standard
    deviations of the estimate: at 3 a true neighbour is missed about once in a thousand.

    Vectors null, empty, zero or with null or non-finite components take no part, nor do rows
    without an id. Repeated rows count once. Vectors of different lengths are not compared. Ties go
    to the smaller vec_id. With fewer candidates than k all are returned; an empty table gives an
    empty result. Other columns are not read.
    """
    return grid_topk(usable(embeddings, False), every, k, make_search(k, eps), pa.float64())


def op2_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
